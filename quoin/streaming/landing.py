"""Landed answers as a stream: each micro-batch is parsed like a batch and appended; a restart goes on at the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.operators.feed import VALID
from quoin.sources.landing import parse

LANDING_SCHEMA = "source_id string, step_no int, kind string, url string, url_no int, body string, fetch_no long, status int"


def stories_from(spark: SparkSession, landing_dir: str, sources: DataFrame, out_dir: str, checkpoint_dir: str, now_ms: int, available_now: bool = True):
    """Start the query: new parquet files of landing_dir become valid stories under out_dir, by the number of their batch.

    A batch is written under its number, over what a failed try of it may have left, so each answer counts once.
    """

    def batch(df: DataFrame, number: int) -> None:
        parse(df, sources, now_ms).where(VALID()).withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{out_dir}/batch_no={number}")

    q = spark.readStream.schema(LANDING_SCHEMA).parquet(landing_dir).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_dir)
    return (q.trigger(availableNow=True) if available_now else q).start()
