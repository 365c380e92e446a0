"""Outputs: the feed document and its summary, and outboxes in place of sent mail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.catalog import CACHE_LEAST
from quoin.functions.text import iso_ms


def cache_policy(count) -> F.Column:
    return F.when(count >= CACHE_LEAST, "s-maxage=600, stale-while-revalidate=3600").otherwise("no-store")


def feed_summary(stories: DataFrame, health: DataFrame, now_ms: int, version: int = 7) -> DataFrame:
    """One row: count, counts and health by source, cache policy. The maps hold one entry a source of the catalogue."""
    by = health.agg(F.map_from_entries(F.collect_list(F.struct("source_id", "stories"))).alias("sources"), F.map_from_entries(F.collect_list(F.struct("source_id", F.struct("via", "tried", "stories", "with_image", "with_short")))).alias("health"))
    n = stories.agg(F.count("*").alias("count"))
    return n.crossJoin(by).select(F.lit(True).alias("success"), F.lit(version).alias("version"), "count", "sources", "health", iso_ms(F.lit(now_ms)).alias("updatedAt"), cache_policy(F.col("count")).alias("cache_control"))


def health_document(summary: DataFrame) -> DataFrame:
    """(version, count, updatedAt, health): what is given out when only health is asked for."""
    return summary.select("version", "count", "updatedAt", "health")


def error_document(spark: SparkSession, message: str) -> DataFrame:
    """What stands in for a feed that could not be built: one row without stories."""
    return spark.range(1).select(F.lit(False).alias("success"), F.lit(message).alias("error"), F.lit(0).cast("long").alias("count"))


def story_json(stories: DataFrame, rank: str = "rank") -> DataFrame:
    """(rank, json): one line a story, so that a feed of any size is written in parallel and in order."""
    cols = [c for c in stories.columns if c != rank]
    return stories.select(rank, F.to_json(F.struct(*cols)).alias("json"))


def write_feed(stories: DataFrame, summary: DataFrame, path: str) -> None:
    """The stories as JSON lines ordered by rank, the summary beside them."""
    stories.repartitionByRange("rank").sortWithinPartitions("rank").write.mode("overwrite").json(f"{path}/stories")
    summary.write.mode("overwrite").json(f"{path}/summary")
