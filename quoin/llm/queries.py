"""Queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quoin.llm.bpe import encode_corpus
from quoin.llm.history import first_rows
from quoin.llm.language import languages, mislabelled, passages
from quoin.llm.mojibake import garbled_values, restored_values
from quoin.llm.packing import fill, pack
from quoin.llm.residue import residue_values, without_residue
from quoin.llm.topn import top_n
from quoin.llm.truncation import cut_shares, cut_values
from quoin.runtime import table

PER_SOURCE = 12


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_values(table(spark, sf_dir, "story"))


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored_values(table(spark, sf_dir, "story"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_rows(table(spark, sf_dir, "story"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    story = table(spark, sf_dir, "story")
    return top_n(story, "sourceId", "timestamp", ["id", "row_id"], PER_SOURCE).select("sourceId", "row_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_values(table(spark, sf_dir, "story"))


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_residue(table(spark, sf_dir, "story"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_values(*(table(spark, sf_dir, t) for t in ("story", "documents", "lang_codes")))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_shares(*(table(spark, sf_dir, t) for t in ("story", "documents", "lang_codes")))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_spec"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill(p7_containers(spark, sf_dir), table(spark, sf_dir, "container_spec"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mislabelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_codes"))


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_codes"))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_codes"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_restored": p1_restored,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_kept": p4_kept,
    "p5_found": p5_found,
    "p5_shares": p5_shares,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_passages": p8_passages,
    "p8_documents": p8_documents,
}

ORACLE_SQL: dict[str, str] = {
    "p3_found": """
        select sourceId, row_id
        from (select sourceId, row_id, row_number() over (
                partition by sourceId order by "timestamp" desc, id asc nulls last, row_id asc) as rn
              from story where sourceId is not null and "timestamp" is not null)
        where rn <= 12""",
}
