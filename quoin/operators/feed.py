"""Relational operators of the feed: fallback, top rows a source, two-key dedupe, recency, enrichment, health, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.catalog import ENRICH_MAX, PER_SOURCE
from quoin.functions import extract
from quoin.functions.predicates import good_preview, recent, valid_story
from quoin.functions.text import absolute_url, link_key, title_key
from quoin.runtime import drop_written, written

VALID = lambda: valid_story(F.col("title"), F.col("link"))


def plan_steps(sources: DataFrame) -> DataFrame:
    """(source_id, step_no, kind, arg, types) of every step of every plan."""
    return sources.select(F.col("id").alias("source_id"), F.posexplode("plan").alias("step_no", "s")).select("source_id", "step_no", "s.kind", "s.arg", "s.types")


def fallback(stories: DataFrame, steps: DataFrame, source: str = "sourceId", step: str = "step_no") -> DataFrame:
    """(source_id, winner, via, tried): the first step with valid stories, and each step tried up to it with its count.

    Sources none of whose steps has valid stories come out with a null winner and all steps tried; a source whose plan can't
    be run at all (``steps`` has none of it) comes out of ``with_unplanned`` with 'error'. Counts are made before any join, so a
    hot source costs one row a step.
    """
    n = stories.where(VALID()).groupBy(F.col(source).alias("source_id"), F.col(step).alias("step_no")).agg(F.count("*").alias("n"))
    each = steps.select("source_id", "step_no", "kind").join(n, ["source_id", "step_no"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    won = each.groupBy("source_id").agg(F.min(F.when(F.col("n") > 0, F.col("step_no"))).alias("winner"), F.array_sort(F.collect_list(F.struct("step_no", "kind", "n"))).alias("all"))
    tried = F.filter("all", lambda s: F.col("winner").isNull() | (s["step_no"] <= F.col("winner")))
    label = F.transform(tried, lambda s: F.concat(s["kind"], F.lit(":"), s["n"].cast("string")))
    via = F.try_element_at(F.transform(F.filter("all", lambda s: s["step_no"] == F.col("winner")), lambda s: s["kind"]), F.lit(1))
    return won.select("source_id", "winner", via.alias("via"), label.alias("tried"))


def with_unplanned(won: DataFrame, sources: DataFrame) -> DataFrame:
    """The fallback's rows and one for each source without a plan: nothing won, 'error' tried."""
    rest = sources.select(F.col("id").alias("source_id")).join(won.select("source_id"), "source_id", "left_anti")
    return won.unionByName(rest.select("source_id", F.lit(None).cast("int").alias("winner"), F.lit(None).cast("string").alias("via"), F.array(F.lit("error")).alias("tried")))


def newest_per_source(df: DataFrame, n: int = PER_SOURCE, source: str = "sourceId", ts: str = "timestamp", ties: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """The n newest rows of each source with their place (src_rank). Spark cuts each map task to n rows a source first."""
    w = Window.partitionBy(source).orderBy(F.col(ts).desc_nulls_last(), *ties)
    return df.withColumn("src_rank", F.row_number().over(w)).where(F.col("src_rank") <= n)


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """A global rank without one task that sees every row: range-partitioned, numbered in each partition, plus an offset."""
    parts = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() % F.lit(1 << 33)), "ranked")
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))  # one row a partition
    return parts.join(F.broadcast(before), "__p").withColumn(name, (F.col("__i") + F.col("__before") + 1).cast("long")).drop("__p", "__i", "__before")


def greedy_dedupe(df: DataFrame, order: str, source: str = "sourceId", title: str = "title", link: str = "link") -> DataFrame:
    """Rows in order, each kept unless an earlier *kept* row has its address key or its title key. Not two first-of-groups.

    order: a column of distinct, rising numbers. Rounds: keep what is first in both its key groups among the undecided, drop
    the undecided that share a key with a kept row, go on with the rest. Each round decides at least the first row left;
    texts with both keys alike are one row from the start, so a hot pair of keys costs one. A row without a link (null or
    empty) or without a title has no key of that kind: it is judged by the other one, and kept where it has neither.
    """
    no_key = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    k = F.when(~no_key(link), link_key(F.col(link)))
    t = F.when(~no_key(title), title_key(F.coalesce(source, F.lit("")), F.col(title)))
    keyed = df.select(F.col(order).alias("o"), k.alias("k"), t.alias("t"))
    left = written(keyed.where("k is not null or t is not null").groupBy("k", "t").agg(F.min("o").alias("o")), "undecided")
    rounds = [written(keyed.where("k is null and t is null").select("o", "k", "t"), "kept")]
    while not left.isEmpty():
        first = left
        for key in ("k", "t"):  # rows without a key stay out of its groups
            least = left.where(f"{key} is not null").groupBy(key).agg(F.min("o").alias(f"{key}_min"))
            first = first.where(f"{key} is not null").join(least, key).unionByName(first.where(f"{key} is null").withColumn(f"{key}_min", F.col("o")))
        now = written(first.where("o = k_min and o = t_min").select("o", "k", "t"), "kept")
        rounds.append(now)
        rest = left.join(now.where("k is not null").select("k"), "k", "left_anti").join(now.where("t is not null").select("t"), "t", "left_anti")
        rest = written(rest.join(now.select("o"), "o", "left_anti").select("k", "t", "o"), "undecided")
        drop_written(left)
        left = rest
    kept = rounds[0]
    for more in rounds[1:]:
        kept = kept.unionByName(more)
    return df.join(kept.select(F.col("o").alias(order)), order, "left_semi")


def with_previews(df: DataFrame, pages: DataFrame, order: str = "rank", most: int | None = ENRICH_MAX, link: str = "link", image: str = "image") -> DataFrame:
    """Stories without an image get their page's preview image; the first ``most`` such stories in order, or all with None."""
    need = df.where(F.col(image).isNull()).select(F.col(order).alias("__o"), F.col(link).alias("__l"))
    if most is not None:
        need = need.orderBy("__o").limit(most)
    url = absolute_url(extract.preview_image(F.col("html")))
    found = pages.where("html is not null").select(F.col("link").alias("__l"), url.alias("__u")).where(good_preview(F.col("__u"))).groupBy("__l").agg(F.min("__u").alias("__u"))
    got = need.join(found, "__l").select("__o", "__u")
    out = df.join(got, F.col(order) == F.col("__o"), "left")
    return out.withColumn(image, F.coalesce(image, "__u")).withColumn("imageVia", F.when(F.col("__u").isNotNull(), F.lit("og")).otherwise(F.col("imageVia") if "imageVia" in df.columns else F.lit(None))).drop("__o", "__u")


def source_health(sources: DataFrame, stories: DataFrame, won: DataFrame | None = None) -> DataFrame:
    """(source_id, via, tried, stories, with_image, with_short) of every source of the catalogue, zeros included."""
    has = lambda c: F.count_if(F.col(c).isNotNull() & (F.col(c) != ""))
    n = stories.groupBy(F.col("sourceId").alias("source_id")).agg(F.count("*").alias("stories"), has("image").alias("with_image"), has("short").alias("with_short"))
    out = sources.select(F.col("id").alias("source_id")).join(n, "source_id", "left")
    out = out.join(won.select("source_id", "via", "tried"), "source_id", "left") if won is not None else out.withColumn("via", F.lit(None).cast("string")).withColumn("tried", F.lit(None).cast("array<string>"))
    return out.select("source_id", "via", "tried", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("stories", "with_image", "with_short")])


def build_feed(stories: DataFrame, now_ms: int, ties: tuple[str, ...] = ("row_id",), n: int = PER_SOURCE) -> DataFrame:
    """Valid stories, the n newest a source, deduped by two keys in that order, recent ones only, with their rank.

    The order of the steps matters: a source is not refilled after dedupe, and age is looked at last.
    """
    top = newest_per_source(stories.where(VALID()).where("sourceId is not null"), n, ties=ties)
    seq = ranked(top, [F.col("sourceId"), F.col("src_rank")], "feed_no")
    kept = greedy_dedupe(seq, "feed_no").where(recent(F.col("timestamp"), now_ms))
    return ranked(kept, [F.desc("timestamp"), F.asc("feed_no")]).drop("feed_no", "src_rank")


def run_feed(stories: DataFrame, sources: DataFrame, pages: DataFrame, now_ms: int, ties: tuple[str, ...] = ("fetch_no", "pos")) -> tuple[DataFrame, DataFrame]:
    """(feed, health): the whole pipeline over parsed stories with ``step_no``.

    Each source's first step with valid stories is taken, then the feed is built of these, previews are looked up for the
    first stories without an image, and health is counted over what comes out, with what was tried.
    """
    won = written(with_unplanned(fallback(stories, plan_steps(sources)), sources), "won")
    chosen = stories.join(won.where("winner is not null").select(F.col("source_id").alias("sourceId"), F.col("winner").alias("step_no")), ["sourceId", "step_no"], "left_semi")
    feed = written(with_previews(build_feed(chosen, now_ms, ties), pages), "feed")
    return feed, source_health(sources, feed, won)


def first_seen(df: DataFrame, key, order: str) -> DataFrame:
    """The first row of each key in order; the winner is found by a pre-aggregated minimum, not by sorting groups."""
    first = df.groupBy(key.alias("__k")).agg(F.min(order).alias("__o"))
    return df.join(first.select("__o"), F.col(order) == F.col("__o"), "left_semi")
