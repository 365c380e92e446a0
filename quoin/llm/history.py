"""Duplicates of new rows against everything accepted before, by a table of distances to fixed pivots.

An address is first brought to one form (redirects unwrapped, host, path and query normalised). Rows with one form are one
article. What is left are slips inside the slug. The metric is Levenshtein's distance over classes of letters; the pivots are
runs of one class, longer than any slug: the distance of x to such a run is the run's length less the number of letters of
the class in x, so a table of counts is the table of distances. By the triangle inequality a pair within two slips differs by
two in all pivot distances together at most, and distances are whole numbers: of three disjoint groups of pivots one is the
same on both sides. A lost short word would change many distances, so words below a length are left out of two more tables,
with one slip left for them: there one of two groups of pivots is the same. Equal groups are found by equi-joins on keys;
the sum of differences, Levenshtein's distance and the kind of slip then decide.

The history is a table bucketed and sorted by key: a batch is shuffled to the buckets, what is stored is only scanned in
place, and the batch's new entries are appended. Links between articles are appended as well and resolved when asked for, so
any division into batches gives the same articles.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.runtime import drop_written, make_dir, scratch_path, ship, shuffle_width, written

#: Query parameters that never tell articles apart: a fixed list of public tracking parameters.
TRACKING = r"utm_\w*|\w*clid|mc_[ce]id|cmpid|igshid|xtor|spm|phpsessid|jsessionid|_ga|hss_\w*|mkt_tok"
#: Parameters that say where a link was placed or how it is shown, if their value is a plain word: fixed values.
SHOWN = r"(?:ref|ref_\w*|source|src|from|share|via|output|print|amp)(?:=(?:[a-z_-]*|1))?"
#: Number of pivots, and the groups of them that are compared: letters are dealt out so that groups are about equally full.
PIVOTS, BANDS, HALVES = 36, ("aoldpx059kz", "einscfq16jyv", "rtumhbgw23478"), ("eadrcumfgvqz13579", "toinshlpbykxjw02468")
#: Slips looked for, the longest word that may be lost, and what two of them come to in letters and in Levenshtein's distance.
SLIPS, SHORT = 2, 4
GAP, RADIUS = SLIPS * SHORT, SLIPS * (SHORT + 1)
#: Keys of a batch a bucket up to which they are held in memory.
HELD = 200_000


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")), c)


def address_columns(link: Column) -> list[tuple[str, Column]]:
    """Steps to the address's one form, each to be added after the ones before it."""
    bare = F.regexp_replace(link, r"^[\s\x00-\x20\x{A0}\x{FEFF}\x{200B}]+|[\s\x00-\x20\x{A0}\x{FEFF}\x{200B}]+$", "")
    host = r"^(?i:[a-z][a-z0-9+.-]*:)?/*([^/?#]*)"
    plain = lambda c: F.replace(F.replace(c, F.lit("&amp;"), F.lit("&")), F.lit("&#38;"), F.lit("&"))
    steps = [("u0", plain(bare))]
    for i in (1, 2):  # a redirect may hold another
        outer, inner = F.col(f"u{i - 1}"), F.col(f"inner{i}")
        steps.append((f"inner{i}", _decode(F.regexp_extract(outer, r"(?i)[?&;][a-z_]+=(https?(?::|%3a)(?:/|%2f){2}[^&#\s]+)", 1))))
        away = (inner != "") & (F.lower(F.regexp_extract(inner, host, 1)) != F.lower(F.regexp_extract(outer, host, 1)))
        steps.append((f"u{i}", plain(F.when(away, inner).otherwise(outer))))
    steps.append(("s", F.lower(F.regexp_replace(_decode(_decode(F.col("u2"))), r"#.*$", ""))))
    steps.append(("s2", F.regexp_replace("s", r"^(?:[a-z][a-z0-9+.-]*:)?/*(?:[^/?#@]*@)?", "")))
    steps.append(("host", F.regexp_replace(F.regexp_replace(F.regexp_extract("s2", r"^([^/?]*)", 1), r"\.?(?::\d*)?$", ""), r"^(?:(?:www\d?|m|amp|mobile)\.)+", "")))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract("s2", r"^[^/?]*([^?]*)", 1), r";[^/]*", ""), r"/+", "/")
    steps.append(("path", F.regexp_replace(path, r"(?:/(?:amp|index\.(?:html?|php)))*/?$", "")))
    params = F.filter(F.split(F.regexp_extract("s2", r"^[^?]*\?(.*)$", 1), "[?&;]"), lambda p: (p != "") & ~p.rlike(rf"^(?:{TRACKING})(?:=|$)|^{SHOWN}$"))
    steps.append(("query", F.array_join(F.array_sort(F.array_distinct(params)), "&")))
    # an article's number, which a day or a month of an archive is not
    dates = r"(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])?/"
    steps.append(("number", F.regexp_extract("path", rf"^/(?:[^/]+/)*?(?!{dates})(?!{dates[:-1]}$)(\d{{5,}})(?:/[^/]*)?$", 1)))
    asked = F.when(F.col("query") != "", F.concat(F.lit("?"), F.col("query"))).otherwise(F.lit(""))
    steps.append(("address", F.when(F.col("number") != "", F.concat("host", F.lit("/#"), "number")).otherwise(F.concat("host", "path", asked))))
    return steps


_ROMAN = r"(?:ii|iii|iv|vi{0,3}|ix|xi{0,3})"


def addresses(rows: DataFrame, id_col: str, link_col: str, *more: Column) -> DataFrame:
    """(row_id, address, place, slug): rows without a link are left out; place and slug are null where there is no slug."""
    df = rows.select(F.col(f"`{id_col}`").alias("row_id"), F.col(f"`{link_col}`").alias("link"), *more)
    extra = df.columns[2:]
    for name, c in address_columns(F.col("link")):
        df = df.withColumn(name, c)
    df = df.where("address is not null and address <> ''")
    slug = F.regexp_extract("path", r"/([^/]*)$", 1)
    numbers = F.array_join(F.filter(F.split(slug, r"[-_.]+"), lambda t: t.rlike(rf"\d|^{_ROMAN}$")), "-")
    place = F.concat_ws("|", "host", F.regexp_extract("path", r"^(.*)/[^/]*$", 1), numbers)
    has = (F.col("number") == "") & (F.col("query") == "") & slug.rlike(r"[^-_.][-_.]+[^-_.]")
    return df.select("row_id", "address", F.when(has, place).alias("place"), F.when(has, slug).alias("slug"), *extra)


_WORD_BREAK = np.zeros(128, bool)
_WORD_BREAK[[ord(c) for c in "-_."]] = True
_CLASS = np.full(128, PIVOTS - 1, np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789"):
    _CLASS[ord(_c)] = _i
_MIX = np.random.default_rng(7).integers(1, 1 << 63, (7, PIVOTS), dtype=np.uint64) | np.uint64(1)


def _members(groups: tuple[str, ...]) -> np.ndarray:
    return np.array([[any(_CLASS[ord(c)] == k for c in g) for k in range(PIVOTS)] for g in groups])


_BAND, _HALF = _members(BANDS), _members(HALVES)


def letter_counts(words: list[str]) -> np.ndarray:
    """Numbers of letters by class: the pivot distances, but for the length of the pivots."""
    out = np.zeros(PIVOTS, np.int64)
    for c in "".join(words):
        k = ord(c)
        out[_CLASS[k] if k < 128 else k * 40503 % 65536 % PIVOTS] += 1
    return out


def _group_keys(counts: np.ndarray, groups: np.ndarray, tag: int) -> np.ndarray:
    """One number for each group of pivots: equal where all its distances are."""
    c = counts.astype(np.uint64)
    return np.stack([(c * (_MIX[tag + g] * members)).sum(-1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tag + g) for g, members in enumerate(groups.astype(np.uint64))], -1)


def _without_long(slug: str) -> list[int]:
    """Keys of a slug of short words: all it may be with up to two of them lost, by halves as a slip may be left."""
    words = [w for w in re.split(r"[-_.]+", slug) if w]
    at = [i for i, w in enumerate(words[:-1]) if len(w) <= SHORT]
    out: set[int] = set()
    for lost in [(), *((i,) for i in at), *combinations(at, 2)]:
        counts = letter_counts([w for i, w in enumerate(words) if i not in lost])
        out.update(_group_keys(counts[None], _HALF, 5)[0].tolist())
    return [*out]


def _pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the pivot distances and the keys of all slugs of a batch at once."""
    for b in batches:
        given = b.column(2).to_pylist()
        slugs = [x or "" for x in given]
        chars = np.frombuffer("\0".join([*slugs, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        low = chars < 128
        breaks = low & _WORD_BREAK[chars * low]
        over = chars == 0
        row = np.cumsum(over) - over
        inner = ~(breaks | over)
        starts = inner & ~np.r_[False, inner[:-1]]
        word = np.cumsum(starts) - 1
        length = np.bincount(word[inner], minlength=max(1, int(starts.sum())))
        cls = np.where(low, _CLASS[chars * low], chars * 40503 % 65536 % PIVOTS)

        def counts(keep: np.ndarray) -> np.ndarray:
            return np.bincount(row[keep] * PIVOTS + cls[keep], minlength=len(slugs) * PIVOTS).reshape(-1, PIVOTS)

        all_ = counts(inner)
        size = np.zeros(len(chars), np.int64)
        size[inner] = length[word[inner]]
        parts = [_group_keys(all_, _BAND, 0)]
        some = [np.ones((len(slugs), 3), bool)]
        for least, tag in ((SHORT + 1, 3), (SHORT + 2, 5)):  # one letter lost or added moves a word over one of these at most
            long_ = counts(size >= least)
            parts.append(_group_keys(long_, _HALF, tag) + np.uint64(11 * tag))
            some.append(np.repeat((long_.sum(1) > 0)[:, None], 2, 1))
        keys, has = np.concatenate(parts, 1), np.concatenate(some, 1)
        place = np.asarray(b.column(1)).astype(np.int64).view(np.uint64) if b.column(1).null_count == 0 else np.zeros(len(slugs), np.uint64)
        lists = []
        for i, (slug, ks, h) in enumerate(zip(given, (keys + place[:, None]).view(np.int64).tolist(), has.tolist())):
            got = [k for k, y in zip(ks, h) if y] if slug else []
            if slug and not h[5]:
                got += [(k + int(place[i])) % (1 << 64) - (1 << 64 if (k + int(place[i])) % (1 << 64) >> 63 else 0) for k in _without_long(slug)]
            lists.append(got)
        flat = pa.array(np.minimum(all_, 127).astype(np.int8).ravel())
        vector = pa.ListArray.from_arrays(pa.array(np.arange(len(slugs) + 1, dtype=np.int32) * PIVOTS), flat)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), vector, pa.array(lists, pa.list_(pa.int64())), b.column(3)], names=["row_id", "slug", "counts", "keys", "address"])


def with_pivots(entries: DataFrame) -> DataFrame:
    """(row_id, slug, counts, keys, address) of every entry: its pivot distances and the keys under which it is found, none without a slug."""
    kind = entries.schema["row_id"].dataType.simpleString()
    base = entries.select("row_id", F.xxhash64("place").alias("p"), F.when(F.col("place").isNotNull(), F.col("slug")), "address")
    return base.mapInArrow(_pivots, f"row_id {kind}, slug string, counts array<tinyint>, keys array<bigint>, address string")


def slip(a: str, b: str) -> bool:
    """Whether b is the word a with one letter inside doubled, added or lost, or two neighbours swapped."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) < 4 or len(a) < 3 or any(c.isdigit() for c in a + b):
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(b) - len(a) == 1:
        return 0 < i and a[i:] == b[i + 1 :] and (i < len(a) or b[-1] == b[-2])
    return len(a) == len(b) and a != b and i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :]


def same_slug(a: str, b: str, most: int = 2) -> bool:
    """Whether two slugs differ by at most ``most`` slips or lost words of up to four letters, not the last. Words with figures and numerals must agree."""
    x, y = re.split(r"[-_.]+", a), re.split(r"[-_.]+", b)
    if abs(len(x) - len(y)) > most:
        return False
    drop = lambda t: 0 if not t else 1 if len(t) <= SHORT and t.isalpha() and not re.fullmatch(_ROMAN, t) else 99
    if x[-1] != y[-1] and not slip(x[-1], y[-1]):
        return False  # another word at the end tells articles apart
    row = [0]
    for t in y:
        row.append(row[-1] + drop(t))
    for t in x:
        new = [row[0] + drop(t)]
        for j, u in enumerate(y):
            change = 0 if t == u else 1 if slip(t, u) else 99
            new.append(min(row[j] + change, row[j + 1] + drop(t), new[j] + drop(u)))
        row = new
        if min(row) > most:
            return False
    return row[-1] <= most


@F.pandas_udf(T.BooleanType())
def _same_slug(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_slug(x, y) for x, y in zip(a, b)], dtype=bool)


def verified(pairs: DataFrame) -> DataFrame:
    """(a, b) of candidates (a, b, x, y, x_counts, y_counts) by the sum over the pivots, the metric and the kind of slip."""
    gap = F.aggregate(F.zip_with("x_counts", "y_counts", lambda p, q: F.abs(p.cast("int") - q.cast("int"))), F.lit(0), lambda s, v: s + v)
    close = pairs.where("x <> y").where(gap <= GAP).where(F.levenshtein("x", "y", RADIUS) >= 0)
    return close.select("a", "b", "x", "y").distinct().where(_same_slug("x", "y")).select("a", "b")


def near_pairs(entries: DataFrame) -> DataFrame:
    """(a, b) with a > b: pairs of (row_id, slug, counts, keys) whose slugs are one slug with slips. Only keys are shuffled."""
    keyed = entries.select("row_id", F.explode("keys").alias("key"))
    x, y = keyed.withColumnRenamed("row_id", "a"), keyed.withColumnRenamed("row_id", "b")
    pairs = x.join(y, "key").where("a > b").select("a", "b").distinct()
    text = lambda r, t: entries.select(F.col("row_id").alias(r), F.col("slug").alias(t), F.col("counts").alias(f"{t}_counts"))
    return verified(pairs.join(text("a", "x"), "a").join(text("b", "y"), "b"))


def entries_of(addr: DataFrame) -> DataFrame:
    """One entry an address, kept by its smallest row_id: what the history stores."""
    return addr.groupBy("address").agg(F.min("row_id").alias("row_id"), F.min(F.struct("slug", "place")).alias("s")).select("address", "row_id", "s.place", "s.slug")


def least_labels(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component. Labels spread and jump until nothing changes."""
    both = written(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = table = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        spread = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = (
            labels.join(spread, "node").join(jump, "label", "left")
            .select("node", F.least("label", "least", F.coalesce("root", "label")).alias("new"), "label")
        )
        new = written(new, "labels")
        changed = new.where("new < label").limit(1).count()
        drop_written(table)
        table, labels = new, new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


class History:
    """The accepted entries with their pivot distances: a table bucketed and sorted by key, and the links between them.

    A batch costs a shuffle of its own keys to the buckets and a scan of the columns joined with; nothing stored is shuffled
    or computed again. ``buckets`` is to grow with the history, as each is read by one task. A batch that is tried again
    after a failure finds its own entries and adds none twice.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.path, self.buckets, self.id_type = spark, path.rstrip("/"), buckets or shuffle_width(spark), id_type
        self.name = "quoin_history_" + uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex
        make_dir(spark, f"{self.path}/links")
        self.spark.sql(
            f"create table if not exists {self.name} (key bigint, kind tinyint, row_id {id_type}, text string, counts array<tinyint>) using parquet "
            f"clustered by (key) sorted by (key) into {self.buckets} buckets location '{self.path}/entries'"
        )

    def _links(self) -> DataFrame:
        return self.spark.read.schema(f"a {self.id_type}, b {self.id_type}").parquet(f"{self.path}/links")

    def close(self) -> None:
        """Forget the name; what is stored stays."""
        self.spark.sql(f"drop table if exists {self.name}")

    def accept(self, addr: DataFrame, empty: bool = False) -> DataFrame:
        """Take in a batch (row_id, address, place, slug): its new addresses are appended, its links to old ones kept.

        Returns (address, row_id) of those of its addresses that are known already. ``empty`` says that nothing is stored yet.
        """
        entries = written(with_pivots(entries_of(addr)), "batch_entries")
        none = F.lit(None).cast("array<tinyint>")
        keyed = entries.select(F.xxhash64("address").alias("key"), F.lit(0).cast("tinyint").alias("kind"), "row_id", F.col("address").alias("text"), none.alias("counts"))
        keyed = keyed.union(entries.select(F.explode("keys").alias("key"), F.lit(1).cast("tinyint").alias("kind"), "row_id", F.col("slug").alias("text"), "counts"))
        links = near_pairs(entries)
        known = entries.select("address", "row_id").limit(0)
        if not empty:
            mine = keyed.select("key", F.col("kind").alias("mine"), F.col("row_id").alias("a"), F.col("text").alias("x"), F.col("counts").alias("x_counts"))
            if entries.count() * 9 <= HELD * self.buckets:
                mine = mine.hint("shuffle_hash")
            stored = self.spark.table(self.name).select("key", "kind", F.col("row_id").alias("b"), F.col("text").alias("y"), F.col("counts").alias("y_counts"))
            # a join by more than the key would shuffle what is stored
            met = written(stored.join(mine, "key").where("kind = 1 and mine = 1 and x <> y or kind = 0 and mine = 0 and x = y").drop("key", "mine"), "batch_met")
            known = met.where("kind = 0").select(F.col("x").alias("address"), F.col("b").alias("row_id")).distinct()
            links = links.union(verified(met.where("kind = 1")))
        links.write.mode("append").parquet(f"{self.path}/links")
        new = keyed if empty else keyed.join(met.where("kind = 0").select(F.col("a").alias("row_id")).distinct(), "row_id", "left_anti")
        new.select("key", "kind", "row_id", "text", "counts").repartition(self.buckets, "key").write.mode("append").insertInto(self.name)
        return known

    def articles(self) -> DataFrame:
        """(address, article) of all that was accepted: addresses that links join, whenever they came in, are one article."""
        at = self.spark.table(self.name).where("kind = 0").select(F.col("text").alias("address"), F.col("row_id").alias("node"))
        return at.join(least_labels(self._links()), "node", "left").select("address", F.coalesce("label", "node").alias("article"))

    def probe(self, rows: DataFrame, id_col: str = "row_id", link_col: str = "link") -> DataFrame:
        """(first_row_id, row_id) of the batch's rows that are known already; the batch's new articles are accepted.

        A row that shows two articles to be one is told by ``articles`` from then on; answers already given out stand.
        """
        addr = written(addresses(rows, id_col, link_col), "batch")
        self.accept(addr)
        out = addr.select("row_id", "address").join(self.articles(), "address").where("article < row_id")
        return out.select(F.col("article").alias("first_row_id"), "row_id").distinct()


def first_rows(rows: DataFrame, id_col: str = "row_id", link_col: str = "link", batch_col: str | None = "batch_no") -> DataFrame:
    """(first_row_id, row_id) of every row whose link leads to an article that a row with a smaller id brought in.

    The batches go through ``History`` one after the other, in the order of ``batch_col`` (rows without a number come first;
    None takes all rows as one batch); links that a later batch shows between earlier articles count too. Rows with a
    null, empty or blank link are no case. Repeated rows with one id give one row. Slips chain: what is one article with the
    first row is one with it. An empty table gives no rows. Only the named columns are read, so other columns can't clash.
    """
    ship(rows.sparkSession)
    spark = rows.sparkSession
    batch = F.coalesce(F.col(f"`{batch_col}`").cast("long"), F.lit(-1)) if batch_col else F.lit(0).cast("long")
    addr = written(addresses(rows, id_col, link_col, batch.alias("batch")), "addresses", by=["batch"])
    history = History(spark, scratch_path(spark, "history"), id_type=addr.schema["row_id"].dataType.simpleString())
    for i, b in enumerate(sorted(r[0] for r in addr.select("batch").distinct().collect())):  # one number a batch
        history.accept(addr.where(F.col("batch") == b), empty=i == 0)
    least = addr.groupBy("address").agg(F.min("row_id").alias("least"), F.count("*").alias("n"))
    m = written(least.join(history.articles(), "address"), "articles")
    first = m.groupBy("article").agg(F.min("least").alias("first_row_id"), F.sum("n").alias("of")).where("of > 1")
    shared = m.join(first, "article").select("address", "first_row_id")
    out = addr.select("row_id", "address").join(shared, "address").where("first_row_id < row_id")
    return out.select("first_row_id", "row_id").distinct()
