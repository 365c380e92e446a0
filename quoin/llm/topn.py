"""Top N rows of every group by a merge of sorted runs.

Every input partition is sorted by (group, score, ties) and cut to N rows a group: one *run*, which is stored with the number
of rows that its group still has from each row on. The runs are bucketed by a hash of the group, so many buckets that a merge
holds about ``BUCKET_ROWS`` rows however large the table is, and each bucket's runs are merged by a loser tree. As soon as N
rows of a group are out, every run seeks to its next group by the stored number, without looking at the rows between. A pass
merges at most ``fan_in`` runs at a time, so any number of runs is merged in ceil(log_fan_in(runs)) passes. A hot group costs
no more than any other: each run holds at most N of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.runtime import partitions_of, ship, shuffle_width, written

RUN, POS, LEFT, BUCKET = "__run", "__pos", "__left", "__bucket"
FAN_IN = 64
#: Rows of all runs that a merge holds, about: the number of buckets follows from it.
BUCKET_ROWS = 20_000


class LoserTree:
    """Tournament tree over k sorted sources; ``winner`` is the source with the least key, None keys come last."""

    def __init__(self, keys: list):
        self.k = len(keys)
        self.keys = keys
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i)

    def _less(self, a: int, b: int) -> bool:
        ka, kb = self.keys[a], self.keys[b]
        if ka is None:
            return False
        return kb is None or ka < kb

    def _replay(self, i: int) -> None:
        node, winner = (i + self.k) // 2, i
        while node > 0:
            held = self.tree[node]
            if held == -1:  # first visit while building: wait here for the opponent
                self.tree[node] = winner
                return
            if self._less(held, winner):
                self.tree[node], winner = winner, held
            node //= 2
        self.tree[0] = winner

    @property
    def winner(self) -> int:
        return self.tree[0]

    def advance(self, key) -> None:
        """The winner's source moves on to key."""
        i = self.tree[0]
        self.keys[i] = key
        node, winner = (i + self.k) // 2, i
        while node > 0:
            held = self.tree[node]
            if self._less(held, winner):
                self.tree[node], winner = winner, held
            node //= 2
        self.tree[0] = winner


class Run:
    """A sorted run from row ``at`` to row ``end`` of columns; rows are made when they are looked at."""

    def __init__(self, cols: list, left, at: int, end: int):
        self.cols, self.left, self.at, self.end, self.looked_at = cols, left, at, end, 0

    def key(self) -> tuple | None:
        if self.at >= self.end:
            return None
        self.looked_at += 1
        return tuple(c[self.at] for c in self.cols)

    def seek(self) -> None:
        """On to the first row of the next group."""
        self.at += self.left[self.at]


def merge_runs(runs: list[Run], n: int) -> Iterator[int]:
    """Merge sorted runs whose first column is the group: the numbers of at most n rows a group, in order."""
    if not runs:
        return
    tree = LoserTree([r.key() for r in runs])
    group, out = object(), 0
    while (key := tree.keys[w := tree.winner]) is not None:
        if key[0] != group:
            group, out = key[0], 0
        if out < n:
            yield runs[w].at
            out += 1
            runs[w].at += 1
        else:
            runs[w].seek()
        tree.advance(runs[w].key())


def _left(codes: np.ndarray) -> np.ndarray:
    """How many rows each row's group still has, itself included, in a sorted column."""
    new = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return np.repeat(np.r_[new[1:], len(codes)], np.diff(np.r_[new, len(codes)])) - np.arange(len(codes))


def _cut(n: int, out_schema: pa.Schema):
    """Rows of a sorted partition: keep the first n of each group; number them as one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run_no, pos, last, seen = TaskContext.get().partitionId(), 0, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(0).dictionary_encode()
            codes = np.asarray(g.indices)
            new = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            first = np.repeat(new, np.diff(np.r_[new, len(codes)]))
            rank = np.arange(len(codes)) - first
            if g.dictionary[int(codes[0])].as_py() == last:
                stop = new[1] if len(new) > 1 else len(codes)
                rank[:stop] += seen
            last, seen = g.dictionary[int(codes[-1])].as_py(), int(rank[-1]) + 1
            keep = rank < n
            t = b.filter(pa.array(keep))
            # a group that goes on in the next batch has two numbers in turn: a seek then takes two steps
            cols = [*t.columns, pa.array(np.full(t.num_rows, run_no, np.int32)), pa.array(np.arange(pos, pos + t.num_rows, dtype=np.int64)), pa.array(_left(codes[keep]).astype(np.int32))]
            pos += t.num_rows
            yield pa.RecordBatch.from_arrays(cols, schema=out_schema)

    return run


def _merge(n: int, fan: int, width: int, out_schema: pa.Schema):
    """Batches sorted by (bucket, run, pos): merge the runs of each bucket and group of runs."""

    def emit(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        runs_at = np.asarray(t.column(width))
        cols = _ordered([t.column(i).to_pylist() for i in range(width)])
        left = t.column(width + 2).to_pylist()
        new = np.flatnonzero(np.r_[True, runs_at[1:] != runs_at[:-1]]).tolist()
        take = pa.array(list(merge_runs([Run(cols, left, a, z) for a, z in zip(new, [*new[1:], len(left)])], n)), pa.int64())
        got = t.take(take)
        out = [got.column(i).combine_chunks() for i in range(width)]
        out = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in out]
        groups = np.asarray(out[0].dictionary_encode().indices) if got.num_rows else np.zeros(0, np.int64)
        out += [pa.array(np.full(got.num_rows, int(runs_at[0]) // fan, np.int32)), pa.array(np.arange(got.num_rows, dtype=np.int64)), pa.array(_left(groups).astype(np.int32) if got.num_rows else np.zeros(0, np.int32))]
        yield pa.RecordBatch.from_arrays(out, schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.asarray(b.column(width + 3)).astype(np.int64) * (1 << 32) + np.asarray(b.column(width)) // fan
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, z in zip(cuts, cuts[1:]):
                if held and key[a] != last:
                    yield from emit(held)
                    held = []
                held.append(b.slice(a, z - a))
                last = key[a]
        if held:
            yield from emit(held)

    return run


def _ordered(cols: list[list]) -> list[list]:
    """Group as it is; score falls; ties rise with nulls last."""
    group, score, *ties = cols
    return [group, [-s for s in score], *[[(x is None, x) if x is not None else (True, 0) for x in t] for t in ties]]


def top_n(df: DataFrame, group: str, score: str, ties: list[str], n: int, fan_in: int = FAN_IN) -> DataFrame:
    """The n rows of each group with the greatest score; ties go to the smaller values of the tie columns, in order.

    Returns the columns group, score and ties only; join them back by a key among the ties for more.
    Strings compare by code point. Rows with a null group or score take no part; null ties come after all others.
    Rows equal in all these columns count as rows. '' is a group. Groups with fewer rows give all of them; an empty
    table gives no rows; n < 1 gives no rows. Other columns of df are neither read nor able to clash.
    """
    spark = df.sparkSession
    ship(spark)
    names = [group, score, *ties]
    kept = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).where("c0 is not null and c1 is not null")
    order = [F.col("c0").asc(), F.col("c1").desc(), *[F.col(f"c{i}").asc_nulls_last() for i in range(2, len(names))]]
    schema = T.StructType([*kept.schema.fields, T.StructField(RUN, T.IntegerType()), T.StructField(POS, T.LongType()), T.StructField(LEFT, T.IntegerType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    runs = written(kept.sortWithinPartitions(*order).mapInArrow(_cut(max(n, 0), arrow), schema), "runs")
    left, width, tasks = partitions_of(kept), len(names), shuffle_width(spark)
    buckets = max(tasks, -(-runs.count() // BUCKET_ROWS))
    while True:
        runs = runs.withColumn(BUCKET, F.pmod(F.xxhash64("c0"), F.lit(buckets)).cast("int"))
        # a merge is of one bucket and of fan_in runs at most
        key = F.pmod(F.xxhash64(BUCKET, F.floor(F.col(RUN) / fan_in)), F.lit(1 << 30))
        runs = runs.repartition(tasks, key).sortWithinPartitions(BUCKET, F.floor(F.col(RUN) / fan_in), RUN, POS)
        runs = runs.mapInArrow(_merge(max(n, 0), fan_in, width, arrow), schema)
        left = -(-left // fan_in)
        if left <= 1:
            break
    return runs.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
