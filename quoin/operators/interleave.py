"""Interleaving of a ranked list, over ranges dealt in parallel.

The next row of another source within the window comes first when the head's source was just dealt. Dealing is a machine with
a small state: the rows held back, all of one source but for the newest ones, and the source dealt last. So what a range does
is a table from the states it may begin with to the state it ends with. These tables are made for all ranges at once; states
soon agree, so most of a range is dealt once. The tables are chained on the driver, and each range is dealt again from the
state it really begins with. A range that begins with a state not foreseen is asked again with just that state.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from quoin.runtime import ship, written

State = tuple[tuple, object]  # (rows held back as (order, source), source dealt last)
CLEAN: State = ((), None)


def deal(state: State, row: tuple | None, window: int) -> tuple[State, tuple | None]:
    """The state after one row more (None: the deck is over), and the row that is dealt, if any."""
    pool, last = state
    if row is not None:
        pool = (*pool, row)
        if len(pool) < window:
            return (pool, last), None
    if not pool:
        return state, None
    pick = 0
    if pool[0][1] == last:
        pick = next((i for i in range(1, min(len(pool), window)) if pool[i][1] != last), 0)
    out = pool[pick]
    return ((*pool[:pick], *pool[pick + 1 :]), out[1]), out


def foreseen(context: list[tuple], window: int) -> list[State]:
    """The states that may hold after the last rows of a deck: up to window - 1 rows, the older of them of one source."""
    held = window - 1
    if len(context) <= held:
        return [(tuple(context), None)]
    out = []
    for k in range(held + 1):
        base = len(context) - (held - k)
        before, fresh = context[:base], tuple(context[base:])
        for s in {r[1] for r in before}:
            own = [r for r in before if r[1] == s]
            if len(own) >= k:
                other = next((r[1] for r in reversed(before) if r[1] != s), s)
                out += [((*own[len(own) - k :], *fresh), x) for x in {s, other}]
    return list(dict.fromkeys(out))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, object, tuple]]:
    """(range, deck, (order, source)) of rows sorted by range, deck and order."""
    for b in batches:
        for p, d, o, s in zip(*(b.column(i).to_pylist() for i in range(4))):
            yield p, d, (o, s)


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator]]:
    from itertools import groupby

    for p, group in groupby(_rows(batches), key=lambda r: r[0]):
        yield p, ((d, row) for _, d, row in group)


def _report(rows: list[tuple[int, object]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([pickle.dumps(r[1]) for r in rows], pa.binary())], names=["p", "what"])


def _ends(keep: int):
    """Of each range: its first and its last deck, the number of the last one's rows, whether it is the only one, its last rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for p, rows in _grouped(batches):
            first = deck = None
            n, tail, only, begun = 0, [], True, False
            for d, row in rows:
                if not begun or d != deck:
                    only = only and not begun
                    first = first if begun else d
                    deck, n, tail, begun = d, 0, [], True
                n += 1
                tail.append(row)
                if len(tail) > keep:
                    del tail[0]
            out.append((p, (first, deck, n, only, tail)))
        yield _report(out)

    return run


def _tables(entries: dict[int, list[State]], window: int):
    """Of each range: the state after it for each state it may begin with. Ranges not asked for are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for p, rows in _grouped(batches):
            if p not in entries:
                continue
            now: dict[State, list[int]] = {}
            for i, s in enumerate(entries[p]):
                now.setdefault(s, []).append(i)
            deck, begun = None, False
            for d, row in rows:
                if begun and d != deck:
                    now = {CLEAN: [i for at in now.values() for i in at]}
                deck, begun = d, True
                new: dict[State, list[int]] = {}
                for s, at in now.items():
                    new.setdefault(deal(s, row, window)[0], []).extend(at)
                now = new
            out.append((p, {i: s for s, at in now.items() for i in at}))
        yield _report(out)

    return run


def _dealt(begin: dict[int, tuple[State, int, bool]], window: int, out_schema: pa.Schema):
    """The rows of each range with their places, from the state it begins with; the deck is dealt out where it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out_schema)], schema=out_schema)

        for p, rows in _grouped(batches):
            state, place, over = begin[p]
            deck, begun = None, False

            def put(row: tuple | None) -> bool:
                nonlocal state, place
                state, got = deal(state, row, window)
                if got is not None:
                    out.append((deck, got[0], place))
                    place += 1
                return got is not None

            for d, row in rows:
                if begun and d != deck:
                    while put(None):
                        pass
                    state, place = CLEAN, 0
                deck, begun = d, True
                put(row)
                if len(out) >= 10_000:
                    yield flush()
            while over and put(None):
                pass
        yield flush()

    return run


def interleave(df: DataFrame, order: str, deck: str | None = None, source: str = "sourceId", window: int = 8) -> DataFrame:
    """The rows with ``place``: order as given, but the next row of another source within the window comes first when the
    head's source was just dealt. order: distinct numbers within a deck; null sources are one source.

    A deck may be of any length: it is dealt in ranges, each by a task of its own. To the driver come, for each range, its last
    rows (three windows of them) and its table of states. An empty table gives no rows.
    """
    spark = df.sparkSession
    ship(spark)
    base = df.select((F.col(deck) if deck else F.lit(0)).alias("d"), F.col(order).alias("o"), F.coalesce(source, F.lit("")).alias("s"))
    ranged = written(base.repartitionByRange("d", "o").select(F.spark_partition_id().alias("p"), "d", "o", "s"), "ranges")
    sorted_ = ranged.repartition("p").sortWithinPartitions("p", "d", "o")
    ask = lambda fn: {p: pickle.loads(w) for p, w in sorted_.mapInArrow(fn, "p int, what binary").collect()}
    ends = ask(_ends(3 * window))
    order_of = sorted(ends)
    entries: dict[int, list[State]] = {}
    contexts: dict[int, tuple[list, int]] = {}
    deck_now, tail, count = None, [], 0
    for i, p in enumerate(order_of):
        first, last, n, only, rows = ends[p]
        if i == 0 or first != deck_now:
            tail, count = [], 0
        contexts[p] = (tail, count)
        entries[p] = foreseen(tail, window)
        tail, count = ((tail + rows)[-3 * window :], count + n) if only else (rows, n)
        deck_now = last
    tables = ask(_tables(entries, window))
    begin: dict[int, tuple[State, int, bool]] = {}
    state = CLEAN
    for i, p in enumerate(order_of):
        if not contexts[p][1]:
            state = CLEAN
        if state not in entries[p]:
            entries[p] = [state]
            tables[p] = ask(_tables({p: [state]}, window))[p]
        over = i + 1 == len(order_of) or ends[order_of[i + 1]][0] != ends[p][1]
        begin[p] = (state, contexts[p][1] - len(state[0]), over)
        state = tables[p][entries[p].index(state)]
    schema = StructType([base.schema["d"], base.schema["o"], StructField("place", LongType())])
    dealt = sorted_.mapInArrow(_dealt(begin, window, to_arrow_schema(schema)), schema)
    on = (F.col(order) == F.col("__o")) & (F.col(deck).eqNullSafe(F.col("__d")) if deck else F.lit(True))
    return df.join(dealt.select(F.col("d").alias("__d"), F.col("o").alias("__o"), "place"), on).drop("__d", "__o")
