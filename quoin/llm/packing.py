"""Documents into containers of fixed capacity with as little unused space as possible.

Sizes are whole tokens, so however many documents there are, they fall into at most ``capacity`` sizes: the packing is worked
out on the histogram of sizes by bin completion. At each node the largest size left is put into a container and all
undominated fillings around it are enumerated, by rising waste and, of one waste, those of few large documents before those of
many small ones. A filling is applied as often as the counts allow, then half as often, down to once. Branches are pruned by
the waste they have made and the least number of containers the rest needs (the bound of Martello and Toth) against the
incumbent, at first the best-fit-decreasing packing. The search ends when the incumbent meets the bound of the whole, when all
branches are done, or after ``max_nodes`` fillings or MAX_STEPS steps of enumeration; it then gives the incumbent.
The result is a list of fillings with numbers of copies; the documents of each size are then dealt out to the places for that
size by their rank among documents of the size, which is a running number in the task plus an offset of the task.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.llm import bpe
from quoin.runtime import ship, written

#: Fillings applied, and steps of enumerating them, before the search stops with its incumbent.
MAX_NODES, MAX_STEPS = 50_000, 1_500_000
#: The bound of the rest is worked out at every so many nodes, as it costs more than a filling.
BOUND_EVERY = 16
#: Greatest capacity: bounds the histogram on the driver.
MAX_CAPACITY = 1 << 20


@dataclass
class Filling:
    items: tuple[tuple[int, int], ...]  # (size, how many in one container)
    copies: int


def waste_bound(counts: list[int], capacity: int) -> int:
    """Least number of containers: Martello and Toth's L2 over the histogram."""
    n = np.asarray(counts, np.int64)
    sizes = np.arange(len(n))
    cn, cs = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * sizes)]  # of sizes < i
    half = capacity // 2
    best = -(-int(cs[-1]) // capacity)
    for a in [0, *np.flatnonzero(n[: half + 1]).tolist()]:
        big = int(cn[capacity + 1] - cn[capacity - a + 1])
        mid_n, mid_s = int(cn[capacity - a + 1] - cn[half + 1]), int(cs[capacity - a + 1] - cs[half + 1])
        small = int(cs[half + 1] - cs[a])
        best = max(best, big + mid_n + max(0, -(-(small - (mid_n * capacity - mid_s)) // capacity)))
    return best


def best_fit(counts: list[int], capacity: int) -> list[Filling]:
    """Best-fit decreasing on the histogram: equal containers are handled together."""
    open_: dict[int, list[list]] = {}  # room -> [[items, copies]]
    rooms: list[int] = []
    for size in range(capacity, 0, -1):
        left = counts[size]
        while left:
            i = bisect.bisect_left(rooms, size)
            if i == len(rooms):
                each = capacity // size
                groups = [((size, each),), left // each] if left >= each else None
                if groups:
                    _open(open_, rooms, capacity - each * size, *groups)
                if left % each:
                    _open(open_, rooms, capacity - (left % each) * size, ((size, left % each),), 1)
                left = 0
                continue
            room = rooms[i]
            items, copies = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[i]
            each = min(room // size, left)
            used = min(copies, left // each)
            if used < copies:
                _open(open_, rooms, room, items, copies - used)
            _open(open_, rooms, room - each * size, (*items, (size, each)), used)
            left -= each * used
    return [Filling(items, copies) for group in open_.values() for items, copies in group]


def _open(open_: dict, rooms: list[int], room: int, items: tuple, copies: int) -> None:
    if room not in open_:
        open_[room] = []
        bisect.insort(rooms, room)
    open_[room].append([items, copies])


@dataclass
class _Stock:
    """The sizes left: counts, and a bit for each size there is."""

    counts: list[int]
    mask: int = 0
    total: int = 0

    def __post_init__(self):
        self.mask = sum(1 << s for s, c in enumerate(self.counts) if c)
        self.total = sum(s * c for s, c in enumerate(self.counts))

    def largest(self, most: int) -> int:
        return (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1

    def take(self, items: tuple, times: int) -> None:
        for s, k in items:
            self.counts[s] -= k * times
            self.total -= s * k * times
            if self.counts[s]:
                self.mask |= 1 << s
            else:
                self.mask &= ~(1 << s)


class _Budget:
    """Steps of enumeration that are left."""

    def __init__(self, steps: int):
        self.steps = steps


def _exact(stock: _Stock, total: int, most: int, budget: _Budget) -> Iterator[tuple[int, ...]]:
    """All multisets of the stock's sizes up to ``most`` that come to just ``total``, larger sizes first."""
    if total == 0:
        yield ()
        return
    a = stock.largest(min(total, most))
    while a > 0 and budget.steps > 0:
        budget.steps -= 1
        if stock.counts[a] > 0:
            stock.counts[a] -= 1  # lent while its completions are enumerated, but not while one is given out
            for rest in _exact(stock, total - a, a, budget):
                stock.counts[a] += 1
                yield (a, *rest)
                stock.counts[a] -= 1
            stock.counts[a] += 1
        a = stock.largest(a - 1)


def dominated(stock: _Stock, big: int, rest: tuple[int, ...], waste: int) -> bool:
    """Whether a document left over fits beside the filling's, or in place of one or two of them, which then are never needed."""
    used = Counter(rest)
    used[big] += 1
    t = stock.largest(waste)
    while t > 0:
        if stock.counts[t] > used[t]:
            return True
        t = stock.largest(t - 1)
    for i, x in enumerate(rest):
        for s in (x, *(x + y for y in rest[i + 1 :])):
            t = stock.largest(min(s + waste, len(stock.counts) - 2))
            if t > x and t >= s and (t > s or s > x) and stock.counts[t] > used[t]:
                return True
    return False


def fillings(stock: _Stock, capacity: int, most_waste: int | None = None, budget: _Budget | None = None) -> Iterator[tuple[int, tuple]]:
    """(waste, items) of all undominated fillings around the largest document, by rising waste up to ``most_waste``."""
    budget = budget or _Budget(MAX_STEPS)
    big = stock.largest(capacity)
    room = capacity - big
    for waste in range(0, min(room, room if most_waste is None else most_waste) + 1):
        stock.counts[big] -= 1
        for rest in _exact(stock, room - waste, room, budget):
            stock.counts[big] += 1
            if not dominated(stock, big, rest, waste):
                yield waste, tuple(sorted(Counter((big, *rest)).items(), reverse=True))
            stock.counts[big] -= 1
        stock.counts[big] += 1
        if budget.steps <= 0:
            return


@dataclass
class _Node:
    options: Iterator[tuple[int, tuple]]
    waste: int = 0
    now: tuple[int, tuple] | None = None
    times: int = 0
    applied: int = 0


def bin_completion(counts: list[int], capacity: int, max_nodes: int = MAX_NODES) -> list[Filling]:
    """Fillings that take all documents of the histogram (counts[size]), into as few containers as the search finds."""
    counts = list(counts) + [0] * (capacity + 2 - len(counts))
    total = sum(s * c for s, c in enumerate(counts))
    if not total:
        return []
    best = best_fit(counts, capacity)
    best_n, least = sum(f.copies for f in best), waste_bound(counts, capacity)
    stock, path, nodes, budget = _Stock(counts), [], 0, _Budget(MAX_STEPS)
    slack = lambda: (best_n - 1) * capacity - total  # noqa: E731  waste that a better packing may make
    stack = [_Node(fillings(stock, capacity, slack(), budget))] if best_n > least else []
    while stack and nodes < max_nodes and best_n > least:
        node = stack[-1]
        if node.applied:  # take back what was tried before
            stock.take(node.now[1], -node.applied)
            path.pop()
            node.applied, node.times = 0, node.times // 2
        if not node.times:
            node.now = next(node.options, None)
            if node.now is None or node.now[0] + node.waste > slack():
                stack.pop()
                continue
            waste, items = node.now
            node.times = min(stock.counts[s] // k for s, k in items)
            if waste:
                node.times = max(1, min(node.times, (slack() - node.waste) // waste))
        waste, items = node.now
        nodes += 1
        node.applied = node.times
        stock.take(items, node.times)
        path.append(Filling(items, node.times))
        made = node.waste + waste * node.times
        # the last container may stay part empty without that being waste that could be saved
        if stock.total and (made > slack() or nodes % BOUND_EVERY == 0 and sum(f.copies for f in path) + waste_bound(stock.counts, capacity) >= best_n):
            continue
        if not stock.total:
            n = sum(f.copies for f in path)
            if n < best_n:
                best, best_n = list(path), n
            continue
        if stock.total <= capacity:  # all that is left goes into one
            n = sum(f.copies for f in path) + 1
            if n < best_n:
                rest = tuple((s, c) for s, c in enumerate(stock.counts) if c and s)
                best, best_n = [*path, Filling(tuple(sorted(rest, reverse=True)), 1)], n
            continue
        stack.append(_Node(fillings(stock, capacity, slack() - made, budget), waste=made))
    return best


def places(fills: list[Filling], first: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """size -> (rank from, container from, places in each container), sorted by rank. Containers are numbered from ``first``."""
    at: dict[int, list] = {}
    rank: dict[int, int] = {}
    for f in fills:
        for size, k in f.items:
            start = rank.get(size, 0)
            at.setdefault(size, []).append((start, first, k))
            rank[size] = start + k * f.copies
        first += f.copies
    return {s: tuple(np.array(x, np.int64) for x in zip(*rows)) for s, rows in at.items()}


def token_counter(tokenizer: str, tokenizer_dir: str):
    """text -> number of tokens, for any of the public tokenizers."""
    if tokenizer.startswith("byte_bpe"):
        enc = bpe.encoder(f"{tokenizer_dir}/{tokenizer}.tiktoken")
        return lambda t: len(enc.packed(t)) // 4
    if tokenizer.startswith("piece_bpe"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=f"{tokenizer_dir}/{tokenizer}.model")
        return lambda t: len(sp.encode(t, num_threads=1))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(f"{tokenizer_dir}/{tokenizer}.json")
    tok.encode_special_tokens = True
    return lambda t: len(tok.encode(t, add_special_tokens=False).ids)


def _measure(specs: list[tuple[int, str, int]], tokenizer_dir: str):
    """(id, n of each spec, task, running number among items of the size in this task, whole containers before it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        count = {t: token_counter(t, tokenizer_dir) for t in {t for _, t, _ in specs}}
        seen = [[0] * (c + 1) for _, _, c in specs]
        whole = [0] * len(specs)
        for b in batches:
            ns, ranks, fulls = [], [], []
            for text in b.column(1).to_pylist():
                n = {t: f(text) if text else 0 for t, f in count.items()}
                row_n, row_r, row_f = [], [], []
                for j, (_, t, c) in enumerate(specs):
                    k = n[t]
                    rest = k if k <= c else k % c
                    row_n.append(k)
                    row_r.append(seen[j][rest])
                    seen[j][rest] += 1
                    row_f.append(whole[j])
                    if k > c:
                        whole[j] += k // c
                ns.append(row_n)
                ranks.append(row_r)
                fulls.append(row_f)
            kind = pa.list_(pa.field("element", pa.int64()))
            cols = [b.column(0), pa.array(ns, kind), pa.array(ranks, kind), pa.array(fulls, kind), pa.array(np.full(b.num_rows, task, np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "rank", "full", "task"])

    return run


def pack(docs: DataFrame, specs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str = bpe.TOKENIZER_DIR, max_nodes: int = MAX_NODES) -> DataFrame:
    """(spec_id, doc_id, piece_no, first_token, tokens, container_id) of every document and every spec.

    A document of more tokens than the capacity is cut into pieces of just the capacity, each a container of its own, and a
    rest that is packed like a document. Documents without tokens (null or empty text) take no space and come out once with
    0 tokens and a null container. Repeated rows and repeated ids are documents each. Specs with a null or a capacity below
    one are left out. No documents or no specs give no rows. Collected to the driver: the specs, and the histogram of at
    most ``capacity`` sizes a spec, whatever the number of documents.
    """
    spark = docs.sparkSession
    ship(spark)
    wanted = [(r[0], r[1], int(r[2])) for r in specs.select("spec_id", "tokenizer", "capacity").where("spec_id is not null and tokenizer is not null and capacity >= 1").distinct().orderBy("spec_id").collect()]
    if any(c > MAX_CAPACITY for _, _, c in wanted):
        raise ValueError(f"capacity above {MAX_CAPACITY}")
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("t"))
    kind = base.schema["doc_id"].dataType.simpleString()
    sizes = written(base.mapInArrow(_measure(wanted, tokenizer_dir), f"doc_id {kind}, n array<long>, rank array<long>, full array<long>, task long"), "sizes")
    capacity = F.element_at(F.array(*[F.lit(c) for _, _, c in wanted] or [F.lit(1)]), F.col("spec") + 1)
    items = sizes.select("doc_id", "task", F.posexplode(F.arrays_zip("n", "rank", "full")).alias("spec", "x")).select("doc_id", "task", "spec", "x.n", "x.rank", "x.full", capacity.alias("c"))
    items = items.withColumn("rest", F.when(F.col("n") <= F.col("c"), F.col("n")).otherwise(F.col("n") % F.col("c"))).withColumn("whole", F.when(F.col("n") > F.col("c"), F.floor(F.col("n") / F.col("c"))).otherwise(0))

    # offsets of the tasks, for each size and for the whole containers
    per_task = items.groupBy("spec", "rest", "task").agg(F.count("*").alias("m")).where("rest > 0")
    per_task = written(per_task, "size_counts")
    before = Window.partitionBy("spec", "rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("spec", "rest", "task", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    full_tasks = written(items.groupBy("spec", "task").agg(F.sum("whole").alias("w")), "full_counts")
    up_to = Window.partitionBy("spec").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    full_offsets = full_tasks.select("spec", "task", F.coalesce(F.sum("w").over(up_to), F.lit(0)).alias("full_base"))

    counts = [[0] * (c + 2) for _, _, c in wanted]
    for s, rest, m in per_task.groupBy("spec", "rest").agg(F.sum("m")).collect():
        counts[s][rest] = m
    fulls = {r[0]: int(r[1]) for r in full_tasks.groupBy("spec").agg(F.sum("w")).collect()}
    dealt = [places(bin_completion(c, wanted[j][2], max_nodes), fulls.get(j, 0)) for j, c in enumerate(counts)]
    spec_ids = [s for s, _, _ in wanted]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spec, rest, rank = (np.asarray(b.column(i)).astype(np.int64) for i in (1, 2, 3))
            out = np.zeros(b.num_rows, np.int64)
            order = np.lexsort((rest, spec))
            key = spec[order] * (MAX_CAPACITY + 1) + rest[order]
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else []
            for a, z in zip(cuts, cuts[1:]):
                rows = order[a:z]
                start, container, each = dealt[spec[rows[0]]].get(int(rest[rows[0]]), (np.zeros(1, np.int64),) * 3)
                i = np.searchsorted(start, rank[rows], "right") - 1
                out[rows] = container[i] + (rank[rows] - start[i]) // np.maximum(each[i], 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out), b.column(4), b.column(5)], names=["doc_id", "spec", "rest", "container_id", "whole", "full"])

    # the offsets grow with tasks times sizes, so they are shuffled to the documents and never broadcast
    joined = items.join(offsets.hint("merge"), ["spec", "rest", "task"], "left").join(full_offsets.hint("merge"), ["spec", "task"], "left")
    ranked = joined.select("doc_id", F.col("spec").cast("int").alias("spec"), "rest", (F.coalesce("base", F.lit(0)) + F.col("rank")).alias("rank"), F.col("whole").cast("long").alias("whole"), (F.coalesce("full_base", F.lit(0)) + F.col("full")).cast("long").alias("full"))
    packed = ranked.mapInArrow(deal, f"doc_id {kind}, spec int, rest long, container_id long, whole long, full long")
    cap = F.element_at(F.array(*[F.lit(c).cast("long") for _, _, c in wanted] or [F.lit(1).cast("long")]), F.col("spec") + 1)
    last = F.when((F.col("rest") > 0) | (F.col("whole") == 0), F.array(F.struct(F.col("whole").alias("piece_no"), F.col("rest").alias("tokens"), F.when(F.col("rest") > 0, F.col("container_id")).alias("container_id")))).otherwise(
        F.array().cast("array<struct<piece_no:bigint,tokens:bigint,container_id:bigint>>")
    )
    cut = F.when(F.col("whole") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1), lambda i: F.struct(i.alias("piece_no"), cap.alias("tokens"), (F.col("full") + i).alias("container_id")))).otherwise(
        F.array().cast("array<struct<piece_no:bigint,tokens:bigint,container_id:bigint>>")
    )
    sid = F.element_at(F.array(*[F.lit(s) for s in spec_ids] or [F.lit(0)]), F.col("spec") + 1)
    pieces = packed.select("doc_id", sid.alias("spec_id"), cap.alias("c"), F.explode(F.concat(cut, last)).alias("p"))
    return pieces.select("spec_id", "doc_id", F.col("p.piece_no").cast("int").alias("piece_no"), (F.col("p.piece_no") * F.col("c")).alias("first_token"), F.col("p.tokens").alias("tokens"), F.col("p.container_id").alias("container_id"))


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, container_id, items, tokens, capacity, unused) of every container; a container holds at most ``capacity`` items."""
    got = packed.where("container_id is not null").groupBy("spec_id", "container_id").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    caps = specs.select("spec_id", "capacity").distinct()
    return got.join(caps, "spec_id").select("spec_id", "container_id", "items", "tokens", "capacity", (F.col("capacity") - F.col("tokens")).alias("unused"))
