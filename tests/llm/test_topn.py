import random

from quoin.llm.topn import LoserTree, Run, merge_runs, top_n

SCHEMA = "sourceId string, timestamp long, id string, row_id long, c0 string"


def brute(rows, n):
    out = []
    for g in {r[0] for r in rows if r[0] is not None}:
        mine = [r for r in rows if r[0] == g and r[1] is not None]
        mine.sort(key=lambda r: (-r[1], (r[2] is None, r[2] or ""), (r[3] is None, r[3] or 0)))
        out += [(r[0], r[3]) for r in mine[:n]]
    return sorted(out, key=str)


def test_loser_tree_sorts():
    rng = random.Random(1)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(k)]
        its = [iter(r) for r in runs]
        tree = LoserTree([next(i, None) for i in its])
        got = []
        while tree.keys[tree.winner] is not None:
            got.append(tree.keys[tree.winner])
            tree.advance(next(its[tree.winner], None))
        assert got == sorted(sum(runs, []))


def as_runs(lists):
    rows = [r for x in lists for r in sorted(x)]
    cols = [list(c) for c in zip(*rows)]
    out, at = [], 0
    left = [sum(1 for r in x if r[0] == g) - i for x in lists for g in sorted({r[0] for r in x}) for i in range(sum(1 for r in x if r[0] == g))]
    for x in lists:
        out.append(Run(cols, left, at, at + len(x)))
        at += len(x)
    return out, rows


def test_merge_seeks_after_n():
    runs, rows = as_runs([[("a", i) for i in range(0, 900, 2)] + [("b", 1)], [("a", i) for i in range(1, 900, 2)], []])
    assert [rows[i] for i in merge_runs(runs, 3)] == [("a", 0), ("a", 1), ("a", 2), ("b", 1)]
    assert sum(r.looked_at for r in runs) < 12  # the rest of the groups was sought over


def test_merges_are_bounded(spark, monkeypatch):
    """Ten times the groups make more merges, not larger ones."""
    from quoin.llm import topn

    monkeypatch.setattr(topn, "BUCKET_ROWS", 50)
    largest = []
    for groups in (40, 400):
        df = spark.range(groups * 5).selectExpr(f"concat('g', id % {groups}) as g", "id as s", "id as t").repartition(3)
        assert top_n(df, "g", "s", ["t"], 4).count() == groups * 4
        buckets = max(4, -(-groups * 5 // 50))
        largest.append(df.selectExpr(f"pmod(xxhash64(g), {buckets}) as b").groupBy("b").count().agg({"count": "max"}).first()[0])
    assert largest[1] <= 3 * 50 and largest[0] <= 3 * 50


def test_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        hot = rng.random() < 0.34
        g = "hot" if hot else rng.choice([None, "", *"abcdefgh", "é", "zz"])
        rows.append((g, rng.choice([None, *range(20)]), rng.choice([None, "", "x", "é", "\U00010000", "￿"]), i, "x"))
    rows += rows[:40]  # repeated rows count as rows
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for n, fan in ((12, 64), (3, 2), (1, 3), (0, 2)):
        got = top_n(df, "sourceId", "timestamp", ["id", "row_id"], n, fan).select("sourceId", "row_id").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, n)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert top_n(df, "sourceId", "timestamp", ["id", "row_id"], 12).count() == 0
