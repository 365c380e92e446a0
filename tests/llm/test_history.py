import random

from quoin.llm.history import History, addresses, address_columns, first_rows, near_pairs, same_slug, slip, with_pivots
from pyspark.sql import functions as F

SCHEMA = "row_id long, link string, address string"


def forms(spark, links):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(links)], "row_id long, link string")
    for n, c in address_columns(F.col("link")):
        df = df.withColumn(n, c)
    return [r.address for r in df.orderBy("row_id").collect()]


def test_one_form(spark):
    same = [
        "https://www.a.example/news/big-new-hall",
        " http://A.example:80//news/Big-New-Hall/ \n",
        "https://m.a.example/news/big-new-hall/amp/?utm_source=x&amp=1#top",
        "https://a.example/news/big%2Dnew-hall;jsessionid=9A?ref=x",
        "https://go.b.example/r/1?u=https%3A%2F%2Fwww.a.example%2Fnews%2Fbig-new-hall%3Ffbclid%3D1&mkt=3",
        "https://out.c.example/?sid=1&url=http%3A%2F%2Fa.example%3A80%2Fnews%2Fbig-%256eew-hall%23x",
        "//a.example/news/big-new-hall/index.html",
    ]
    assert set(forms(spark, same)) == {"a.example/news/big-new-hall"}
    assert len(set(forms(spark, ["https://a.example/?p=1", "https://a.example/?p=2", "https://a.example/story.php?id=1", "https://b.example/?p=1"]))) == 4
    assert len(set(forms(spark, ["https://a.example/10012/old-name", "https://www.a.example/10012/new-name/", "https://a.example/10012"]))) == 1


def test_slips():
    assert slip("library", "lbrary") and slip("housing", "housnig") and slip("floating", "floatting") and slip("public", "publci")
    assert not slip("bisnos", "bishos") and not slip("d6", "bx") and not slip("hall", "halls") and not slip("part2", "part3") and not slip("same", "same")
    assert same_slug("in-gesprek-met-x", "gesprek-met-x") and same_slug("brick-vaults-community", "brick-vaulst-commuity")
    assert not same_slug("the-hall", "the-hall-2") and not same_slug("the-hall", "the-hall-ii") and not same_slug("a-b-c-hall", "hall")


def rows_with_slips(n=400, seed=5):
    rng = random.Random(seed)
    words = ["garden", "library", "timber", "station", "harbour", "theatre", "courtyard", "valley", "for", "the", "of", "museum", "bridge"]
    rows = []
    for i in range(n):
        slug = "-".join(rng.sample(words, 6)) + "-" + "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
        host = "hot.example" if rng.random() < 0.34 else f"h{rng.randrange(5)}.example"
        rows.append(f"https://{host}/news/{slug}")
        if rng.random() < 0.3:
            k = rng.randrange(1, len(slug) - 1)
            rows.append(f"http://www.{host}/news/{slug[:k]}{slug[k]}{slug[k:]}?utm_source=a")
        if rng.random() < 0.1:
            rows.append(rows[-1])
    rng.shuffle(rows)
    return [(i, x, "clash") for i, x in enumerate(rows)] + [(90001, None, ""), (90002, "", ""), (90003, " \t", "")]


def brute(rows):
    """Every pair compared; components by repeated sweeps."""
    import re

    keyed = [(i, re.sub(r"^https?://(www\.)?|\?.*", "", x)) for i, x, _ in rows if x and x.strip()]
    root = {i: i for i, _ in keyed}
    find = lambda i: i if root[i] == i else find(root[i])
    for n, (i, x) in enumerate(keyed):
        for j, y in keyed[:n]:
            a, b = x.rsplit("/", 1), y.rsplit("/", 1)
            if x == y or a[0] == b[0] and same_slug(a[1], b[1]):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted((find(i), i) for i, _ in keyed if find(i) != i)


def test_against_all_pairs(spark):
    rows = rows_with_slips()
    df = spark.createDataFrame(rows, SCHEMA)
    for batches in ("row_id div 100", "0", "if(row_id < 50, null, row_id % 3)"):
        assert sorted(map(tuple, first_rows(df.withColumn("batch_no", F.expr(batches))).collect())) == brute(rows)
    assert first_rows(df.limit(0), batch_col=None).count() == 0


def test_what_is_another_article(spark):
    got = forms(spark, ["https://a.example/20240115/glass-tower-opens", "https://a.example/20240115/museum-closes-doors", "https://a.example/202401/glass-tower", "https://a.example/202401/old-mill", "https://a.example/v?cid=1", "https://a.example/v?cid=2",
                        "https://a.example/v?from=1201", "https://a.example/v?from=homepage", "https://a.example/v?source=rss", "https://a.example/v?view=2"])
    assert len(set(got)) == 9 and got[7] == got[8] == "a.example/v"


def keys_of(spark, slugs):
    df = spark.createDataFrame([(i, f"https://a.example/news/{s}") for i, s in enumerate(slugs)], "row_id long, link string")
    return with_pivots(addresses(df, "row_id", "link"))


def mutated(rng, slug):
    """One slip or lost word of the slug, at random."""
    words = slug.split("-")
    i = rng.randrange(len(words))
    w, k = words[i], rng.randrange(1, max(2, len(words[i]) - 1))
    kind = rng.randrange(4)
    if kind == 0 and len(w) <= 4 and i < len(words) - 1:
        return "-".join(words[:i] + words[i + 1 :])
    words[i] = [w[:k] + w[k - 1] + w[k:], w[:k] + w[k + 1 :], w[: k - 1] + w[k : k + 1] + w[k - 1 : k] + w[k + 1 :], w[:k] + rng.choice("aeiouяж") + w[k:]][rng.randrange(4)]
    return "-".join(words)


def test_no_pair_of_two_slips_is_missed(spark):
    rng = random.Random(3)
    words = ["this", "that", "glass", "tree", "house", "villa", "of", "an", "oslo", "tower", "museum", "library", "courtyard", "über", "стекло", "дом", "new", "homes", "brick"]
    slugs = ["this-that-glass-architecture", "glass-architecture", "tree-house-villa", "tre-huse-villa"]
    for _ in range(300):
        s = "-".join(rng.choice(words) for _ in range(rng.randrange(2, 7)))
        slugs += [s, mutated(rng, s), mutated(rng, mutated(rng, s))]
    slugs = [s for s in dict.fromkeys(slugs) if "-" in s and "--" not in s and not s.startswith("-") and not s.endswith("-")]
    entries = keys_of(spark, slugs)
    slug_of = {r.row_id: r.slug for r in entries.collect()}
    want = {(a, b) for a in slug_of for b in slug_of if a > b and same_slug(slug_of[a], slug_of[b])}
    assert set(map(tuple, near_pairs(entries).collect())) == want and len(want) > 300


def test_foreign_slugs_share_no_hot_key(spark):
    rng = random.Random(4)
    slugs = ["-".join("".join(rng.choice("абвгдежзийклмнопрстуфхцчшщ") for _ in range(7)) for _ in range(4)) for _ in range(400)]
    by_key = keys_of(spark, slugs).select(F.explode("keys").alias("k")).groupBy("k").count()
    assert by_key.agg(F.max("count")).first()[0] <= 8  # of 400: no hot key, where a key without foreign letters would hold all


def test_batches_give_what_one_load_gives(spark, tmp_path):
    rows = rows_with_slips(120, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    history, got = History(spark, f"file://{tmp_path}/h", 16), []
    for lo, hi in ((0, 90), (90, 120), (120, 100_000)):
        got += map(tuple, history.probe(df.where(f"row_id >= {lo} and row_id < {hi}")).collect())
    assert sorted(got) == brute(rows)
    assert history.probe(df.where("row_id < 50")).count() == sum(b < 50 for _, b in brute(rows))  # a batch tried again adds nothing
    assert history.articles().count() == history.articles().select("address").distinct().count()
    history.close()


def test_history_is_not_shuffled(spark, tmp_path):
    history = History(spark, f"file://{tmp_path}/h", 4)
    history.probe(spark.createDataFrame(rows_with_slips(40, 2), SCHEMA))
    mine = spark.range(10).select(F.col("id").alias("key"), F.lit(1).cast("tinyint").alias("mine"))
    plan = spark.table(history.name).join(mine.hint("shuffle_hash"), "key").where("kind = 1 and mine = 1 or kind = 0 and mine = 0")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1
    history.close()
