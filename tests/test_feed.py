"""Sequential models of the order-dependent operators, and landed documents by hand."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quoin.catalog import source_catalog
from quoin.operators import feed as ops
from quoin.operators.interleave import interleave
from quoin.plans import consumers
from quoin.sources import landing, sinks

NOW = 1_764_547_200_000
STORY = "row_id long, sourceId string, title string, link string, timestamp long, image string, short string, excerpt string, id string, sourceName string"


def story(i, s="a", title=None, link=None, ts=NOW, image=None):
    return (i, s, title if title is not None else f"Title {i}", link if link is not None else f"https://x.example/{i}", ts, image, "s", "e", f"{s}-{i}", s.upper() if s else None)


def greedy(rows):
    """One row after the other; a missing link or title is no key."""
    seen, out = set(), []
    for i, s, title, link, *_ in rows:
        k = (link or "").split("?")[0].split("#")[0]
        keys = {("k", (k[:-1] if k.endswith("/") else k).lower())} if link else set()
        keys |= {("t", (s or "") + "|" + title[:60].lower())} if title else set()
        if not keys & seen:
            seen |= keys
            out.append(i)
    return out


def mix(rows):
    pool, out = list(rows), []
    while pool:
        last, pick = out[-1][1] if out else None, 0
        if pool[0][1] == last:
            pick = next((i for i in range(1, min(len(pool), 8)) if pool[i][1] != last), 0)
        out.append(pool.pop(pick))
    return [r[0] for r in out]


def test_greedy_dedupe(spark):
    rng = random.Random(4)
    rows = [story(0, title="t1", link="https://k1"), story(1, title="t2", link="https://k1"), story(2, title="t2", link="https://k2")]
    assert {r.row_id for r in ops.greedy_dedupe(spark.createDataFrame(rows, STORY), "row_id").collect()} == {0, 2} == set(greedy(rows))
    rows = [story(i, rng.choice(["a", "b", None]), rng.choice(["", None, *"pqrstuv"]), rng.choice([None, "", *[f"https://x/{j}/?q" for j in range(14)]])) for i in range(150)]
    assert sorted(r.row_id for r in ops.greedy_dedupe(spark.createDataFrame(rows, STORY), "row_id").collect()) == greedy(rows)
    assert ops.greedy_dedupe(spark.createDataFrame([], STORY), "row_id").count() == 0


def test_interleave(spark):
    for sources in ("aaabac", "aaaaaaaaab", "abab", "a", "aabbccaaab" * 9):
        rows = [story(i, s) for i, s in enumerate(sources)]
        got = interleave(spark.createDataFrame(rows, STORY), "row_id").orderBy("place").collect()
        assert [r.row_id for r in got] == mix(rows)
    assert interleave(spark.createDataFrame([], STORY), "row_id").count() == 0
    two = spark.createDataFrame([(d, i, s) for d in (1, 2) for i, s in enumerate("aab")], "deck int, n int, sourceId string")
    assert [(r.deck, r.n) for r in interleave(two, "n", "deck").orderBy("deck", "place").collect()] == [(1, 0), (1, 2), (1, 1), (2, 0), (2, 2), (2, 1)]


def test_interleave_in_ranges(spark):
    """Many ranges, hot sources, decks that begin and end within ranges: the same as one row after the other."""
    rng = random.Random(8)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for weights in ((9, 1, 1), (1, 1, 1), (30, 1, 0), (1, 0, 0)):
            rows = [(d, i, rng.choices("abc", weights)[0] if rng.random() < 0.95 else None) for d in (1, 2, 3) for i in range((700, 3, 260)[d - 1])]
            df = spark.createDataFrame(rows, "deck int, n int, sourceId string").repartition(5)
            want = [(d, n) for d in (1, 2, 3) for n in mix([(n, s or "") for e, n, s in rows if e == d])]
            assert [(r.deck, r.n) for r in interleave(df, "n", "deck").orderBy("deck", "place").collect()] == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_states_are_foreseen():
    from quoin.operators.interleave import CLEAN, deal, foreseen

    rng = random.Random(9)
    for _ in range(60):
        weights = [rng.random() ** 3 for _ in range(4)]
        rows = [(i, rng.choices("abcd", weights)[0]) for i in range(120)]
        state = CLEAN
        for i, row in enumerate(rows):
            state = deal(state, row, 8)[0]
            assert state in foreseen(rows[max(0, i - 23) : i + 1], 8)


def test_rank_is_global(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert [(r.v, r["rank"]) for r in ops.ranked(df, [F.col("v")]).orderBy("rank").collect()] == [(i, i + 1) for i in range(1000)]


def test_feed_order_of_steps(spark):
    rows = [story(i, ts=NOW - i * 1000) for i in range(14)] + [story(20, "b", "Title 1", "https://x.example/3/", NOW - 500), story(21, "b", ts=NOW - 91 * 86_400_000), story(22, "b", "abc"), story(23, None)]
    got = ops.build_feed(spark.createDataFrame(rows, STORY), NOW).orderBy("rank").collect()
    assert [r.row_id for r in got] == list(range(12))  # two of a's are cut, b's copy is a copy, b's old one is old
    assert ops.build_feed(spark.createDataFrame([], STORY), NOW).count() == 0


def test_fallback_and_health(spark):
    src = spark.createDataFrame([("a", "A", "#1", "a.example", [("rss", ["u"], None), ("bing", ["d"], None)]), ("b", "B", None, "b.example", [("wp", ["u"], ["t"])])], "id string, name string, color string, domain string, plan array<struct<kind string, arg array<string>, types array<string>>>")
    st = spark.createDataFrame([("a", 0, "Login to x", "https://x"), ("a", 1, "Good one", "https://x")], "sourceId string, step_no int, title string, link string")
    got = {r.source_id: (r.winner, r.via, r.tried) for r in ops.fallback(st, ops.plan_steps(src)).collect()}
    assert got == {"a": (1, "bing", ["rss:0", "bing:1"]), "b": (None, None, ["wp:0"])}
    feed = spark.createDataFrame([story(1, image="https://i"), story(2)], STORY)
    health = ops.source_health(src, feed, ops.fallback(st, ops.plan_steps(src)))
    assert {(r.source_id, r.stories, r.with_image, r.with_short) for r in health.collect()} == {("a", 2, 1, 2), ("b", 0, 0, 0)}
    doc = sinks.feed_summary(feed, health, NOW).collect()[0]
    assert doc["count"] == 2 and doc.cache_control == "no-store" and doc.sources == {"a": 2, "b": 0} and doc.updatedAt == "2025-12-01T00:00:00.000Z"


RSS = """<rss><item><title>Tower &amp; hall – Dezeen</title><link>https://pub.example/a</link><description>short text</description><content:encoded><![CDATA[<p>{body}</p><img src="//i.example/a.jpg">]]></content:encoded><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item>
<item><title>No date</title><link>https://pub.example/b</link></item></rss>"""
ATOM = '<feed><entry><title>Entry</title><link rel="alternate" href="https://pub.example/c"/><summary>{body}</summary><updated>2024-01-02T03:04:05Z</updated></entry></feed>'
WP = '[{"title":{"rendered":"A &#8211; b"},"link":"https://pub.example/w","date_gmt":"2024-01-02T03:04:05","excerpt":{"rendered":""},"yoast_head_json":{"description":"From the head","og_image":[{"url":"https://i.example/o.jpg"}]},"_embedded":{"wp:featuredmedia":[{"source_url":"https://i.example/s.jpg","media_details":{"sizes":{"medium_large":{"source_url":"https://i.example/m.jpg"}}}}]}}]'
PAGE = '<article class="x c-article-prev"><a href="/en/news/2024/01/02/a-b.html"><span class="inject-title">T &amp; t</span><p class="inject-desc">D</p><img src="/s.jpg" data-src="/a.foto.rsmall.b.foto.rsmall.jpg"></article><article class="c-article-prev"><a href="/en/shop/2024/01/02/x.html"></article><article class="c-article-prev"><a href="/en/news/2024/01/02/c.html"><span class="inject-title">Two</span></article>'
BING = "<rss><item><title>Hit | Dezeen</title><link>https://s/?url=https%3A%2F%2Fpub.example%2Fh</link><description>&lt;b&gt;text&lt;/b&gt;</description><News:Image>https://i/x</News:Image><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item></rss>"


def test_landed_documents(spark):
    body = " ".join(["word"] * 50)
    src = spark.createDataFrame([("p", "Pub", "#1", "pub.example", [])], "id string, name string, color string, domain string, plan array<struct<kind string, arg array<string>, types array<string>>>")
    rows = [("p", 0, "rss", 0, RSS.replace("{body}", body)), ("p", 1, "rss", 0, ATOM.replace("{body}", body)), ("p", 2, "wp", 0, "not json"), ("p", 2, "wp", 1, WP), ("p", 3, "domus", 0, PAGE), ("p", 3, "domus", 1, PAGE), ("p", 4, "bing", 0, BING), ("p", 5, "rss", 0, None), ("p", 6, "rss", 0, "<html>")]
    land = spark.createDataFrame(rows, "source_id string, step_no int, kind string, url_no int, body string")
    got = {(r.step_no, r.pos): r for r in landing.parse(land, src, NOW).collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 0), (2, 0), (3, 0), (3, 1), (4, 0)}
    a, b, e, w, s, s2, h = (got[k] for k in sorted(got))
    assert a.title == "Tower & hall" and a.excerpt == body and a.image == "https://i.example/a.jpg" and a.timestamp == 1704164645000 and a.dated and a.pubDate == "2024-01-02T03:04:05.000Z" and a.via == "rss" and a.sourceName == "Pub"
    assert not b.dated and b.timestamp == NOW - 3_600_000 - 86_400_000 and b.excerpt == "" and b.image is None
    assert e.link == "https://pub.example/c" and e.timestamp == a.timestamp
    assert w.title == "A – b" and w.excerpt == "From the head" and w.image == "https://i.example/m.jpg" and w.timestamp == a.timestamp
    assert s.link == "https://www.domusweb.it/en/news/2024/01/02/a-b.html" and s.title == "T & t" and s.image == "https://www.domusweb.it/a.foto.rmedium.b.foto.rsmall.jpg" and s.timestamp == 1704196800000 and s2.timestamp == s.timestamp - 60_000 and s.via == "page"
    assert h.title == "Hit" and h.link == "https://pub.example/h" and h.excerpt == "text" and h.image == "https://i/x&w=900&h=600&c=14"


def test_previews(spark):
    df = spark.createDataFrame([story(1), story(2), story(3, image="https://i/own.jpg"), story(4)], STORY)
    page = lambda u: f'<meta property="og:image" content="{u}">'
    pages = spark.createDataFrame([("https://x.example/1", page("//i/p.jpg")), ("https://x.example/2", page("https://i/logo.jpg")), ("https://x.example/3", page("https://i/q.jpg")), ("https://x.example/4", None), ("https://x.example/1", page("//i/p.jpg"))], "link string, html string")
    got = {r.row_id: (r.image, r.imageVia) for r in ops.with_previews(df, pages, "row_id").collect()}
    assert got == {1: ("https://i/p.jpg", "og"), 2: (None, None), 3: ("https://i/own.jpg", None), 4: (None, None)}


def test_consumers(spark):
    log = spark.createDataFrame([(1, "a-1", 5), (1, "a-1", 6), (1, "a-2", 7), (None, "x", 1), (2, "gone", 9)], "reader_no long, story_id string, saved_at long")
    saved = consumers.saved_set(log)
    assert {tuple(r) for r in saved.collect()} == {(1, "a-2", 7), (2, "gone", 9)}
    taps = spark.createDataFrame([(1, "a-2", 8), (1, "a-3", 9)], "reader_no long, story_id string, saved_at long")
    assert {tuple(r) for r in consumers.toggle(saved, taps).collect()} == {(2, "gone", 9), (1, "a-3", 9)}
    feed = ops.build_feed(spark.createDataFrame([story(1, title="<Two>"), story(2, ts=NOW - 1)], STORY), NOW)
    assert {tuple(r) for r in consumers.saved_counts(saved, feed).collect()} == {(1, 1, 1), (2, 1, 0)}
    assert [r.id for r in consumers.view(feed, "saved", saved).collect()] == ["a-2"] and consumers.view(feed, "nobody").count() == 0
    src = spark.createDataFrame([("a", "A", None)], "id string, name string, color string")
    card = consumers.cards(consumers.view(feed, "all"), src, NOW).orderBy("place").collect()[0]
    assert (card.ordinal, card.title, card.color, card.age) == ("01 / 02", "&lt;Two&gt;", "#333", "1m ago")
    assert "<h2>&lt;Two&gt;</h2>" in consumers.card_html(consumers.cards(consumers.view(feed, "all"), src, NOW)).orderBy("place").first().html
    raw = spark.createDataFrame([(" A@b ",), ("a@B",), ("abc",), (None,), ("@",)], "email string")
    known = spark.createDataFrame([("@",)], "email string")
    assert [r.email for r in consumers.new_subscribers(raw, known).collect()] == ["a@b"]
    day = F.lit("2025-12-01").cast("date")
    html = consumers.digest_html(consumers.digest_rows(feed, src), day)
    assert "MONDAY, DECEMBER 1, 2025" in html.first().html and html.first().html.count("<tr>") == 2
    many = spark.createDataFrame([(f"u{i:03}@x",) for i in range(120)], "email string")
    sizes = consumers.outbox(many, html, day).groupBy("batch_no").count().orderBy("batch_no").collect()
    assert [tuple(r) for r in sizes] == [(0, 50), (1, 50), (2, 20)]


def test_reader_and_sign_ups(spark):
    feed = spark.createDataFrame([story(1), story(2)], STORY)
    asked = spark.createDataFrame([("#a-1", "saved"), ("a%2D2", "b"), ("#gone", "b"), ("#%zz", "b"), (None, "b")], "fragment string, wanted string")
    assert [(r.requested, r.found, r["filter"]) for r in consumers.deep_links(asked, feed).orderBy("requested", "wanted").collect()] == [(None, False, "b"), (None, False, "b"), ("a-1", True, "all"), ("a-2", True, "all"), ("gone", False, "b")]
    with pytest.raises(ValueError):
        consumers.loadable(feed.limit(0), required=True)
    assert consumers.loadable(feed, required=True).count() == 2
    bodies = spark.createDataFrame([('{"email":" A@b "}',), ('"{\\"email\\":\\"c@d\\"}"',), ("{}",), ("[1",), (None,)], "body string")
    assert [r.email for r in consumers.sign_ups(bodies).collect()] == [" A@b ", "c@d", "", "", ""]
    new = spark.createDataFrame([("n@x",)], "email string")
    assert consumers.subscriber_counter(spark.createDataFrame([("a@x",), ("a@x",)], "email string"), new).first()[0] == 2
    assert consumers.welcomes(new).first().to == "n@x"
    empty = spark.createDataFrame([], "batch_no long, to string")
    assert consumers.digest_log(empty, F.lit("t")).count() == 0
    state = consumers.digest_counters(consumers.digest_log(empty, F.lit("t"))).first()
    assert (state.last_sent, state.emails_sent, state.recipients) == (None, 0, 0)
    no_rows = consumers.digest_html(consumers.digest_rows(feed.limit(0).withColumn("rank", F.lit(1)), spark.createDataFrame([], "id string, color string")), F.lit("2025-12-01").cast("date"))
    assert no_rows.count() == 0  # no stories, no digest
    value = spark.createDataFrame([('{"n":1}',), ("{",), (None,)], "v string")
    assert [r[0] for r in value.select(consumers.stored(F.col("v"), "n bigint", F.struct(F.lit(7).cast("long").alias("n")))["n"]).collect()] == [1, 7, 7]
    assert sinks.error_document(spark, "late").first().asDict() == {"success": False, "error": "late", "count": 0}


def test_failed_answers_and_unplanned_sources(spark):
    src = spark.createDataFrame([("p", "Pub", "#1", "pub.example", [("rss", ["u"], None)]), ("q", "Q", None, "q.example", None)], "id string, name string, color string, domain string, plan array<struct<kind string, arg array<string>, types array<string>>>")
    item = "<item><title>Title one</title><link>https://pub.example/1</link></item>"
    land = spark.createDataFrame([("p", 0, "rss", 0, item, 1, 503), ("p", 0, "rss", 0, item, 2, 200), ("p", 0, "rss", 0, item, None, None)], "source_id string, step_no int, kind string, url_no int, body string, fetch_no long, status int")
    stories = landing.parse(land, src, NOW)
    assert sorted(r.fetch_no for r in stories.collect()) == [0, 2]
    feed, health = ops.run_feed(stories, src, spark.createDataFrame([], "link string, html string"), NOW)
    assert [(r["rank"], r.title) for r in feed.collect()] == [(1, "Title one")]
    assert {(r.source_id, r.via, tuple(r.tried), r.stories) for r in health.collect()} == {("p", "rss", ("rss:2",), 1), ("q", None, ("error",), 0)}


def test_own_name_with_a_dash(spark):
    from quoin.functions.text import clean_title

    df = spark.createDataFrame([("A hall - Arch-Record", "Arch-Record"), ("A hall -Arch-Record", "Arch-Record"), ("Arch-Record", "Arch-Record"), ("A hall | Dezeen", None), ("A hall – x (y)", "X (y)")], "t string, n string")
    assert [r[0] for r in df.select(clean_title(F.col("t"), F.col("n"))).collect()] == ["A hall", "A hall -Arch-Record", "Arch-Record", "A hall", "A hall"]


def test_catalog(spark):
    steps = ops.plan_steps(source_catalog(spark))
    assert source_catalog(spark).count() == 8 and steps.count() == 20


def test_entry_point_without_and_with_data(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if Path(e.SMOKE_DIR).exists():
        assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["feed_stories", "clean_excerpts", "story_hashes", "fallback_winner", "enriched_images", "interleaved", "rss_items", "wp_posts", "section_articles", "search_hits", "feed_run", "feed_health"])
def test_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    d = Path(e.SMOKE_DIR)
    if not d.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for p in d.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    r = con.execute(e.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    want = sorted((tuple(x) for x in r.fetchall()), key=str)
    got = sorted((tuple(x[c] for c in cols) for x in e.queries()[name](spark, str(d)).collect()), key=str)
    assert got == want
