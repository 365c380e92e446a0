"""Literal cases of the text scalars, in one pass over one small table each."""

from pyspark.sql import functions as F

from quoin.functions import dates, extract, predicates
from quoin.functions import text as T


def values(spark, fn, items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_entities(spark):
    got = values(spark, T.decode_entities, ["&#38;lt;", "&#38;#65; &#65;", "&#1114112;", "&unknown;", "&AMP;", "&#x41;&#X1F600;", "&eacute;&nbsp;&bull;", "no", "", None, "&#99999999999999999999;", "&#xFFFFFFFFFFFFFFFFFF;"])
    assert got == ["<", "&#65; A", "", "&unknown;", "&AMP;", "A😀", "é •", "no", "", None, "", ""]
    assert values(spark, T.deep_decode, ["&#38;#65; &#65;", "&amp;amp;amp;amp;lt;"]) == ["A A", "&amp;lt;"]


def test_html_to_text(spark):
    assert values(spark, T.to_text, ["<h2>x</h2><p>a , b</p>", "<![CDATA[<b>x</b>]]>", "( a ) “ q", None, "&lt;script&gt;x&lt;/script&gt;y", "a\x0b　b<br>c"]) == ["a, b", "x", "(a ) “q", "", "y", "a b c"]
    long = "word " * 200
    got = values(spark, T.clean_excerpt, ["Intro. Read more about it", "text [...]", "The post X appeared first on Y.", long, "Reading more is fine"])
    assert got[:3] == ["Intro.", "text…", ""] and got[3] == ("word " * 140)[:700].rsplit(" ", 1)[0].strip() + "…" and got[4] == "Reading more is fine"


def test_short(spark):
    w = lambda n, x="w": " ".join([x] * n)
    got = values(spark, T.make_short, [w(60), w(61), f"{w(17)}. {w(50)}.", f"{w(18)}. {w(50)}.", "", None, f"{w(59)} a, {w(5)}"])
    assert got[0] == w(60) and got[1] == w(60) + "…" and got[2].endswith("…") and len(got[2].split(" ")) == 60 and got[3] == w(18) + "." and got[4] == "" and got[5] == ""
    assert got[6] == f"{w(59)} a…"


def test_addresses(spark):
    assert values(spark, T.absolute_url, ["//h/a", "http://h/a", "https://h/a", "/a", "a.png", "", None, " https://h/a?b=1&amp;c=2 "]) == ["https://h/a", "https://h/a", "https://h/a", None, None, None, None, "https://h/a?b=1&c=2"]
    assert values(spark, lambda c: T.absolute_url(c, "https://b.example"), ["/a"]) == ["https://b.example/a"]
    assert values(spark, T.link_key, ["https://H/A/?x=1#y", "https://h/a#b", None]) == ["https://h/a", "https://h/a", None]
    assert values(spark, T.uri_decode, ["a+b%20c", "%zz"]) == ["a+b c", None]
    assert values(spark, T.safe_url, ["https://x", "http://x", None]) == ["https://x", "", ""]


def djb(s):
    h = 5381
    b = s.encode("utf-16-be")
    for i in range(0, len(b), 2):
        h = (h * 33 + b[i] * 256 + b[i + 1]) % 2**32
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    out = ""
    while h:
        out, h = digits[h % 36] + out, h // 36
    return out


def test_hash(spark):
    items = ["a", "https://x.example/a", "é漢😀", "x" * 3000, ""]
    assert values(spark, T.base36_hash, items) == [djb(x) for x in items]


def test_titles_and_ages(spark):
    assert values(spark, T.clean_title, ["Tower – Dezeen", "Tower-Dezeen", " A  b | domus web ", None, "A - The Architect’s Newspaper"]) == ["Tower", "Tower-Dezeen", "A b", "", "A"]
    assert values(spark, lambda c: T.clean_title(c, F.lit("Arch Record")), ["Hall | Arch Record", "Hall | Dezeen", "Hall | Other"]) == ["Hall", "Hall", "Hall | Other"]
    now = 10**12
    assert values(spark, lambda c: T.age(c, now), [now - s * 1000 for s in (30, 3599, 86400, 172800, 7200, -99)], "long") == ["1m ago", "59m ago", "Yesterday", "2d ago", "2h ago", "1m ago"]
    assert values(spark, T.escape_html, ["<a href=\"x\">'&'", None]) == ["&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;", ""]
    assert values(spark, T.digest_excerpt, ["", None, "x" * 200]) == ["...", "...", "x" * 140 + "..."]
    assert values(spark, T.email, ["　A@B.c\xa0", None]) == ["a@b.c", ""]


def test_dates(spark):
    got = values(spark, dates.parse_ms, ["Tue, 02 Jan 2024 03:04:05 GMT", "2 Jan 2024 03:04:05 +0100", "Tue, 02 Jan 2024 03:04:05 EST", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.678Z", "2024-01-02", "nonsense", "", None])
    base = 1704164645000
    assert got == [base, base - 3_600_000, base + 5 * 3_600_000, base, base + 678, 1704153600000, None, None, None]
    assert values(spark, lambda c: dates.ms_or_default(F.lit(None).cast("long"), c, 10**12), [2], "int") == [10**12 - 2 * 3_600_000 - 86_400_000]


def test_predicates(spark):
    assert values(spark, predicates.good_image, ["https://x/a.jpg", "http://x/a.jpg", "https://x/favicon.ico", "https://x/1x1.gif", None]) == [True, False, False, False, False]
    assert values(spark, lambda c: predicates.valid_story(c, F.lit("https://x.example/a")), ["Login to x", "abc", "Tower", None]) == [False, False, True, False]
    assert values(spark, lambda c: predicates.valid_story(F.lit("Tower"), c), ["http://x", "https://www.bing.com/a", "https://x", None]) == [False, False, True, False]
    assert values(spark, predicates.acceptable_email, ["@", "abc", "", None]) == [True, False, False, False]


def test_extraction(spark):
    assert values(spark, lambda c: extract.tag(c, "content"), ["<content:encoded>a</content:encoded><content type='x'> <![CDATA[b]]> </content>", "none"]) == ["b", ""]
    video = '<media:content url="https://x/v.mp4" medium="video"/><media:thumbnail url="https://x/t.jpg"/><enclosure url="https://x/e.jpg" type="image/jpeg"/>'
    assert values(spark, lambda c: extract.item_image(c, F.lit('<img src="https://x/i.jpg">')), [video, '<enclosure url="//x/a.mp3" type="audio/x"/>', '<enclosure url="//x/e.jpg"/>']) == ["https://x/t.jpg", "https://x/i.jpg", "https://x/e.jpg"]
    atom = '<link rel="alternate" href="https://x/a?b&amp;c"/><link href="https://x/z"/>'
    assert values(spark, extract.item_link, ["<link>https://x/y</link>", atom, '<link href="https://x/z"/>', "<a/>"]) == ["https://x/y", "https://x/a?b&c", "https://x/z", ""]
    w = lambda n: " ".join(["w"] * n)
    bodies = spark.createDataFrame([([w(10), "", w(50), w(60)],), ([w(7)] * 4,), ([w(46), w(50)],)], "x array<string>")
    assert sorted(len(r[0].split()) for r in bodies.select(extract.best_body(F.col("x"))).collect()) == [0, 46, 50]
    page = "<meta property=\"og:image\" content=\"https://x/a.jpg\"><meta content='https://x/b.jpg' name='twitter:image'>"
    assert values(spark, extract.preview_image, [page, "<meta content='https://x/b.jpg' name='twitter:image'>", ""]) == ["https://x/a.jpg", "https://x/b.jpg", None]
    hit = "<link>https://s/?u=1&amp;url=https%3A%2F%2Fpub.example%2Fa+b&amp;c=1</link><News:Image>http://i/x?a=1&amp;b=2</News:Image>"
    assert values(spark, lambda c: extract.search_link(c, F.lit("pub.example")), [hit, "<link>x?url=%zz</link>", hit.replace("pub", "other")]) == ["https://pub.example/a+b", "", ""]
    assert values(spark, extract.search_image, [hit, "<a/>"]) == ["https://i/x?a=1&b=2&w=900&h=600&c=14", None]
