from quoin.llm import residue as residue_module
from quoin.llm.residue import Model, all_placeholders, fit, idioms, learn, residue, residue_values, span_features, spans, without_residue, words

GOOD = ["The museum opens a new wing in the spring.", "Error as method, an essay by Ana Bel", "A house with 404 windows", "The installation prints the words “404 Not Found” on every missing brick.", "The JavaScript Garden: a facade in code",
        "Null and void: essays on empty plots", "Nothing undefined remains in the plan", "They call the plots {placeholders} for a school", "The show [untitled], brackets included", "Who is denied access to the riverfront?",
        "Half of it, about 50% in all, went into the roof", "In the catalogue, filler text such as lorem ipsum is treated as ornament", "What is to be done? None of it is easy."]
BAD = ["{{ title }}", "A house by {{author.name}} in the hills", "%%EXCERPT%%: ${post.title}", "<%= item.name %> tower", "404 Not Found", "Gateway time-out. Error code 1234", "undefined", "A tower by undefined on the hill",
       "null | null", "The plan is simple. 500 Internal Server Error", "Please enable JavaScript to view this page.", "Seite nicht gefunden!", "ページが見つかりません", "Lorem ipsum dolor sit amet consectetur elit sed magna", "[object Object] car park",
       "MISSING_TRANSLATION", "Page not found The museum opens a new wing", "*|STORY_TITLE|*", "An interview with Dan None on roofs", "{0}"]


NOTICES = ["Gateway time-out. Error code 12", "Page not found", "500 Internal Server Error", "Please enable JavaScript to view this page", "Enable JavaScript to run this app", "Seite nicht gefunden", "ページが見つかりません"]


def model():
    keys = ["{{ title }}", "${post.title}", "%%EXCERPT%%", "*|STORY_TITLE|*", "{{ author.name }}", "{% missing_translation %}", "{{0}}"] * 3
    return fit([(t, 5) for t in NOTICES], keys, GOOD * 20, idioms={("nothing", "undefined", "remains")})


def test_values_by_hand():
    m = model()
    assert [t for t in GOOD if residue(m, t)] == []
    assert [t for t in BAD if not residue(m, t)] == []
    m.odds, m_odds = {}, m.odds
    assert [t for t in BAD if residue(m, t)] == []  # nothing is found but by the weights
    m.odds = m_odds
    assert not residue(m, None) and not residue(m, "") and not residue(m, " \n") and not residue(m, "word " * 50_000)


def test_parts_of_placeholders():
    assert [s[0] for s in spans("a {{b}} c ${d} [E_F] {{{g}}}")] == ["{{", "${", "[", "{{{"]
    assert {"m:{{", "i:author", "i:name", "h:path"} <= set(span_features("{{", "{{ author.name }}"))
    assert all_placeholders("{{a}} | %%B_C%%") and not all_placeholders("{{a}} hall") and not all_placeholders("plain")
    assert words("Error 404: 12 日本語") == ["error", "404", "0", "日本", "本語"]
    assert not residue(Model(), "plain words only")


def test_table(spark):
    rows = [(i, f"s{i % 9}", f"https://s{i % 9}.example/{i}", t, f"{t} It is told at length, plan {i}.", "clash") for i, t in enumerate(GOOD)]
    rows += [(1000 * k + 100 + i, f"s{i % 9}", "x", *((t, None) if k else (None, t)), "clash") for k in range(3) for i, t in enumerate(NOTICES * 3)]
    rows += [(5000 + i, f"s{i % 9}", "x", f"Hall {i} opens", t, "clash") for i, t in enumerate(BAD)]
    rows += [(200 + i, f"s{i}", f"y{i}", "Zet uw tekst hier neer", "", "") for i in range(6)]  # a title of many publishers, and a text
    rows += [(300, "s1", "z", "A fine hall", "Zet uw tekst hier neer", ""), (301, "s2", None, None, None, None)]
    rows += [(10_000 + i, f"s{i % 9}", "x", f"Hall {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} opens", f"A hall for {i} readers.", "clash") for i in range(900)]  # residue is rare
    rows += [(400 + i, f"s{i}", f"q{i}", "The same hall at six publishers", f"A hall of plan {chr(97 + i)}.", "") for i in range(6)]  # a title only
    df = spark.createDataFrame(rows + rows[:2], "row_id long, sourceId string, link string, title string, excerpt string, field string")
    got = set(map(tuple, residue_values(df).collect()))
    rare = {"MISSING_TRANSLATION", "{0}"}
    assert got >= {(5000 + i, "excerpt") for i, t in enumerate(BAD) if t not in rare} | {(200 + i, "title") for i in range(6)} | {(300, "excerpt")}
    assert not {i for i, _ in got} & ({*range(13), *range(400, 406)} - {6})  # one lone setting of a printed word is no idiom yet
    assert set(map(tuple, residue_values(df.repartition(5, "title")).collect())) == got
    assert residue_values(df.limit(0)).count() == 0
    kept = {r.row_id for r in without_residue(df).collect()}
    assert 301 in kept and 0 in kept and not kept & {5000, 200, 300}


def test_idioms_by_spread(spark):
    story = lambda i, t: (i, f"s{i % 10}", t, None)
    rows = [story(i, f"Nothing undefined remains in plan {chr(97 + i)}") for i in range(10)]
    rows += [story(20 + i, f"A {w} tower by null on the hill") for i, w in enumerate(("tall", "low", "red"))]  # one template at three publishers
    rows += [story(30 + i, f"A {w} tower by Ana on the hill") for i, w in enumerate(("wide", "thin", "grey", "old"))]
    rows += [story(40 + i, "A quay of NaN meters") for i in range(9)]  # copies of one story
    rows += [(60 + i, "s1", f"{w} halls with null seats", None) for i, w in enumerate(("Two", "Six", "Ten"))]  # one hot source
    df = spark.createDataFrame(rows, "row_id long, sourceId string, title string, excerpt string")
    assert idioms(df, "sourceId", ("title", "excerpt")) == {("nothing", "undefined", "remains")}
    m = Model(odds={"x:undefined": 5.0}, idioms={("nothing", "undefined", "remains")})
    assert not residue(m, "Nothing undefined remains in the plan") and residue(m, "Nothing undefined remains in the plan. A hall by undefined on the hill")


def test_phrases_beyond_the_fitting_sample(spark, monkeypatch):
    phrases = ["Zet uw tekst hier neer", "Qui va il corpo", "Veld nog leeg gelaten", "Brak opisu wpisu"]
    rows = [(100 * k + i, f"s{i}", p, p if i % 2 else None) for k, p in enumerate(phrases) for i in range(6)]
    rows += [(1000, "s9", "A fine hall", f"{phrases[3]} The hall opens in the spring of next year"), (1001, "s9", "The hall opens", None)]
    df = spark.createDataFrame(rows, "row_id long, sourceId string, title string, excerpt string")
    want = {(r[0], f) for r in rows[:-2] for f, v in zip(("title", "excerpt"), r[2:]) if v} | {(1000, "excerpt")}
    monkeypatch.setattr(residue_module, "TRUSTED_MAX", 1)
    assert set(map(tuple, residue_values(df).collect())) == want


def test_what_is_both_title_and_text_is_trusted(spark):
    rows = [(i, f"s{i}", f"Hall {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} opens", f"A hall {i}.") for i in range(400)]
    rows += [(9000 + i, f"s{i}", "Studio opens a workshop in Orrin", "It opens today.") for i in range(5)]  # one story at five publishers
    rows += [(9100 + i, f"s{i}", *(("Qui va il corpo", None) if i % 2 else (None, "Qui va il corpo"))) for i in range(5)]
    rows += [(9200 + i, "s1", *(("One source only", None) if i % 2 else (None, "One source only"))) for i in range(5)]
    rows += [(9300, "s1", "Same as its text", "Same as its text"), (9300, "s2", "Same as its text", "Same as its text"), (9300, "s3", "Same as its text", "Same as its text")]
    long_ = "The error page goes on " + "and on " * 100
    rows += [(9400 + i, f"s{i}", *((long_, None) if i % 2 else (None, long_))) for i in range(5)]
    m = learn(spark.createDataFrame(rows, "row_id long, sourceId string, title string, excerpt string"))
    assert "qui va il corpo" in m.phrases and any(p.startswith("the error page") for p in m.phrases)
    assert not m.phrases & {"studio opens a workshop in orrin", "one source only", "same as its text"}


def test_headlines_repeated_below_themselves_are_not_trusted(spark):
    row = lambda i, s, t, x: (i, s, t, x)
    rows = [row(i, f"s{i}", f"Hall {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} opens", f"A hall {i}.") for i in range(100)]
    rows += [row(200 + i, f"s{i}", "Studio 404 opens a workshop in Orrin", f"The stone of quarry {i} is reused.") for i in range(5)]
    rows += [row(300, "s9", "Studio 404 opens a workshop in Orrin", "Studio 404 opens a workshop in Orrin"), row(301, "s8", "Studio 404 opens a workshop in Orrin | The Plinth", "Studio 404 opens a workshop in Orrin")]
    rows += [row(400 + i, f"s{i}", f"Qui va il corpo {'' if i % 2 else '!'}" if i < 3 else f"A quay of plan {chr(97 + i)}", "Qui va il corpo" if i >= 3 else f"A quay for reader {chr(97 + i)}.") for i in range(6)]
    rows += [row(500, "s1", "One story at many publishers", "One story at many publishers"), row(501, "s1", "One story at many publishers", "It is told.")]
    copies = [(10_000 * k + i, f"{s}~{k}", t, x) for k in range(4) for i, s, t, x in rows]  # keys and publishers shifted
    for of in (rows, copies):
        m = learn(spark.createDataFrame(of, "row_id long, sourceId string, title string, excerpt string"))
        assert "qui va il corpo" in m.phrases
        assert not m.phrases & {"studio 404 opens a workshop in orrin", "one story at many publishers"}


def test_trusted_placeholders_of_asking_kinds_stay_where_the_sample_is_full_of_them():
    keys = ["{{ title }}", "${post.title}", "%%EXCERPT%%", "{{0}}"] * 5
    rest = [f"A hall of plan {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(900)]
    for n in (2, 200):  # so many of them in the sample
        m = fit([("Page not found", 5), ("{0}", 5)], keys, rest + ["{0}", "They call the plots {placeholders} for a school"] * n)
        assert residue(m, "{0}") and residue(m, "A hall {0} in the hills") and not residue(m, "They call the plots {placeholders} for a school")
