import pytest

from quoin.llm.truncation import ORDERS, chunks, context, context_keys, cut_rates, cut_shares, cut_values, ends, tail, unfinished, without_marks

SENTENCES = ["The new library opens a row of workshops to the street.", "A retired engineer keeps the original trusses in place.", "The jury will announce the winner in the autumn.", "Visitors climb the stairs to the reading room.", "The garden is open every day and costs nothing.",
             "The old mill was rebuilt with great care and little money."]
SCHEMA = "row_id long, sourceId string, title string, excerpt string, short string, link string, length int"


def rows():
    out = []
    for i in range(240):
        k = i % len(SENTENCES)
        text = " ".join(SENTENCES[(k + j) % len(SENTENCES)] for j in range(4))
        out.append((i, f"s{i % 4}", f"Hall {i} opens", text, SENTENCES[k], "x", 1))
    cut = [
        (1000, "s0", "t", "The jury will announce the winner in the", None, "x", 1),
        (1001, "s0", "t", SENTENCES[0] + " A retired engin", "Visitors climb the stairs to…", "x", 1),
        (1002, "s1", "t", "The garden is open every […]", "The old mill was rebuilt with <em", "x", 1),
    ]
    whole = [
        (2000, "s1", "t", "The jury will announce the winner in the autumn", "Visitors climb the stairs to the reading room", "x", 1), (2001, None, None, None, "", "x", 1), (2002, "s2", "t", " \n", "Photo Studio Hale", "x", 1),
        (2003, "s2", "t", "Please enable JavaScript to view this page", "404 Not Found", "x", 1), (2004, "s3", "t", "word " * 40_000 + "end.", SENTENCES[1], "x", 1),
    ]
    notice = "Please enable JavaScript to view this page"  # known as one: a whole title and a whole text at three publishers
    whole += [(2100 + i, f"s{i % 4}", *((notice, None) if i % 2 else ("t", notice)), None, "x", 1) for i in range(8)]
    want = {(1000, "excerpt"), (1001, "excerpt"), (1001, "short"), (1002, "excerpt"), (1002, "short")}
    return out + cut + whole, want


def test_ends_of_values():
    assert chunks("In 1976, “A b”") == ["In", "0000,", "“A", "b”"] and ends("leak,”") is False and ends("done.”") is True
    assert tail("It ends here.") == ("closed", "ends here") and tail("It goes on") == ("open", "goes on") and tail("It trails…")[0] == "dots" and tail("It goes [...]")[0] == "bracket" and tail("a <em")[0] == "broken"
    assert tail(" ") is None and tail("…") is None
    assert tail("新しい図書館を残")[1] == "図書館を残" and context(["残", "さ"], "れ") == "残され"


@pytest.mark.parametrize("text, kind, ctx", [
    ("walls of brick, glass and […].", "bracket", "glass and"), ("the hall in the (read more.)", "phrase", "in the"), ("The tower rises. »", "closed", "tower rises"), ("They said « La tour monte »", "open", "tour monte"),
    ("the hall in &hellip; Read more >>", "arrow+dots+phrase", "hall in"), ("He left. [...]", "closed", "He left"), ("It grew furthermore", "open", "grew furthermore"), ("the plan (see htt", "broken", "(see htt"),
    ("the plan (see https://www.a.example/x", "broken", "(see https://www.a.example/x"), ("a <a href=\"https://x.example/" + "y" * 400, "broken", "<a href=\"https://x.example/" + "y" * 400), ("a < b.", "closed", "< b"), ("rock &amp", "broken", "rock &amp"),
    ("in the" + " …" * 80, "dots", "in the"), ("one;", "open", " one;"),
])
def test_marks_are_found_wherever_they_are(text, kind, ctx):
    assert tail(text) == (kind, ctx)


def test_marks_and_open_ends():
    assert without_marks("the hall… [...] ") == ("the hall", "bracket+dots") and without_marks("no more") == ("no more", "") and without_marks("plain") == ("plain", "")
    assert not unfinished("1 < 2 and 3 > 2 it is") and unfinished("see <") and unfinished("x &#82") and not unfinished("x &#82;")


def test_contexts_are_the_last_characters():
    owner, n, key, final = context_keys([" of the", "in the", "残され"], False)
    assert sorted(n[owner == 0].tolist()) == [k for k in ORDERS if k <= 7] and sorted(n[owner == 2].tolist()) == [3] and final.all()
    same = {(int(k), int(x)) for o, k, x in zip(owner, n, key) if o == 0} & {(int(k), int(x)) for o, k, x in zip(owner, n, key) if o == 1}
    assert sorted(k for k, _ in same) == [3, 4]  # "the", " the"
    inner = context_keys(["in the"], True)
    assert sorted(zip(inner[1].tolist(), inner[3].tolist())) == sorted((k, at == 5) for at in (3, 4, 5) for k in ORDERS if k <= at + 1)


def test_rates_are_learnt():
    got = cut_rates([("short", "dots", 12, 90), ("short", "dots", -12, 10), ("short", "open", -16, 95), ("short", "open", 16, 5)])
    assert 1.8 < got["short", "dots"] < 2.8 and -3.4 < got["short", "open"] < -2.4


def test_table(spark):
    data, want = rows()
    df = spark.createDataFrame(data + data[:2], SCHEMA)
    docs = spark.createDataFrame([(i, s, "en") for i, s in enumerate(SENTENCES)], "doc_id long, text string, lang string")
    codes = spark.createDataFrame([("en", "English")], "code string, name string")
    assert set(map(tuple, cut_values(df, docs, codes).collect())) == want
    shares = {(r.source, r.field): (r["values"], r.cut) for r in cut_shares(df, docs, codes).collect()}
    assert shares["s0", "excerpt"][1] == 2 and shares["s3", "short"][1] == 0
    assert cut_values(df.limit(0), docs.limit(0), codes.limit(0)).count() == 0
