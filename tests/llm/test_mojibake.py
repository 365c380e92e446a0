import pytest

from quoin.llm.mojibake import garbled_forms, garbled_values, pieces, restore, restored_values

CLEAN = ["La façade en brique coûte moins cher", "Die Räume für alle Bewohner", "Маленький театр за вокзалом", "レンガの外壁は水辺に建つ", "“Nobody asked” he said – it’s done…", "naprawiać zamiast burzyć"]


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp1251", "cp437", "mac_roman", "gbk"])
def test_forms_hold_each_way_of_reading(read):
    for word in ("façade", "für", "театр", "burzyć"):
        try:
            form = word.encode().decode(read)
        except UnicodeDecodeError:
            continue
        assert form in garbled_forms(word)


def test_clean_words_are_no_forms_of_themselves():
    for w in ("plain", "für", "ÇA", "театр"):
        assert w not in garbled_forms(w) and w.lower() not in garbled_forms(w) and w.upper() not in garbled_forms(w)


def test_restore_is_the_way_back():
    text = "Die Räume für alle"
    bad = text.encode().decode("cp1252")
    swaps = {"w:" + f: "w:" + w for w in text.split() for f in garbled_forms(w)}
    assert restore(bad, swaps) == text
    assert pieces("plain text", False) == set() and pieces("caf? ol?", False) == set()


def rows():
    good = [(i * 10 + k, t, t, "x") for i, t in enumerate(CLEAN) for k in range(4)]
    garble = lambda t, c: t.encode().decode(c, "replace")
    bad = [
        (1000, garble(CLEAN[0], "cp1252"), None, ""),
        (1001, "", garble(CLEAN[1], "latin-1"), ""),
        (1002, CLEAN[2].encode("cp1251").decode("latin-1"), CLEAN[2], ""),
        (1003, CLEAN[1].encode("latin-1").decode("utf-8", "replace"), "x", ""),
        (1004, None, garble(garble(CLEAN[0], "cp1252"), "cp1252"), ""),
        (1005, "plain", CLEAN[5].encode("ascii", "replace").decode(), ""),
    ]
    decoys = [(2000, "A IRMÃ® de betão", "MANHÃ… e tarde ± ½ «x» m²", ""), (2001, None, "", ""), (2002, "What? Why?", "&#233;t&eacute;", "")]
    return good + bad[:5] + decoys, {(1000, "title"), (1001, "excerpt"), (1002, "title"), (1003, "title"), (1004, "excerpt")}


def test_values(spark):
    data, want = rows()
    df = spark.createDataFrame(data + data[:3], "row_id long, title string, excerpt string, field string")
    assert set(map(tuple, garbled_values(df).collect())) == want
    got = {(r.row_id, r.field): (r.restored, r.whole) for r in restored_values(df).collect()}
    assert got[1000, "title"] == (CLEAN[0], True) and got[1001, "excerpt"] == (CLEAN[1], True) and got[1002, "title"][0] == CLEAN[2]
    assert garbled_values(df.limit(0)).count() == 0


def test_a_hot_source_and_rare_words(spark):
    text = "Маленький театр построил новый вокзал"
    bad = text.encode("koi8-r").decode("cp1251")
    rows = [(i, f"s{i}", text, None) for i in range(4)] + [(100 + i, "hot", bad, None) for i in range(30)]  # copies outnumber the clean
    rare = "Школьный сквер украсил музей"
    rows += [(200, "s1", rare, None), (201, "s2", rare, None), (300, "hot", rare.encode("koi8-r").decode("cp1251"), None)]
    df = spark.createDataFrame(rows, "row_id long, sourceId string, title string, excerpt string")
    want = {(i, "title") for i in (*range(100, 130), 300)}
    assert set(map(tuple, garbled_values(df).collect())) == want
    assert {r.restored for r in restored_values(df).collect()} == {text, rare}


def test_long_words_and_unspaced_texts(spark):
    long_word = "сверхвысокоэнергоэффективнейшегодомостроения"
    japanese = "古い倉庫を改修した図書館が水辺に開館し市民の新しい集いの場になる" * 3
    clean = [(i, f"s{i}", f"{long_word} и театр", japanese) for i in range(5)] + [(10 + i, f"s{i}", "A plain hall", japanese[i * 3 :]) for i in range(8)]
    bad = [(100, "s1", f"{long_word.encode().decode('cp1252', 'replace')} x", None)]
    assert len(bad[0][2]) > 80
    for i, codec in enumerate(("latin-1", "cp437", "cp866", "mac_roman", "cp850"), 101):
        bad.append((i, "s1", None, japanese[5:40].encode().decode(codec, "replace")))
    df = spark.createDataFrame(clean + bad, "row_id long, sourceId string, title string, excerpt string")
    assert set(map(tuple, garbled_values(df).collect())) == {(100, "title"), *((i, "excerpt") for i in range(101, 106))}
    got = {r.row_id: r.restored for r in restored_values(df).collect()}
    assert got[102] == japanese[5:40] and got[103] == japanese[5:40]
