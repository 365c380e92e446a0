from pyspark.sql import functions as F

from quoin.llm.language import Classifier, code_of, grams, languages, mislabelled, passages, tokens, train

EN = ["The jury will announce the winner in the autumn.", "Visitors climb the stairs to the reading room.", "The old mill was rebuilt with great care and little money.", "What does it mean to build less than before?", "The garden is open every day and costs nothing."]
DE = ["Die Jury wird den Gewinner im Herbst bekannt geben.", "Die Besucher steigen über die Treppe in den Lesesaal.", "Die alte Mühle wurde mit großer Sorgfalt und wenig Geld umgebaut.", "Was heißt es, weniger zu bauen als früher?", "Der Garten ist jeden Tag geöffnet und kostet nichts."]
FR = ["Le jury annoncera le gagnant à l’automne.", "Les visiteurs montent par l’escalier à la salle de lecture.", "Le vieux moulin a été rénové avec soin et peu d’argent.", "Que veut dire construire moins qu’avant ?", "Le jardin est ouvert tous les jours et ne coûte rien."]
JA = ["審査員は秋に勝者を発表する。", "来館者は階段を上って閲覧室へ行く。", "古い工場は丁寧に改修された。"]
CODES = [("en", "English"), ("de", "German"), ("fr", "French"), ("ja", "Japanese")]


def docs():
    rows = []
    for code, sents in (("en", EN), ("de", DE), ("fr", FR), ("ja", JA)):
        for i in range(12):
            rows.append((len(rows), " ".join(sents[i % len(sents) :] + sents[: i % len(sents)]), code, "clash"))
    n = len(rows)
    rows += [
        (n, " ".join(EN), None, ""), (n + 1, " ".join(DE), "en", ""), (n + 2, " ".join(EN[:3]) + " " + DE[0] + " " + EN[3], "EN_us", ""), (n + 3, " ".join(FR), " French ", ""),
        (n + 4, None, None, ""), (n + 5, "", "xx", ""), (n + 6, "12 345,6", None, ""), (n + 7, " ".join(EN), "eng", ""), (n + 8, " ".join(JA), "n/a", ""),
        (n + 9, "The sign reads “Der Garten” in red. " + " ".join(EN), "en-GB", ""), (n + 10, " ".join(EN * 2000), "English", ""),
    ]
    want = {(n, "en"), (n + 1, "de"), (n + 2, "en"), (n + 2, "de"), (n + 8, "ja")}
    return rows, want


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("en", " EN", "en-GB", "pt_br", "English", "deu", "xx", "", None, "und", "Deutsch", "german (at)")], "l string")
    got = [r[0] for r in df.select(code_of(F.col("l"), dict(CODES))).collect()]
    assert got == ["en", "en", "en", None, "en", "de", None, None, None, None, "de", "de"]


def test_tokens_and_grams():
    assert tokens("A b. 3.5 c!”\nd") == ["A", "b", ".", "c", "!", "\n", "d"]
    assert grams("ab") == ["a", "b", "_a", "ab", "b_", "_ab", "ab_", "_ab_"] and grams("日本") == ["日", "本", "日本"]


def test_documents_and_passages(spark):
    rows, want = docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, code string")
    codes = spark.createDataFrame(CODES, "code string, name string")
    assert set(map(tuple, mislabelled(df, codes).collect())) == want
    mixed = [r for r in passages(df, codes).orderBy("passage_no").collect() if r.doc_id == len(rows) - 9]
    assert [(r.first_sentence, r.sentences, r.lang) for r in mixed] == [(0, 3, "en"), (3, 1, "de"), (4, 1, "en")]
    assert all(0 <= r.confidence <= 1 for r in mixed)
    shares = {(r.lang): r.share for r in languages(df, codes).collect() if r.doc_id == len(rows) - 9}
    assert shares == {"en": 0.8, "de": 0.2}
    assert mislabelled(df.limit(0), codes).count() == 0 and mislabelled(df, codes.limit(0)).count() == 0


def test_held_out_sentences(spark):
    rows, _ = docs()
    df = spark.createDataFrame(rows[:48], "doc_id long, text string, lang string, code string")
    c = Classifier(train(df, F.col("lang")))
    held = [("en", "The winner was rebuilt every day."), ("de", "Der Lesesaal wird im Herbst umgebaut."), ("fr", "La salle est ouverte à l’automne."), ("ja", "工場は秋に改修された。")]
    assert [c.passages(t)[0][2] for _, t in held] == [x for x, _ in held]
