"""Text garbled by a wrong character encoding: find it, and put the original back.

The corpus itself says what its text should look like. Every distinct word of it is garbled under all chains of encodings
(written in one, read in another, up to three times over), and so are its smaller pieces: a foreign letter with its two
neighbours, and pairs of ideographs, as these scripts have no blanks. The forms that occur in the corpus make up the table of
garbled forms. The documents' tokens are hash-joined against it; a hit is a garbled token and has its original, which is
verified: it is itself a piece of the corpus and garbling it again gives the token. Replacement characters and C1 controls
are garbled in themselves.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.llm.sieve import Sieve, sieve_of_texts, text_key
from quoin.runtime import ship, shuffle_width, written

#: Encodings text is read in by mistake when it was written in UTF-8.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "iso8859-2", "iso8859-5", "iso8859-15", "cp437", "cp850", "cp852", "cp866", "mac_roman", "mac_cyrillic", "koi8-r", "gbk", "big5", "cp932", "euc_jp", "cp949")
#: One-byte encodings taken for one another: (written in, read in).
ONE_BYTE = (
    ("cp1251", "cp1252"), ("cp1251", "latin-1"), ("cp1251", "koi8-r"), ("cp1251", "mac_roman"), ("cp1251", "cp866"), ("koi8-r", "cp1251"), ("koi8-r", "cp1252"), ("koi8-r", "latin-1"), ("cp866", "cp1251"),
    ("cp866", "cp1252"), ("iso8859-5", "cp1251"), ("iso8859-5", "cp1252"), ("cp1250", "cp1252"), ("iso8859-2", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "iso8859-2"), ("cp1252", "cp437"), ("cp1252", "cp850"),
    ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1254", "cp1252"), ("cp1257", "cp1252"), ("cp852", "cp1250"), ("cp852", "cp1252"),
    ("cp1250", "cp852"), ("mac_cyrillic", "cp1251"), ("cp1252", "cp932"), ("cp1252", "gbk"), ("cp1251", "gbk"),
)
#: East Asian encodings read as one-byte ones or as each other.
WIDE = (("cp932", "cp1252"), ("cp932", "latin-1"), ("cp932", "mac_roman"), ("cp932", "cp1251"), ("cp932", "cp437"), ("cp932", "gbk"), ("cp932", "euc_jp"), ("euc_jp", "cp1252"), ("euc_jp", "latin-1"), ("euc_jp", "cp932"), ("gbk", "cp1252"), ("gbk", "latin-1"), ("big5", "cp1252"))
#: Codes that are written in one of these and read as UTF-8, each bad byte becoming U+FFFD.
LOST = ("cp1252", "cp1250", "cp1251", "koi8-r", "cp932", "mac_roman")
#: UTF-8 read wrongly, written as UTF-8 again, and so on.
TWICE = (("cp1252", "cp1252"), ("latin-1", "latin-1"), ("cp1252", "latin-1"), ("latin-1", "cp1252"), ("cp1250", "cp1250"), ("cp1251", "cp1251"), ("mac_roman", "mac_roman"), ("cp1252", "cp1252", "cp1252"), ("latin-1", "latin-1", "latin-1"))

#: Share of a value's foreign words that one chain must make clean where the corpus can't tell.
OWN_SHARE = 0.8
#: Lengths that pairs of ideographs have when garbled: into ideographs, into letters and signs, and that twice.
TO_WIDE, TO_LETTERS, TO_LETTERS_TWICE = (2, 3), (4, 5, 6), (12,)
WINDOWS = TO_WIDE + TO_LETTERS + TO_LETTERS_TWICE
#: Texts of scripts without blanks are words up to this length; longer ones are made of pairs of ideographs, which find them too.
UNSPACED = 60

_C1 = re.compile("[\x80-\x9f]")
_SURE = re.compile("[\x80-\x9f�]")
_RUN = re.compile(r"[^\x00-\x7f]+")
_ASKED = re.compile(r"[^\W\d_]\?+[^\W\d_]")
#: Characters of the Western code pages.
_WEST = re.compile("[\x00-\u017fƒˆ˜–-™€]*")
_CJK = re.compile("[぀-ヿ㐀-鿿가-힯]{2,}")
_NO_KANA = re.compile("[^\x00-\x7fぁ-ヿ]{6,}")
_CASE_FLIP = re.compile("[a-zß-öø-ÿа-џ][A-ZÀ-ÖØ-ÞА-ЯЀ-Џ]")
_IDEOGRAPH = re.compile("[぀-ヿ㐀-鿿가-힯]")
#: Characters that hardly occur in words but often in garbled ones.
_ODD = re.compile("[\u0080-¿ƒˆ˜‘-›€™ŒœŠšŸŽž∀-⋿⌠-◿�]")
#: ASCII and the marks that typesetting puts beside words on purpose.
_MARKS = re.compile(r"(?=.*[^\x00-\x7f])[\x00-\x7f–-‧‹›™®©«»°·]*")
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@lru_cache(maxsize=4096)
def _byte(b: int, codec: str) -> str:
    try:
        return bytes([b]).decode(codec)
    except UnicodeDecodeError:
        return chr(b)


def _read(raw: bytes, codec: str) -> str:
    """Read raw in a codec; bytes without a meaning become C1 controls, as browsers have it."""
    try:
        return raw.decode(codec)
    except UnicodeDecodeError:
        pass
    if codec in ("gbk", "big5", "cp932", "euc_jp", "cp949"):
        return raw.decode(codec, "replace")
    return "".join(_byte(b, codec) for b in raw)


def _variants(g: str) -> Iterator[str]:
    """What later steps make of a garbled form: controls dropped or replaced, no-break spaces made blanks, case folded."""
    forms = [g]
    if _C1.search(g):
        forms += [_C1.sub("", g), _C1.sub("�", g), _C1.sub("?", g)]
    for f in forms:
        yield f
        yield f.lower()
        yield f.upper()
        if "\xa0" in f:
            yield f.replace("\xa0", "")
            if _WEST.fullmatch(f):  # elsewhere what the blank leaves may be a word of its own
                yield from (x for x in (f.split("\xa0", 1)[0], f.rsplit("\xa0", 1)[1]) if len(x) > 1)


def garbled_forms(word: str) -> dict[str, tuple[int, bool]]:
    """Every garbled form of a word: its number of steps, and whether it took a one-byte chain."""
    return {f: v[:2] for f, v in _forms(word).items()}


def _forms(word: str) -> dict[str, tuple[int, bool, int]]:
    """Garbled forms as above, with the set of one-byte chains that lead to each, as bits."""
    out: dict[str, tuple[int, bool, int]] = {}

    def put(form: str, steps: int, one_byte: bool, chain: int = 0) -> None:
        if form.casefold() == same:
            return  # this chain leaves the word as it is
        for f in _variants(form):
            if len(f) > 1 and f.casefold() != same and (not f.isascii() or "?" in f) and f not in out and not (one_byte and _MARKS.fullmatch(f)):
                out[f] = (steps, one_byte, 1 << chain if one_byte else 0)
            elif one_byte and f in out and out[f][1]:
                out[f] = (*out[f][:2], out[f][2] | 1 << chain)

    same, raw = word.casefold(), word.encode("utf-8", "replace")
    for codec in READ_AS:
        put(_read(raw, codec), 1, False)
    put(word.encode("ascii", "replace").decode(), 1, True)
    put("".join(c if ord(c) < 128 else "?" * len(c.encode("utf-8", "replace")) for c in word), 1, True)
    for chain in TWICE:
        form = word
        for codec in chain:
            form = _read(form.encode("utf-8", "replace"), codec)
        put(form, len(chain), False)
        put(_C1.sub("", form), len(chain), False)
    for i, (write, read) in enumerate(ONE_BYTE):
        try:
            put(_read(word.encode(write), read), 1, True, i + 1)
        except UnicodeEncodeError:
            pass
    for write, read in WIDE if _IDEOGRAPH.search(word) else ():
        try:
            put(_read(word.encode(write), read), 1, False)
        except UnicodeEncodeError:
            pass
    for i, write in enumerate(LOST, len(ONE_BYTE) + 1):
        try:
            put(word.encode(write).decode("utf-8", "replace"), 1, True, i)
            put(word.encode(write, "replace").decode(write), 1, True, i)
        except UnicodeEncodeError:
            pass
    return out


def _windows(run: str, sizes: tuple[int, ...]) -> list[list[str]]:
    return [["c:" + run[i : i + size] for i in range(len(run) - size + 1)] for size in sizes]


def pieces(text: str, of_corpus: bool) -> set[str]:
    """The pieces of a text: w:word, x:foreign letters with their neighbours, c:pairs of ideographs or windows of odd runs.

    of_corpus: pieces to be garbled; otherwise pieces to be looked up.
    """
    out: set[str] = set()
    if text.isascii() and "?" not in text:
        return out
    for tok in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "):
        if tok.isascii():
            if not of_corpus and "?" in tok and _ASKED.search(tok):
                out.add("w:" + tok.strip(_EDGE))
            continue
        word = tok.strip(_EDGE)
        wide = bool(_IDEOGRAPH.search(tok))
        if not wide or len(word) <= UNSPACED:
            out.add("w:" + word)
        for m in _RUN.finditer(tok):
            a, b = m.span()
            if b - a <= 12 or not wide and m[0] != word:  # a long word that is all run is looked up as a word
                out.add(f"x:{tok[a - 1] if a else '^'}{m[0]}{tok[b] if b < len(tok) else '$'}")
        if of_corpus:
            for m in _CJK.finditer(tok) if wide else ():
                run = m[0]
                out.update("c:" + run[i : i + 2] for i in range(len(run) - 1))
        elif len(tok) >= 6:
            if len(_ODD.findall(tok)) * 4 >= len(tok):
                out.update(*_windows(tok, TO_LETTERS + TO_LETTERS_TWICE))
            for m in _NO_KANA.finditer(tok):  # garbled ideographs hold no kana, and no plain word's run of letters
                run = m[0]
                if _IDEOGRAPH.search(run):
                    out.update(*_windows(run, TO_WIDE + TO_LETTERS))
                elif not run.isalpha() or _CASE_FLIP.search(run):
                    out.update(*_windows(run, TO_LETTERS))
    return out


def _garbled_pieces(piece: str) -> dict[str, tuple[int, bool, int]]:
    kind, body = piece[:2], piece[2:]
    if kind == "w:":
        return _forms(body)
    if kind == "c:":
        return {f: v for f, v in _forms(body).items() if len(f) in WINDOWS and not v[1]}
    # the neighbours may themselves be marks of an edge, and stay; only chains of several bytes are told by a letter alone
    a, run, b = body[0], body[1:-1], body[-1]
    got = {}
    for f, v in _forms(run).items():
        if not v[1] and len(f) > len(run) and not f.isascii() and not _SURE.search(f):
            got[a + f + b] = v
    return got


def _corpus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of pieces by source, summed up before they leave the task."""
    counts: Counter[tuple[str, str]] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["piece", "s", "n"])
        counts.clear()
        return out

    for b in batches:
        sources = b.column(1).to_pylist()
        for col in range(2, b.num_columns):
            for s, text in zip(sources, b.column(col).to_pylist()):
                if text:
                    counts.update((p, s) for p in pieces(text, True))
        if len(counts) > 300_000:
            yield flush()
    yield flush()


def _lookup(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows: list[int] = []
            names: list[str] = []
            got: list[str] = []
            of: list[str] = []
            for col, field in enumerate(fields, 2):
                for i, s, text in zip(ids, sources, b.column(col).to_pylist()):
                    if not text:
                        continue
                    found = {"!"} if _SURE.search(text) else set()
                    found |= pieces(text, False)
                    rows += [i] * len(found)
                    names += [field] * len(found)
                    got += found
                    of += [s] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(rows, b.column(0).type), pa.array(names, pa.string()), pa.array(got, pa.string()), pa.array(of, pa.string())], names=["row_id", "field", "piece", "s"])

    return run


def _images(sieve) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: _garble(batches, sieve.value)


def _garble(batches: Iterator[pa.RecordBatch], sieve: Sieve) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, 2000):
            part = b.slice(s, 2000)
            g, o, n, n_s, steps, one, chains = [], [], [], [], [], [], []
            for piece, count, spread in zip(*[part.column(i).to_pylist() for i in range(3)]):
                if _SURE.search(piece):
                    continue  # surely garbled itself
                for form, (k, single, bits) in _garbled_pieces(piece).items():
                    if text_key(piece[:2] + form) not in sieve:
                        continue
                    g.append(piece[:2] + form)
                    o.append(piece)
                    n.append(count)
                    n_s.append(spread)
                    steps.append(k)
                    one.append(single)
                    chains.append(bits)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(o, pa.string()), pa.array(n, pa.int64()), pa.array(n_s, pa.int64()), pa.array(steps, pa.int32()), pa.array(one, pa.bool_()), pa.array(chains, pa.int64())], names=["piece", "original", "original_n", "original_s", "steps", "one_byte", "chains"])


def garbled_table(vocabulary: DataFrame, looked_up: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(piece, original, steps): the garbled forms of the corpus's pieces that occur in it, each with its likeliest original.

    A form reached by one-byte chains is made of plausible letters, so there its original must be the commoner by far, in
    sources or, unless the sources say the opposite, in rows, and it must have two letters at least. An original that is garbled
    itself gives way to one that is not. The second table has the one-byte forms of which neither is the commoner by far, for
    the values they are in to decide.
    """
    seen = written(looked_up.groupBy("piece", "s").agg(F.count("*").alias("n")).groupBy("piece").agg(F.sum("n").alias("n"), F.count("*").alias("n_s")), "seen")
    sieve = seen.sparkSession.sparkContext.broadcast(sieve_of_texts(seen.select("piece"), seen.count()))
    work = vocabulary.repartition(shuffle_width(seen.sparkSession))  # few bytes, much work
    images = work.mapInArrow(_images(sieve), "piece string, original string, original_n long, original_s long, steps int, one_byte boolean, chains long")
    commoner = F.expr("original_s > 2 * n_s or original_n > 2 * n and n_s <= 2 * original_s")
    rarer = F.expr("n_s > 2 * original_s or n > 2 * original_n")
    hits = images.join(seen, "piece").withColumn("sure", F.when(F.col("one_byte"), commoner).when(F.col("piece").startswith("x:"), F.col("original_n") >= 2).when(F.col("piece").startswith("c:") & (F.length("piece") <= 5), commoner).otherwise(F.lit(True)))
    hits = written(hits.where((~F.col("one_byte") | (F.length("piece") > 3)) & (F.col("sure") | ~rarer)), "garbled")
    sure = hits.where("sure")
    clean = sure.join(sure.select(F.col("piece").alias("original")).distinct(), "original", "left_anti")
    best = F.row_number().over(Window.partitionBy("piece").orderBy("one_byte", "steps", F.desc("original_n"), "original"))
    return clean.withColumn("rank", best).where("rank = 1").select("piece", "original", "steps"), hits.where("one_byte and piece like 'w:%'")


def _hits(looked: DataFrame, tables: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(row_id, field, piece, original): what is garbled in each value.

    Besides the sure forms, a value's own words decide: one chain makes clean two of its foreign words at least and OWN_SHARE of
    them, and the originals have more sources together than the forms. Copies have no more words than one value.
    """
    table, close = tables
    sure = looked.join(table, "piece").select("row_id", "field", "piece", "original")
    each = looked.join(close, "piece").groupBy("row_id", "field", "piece").agg(F.bit_or("chains").alias("chains"), F.max("original_s").alias("o"), F.max("n_s").alias("n"), F.max(F.struct("original_s", "original_n", "original"))["original"].alias("original"))
    each = written(each, "close")
    by = each.groupBy("row_id", "field").agg(F.count("*").alias("made"), F.bit_and("chains").alias("chain"), F.sum("o").alias("o"), F.sum("n").alias("n")).where("made >= 2 and chain <> 0 and o > n")
    words = looked.where("piece like 'w:%'").join(by, ["row_id", "field"], "left_semi").groupBy("row_id", "field").agg(F.count_distinct("piece").alias("words"))
    own = by.join(words, ["row_id", "field"]).where(F.col("made") >= F.col("words") * OWN_SHARE).select("row_id", "field")
    return sure.union(each.join(own, ["row_id", "field"], "left_semi").join(table, "piece", "left_anti").select("row_id", "field", "piece", "original"))


def _parts(rows: DataFrame, id_col: str, fields: list[str], source_col: str):
    # without a column of sources each row is one of its own
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")) if source_col in rows.columns else F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    base = rows.select(F.col(f"`{id_col}`").alias("row_id"), source.alias("s"), *[F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(fields)])
    kind = base.schema["row_id"].dataType.simpleString()
    looked = written(base.mapInArrow(_lookup(fields), f"row_id {kind}, field string, piece string, s string"), "pieces")
    each = base.mapInArrow(_corpus, "piece string, s string, n long").groupBy("piece", "s").agg(F.sum("n").alias("n"))
    vocabulary = each.groupBy("piece").agg(F.sum("n").alias("n"), F.count("*").alias("n_s"))
    return base, looked, garbled_table(vocabulary, looked.where("piece <> '!'"))


def garbled_values(rows: DataFrame, id_col: str = "row_id", fields: tuple[str, ...] = ("title", "excerpt"), source_col: str = "sourceId") -> DataFrame:
    """(row_id, field) of every value that holds garbled text, restorable or not, each once.

    Null, empty and pure ASCII values without '?' inside a word are no case. An empty table gives no rows. Only the named
    columns are read, so other columns can't clash; long texts are read whole.
    """
    ship(rows.sparkSession)
    _, looked, table = _parts(rows, id_col, list(fields), source_col)
    sure = looked.where("piece = '!'").select("row_id", "field")
    return sure.union(_hits(looked, table).select("row_id", "field")).distinct()


def restored_values(rows: DataFrame, id_col: str = "row_id", fields: tuple[str, ...] = ("title", "excerpt"), source_col: str = "sourceId") -> DataFrame:
    """(row_id, field, restored, whole): garbled values with verified originals put in; whole: nothing garbled is left.

    Values of which nothing can be restored come out as they are, with whole = false.
    """
    ship(rows.sparkSession)
    base, looked, table = _parts(rows, id_col, list(fields), source_col)
    sure = looked.where("piece = '!'").select("row_id", "field", F.lit(None).cast("string").alias("piece"), F.lit(None).cast("string").alias("original"))
    hits = _hits(looked, table).union(sure).distinct()
    swaps = hits.groupBy("row_id", "field").agg(F.collect_list(F.struct("piece", "original")).alias("swaps"))
    text = F.coalesce(*[F.when(F.col("field") == f, F.col(f"f{i}")) for i, f in enumerate(fields)])
    work = base.drop("s").distinct().join(swaps, "row_id").select("row_id", "field", text.alias("t"), F.to_json("swaps").alias("s")).where("t is not null")
    kind = base.schema["row_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for b in batches:
            texts, whole = [], []
            for t, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                new = restore(t, {x["piece"]: x["original"] for x in json.loads(s) if "piece" in x})
                texts.append(new)
                whole.append(not _SURE.search(new) and len(_ODD.findall(new)) * 8 < max(8, len(new)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(np.array(whole, bool))], names=["row_id", "field", "restored", "whole"])

    return work.mapInArrow(run, f"row_id {kind}, field string, restored string, whole boolean")


def restore(text: str, swaps: dict[str, str]) -> str:
    """Put the originals in: words first, then letters with their neighbours, then windows of ideographs."""
    out = []
    for tok in re.split(r"([ \t\r\n]+)", text):
        word = tok.strip(_EDGE)
        if word and (o := swaps.get("w:" + word)):
            tok = tok.replace(word, o[2:])
        elif not tok.isascii():
            made, last = [], 0
            for m in _RUN.finditer(tok):
                a, b = m.span()
                o = swaps.get(f"x:{tok[a - 1] if a else '^'}{m[0]}{tok[b] if b < len(tok) else '$'}")
                made += [tok[last:a], o[3:-1] if o else m[0]]
                last = b
            tok = "".join([*made, tok[last:]])
            made, i = [], 0
            while i < len(tok):
                hit = next(((s, o) for s in reversed(WINDOWS) if (o := swaps.get("c:" + tok[i : i + s])) and len(tok) - i >= s), None)
                if hit:  # a pair at a time; its second half may begin the next pair
                    step = hit[0] // 2
                    nxt = None if hit[0] % 2 else swaps.get("c:" + tok[i + step : i + step + hit[0]])
                    made.append(hit[1][2] if nxt else hit[1][2:])
                    i += step if nxt else hit[0]
                else:
                    made.append(tok[i])
                    i += 1
            tok = "".join(made)
        out.append(tok)
    return "".join(out)
