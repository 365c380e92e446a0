"""Texts cut off by a field limit or a broken transfer.

A backward character n-gram model: the contexts of a place in a text are its last 3, 4, ... characters, back to the beginning
of the word before. At every place of all texts the corpus says whether a sentence ended there or the text went on, by a
letter of the same word or by another word. The counts of a value's final contexts, shorter ones interpolated into longer
ones, give the log-odds of continuation against end. Values come by kind of ending: without a stop, or with a mark that says
that there is more. How often each kind is cut is learnt by expectation-maximisation from the contexts before the mark, so a
mark weighs what the corpus shows; a length at which far more values without a stop end than at lengths near it is a field's
limit and adds the log of that ratio. What closed values of the same language and column reach, but for FALSE_SHARE of
them, is the threshold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.llm.language import Classifier, Profiles, code_of, codes_of, train
from quoin.llm.residue import Model, judged, learn, trusted_asked
from quoin.llm.sieve import sieve_of
from quoin.runtime import ship, shuffle_width, written

#: Share of the closed values that may lie above a threshold.
FALSE_SHARE = 0.01
#: Lengths of contexts; a context reaches back to the beginning of the word before at most. Shorter ones tell garbled text and names
#: from words, not ends from cuts.
ORDERS = (3, 4, 5, 6, 7, 8, 10, 12, 16)
#: Weight of the shorter context in the longer one's estimate, in places.
BACK_OFF = 2.0
#: Lengths this near, in characters, are a limit's surroundings.
NEAR = 40
#: Width of a bin of log-odds where expectation-maximisation runs on counts.
BIN = 0.25

#: Marks put where a text was cut: fixed values.
DOTS = ("…", "...", ". . .", "&hellip;", "&#8230;", "&#x2026;", "â€¦")
BRACKETS = ("[…]", "[...]", "(…)", "(...)", "[&hellip;]", "[&#8230;]", "[..]", "[. . .]")
ARROWS = ("»", "→", ">>", "&raquo;", "&rarr;")
MORE = r"read more|see more|more|continue reading|read the full story|weiterlesen|lire la suite|leer más|ler mais|leggi tutto|lees meer|läs mer|czytaj dalej|читать далее|читати далі|続きを読む"

_MORE = re.compile(rf"[\[(]?\s*(?<![^\W\d_])(?:{MORE})\s*[.:…]*\s*[\])]?\Z", re.I)
_MORE_END = {*"".join(x[-1] for x in MORE.split("|")), *"])"}
_CLOSE = "\"'”’»)]›“」』*_"
_STOP = ".!?。！？…"
_WIDE = re.compile("([぀-ヿ㐀-鿿])(?![。！？、」』…])")
_IS_WIDE = re.compile("[぀-ヿ㐀-鿿]")
_DIGITS = re.compile(r"\d")
_REFERENCE = re.compile(r"&(?:[a-z]{2,8}|#x?[0-9a-fA-F]{0,6})\Z")
_ADDRESS = re.compile(r"https?(?::/?/?\S{0,3})?\Z")
#: The base of the hash of contexts.
_BASE = np.uint64(0x100000001B3)


def chunks(text: str) -> list[str]:
    """Words with the marks at them; ideographs one by one; figures are alike but for their length."""
    t = _WIDE.sub(r"\1 ", text) if not text.isascii() else text
    return _DIGITS.sub("0", t).split()


def ends(chunk: str) -> bool:
    """Whether a sentence ends with this chunk."""
    c = chunk.rstrip(_CLOSE)
    return bool(c) and c[-1] in _STOP


def context(before: list[str], last: str) -> str:
    """The characters up to a place that contexts are taken from: the word before and this one, or a few ideographs."""
    if _IS_WIDE.match(last) and len(last) <= 2:
        wide = []
        for c in reversed(before[-4:]):
            if not _IS_WIDE.match(c):
                break
            wide.append(c)
        return "".join(reversed(wide)) + last
    return f"{before[-1] if before else ''} {last}"


def unfinished(t: str) -> bool:
    """Whether a text ends within a tag, a character reference or an address."""
    i = t.rfind("<")
    if i >= 0 and t.find(">", i) < 0 and (i + 1 == len(t) or t[i + 1].isalpha() or t[i + 1] in "/!"):
        return True
    if "&" in t[-10:] and _REFERENCE.search(t[-10:]):
        return True
    if "http" in t:
        last = t.rsplit(None, 2)
        return bool(_ADDRESS.match(last[-1].lstrip("("))) or last[-1].startswith("http") and last[-2:-1] == ["(see"]
    return t.endswith(("(see h", "(see ht", "(see htt"))


def without_marks(t: str) -> tuple[str, str]:
    """(the text before the marks that say that there is more, the kinds of these marks)."""
    kinds = set()
    while True:
        t = t.rstrip()
        got = None
        for kind, marks in (("bracket", BRACKETS), ("dots", DOTS), ("arrow", ARROWS)):
            if t.endswith(marks) or t.endswith(".") and kind == "bracket" and t[:-1].endswith(marks):
                body = t if t.endswith(marks) else t[:-1]
                mark = max((m for m in marks if body.endswith(m)), key=len)
                if mark == "»" and "«" in t and t.rfind("«") > t[:-1].rfind("»"):
                    continue  # it closes a quotation
                got, t = kind, body[: -len(mark)].rstrip(".") if kind == "dots" else body[: -len(mark)]
                break
        if got is None and t and (t[-1].lower() in _MORE_END or t[-1] in ".:") and (m := _MORE.search(t, max(0, len(t) - 60))):
            if m.start() == 0 or len(m[0].strip()) > 4 or m[0][0] in "[(":
                got, t = "phrase", t[: m.start()]
        if got is None:
            return t, "+".join(sorted(kinds))
        kinds.add(got)


def tail(text: str) -> tuple[str, str] | None:
    """(kind, context) of a value's end; None without words.

    kind: closed (ends with a stop, marks aside), open (does not), the marks that say that there is more, or broken (within a
    tag, a reference or an address).
    """
    t = text.rstrip()
    if not t:
        return None
    kind = "open"
    if unfinished(t):
        kind = "broken"
    else:
        bare = t[-1] if t[-1] not in _CLOSE else (t.rstrip(_CLOSE) or " ")[-1]
        if bare not in ".!?。！？" or t.endswith(("..", ". .")) or t[-1] in ")]»." and len(t) > 1 and (t[-2] in ")].…" or t[-1] in ")]»"):
            t, marks = without_marks(t)
            kind = marks or kind
    while kind == "open" and t:
        last = t.rsplit(None, 1)[-1]
        if ends(last) or any(x.isalnum() for x in last):
            break
        t = t[: len(t) - len(last)].rstrip()  # a dash or a quotation mark that stands alone
    c = chunks(" ".join(t.rsplit(None, 2)[-2:])) if t else []
    if not c:
        return None
    last, before = c[-1], c[:-1]
    if kind != "broken" and ends(last):
        last = last.rstrip(_CLOSE).rstrip(_STOP)
        return "closed", context(before, last)
    if not any(x.isalnum() for x in last):
        return (kind, context(before, last)) if kind != "open" else None
    return kind, context(before, last)


def _count(n_texts: int):
    """(context, ended, went_on) of all words of all texts; the last of an open value is left out. The first columns are titles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ended: Counter[str] = Counter()
        on: Counter[str] = Counter()

        def flush():
            keys = list({*ended, *on})
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([ended[k] for k in keys], pa.int64()), pa.array([on[k] for k in keys], pa.int64())], names=["context", "ended", "went_on"])
            ended.clear()
            on.clear()
            return out

        for b in batches:
            for col in range(n_texts):
                for text in b.column(col).to_pylist():
                    if not text:
                        continue
                    c = chunks(text)
                    if not c:
                        continue
                    wide = not text.isascii() and _IS_WIDE.search(text)
                    stop = [i for i, x in enumerate(c) if x[-1] in _STOP or x[-1] in _CLOSE and ends(x)]
                    at = c.copy()
                    for i in stop:
                        at[i] = c[i].rstrip(_CLOSE).rstrip(_STOP)
                    pairs = [context(c[max(0, i - 4) : i], x) for i, x in enumerate(at)] if wide else [f"{p} {x}" for p, x in zip(["", *c], at)]
                    final = len(c) - 1
                    if col == 0:
                        ended[pairs[final]] += 1
                        stop = stop[:-1] if stop and stop[-1] == final else stop
                    elif stop and stop[-1] == final:
                        final += 1
                    for i in stop:
                        ended[pairs[i]] += 1
                    gone = {*stop}
                    on.update([p for i, p in enumerate(pairs[:final]) if i not in gone] if gone else pairs[:final])
            if len(on) + len(ended) > 400_000:
                yield flush()
        yield flush()

    return run


def counts(rows: DataFrame, title: str | None, fields: tuple[str, ...]) -> DataFrame:
    """(context, ended, went_on) of all words of all titles and fields. A title is whole, wherever it ends."""
    cols = [F.col(f"`{title}`") if title else F.lit(None).cast("string"), *[F.col(f"`{f}`") for f in fields]]
    base = rows.select(*[c.alias(f"t{i}") for i, c in enumerate(cols)])
    each = base.mapInArrow(_count(len(cols)), "context string, ended long, went_on long")
    return each.groupBy("context").agg(F.sum("ended").alias("ended"), F.sum("went_on").alias("went_on"))


def context_keys(texts: list[str], inner: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, order, key, final) of the last n characters, for each n, at the end of each text and, if asked, at each place within
    its last word."""
    chars = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    edge = np.flatnonzero(chars == 10)
    start, end = edge[:-1] + 1, edge[1:]  # texts hold no line ends
    size = end - start
    at = np.arange(len(chars))
    of = np.searchsorted(edge, at, "left") - 1
    if inner:
        space = np.where(chars == 32, at, -1)
        last_space = np.maximum.reduceat(space, np.minimum(start, len(chars) - 1)) if len(start) else np.zeros(0, np.int64)
        first = np.where(last_space >= start, last_space + 1, end - 1)
        place = np.flatnonzero((chars != 10) & (of >= 0) & (of < len(texts)))
        place = place[place >= first[of[place]]]
    else:
        place = (end - 1)[size > 0]
    owner = of[place]
    room = place - start[owner] + 1
    is_final = place == end[owner] - 1
    h, power = np.zeros(len(place), np.uint64), np.uint64(1)
    out = [[], [], [], []]
    done = 0
    with np.errstate(over="ignore"):
        for n in ORDERS:
            while done < n:
                h = h + chars[np.maximum(place - done, 0)] * power
                power = power * _BASE
                done += 1
            ok = room >= n
            mixed = (h[ok] ^ (h[ok] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            for x, v in zip(out, (owner[ok], np.full(int(ok.sum()), n, np.int32), (mixed ^ (mixed >> np.uint64(32))).view(np.int64), is_final[ok])):
                x.append(v)
    return tuple(np.concatenate(x) for x in out)


def _final_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(context, n, key, loose) of the final contexts of each text."""
    for b in batches:
        for s in range(0, b.num_rows, 5000):
            part = b.slice(s, 5000)
            owner, n, key, _ = context_keys(part.column(0).to_pylist(), False)
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), pa.array(n), pa.array(key), part.column(1).take(take)], names=["context", "n", "key", "loose"])


def _all_keys(sieve):
    """(key, ended, went_on) of every place of the words' last word, summed up; only keys that some value ends with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 20_000):
                part = b.slice(s, 20_000)
                owner, _, key, final = context_keys(part.column(0).to_pylist(), True)
                keep = sieve.value.passes(key)
                owner, key, final = owner[keep], key[keep], final[keep]
                e, o = np.asarray(part.column(1))[owner], np.asarray(part.column(2))[owner]
                keys, back = np.unique(key, return_inverse=True)
                ended = np.bincount(back, np.where(final, e, 0), len(keys)).astype(np.int64)
                on = np.bincount(back, np.where(final, o, e + o), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ended), pa.array(on)], names=["key", "ended", "went_on"])

    return run


def _tails(fields: tuple[str, ...], profiles: Profiles, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        c = Classifier(profiles)
        for b in batches:
            at, out = [], [[] for _ in range(8)]
            for j, f in enumerate(fields, 2):
                for i, text in enumerate(b.column(j).to_pylist()):
                    got = tail(text) if text else None
                    if not got:
                        continue
                    kind, ctx = got
                    is_residue, asked = judged(model, text) if kind != "closed" else (False, None)
                    if is_residue:
                        continue
                    at.append(i)
                    clause = re.split(r"[.!?。！？]\s", text)[-1] if kind == "open" else None
                    for x, v in zip(out, (f, c.nearest(text), kind, ctx, len(text.rstrip()), text.count(" ") + 1, clause, asked)):
                        x.append(v)
            take = pa.array(at, pa.int64())
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *[pa.array(x, k) for x, k in zip(out, kinds)]], names=["row_id", "source", "field", "lang", "kind", "context", "length", "words", "clause", "asked"])

    return run


def cut_rates(bins: list[tuple[str, str, int, int]], rounds: int = 50) -> dict[tuple[str, str], float]:
    """(field, kind) -> log-odds that a value of this kind is cut, by expectation-maximisation over (field, kind, bin, n)."""
    by: dict[tuple[str, str], list[tuple[float, int]]] = {}
    for field, kind, x, n in bins:
        by.setdefault((field, kind), []).append((x * BIN, n))
    out = {}
    for key, rows in by.items():
        x, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
        share = 0.5
        for _ in range(rounds):
            prior = math.log(share / (1 - share))
            share = float(((n / (1 + np.exp(-np.clip(x + prior, -30, 30)))).sum() + 0.5) / (n.sum() + 1))
        out[key] = math.log(share / (1 - share))
    return out


def _chosen(rates: dict[tuple[str, str], float], field: Column, kind: Column) -> Column:
    table = F.create_map(*[x for (f, k), v in rates.items() for x in (F.lit(f"{f}|{k}"), F.lit(v))]) if rates else None
    return F.coalesce(F.try_element_at(table, F.concat_ws("|", field, kind)), F.lit(0.0)) if rates else F.lit(0.0)


def ending_odds(tails: DataFrame, words: DataFrame) -> DataFrame:
    """(context, if_closed, if_open): log-odds of continuation against end of each final context, above those of any word's end.

    The value itself is left out: a closed one's end, or an open one's, which counts once for each different last clause, as
    headlines and credits end too.
    """
    each = written(tails.groupBy("context").agg(F.count_distinct("clause").alias("loose")), "endings")
    keyed = written(each.mapInArrow(_final_keys, "context string, n int, key long, loose long"), "ending_keys")
    loose = keyed.groupBy("key").agg(F.sum("loose").alias("loose"))
    asked = written(loose, "asked_keys")
    sieve = tails.sparkSession.sparkContext.broadcast(sieve_of(asked.select("key"), asked.count()))
    work = words.repartition(shuffle_width(words.sparkSession))  # few bytes, much work
    got = work.mapInArrow(_all_keys(sieve), "key long, ended long, went_on long").groupBy("key").agg(F.sum("ended").alias("ended"), F.sum("went_on").alias("went_on"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    known = asked.join(got, "key", "left").select("key", (zero("ended") + F.col("loose")).alias("e"), zero("went_on").alias("o"))
    total = words.agg(F.sum("ended"), F.sum("went_on")).first()
    e0, o0 = float(total[0] or 0) + 1, float(total[1] or 0) + 1
    by = keyed.select("context", "n", "key").join(known, "key").groupBy("context").agg(F.array_sort(F.collect_list(F.struct("n", "e", "o"))).alias("at"))  # one entry an order

    def odds(own: float) -> Column:
        def step(p: Column, x: Column) -> Column:
            e = F.greatest(x["e"] - own, F.lit(0.0))
            return (e + BACK_OFF * p) / (e + x["o"] + BACK_OFF)

        p = F.least(F.greatest(F.aggregate("at", F.lit(e0 / (e0 + o0)), step), F.lit(1e-12)), F.lit(1 - 1e-12))
        return F.log((1 - p) / p) - math.log(o0 / e0)

    at = by.join(each, "context")
    return at.select("context", odds(1.0).alias("if_closed"), F.when(F.col("loose") > 0, odds(1.0)).otherwise(odds(0.0)).alias("if_open"))


def scored(rows: DataFrame, docs: DataFrame, lang_codes: DataFrame, id_col: str = "row_id", source_col: str = "sourceId", title: str | None = "title", fields: tuple[str, ...] = ("excerpt", "short")) -> DataFrame:
    """(row_id, source, field, lang, kind, odds, threshold, cut) of every value with words that is no residue as such."""
    ship(rows.sparkSession)
    spark = rows.sparkSession
    codes = codes_of(lang_codes)
    label = code_of(F.col("lang"), codes) if codes else F.lit(None).cast("string")
    profiles = train(docs, label)
    m = learn(rows, id_col=id_col, source_col=source_col)
    shared = spark.sparkContext.broadcast(m)
    model = written(counts(rows, title, fields), "contexts")
    base = rows.select(F.col(f"`{id_col}`").alias("row_id"), F.col(f"`{source_col}`").alias("source"), *[F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(fields)])
    kind, kind2 = base.schema["row_id"].dataType.simpleString(), base.schema["source"].dataType.simpleString()
    tails = base.mapInArrow(_tails(fields, profiles, shared), f"row_id {kind}, source {kind2}, field string, lang string, kind string, context string, length int, words int, clause string, asked string")
    tails = tails.withColumn("clause", F.xxhash64("clause")).withColumn("clause", F.when(F.col("kind") == "open", F.col("clause")))
    if m.sieve is not None:
        tails = written(tails, "judged")
        tails = tails.join(trusted_asked(tails, m), "asked", "left_anti")
    tails = written(tails.drop("asked"), "tails")

    odds = ending_odds(tails, model)
    base_odds = F.when(F.col("kind") == "closed", F.col("if_closed")).otherwise(F.col("if_open"))
    # a context too short for any order tells nothing
    total = written(tails.join(odds, "context", "left").withColumn("base", F.coalesce(base_odds, F.lit(0.0))).drop("context", "clause", "if_closed", "if_open"), "base_odds")

    # how often each kind of ending is cut: a table of columns x kinds x bins of log-odds
    bins = total.where("kind <> 'closed'").groupBy("field", "kind", F.round(F.col("base") / BIN).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    rates = cut_rates([tuple(r) for r in bins.collect()])

    # lengths at which values without a stop pile up are limits
    def limits(length: str, near: int) -> DataFrame:
        at = total.where("kind <> 'closed'").groupBy("field", length).agg(F.count("*").alias("n"))
        around = Window.partitionBy("field").orderBy(length).rangeBetween(-near, near)  # one row a length
        usual = (F.sum("n").over(around) - F.col("n")) / F.lit(2 * near)
        return at.select("field", length, F.greatest(F.log((F.col("n") + 1) / (usual + 1)), F.lit(0.0)).alias(f"{length}_limit"))

    rest = total.join(limits("length", NEAR), ["field", "length"], "left").join(limits("words", NEAR // 4), ["field", "words"], "left")
    limit = F.greatest(F.coalesce("length_limit", F.lit(0.0)), F.coalesce("words_limit", F.lit(0.0)))
    is_closed = F.col("kind") == "closed"
    kind_or_open = F.when(is_closed, "open").otherwise(F.col("kind"))
    rest = rest.withColumn("odds", F.col("base") + _chosen(rates, F.col("field"), kind_or_open) + F.when(is_closed, 0.0).otherwise(limit))
    bar = rest.where(is_closed).groupBy("lang", "field").agg(F.percentile_approx("odds", 1 - FALSE_SHARE, 1000).alias("bar"))  # a few rows: languages x columns
    out = rest.join(F.broadcast(bar), ["lang", "field"], "left").select("row_id", "source", "field", "lang", "kind", "odds", F.greatest(F.coalesce("bar", F.lit(0.0)), F.lit(0.0)).alias("threshold"))
    return out.withColumn("cut", (F.col("kind") != "closed") & (F.col("odds") > F.col("threshold")))


def cut_values(rows: DataFrame, docs: DataFrame, lang_codes: DataFrame, **named) -> DataFrame:
    """(row_id, field) of every value that was cut inside a word or a sentence, each once.

    Null, empty and blank values, values that end with a stop (marks aside), and residue as such are no case. An empty table
    gives no rows. Only the named columns are read, so other columns can't clash; texts are read whole.
    """
    return scored(rows, docs, lang_codes, **named).where("cut").select("row_id", "field").distinct()


def cut_shares(rows: DataFrame, docs: DataFrame, lang_codes: DataFrame, **named) -> DataFrame:
    """(source, field, values, cut, share): how many of each source's values are cut. Null sources are one."""
    s = scored(rows, docs, lang_codes, **named)
    by = s.groupBy("source", "field").agg(F.count("*").alias("values"), F.count_if("cut").alias("cut"))
    return by.select("source", "field", "values", "cut", (F.col("cut") / F.col("values")).alias("share"))
