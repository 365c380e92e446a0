"""Languages of documents and of the passages in them, by rank order of n-grams.

A language's profile is the order of its most frequent character n-grams (one to five letters within padded words), counted
over all documents by their labels; as some labels are wrong, an n-gram counts for a language only where it is not far
rarer than in another. A text's distance to a profile is out-of-place: the sum over the text's most frequent n-grams of how
far their ranks differ, the profile's length for those it lacks. A document is compared as a whole. A sentence's n-grams
all occur about once, so they share the first rank and the sum runs over its words, whose sums are remembered. Neighbouring
sentences of one language make a passage; a passage in another language than the document's counts where it holds a whole
sentence, is clearly nearer to that language, and is so again when compared as a text of its own.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.runtime import ship, written

#: Length of a profile, and n-grams of a text that are compared with it.
PROFILE, TOP = 2000, 400
#: Greatest length of an n-gram.
GRAM = 5
#: An n-gram is no sign of a language in which it is so much rarer than in another.
PURITY = 0.12
#: A sentence counts with this many words and letters, names aside, and as another language with this lead (in profile lengths
#: per n-gram). Without a stop at its end it needs twice the words and OPEN_LEAD.
LEAST_WORDS, LEAST_LETTERS, LEAD, OPEN_LEAD = 3, 12, 0.035, 0.12
WORDS_KEPT = 300_000
#: Languages there may be: they are collected to the driver.
CODES_MAX = 10_000

#: ISO 639-2 and 639-3 codes beside the two-letter ones: fixed values.
THREE_LETTERS = {
    "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "ita": "it", "nld": "nl", "dut": "nl", "swe": "sv", "pol": "pl", "rus": "ru", "ukr": "uk", "jpn": "ja",
    "ces": "cs", "cze": "cs", "dan": "da", "nor": "no", "fin": "fi", "tur": "tr", "zho": "zh", "chi": "zh", "kor": "ko", "ara": "ar", "hun": "hu", "ron": "ro", "rum": "ro", "ell": "el", "gre": "el",
}
#: What the languages call themselves: fixed values.
OWN_NAMES = {
    "deutsch": "de", "français": "fr", "francais": "fr", "español": "es", "espanol": "es", "castellano": "es", "português": "pt", "portugues": "pt", "italiano": "it", "nederlands": "nl", "svenska": "sv",
    "polski": "pl", "русский": "ru", "українська": "uk", "日本語": "ja",
}

#: A word, or what ends a sentence: a stop followed by a blank or a closing mark, an East Asian stop, a line end.
_TOKEN = re.compile("[^\\W\\d_]+|[.!?…]+(?=[\\s\"”’»)\\]]|$)|[。！？\\n\\r]")
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
_WIDE = re.compile("[぀-ヿ㐀-鿿ｦ-ﾟ]")


def code_of(label: Column, codes: dict[str, str]) -> Column:
    """The code a label names, or null: any case, blanks, regions, names and three-letter codes."""
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace(label, r"[\s\x{A0}]+", " "))), "_", "-")
    known = {c.lower(): c for c in codes} | {n.lower(): c for c, n in codes.items() if n} | {k: v for k, v in (THREE_LETTERS | OWN_NAMES).items() if v in codes}
    table = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, plain), F.try_element_at(table, F.regexp_extract(plain, r"^([^\s-]+)-[a-z0-9-]+$", 1)), F.try_element_at(table, F.regexp_extract(plain, r"^(\S+) ?\(.*\)$", 1)))


def codes_of(lang_codes: DataFrame) -> dict[str, str]:
    """code -> name. More than CODES_MAX languages are no table of languages: an error, as they are collected."""
    got = lang_codes.select("code", "name").where("code is not null").distinct().limit(CODES_MAX + 1).collect()
    if len(got) > CODES_MAX:
        raise ValueError(f"more than {CODES_MAX} languages")
    return {r[0]: r[1] for r in sorted(got, key=lambda r: (r[0], r[1] or ""))}


def grams(word: str) -> list[str]:
    """The n-grams of a word; words of scripts without blanks have no edges."""
    if _WIDE.search(word):
        return [word[i : i + n] for n in (1, 2, 3) for i in range(len(word) - n + 1)]
    w = f"_{word}_"
    return [w[i : i + n] for n in range(1, GRAM + 1) for i in range(len(w) - n + 1) if w[i : i + n] != "_"]


def tokens(text: str) -> list[str]:
    if not text.isascii():
        for c in _INVISIBLE:
            if c in text:
                text = text.replace(c, "")
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
    return _TOKEN.findall(text)


def _words_by_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter[str]] = {}

    def flush():
        langs, found, n = [], [], []
        for lang, of in counts.items():
            for w, k in of.items():
                if w[0].isalpha():
                    langs.append(lang)
                    found.append(w.lower())
                    n.append(k)
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if lang not in counts:
                counts[lang] = Counter()
            counts[lang].update(tokens(text))
        if sum(map(len, counts.values())) > 300_000:
            yield flush()
    yield flush()


def _grams_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[tuple[str, str]] = Counter()
    for b in batches:
        for lang, word, n in zip(*(b.column(i).to_pylist() for i in range(3))):
            for g in grams(word):
                counts[lang, g] += n
    keys = list(counts)
    for s in range(0, len(keys), 50_000):
        part = keys[s : s + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in part], pa.string()), pa.array([k[1] for k in part], pa.string()), pa.array([counts[k] for k in part], pa.int64())], names=["lang", "gram", "n"])


@dataclass
class Profiles:
    """ranks[gram][i]: rank of the n-gram in language i's profile, PROFILE where it is not in it."""

    langs: list[str]
    ranks: dict[str, np.ndarray]


def train(docs: DataFrame, lang: Column, text_col: str = "text") -> Profiles:
    """Profiles of all languages that label documents, counted over all labelled documents.

    What comes to the driver is PROFILE n-grams a language, whatever the number of documents.
    """
    ship(docs.sparkSession)
    labelled = docs.select(lang.alias("lang"), F.col(f"`{text_col}`").alias("t")).where("lang is not null and t is not null and t <> ''")
    words = labelled.mapInArrow(_words_by_label, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = words.mapInArrow(_grams_of_words, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = written(counted, "grams")
    totals = F.broadcast(counted.groupBy("lang").agg(F.sum("n").alias("total")))  # one row a language
    rate = counted.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    pure = rate.withColumn("most", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= PURITY * F.col("most"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = pure.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE).select("lang", "gram", "rank").collect()
    langs = sorted({r[0] for r in top})
    at = {x: i for i, x in enumerate(langs)}
    ranks: dict[str, np.ndarray] = {}
    for x, g, r in top:
        if g not in ranks:
            ranks[g] = np.full(len(langs), PROFILE, np.int32)
        ranks[g][at[x]] = r - 1
    return Profiles(langs, ranks)


class _Words(dict):
    """Numbers of words, given at first sight; what ends a sentence has -2 with a stop, -1 without."""

    def __init__(self, add):
        self.add = add

    def __missing__(self, t: str) -> int:
        i = self[t] = self.add(t) if t[0].isalpha() else -2 if t > "\r" else -1
        return i


class Classifier:
    """Distances of documents and sentences to the profiles; one a task, words remembered."""

    def __init__(self, p: Profiles):
        self.langs = p.langs
        self.gram_id = {g: i for i, g in enumerate(p.ranks)}
        self.ranks = np.stack([*p.ranks.values()]).astype(np.int16) if p.ranks else np.zeros((0, len(p.langs)), np.int16)
        self._forget()

    def _forget(self) -> None:
        self.word_id = _Words(self._add)
        self.word_grams: list[bytes] = []  # packed int32: joining bytes is much quicker than joining arrays
        self.sums = np.zeros((1024, len(self.langs)), np.float32)
        self.sizes = np.zeros(1024, np.float32)
        self.letters = np.zeros(1024, np.int32)
        self.name = np.zeros(1024, bool)
        self.settled = 0

    def _add(self, w: str) -> int:
        i = len(self.word_grams)
        if i >= len(self.sums):
            for name in ("sums", "sizes", "letters", "name"):
                x = getattr(self, name)
                setattr(self, name, np.concatenate([x, np.zeros_like(x)]))
        self.name[i] = w[0].isupper() and w[1:2].islower()
        w = w.lower()
        every = grams(w)
        gram_id = self.gram_id
        self.word_grams.append(np.array([gram_id[g] for g in every if g in gram_id], np.int32).tobytes())
        self.sizes[i] = len(every)
        self.letters[i] = len(w) * (3 if _WIDE.search(w) else 1)
        return i

    def _settle(self) -> None:
        """Sums of the words seen since the last time, all at once."""
        new = self.word_grams[self.settled :]
        if not new:
            return
        lengths = np.array([len(g) // 4 for g in new])
        running = np.zeros((int(lengths.sum()) + 1, len(self.langs)), np.int64)
        np.cumsum(self.ranks[np.frombuffer(b"".join(new), np.int32)], 0, out=running[1:])
        to = np.cumsum(lengths)
        rows = slice(self.settled, len(self.word_grams))
        self.sums[rows] = (running[to] - running[to - lengths]) / PROFILE + (self.sizes[rows] - lengths)[:, None]
        self.settled = len(self.word_grams)

    def out_of_place(self, words: np.ndarray) -> np.ndarray:
        """Distance of a text, given by its words, to each profile: 0 the same order, 1 nothing in common."""
        known = self.word_grams
        # what is in no profile is as far from each and is not counted
        every = np.frombuffer(b"".join([known[i] for i in words.tolist()]), np.int32)
        if not len(every):
            return np.ones(len(self.langs))
        every = np.sort(every)
        starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        some, counts = every[starts], -np.diff(starts, append=len(every))
        if len(some) > 2 * TOP:  # the TOP first are among those no rarer than the TOP-th
            least = np.partition(counts, TOP - 1)[TOP - 1]
            near = np.flatnonzero(counts <= least)
            counts, some = counts[near], some[near]
        order = np.argsort(counts, kind="stable")[:TOP]
        counts, top = counts[order], some[order]
        first = np.searchsorted(counts, counts, "left").astype(np.int16)  # equal counts share a rank
        ranks = self.ranks[top]
        gap = np.abs(ranks - first[:, None])
        gap[ranks >= PROFILE] = PROFILE
        return gap.sum(0, dtype=np.int64) / (PROFILE * len(top))

    def nearest(self, text: str) -> str | None:
        """The language nearest to a short text as one sentence; None without words or profiles."""
        if len(self.word_grams) > WORDS_KEPT:
            self._forget()
        ids = [i for i in map(self.word_id.__getitem__, tokens(text)) if i >= 0]
        self._settle()
        return self.langs[int(self.sums[ids].sum(0).argmin())] if ids and self.langs else None

    def passages(self, text: str) -> list[tuple[int, int, str, float]]:
        """(first sentence, sentences, language, confidence) of a text, in order; [] without a sentence."""
        return self.passages_of([text])[0]

    def passages_of(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """The passages of many texts at once."""
        if len(self.word_grams) > WORDS_KEPT:
            self._forget()
        flat: list[int] = []
        ends_at = []
        number = self.word_id.__getitem__
        for text in texts:
            if text:
                flat += map(number, tokens(text))
            flat.append(-1)  # no sentence goes on in the next text
            ends_at.append(len(flat))
        self._settle()
        toks = np.array(flat, np.int64)
        is_word = toks >= 0
        ids = toks[is_word]
        if not len(ids):
            return [[] for _ in texts]
        before = np.r_[False, is_word[:-1]]
        opens, closes = is_word & ~before, ~is_word & before
        words_to, sentences_to = np.r_[0, np.cumsum(is_word)], np.r_[0, np.cumsum(opens)]
        starts, stopped = words_to[:-1][opens], toks[closes] == -2
        from_ = [0, *ends_at[:-1]]
        at = list(zip(words_to[from_].tolist(), words_to[ends_at].tolist(), sentences_to[from_].tolist(), sentences_to[ends_at].tolist()))
        whole = [self.out_of_place(ids[a:b]) if b > a else None for a, b, _, _ in at]
        main = np.repeat([int(np.argmin(w)) if w is not None else 0 for w in whole], [d - c for _, _, c, d in at])
        plain = ~self.name[ids]  # names tell nothing of the sentence they are in
        plain[starts] = True
        sums = np.add.reduceat(self.sums[ids] * plain[:, None], starts, 0)
        sizes = np.add.reduceat(self.sizes[ids] * plain, starts)
        letters = np.add.reduceat(self.letters[ids] * plain, starts)
        words = np.add.reduceat(plain.astype(np.int64), starts)
        words = np.maximum(words, letters // (3 * LEAST_LETTERS) * LEAST_WORDS)  # scripts without blanks
        near = sums / np.maximum(sizes, 1)[:, None]
        best, row = near.argmin(1), np.arange(len(near))
        lead = near[row, main] - near[row, best]
        full = (letters >= LEAST_LETTERS) & (words >= LEAST_WORDS)
        other = (best != main) & full & np.where(stopped, lead >= LEAD, (lead >= OPEN_LEAD) & (words >= 2 * LEAST_WORDS))
        lang, ends = np.where(other, best, main), np.r_[starts[1:], len(ids)]
        return [self._cut(ids, starts[c:d], ends[c:d], lang[c:d], int(main[c]), w) if d > c else [] for (_, _, c, d), w in zip(at, whole)]

    def _cut(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: np.ndarray, main: int, whole: np.ndarray) -> list[tuple[int, int, str, float]]:
        """Runs of sentences of one language; a run in another than the document's must be so as a text of its own."""
        cuts = [0, *(np.flatnonzero(lang[1:] != lang[:-1]) + 1).tolist(), len(lang)]
        out: list[tuple[int, int, str, float]] = []
        for a, z in zip(cuts, cuts[1:]):
            x = int(lang[a])
            own = whole if z - a == len(lang) else self.out_of_place(ids[starts[a] : ends[z - 1]])
            if x != main and int(np.argmin(own)) != x:
                x = main
            rest = np.delete(own, x)
            sure = max(0.0, min(1.0, float((rest.min() - own[x]) / max(rest.min(), 1e-9)))) if len(rest) else 1.0
            if out and out[-1][2] == self.langs[x]:
                first = out[-1][0]
                own = self.out_of_place(ids[starts[first] : ends[z - 1]])
                rest = np.delete(own, x)
                sure = max(0.0, min(1.0, float((rest.min() - own[x]) / max(rest.min(), 1e-9)))) if len(rest) else 1.0
                out[-1] = (first, z - first, self.langs[x], sure)
            else:
                out.append((a, z - a, self.langs[x], sure))
        return out


def passages(docs: DataFrame, lang_codes: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(doc_id, label, passage_no, first_sentence, sentences, lang, confidence) of every passage of every document.

    label is the code the document's label names, null for a missing or unknown one. Documents without a sentence (null,
    empty, blank, figures only) have no passages. Repeated rows give repeated passages. An empty table gives no rows.
    Only the named columns are read, so other columns can't clash.
    """
    ship(docs.sparkSession)
    codes = codes_of(lang_codes)
    label = code_of(F.col(f"`{label_col}`"), codes) if codes else F.lit(None).cast("string")
    profiles = train(docs, label, text_col)
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), label.alias("label"), F.col(f"`{text_col}`").alias("t")).where("t is not null and t <> ''")
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(profiles)
        for b in batches:
            at, cols = [], [[], [], [], [], []]
            for s in range(0, b.num_rows, 100):
                texts = b.column(2).slice(s, 100).to_pylist()
                for i, got in enumerate(c.passages_of(texts) if profiles.langs else [], s):
                    for k, p in enumerate(got):
                        at.append(i)
                        for x, v in zip(cols, (k, *p)):
                            x.append(v)
            take = pa.array(at, pa.int64())
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *[pa.array(x, t) for x, t in zip(cols, kinds)]], names=["doc_id", "label", "passage_no", "first_sentence", "sentences", "lang", "confidence"])

    return base.mapInArrow(run, f"doc_id {kind}, label string, passage_no int, first_sentence int, sentences int, lang string, confidence double")


def languages(docs: DataFrame, lang_codes: DataFrame, **cols: str) -> DataFrame:
    """(doc_id, label, lang, share, confidence): each language of each document, its share of the sentences, one row each."""
    p = passages(docs, lang_codes, **cols)
    by = p.groupBy("doc_id", "lang").agg(F.first("label").alias("label"), F.sum("sentences").alias("n"), F.max("confidence").alias("confidence"))
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    return by.select("doc_id", "label", "lang", (F.col("n") / total).alias("share"), "confidence")


def mislabelled(docs: DataFrame, lang_codes: DataFrame, **cols: str) -> DataFrame:
    """(doc_id, lang): every language of each document whose label is missing, names none of its languages, or is not all.

    A right label in another spelling (case, blanks, region, name, three letters) is not wrong. Documents without a sentence
    are no case. Documents with one id are taken as one.
    """
    p = passages(docs, lang_codes, **cols)
    by = p.groupBy("doc_id").agg(F.collect_set("lang").alias("langs"), F.bool_or(F.col("label").isNull()).alias("bare"), F.collect_set("label").alias("labels"))
    wrong = F.col("bare") | (F.size("langs") > 1) | F.exists("labels", lambda x: ~F.array_contains(F.col("langs"), x))
    return by.where(wrong).select("doc_id", F.explode("langs").alias("lang"))
