"""Template residue, filler, error pages and script notices in place of text or within it.

Positive-unlabelled naive Bayes. Trusted records come from the corpus itself: what stands as the whole title of one story and
as the whole excerpt of another, at several publishers and for several stories, names no story and tells of none, unless it is
the headline of stories and repeated as a text only below itself; and values made of placeholders only. Beside them stand the numbered reason phrases of the HTTP standard, the classic filler passage, one example of each
kind of placeholder and the printed missing values. Everything else is unlabelled. Expectation-maximisation fits log-odds of
features on a bounded sample: words, whole phrases, marks and parts of placeholders, printed missing values; passages like
the trusted ones lose their weight among the negatives and gain it among the positives. A value is scored by passages:
placeholder spans, sentences and parts between bars and dashes, and the beginnings and ends of sentences that an error text
was glued to. The record is decided by its passages: one that is residue for the greater part of its words makes the value a
case, one that merely mentions such words among others does not. Nothing is a case but by the fitted weights.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from http import HTTPStatus

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.llm.sieve import Sieve, sieve_of_texts, text_key
from quoin.runtime import scratch_path, ship, written

#: Bounds of the fitting sample: trusted phrases by their spread, unlabelled values in the order of a hash. Matching has all phrases.
TRUSTED_MAX, UNLABELLED_MAX = 5_000, 20_000
#: Publishers that must have a phrase as a whole title or a whole excerpt, for it to be trusted to be neither.
SPREAD = 3
#: What one standard record of a kind counts for among the trusted ones, as a share of them and at least.
STANDARD_SHARE, STANDARD_LEAST = 0.02, 3.0
ROUNDS = 6
#: A setting of a printed missing value is an idiom with this share of the word's distinct values, and of its sources, and so many at least.
IDIOM_SHARE, IDIOM_LEAST = 0.25, 3
#: Rates below this tell nothing; a whole phrase is more telling than a word.
FLOOR, PHRASE_FLOOR = 2e-4, 1e-6
#: Log-odds that a printed missing value or a placeholder must have.
LEAST_SPAN = 2.0
#: Log-odds of a passage and share of its words that must speak for residue.
LEAST_ODDS, LEAST_SHARE = 4.0, 0.5

#: Reason phrases of the HTTP standard with their numbers, from the standard library's table.
REASONS = tuple(f"{s.value} {s.phrase}" for s in HTTPStatus if s.value >= 400)
#: The classic filler passage and printed missing values: fixed values.
FILLER = (
    "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua", "ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat",
    "duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur", "Lorem ipsum",
)
PRINTED = ("undefined", "null", "NaN", "None", "nil", "N/A", "untitled", "no title", "(null)", "(none)", "(no title)", "(no title set)")
#: One example of each kind of placeholder, as template languages document them: fixed values.
EXAMPLES = (
    "{{{title}}}", "{{ title }}", "{% title %}", "{!! title !!}", "${title}", "{$title}", "<%= title %>", "<?= title ?>", "%%TITLE%%", "[[title]]", "[% title %]", "*|TITLE|*", "##TITLE##", "__TITLE__", "%(title)s", "@Model.Title", "[object Object]",
    "#{title}", "%s", "{# title #}",
)

#: Kinds of placeholders: sure ones by their marks alone, and those whose content must tell. Fixed patterns of public template languages.
SURE = (
    ("{{{", r"\{\{\{[^{}]{1,80}\}\}\}"), ("{{", r"\{\{[^{}]{0,80}\}\}"), ("{%", r"\{%[^%]{1,80}%\}"), ("{!!", r"\{!![^!]{1,80}!!\}"), ("${", r"\$!?\{[^{}]{1,80}\}"), ("{$", r"\{\$[^{}]{1,80}\}"), ("<%", r"(?:<|&lt;)%[^%]{1,80}%(?:>|&gt;)"),
    ("<?", r"(?:<|&lt;)\?[^?]{1,80}\?(?:>|&gt;)"), ("%%", r"%%[\w.]{2,60}%%"), ("[[", r"\[\[[\w .|:-]{1,60}\]\]"), ("[%", r"\[%[^%]{1,80}%\]"), ("*|", r"\*\|[\w.: ]{1,60}\|\*"), ("##", r"##[A-Za-z][\w.]{1,60}##"), ("__", r"(?<!\w)__[A-Za-z][\w.]{1,60}?__(?!\w)"),
    ("%(", r"%\([\w.]{1,60}\)[sd]"), ("@M", r"@(?:Model|ViewBag|model)\.\w{1,60}"), ("obj", r"\[object \w{3,20}\]"), ("#{", r"#\{[^{}]{1,80}\}"), ("%s", r"(?<![\w%])%[sd](?!\w)"), ("{#", r"\{#[^{}]{1,80}#?\}"),
)
ASK = (("{", r"(?<![{$#%])\{(?![{%$#!])[^{}\s]{1,60}\}(?!\})"), ("[", r"(?<!\[)\[(?!\[)[\w.]{1,60}\](?!\])"), ("<", r"<[a-z_][\w.-]{1,40}>"), ("%", r"(?<![\w%])%[A-Z_]{3,40}%"), ("bare", r"(?<![\w.])(?:[A-Z]{2,}(?:_[A-Z]+)+|[a-z]{2,}(?:_[a-z]+)+)(?![\w.])"))
_SPAN = re.compile("|".join(f"(?P<s{i}>{rx})" for i, (_, rx) in enumerate((*SURE, *ASK))))
_INNER = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: Printed missing values that may be a phrase of their own.
_MISSING = re.compile(r"(?:undefined|null|nan|none|nil|n/a|\(null\)|\(none\)|\(no \w+(?: set)?\)|untitled|no title)", re.I)
#: One printed missing value with the words beside it.
_MISSING_ONE = re.compile(r"(?:(\S+)\s+)?(?<![\w“‘'\"])(undefined|null|NaN)(?![\w”’'\"])(?:\s+(\S+))?")
#: None with a capital where no sentence begins, or as a heading.
_NONE = re.compile(r"(?<=[^\W\d_A-Z] )None(?= [^\W\d_])|^None(?=:)")
_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_WIDE = re.compile("[぀-ヿ㐀-鿿]")
_SPLIT = re.compile(r"(?<=[.!?。！？])[”\"’»)]*(?:\s+|(?<=[。！？]))|\s+[|–—-]\s+|\n+|(?<=\S)\s*…\s+")
_QUOTES = "“”‘’\"'«»„"


def words(text: str) -> list[str]:
    """Tokens of a passage: words in lower case, status codes as they are, other figures as 0; ideographs as pairs."""
    out = []
    for t in _TOKEN.findall(text):
        if t.isdigit():
            out.append(t if len(t) == 3 and t[0] in "45" else "0")
        elif _WIDE.search(t):
            out += [t[i : i + 2] for i in range(max(1, len(t) - 1))]
        else:
            out.append(t.lower())
    return out


def phrase(text: str) -> str:
    return " ".join(words(text))


def spans(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, content, from, to) of everything that looks like a placeholder."""
    out = []
    for m in _SPAN.finditer(text):
        i = int(m.lastgroup[1:])
        out.append(((SURE + ASK)[i][0], m[0], *m.span()))
    return out


_SURE_KINDS = {k for k, _ in SURE}


def span_features(kind: str, content: str) -> list[str]:
    """What a placeholder is made of: its marks, the words in it and how they are put together."""
    inner = content.strip("{}[]<>%$!#*|_@()=? ")
    f = ["m:" + kind, *("i:" + w.lower() for w in _INNER.findall(inner))]
    if re.search(r"[a-zA-Z]_[a-zA-Z]", inner):
        f.append("h:snake")
    if re.search(r"[a-zA-Z]\.[a-zA-Z]", inner):
        f.append("h:path")
    if re.search(r"[a-z][A-Z]", inner):
        f.append("h:camel")
    if re.fullmatch(r"[A-Z][A-Z_]+", inner):
        f.append("h:upper")
    if inner.isdigit():
        f.append("h:figure")
    return f


def only_spans(text: str) -> list[tuple[str, str, int, int]]:
    """The spans of a value that nothing but them, and separators, makes up; else none."""
    got = spans(text)
    rest, last = [], 0
    for _, _, a, b in got:
        rest.append(text[last:a])
        last = b
    return [] if re.search(r"\w", "".join(rest) + text[last:]) else got


def all_placeholders(text: str) -> bool:
    """Whether nothing but placeholders, one of a sure kind at least, and separators, makes up the value."""
    return any(k in _SURE_KINDS for k, *_ in only_spans(text))


def bare(text: str) -> str:
    """A value with its marks, but for what differs between copies: letter case, figures, blanks and full stops around it."""
    return re.sub(r"\d+", "0", text.strip().rstrip(" .!").lower())


@dataclass
class Model:
    odds: dict[str, float] = field(default_factory=dict)
    phrases: set[str] = field(default_factory=set)
    idioms: set[tuple[str, str, str]] = field(default_factory=set)  # settings of these words that recur: they belong there
    sieve: Sieve | None = None  # of all trusted phrases, where they are more than the fitting sample holds
    path: str | None = None  # the table of these phrases
    asked: set[str] = field(default_factory=set)  # runs of words that passed the sieve


def _telling(w: list[str]) -> bool:
    """Whether a phrase of these words may be matched as it is."""
    return len(w) >= 2 or bool(w) and bool(_MISSING.fullmatch(w[0]))


#: First letters of the features of placeholders; passages have the others. Each kind of trusted record has its own rates, but the
#: rest is one, as most of what looks like a placeholder is none of the rest.
_OF_SPANS = frozenset("mih")


def _odds(pos: Counter, n_pos: list[float], neg: Counter, n_neg: list[float]) -> dict[str, float]:
    """Log-odds of features by their rates among the passages ([0]) or the placeholders ([1]), whichever they belong to."""
    out = {}
    for t in {*pos, *neg}:
        k, floor = t[0] in _OF_SPANS, PHRASE_FLOOR if t[0] == "p" else FLOOR
        out[t] = math.log((pos[t] / max(n_pos[k], 1) + floor) / (neg[t] / max(sum(n_neg), 1) + floor))
    return out


def printed(text: str) -> list[tuple[str, tuple[str, str, str]]]:
    """(feature, setting) of every printed missing value within a text."""
    if not _MAY_MISS.search(text):
        return []
    out = [("x:" + m[2], setting(*m.groups())) for m in _MISSING_ONE.finditer(text)]
    return out + [("x:None", ("", "None", ""))] * bool(_NONE.search(text))


def features(part: str, phrases: set[str], idioms: set) -> set[str]:
    """Features of a passage: its words, itself if it is a trusted phrase, and its printed missing values but for idioms."""
    w = words(part)
    out = {"w:" + t for t in w} | {x for x, at in printed(part) if at not in idioms}
    whole = " ".join(w)
    return out | {"p:" + whole} if whole in phrases else out


def fit(trusted: list[tuple[str, int]], placeholders: list[str], unlabelled: list[str], rounds: int = ROUNDS, idioms: set[tuple[str, str, str]] = frozenset()) -> Model:
    """Naive Bayes from trusted phrases (with weights), placeholder values and unlabelled values, by expectation-maximisation."""
    m = Model(idioms=set(idioms))
    known = [(words(t), float(min(n, 5))) for t, n in trusted if not all_placeholders(t)]  # those are counted by their parts
    spanned = {bare(t): (got, float(min(n, 5))) for t, n in trusted if (got := only_spans(t))}
    standard = [words(t) for t in (*REASONS, *FILLER, *PRINTED)]
    m.phrases = {" ".join(w) for w in (*(w for w, _ in known), *standard) if _telling(w)}
    sure_pos: Counter[str] = Counter()
    n_sure = [0.0, 0.0]  # passages, placeholders
    for w, k in [*known, *((w, STANDARD_LEAST) for w in standard)]:
        for t in {"w:" + t for t in w} | {"p:" + " ".join(w)}:
            sure_pos[t] += k
        n_sure[0] += k
    for got, k in [*((spans(text), 1.0) for text in placeholders), *spanned.values()]:
        for kind, content, *_ in got:
            for f in set(span_features(kind, content)):
                sure_pos[f] += k
            n_sure[1] += k
    each = [max(STANDARD_LEAST, STANDARD_SHARE * n) for n in n_sure]
    for text in EXAMPLES:
        for kind, content, *_ in spans(text):
            for f in set(span_features(kind, content)):
                sure_pos[f] += each[1]
            n_sure[1] += each[1]
    for x in ("undefined", "null", "NaN", "None"):
        sure_pos["x:" + x] += each[0]
        n_sure[0] += each[0]
    bags: list[tuple[int, set[str]]] = []
    known_bags: list[bool] = []  # a trusted phrase is one wherever it stands, so among the unlabelled too, and so is a trusted placeholder
    for text in unlabelled:
        made = [(0, b) for part in parts(text) if (b := features(part, m.phrases, m.idioms))]
        known_bags += [any(t[0] == "p" for t in b) for _, b in made]
        got = spans(text)
        known_bags += [bool(got) and bare(text) in spanned] * len(got)
        bags += made + [(1, set(span_features(k, c))) for k, c, *_ in got]
    sure_marks = {"m:" + k for k in _SURE_KINDS}
    weight = [float(k) for k in known_bags]
    for _ in range(max(1, rounds)):
        pos, neg, n_pos, n_neg = Counter(sure_pos), Counter(), list(n_sure), [0.0, 0.0]
        for (kind, b), p in zip(bags, weight):
            n_pos[kind] += p
            n_neg[kind] += 1 - p
            for t in b:
                if p > 0.01:
                    pos[t] += p
                neg[t] += 1 - p
        m.odds = _odds(pos, n_pos, neg, n_neg)
        prior = -5.0
        new = []
        for (_, b), is_known in zip(bags, known_bags):
            if is_known:
                new.append(1.0)
                continue
            strong = [t for t in b if m.odds.get(t, 0.0) > 1.0]
            z = prior + sum(m.odds.get(t, 0.0) for t in b)
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) if len(strong) * 2 >= len(b) and (len(strong) >= 2 or b & sure_marks) else 0.0)
        if max((abs(x - y) for x, y in zip(new, weight)), default=0.0) < 1e-3:
            break
        weight = new
    return m


def parts(text: str) -> list[str]:
    return [p for p in _SPLIT.split(text) if p and p.strip()]


def _speaks(m: Model, toks: list[str], whole: bool) -> bool:
    """Whether a run of words is residue, by the odds of the whole phrase, or by its words' and for the greater part of them."""
    if not toks:
        return False
    run = " ".join(toks)
    if m.odds.get("p:" + run, 0.0) >= LEAST_ODDS and _telling(toks):
        return True
    if m.sieve is not None and text_key(run) in m.sieve:
        m.asked.add(run)
    got = [m.odds.get("w:" + t, 0.0) for t in toks]
    strong = sum(g > 1.0 for g in got)
    return sum(got) >= LEAST_ODDS + (0 if whole else 4) and strong >= max(2, LEAST_SHARE * len(toks)) and not any(g < -2.5 for g in got)


_MAY_SPAN = re.compile(r"[{}<\[%#*@_]")
_MAY_MISS = re.compile(r"undefined|null|NaN|None")


def setting(before: str | None, word: str, after: str | None) -> tuple[str, str, str]:
    return (before or "").lower(), word, (after or "").lower()


def residue(m: Model, text: str | None) -> bool:
    """Whether a value consists of residue or contains some."""
    if not text or not text.strip():
        return False
    odds = m.odds
    if any(odds.get(x, 0.0) >= LEAST_SPAN and at not in m.idioms for x, at in printed(text)):
        return True
    for kind, content, a, b in spans(text) if _MAY_SPAN.search(text) else ():
        f = span_features(kind, content)
        inner = [odds.get(x, 0.0) for x in f if x[0] in "ih"]
        if kind in _SURE_KINDS:
            if odds.get("m:" + kind, 0.0) + max(0.0, sum(inner) / max(1, len(inner))) >= LEAST_SPAN and (kind != "[[" or re.search(r"\w", content)):
                return True
            continue
        alone = not re.search(r"\w", text[:a] + text[b:])
        if kind == "bare":
            # a name with underscores is a key when all of its words are words of keys
            if inner and min(inner) > 0.5 and (alone or text[a:b].isupper() or min(inner) > 2.0):
                return True
        elif inner and max(inner) > 0.5 and (sum(inner) / len(inner) > 1.0 and max(inner) > 2.0 or "h:figure" in f and alone or {"h:upper", "h:snake"} <= {*f} or {"h:path"} & {*f} and max(inner) > 1.0):
            return True
    toks = words(text)
    if _speaks(m, toks, True):
        return True
    for p in parts(text):
        toks = words(p)
        if not toks or p.strip()[0] in _QUOTES:
            continue
        strong = [odds.get("w:" + t, 0.0) > 1.0 for t in toks]
        if _speaks(m, toks, True):
            return True
        if len(toks) > 4 and (m.sieve is not None or any(strong[:4]) or any(strong[-4:])):  # an error text glued to the beginning or the end
            cut = p.split()
            for k in range(3, min(14, len(cut))):
                for run, edge in ((cut[:k], cut[k]), (cut[-k:], cut[-k])):
                    if edge[0] in _QUOTES or run[0][0] in _QUOTES or run[-1][-1] in _QUOTES or not (edge[0].isupper() or edge[0].isdigit()):
                        continue
                    if _speaks(m, words(" ".join(run)), False):
                        return True
    return False


def judged(m: Model, text: str | None) -> tuple[bool, str | None]:
    """Whether a value is residue by the model alone; else the runs of words, one a line, that may be trusted phrases of the table."""
    m.asked.clear()
    if residue(m, text):
        return True, None
    return False, "\n".join(sorted(m.asked)) or None


def trusted_asked(df: DataFrame, m: Model) -> DataFrame:
    """(asked): those values of the column that hold a trusted phrase, joined with the whole table of phrases."""
    each = df.where("asked is not null").select("asked").distinct().withColumn("phrase", F.explode(F.split("asked", "\n")))
    return each.join(df.sparkSession.read.schema("phrase string").parquet(m.path), "phrase", "left_semi").select("asked").distinct()


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([" ".join(w) for t in b.column(0).to_pylist() if _telling(w := words(t))], pa.string())], names=["phrase"])


def idioms(rows: DataFrame, source_col: str, fields: tuple[str, ...]) -> set[tuple[str, str, str]]:
    """Settings in which a word that is also a printed missing value belongs.

    A setting counts once a distinct value and once a source, so copies and a hot source add nothing, and is measured against all
    distinct values and sources of its word. What fills a gap of a template recurs as well, but there other words stand in its place:
    in an idiom's they hardly do. At most 1 / IDIOM_SHARE settings a word pass, so few are collected.
    """
    values = rows.select(F.explode(F.array(*[F.col(f"`{f}`") for f in fields])).alias("v"), F.col(f"`{source_col}`").alias("s"))
    each = values.where("v rlike 'undefined|null|NaN'").groupBy("v", "s").agg(F.lit(1).alias("one"))
    found = F.explode(F.transform(F.regexp_extract_all("v", F.lit(_MISSING_ONE.pattern), F.lit(0)), lambda x: F.struct(*[g.alias(n) for n, g in (("word", F.regexp_extract(x, _MISSING_ONE.pattern, 2)), ("before", F.lower(F.regexp_extract(x, _MISSING_ONE.pattern, 1))), ("after", F.lower(F.regexp_extract(x, _MISSING_ONE.pattern, 3))))])))
    seen = written(each.select("v", "s", found.alias("x")).select("v", "s", "x.*").distinct(), "settings")
    spread = lambda by: seen.groupBy(*by).agg(F.count_distinct("v").alias("n"), F.count_distinct("s").alias("n_s"))
    of_word = spread(["word"]).withColumnsRenamed({"n": "all", "n_s": "all_s"})
    least = lambda n, total: F.col(n) >= F.greatest(F.lit(IDIOM_LEAST), F.col(total) * IDIOM_SHARE)
    often = spread(["word", "before", "after"]).join(F.broadcast(of_word), "word").where(least("n", "all") & least("n_s", "all_s"))
    got = {(r.before, r.word, r.after): r.n for r in often.collect() if r.before.isalpha() and r.after.isalpha()}
    if not got:
        return set()
    gap = {k: F.regexp_extract("v", rf"(?i)(?<!\S){k[0]}\s+(?!{k[1]}\s)\S+(?:\s+\S+)?\s+{k[2]}(?!\w)", 0) != "" for k in got}
    other = values.where("v is not null").agg(*[F.count_distinct(F.when(is_other, F.xxhash64("v"))).alias(f"n{i}") for i, is_other in enumerate(gap.values())]).first()
    return {k for (k, n), others in zip(got.items(), other) if others < n}


def learn(rows: DataFrame, source_col: str = "sourceId", title_col: str = "title", fields: tuple[str, ...] = ("title", "excerpt"), id_col: str = "row_id") -> Model:
    """Trusted records counted over all rows, then the model fitted on a bounded sample.

    One pass counts phrases (by a hash, each text once a source) and values, one takes the samples, one looks for idioms. The
    sample is what comes first by a hash of the row and the value itself, so it does not depend on how the rows are stored.
    """
    ship(rows.sparkSession)
    col = lambda c: F.col(f"`{c}`")
    fold = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), r"\d+", "0"))
    marks = lambda c: c.rlike(r"[{%\[<*#@_$]")
    at = range(len(fields))
    w, key, has = ([F.col(f"{k}{i}") for i in at] for k in ("w", "key", "has"))
    own = rows.select(col(source_col).alias("s"), F.xxhash64(col(id_col)).alias("h"), *[x for i, f in enumerate(fields) for x in (col(f).alias(f"v{i}"), fold(col(f)).alias(f"w{i}"), marks(col(f)).alias(f"marked{i}"))])
    # a value with marks is known by them, any other by its words
    marked_key = lambda i: F.regexp_replace(F.lower(F.rtrim(F.trim(F.col(f"v{i}")), F.lit(" .!"))), r"\d+", "0")
    own = own.select("*", *[F.xxhash64(F.when(F.col(f"marked{i}"), marked_key(i)).otherwise(w[i])).alias(f"key{i}") for i in at], *[F.coalesce(w[i] != "", F.lit(False)).alias(f"has{i}") for i in at])
    # the story that a value belongs to, by its texts; a value that stands alone has its row only
    story = F.when(sum(x.cast("int") for x in has) > 1, F.xxhash64(*key)).otherwise(F.col("h"))
    told = lambda i: reduce(Column.__or__, [has[j] & (key[j] != key[i]) for j in at if j != i], F.lit(False))

    def beside(i: int, t: int) -> Column:
        """Whether a quarter of the words of a text, or more, are words of the title over it."""
        of_text, of_title = F.split(w[i], " "), F.split(w[t], " ")
        return has[t] & (F.size(of_text) <= 4 * F.size(of_title)) & (4 * F.size(F.array_intersect(of_text, of_title)) >= F.size(of_text))

    title_at = fields.index(title_col) if title_col in fields else None
    against = lambda i: told(i) if i == title_at or title_at is None else beside(i, title_at)
    each = [F.struct(F.lit(i == title_at).alias("is_title"), F.col(f"v{i}").alias("v"), has[i].alias("has"), key[i].alias("key"), F.col(f"marked{i}").alias("marked"), against(i).alias("against")) for i in at]
    values = own.select(F.explode(F.array(*each)).alias("x"), "s", "h", story.alias("story")).select("x.*", "s", "h", "story").where("v is not null and trim(v) <> ''")
    t_only = lambda c: F.when(F.col("is_title"), F.col(c))
    once = values.groupBy("key", "s").agg(
        F.count("*").alias("n"), F.count_if("marked").alias("marked"), F.min(F.when(F.col("has"), t_only("v"))).alias("t"), F.max("is_title").alias("title"), F.count_if(~F.col("is_title")).alias("texts"),
        F.count_if(~F.col("is_title") & F.col("against")).alias("under"), F.count_if(F.col("is_title") & F.col("against")).alias("heads"),
        F.min(t_only("story")).alias("t_from"), F.max(t_only("story")).alias("t_to"), F.min("story").alias("from"), F.max("story").alias("to"),
    )
    once = written(once, "phrases_once")
    total, n_marked = (int(x or 0) for x in once.agg(F.sum("n"), F.sum("marked")).first())
    # publishers count as often as they have stories of their own: copies of one story add nothing
    spread = once.where("s is not null").groupBy("key").agg(
        F.count_distinct("from").alias("spread"), F.min("t").alias("t"), F.max("title").alias("title"), *[F.sum(c).alias(c) for c in ("texts", "under", "heads")],
        F.min("t_from").alias("t_from"), F.max("t_to").alias("t_to"), F.min("from").alias("from"), F.max("to").alias("to"),
    )
    # a whole title, and a whole text of another story; no headline, which heads stories and is a text below itself for the greater part
    spread = spread.where(f"spread >= {SPREAD} and title and texts > 0 and t is not null and (t_from <> `to` or t_to <> `from`) and (2 * under < texts or heads = 0)")
    spread = written(spread.select("key", "spread", "t"), "spread")
    trusted = [(r.t, r.spread) for r in spread.orderBy(F.desc("spread"), "key").limit(TRUSTED_MAX).collect()]

    def below(n: int) -> Column:
        """Rows by a range of the hash that holds somewhat more than UNLABELLED_MAX values: tasks send little more than is taken."""
        part = min(1.0, 1.2 * UNLABELLED_MAX / max(n, 1))
        return F.lit(True) if part >= 1 else F.col("h") < F.lit(int(-(1 << 63) + part * ((1 << 64) - 1)))

    plain = rows.select(F.explode(F.array(*[col(f) for f in fields])).alias("v"), F.xxhash64(col(id_col)).alias("h")).where("v is not null and trim(v) <> ''")
    taken = plain.where(below(total) | marks(F.col("v")) & below(n_marked)).select("h", "v", below(total).alias("of_all"), (marks(F.col("v")) & below(n_marked)).alias("of_marked"))
    rows_taken = sorted((r.h, r.v, r.of_all, r.of_marked) for r in taken.collect())  # 2.4 times UNLABELLED_MAX, about
    unlabelled, made = [r[1] for r in rows_taken if r[2]][:UNLABELLED_MAX], [r[1] for r in rows_taken if r[3]][:UNLABELLED_MAX]
    m = fit(trusted, [v for v in made if all_placeholders(v)], unlabelled + made, idioms=idioms(rows, source_col, fields))
    if spread.count() > TRUSTED_MAX:
        m.path = scratch_path(rows.sparkSession, "phrases")
        spread.select("t").mapInArrow(_phrases, "phrase string").distinct().write.parquet(m.path)
        stored = rows.sparkSession.read.schema("phrase string").parquet(m.path)
        m.sieve = sieve_of_texts(stored, stored.count())
    return m


def residue_values(rows: DataFrame, id_col: str = "row_id", fields: tuple[str, ...] = ("title", "excerpt"), model: Model | None = None) -> DataFrame:
    """(row_id, field) of every value that consists of residue or contains some, each once.

    Null, empty and blank values are no case. Repeated rows with one id give one row a field. An empty table gives no rows.
    Long texts are read whole; only the named columns (and those ``learn`` names) are read.
    """
    ship(rows.sparkSession)
    m = model or learn(rows, fields=fields, id_col=id_col)
    base = rows.select(F.col(f"`{id_col}`").alias("row_id"), *[F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(fields)])
    kind = base.schema["row_id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(m)  # bounded by the fitting sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            at, names, asked = [], [], []
            for col, f in enumerate(fields, 1):
                for i, text in enumerate(b.column(col).to_pylist()):
                    sure, runs = judged(model, text)
                    if sure or runs:
                        at.append(i)
                        names.append(f)
                        asked.append(runs)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(asked, pa.string())], names=["row_id", "field", "asked"])

    found = base.mapInArrow(run, f"row_id {kind}, field string, asked string")
    if m.sieve is None:
        return found.select("row_id", "field").distinct()
    found = written(found, "judged")
    rest = found.join(trusted_asked(found, m), "asked", "left_semi")
    return found.where("asked is null").select("row_id", "field").union(rest.select("row_id", "field")).distinct()


def without_residue(rows: DataFrame, id_col: str = "row_id", fields: tuple[str, ...] = ("title", "excerpt")) -> DataFrame:
    """The rows none of whose fields holds residue."""
    bad = written(residue_values(rows, id_col, fields).select(F.col("row_id").alias("__bad")).distinct(), "residue")
    return rows.join(bad, rows[id_col].eqNullSafe(F.col("__bad")), "left_anti")
