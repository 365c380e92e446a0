"""Text scalars as Column -> Column, all of them built in: no Python in the data path.

White space is what the web's language calls so (no-break and typographic blanks included). Lengths are code points.
A null argument gives null unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoin.catalog import DEFAULT_COLOR, DROPPED_ELEMENTS, ENTITIES, FEED_CREDIT, MORE_PHRASES, PUBLICATIONS, SENTENCE

WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def collapse(c: Column) -> Column:
    return trim(F.regexp_replace(c, WS + "+", " "))


def code_point(n: Column) -> Column:
    """The character of a code point; '' where there is none."""
    return F.coalesce(F.when((n >= 0) & (n <= 1114111), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")), F.lit(""))


def _replace_each(s: Column, rx: str, fn: Callable[[Column], Column]) -> Column:
    """Replace every match of rx by fn of its first group."""
    gaps, found = F.split(s, rx, -1), F.transform(F.regexp_extract_all(s, F.lit(rx), F.lit(1)), fn)
    return F.array_join(F.zip_with(gaps, F.array_append(found, F.lit("")), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


#: The dictionary as one SQL literal, which is parsed at once; a call a name would take longer than many queries.
_NAMED = "map(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for kv in ENTITIES.items() for x in kv) + ")"


def decode_entities(c: Column) -> Column:
    """Hexadecimal, decimal and named references, one pass each in this order. Unknown names stay; names are case-sensitive."""
    named = F.expr(_NAMED)
    hexa = lambda h: F.when(F.length(F.regexp_replace(h, "^0+", "")) <= 8, code_point(F.conv(h, 16, 10).cast("bigint"))).otherwise("")
    dec = lambda d: F.when(F.length(F.regexp_replace(d, "^0+", "")) <= 9, code_point(d.try_cast("bigint"))).otherwise("")
    name = lambda n: F.coalesce(F.try_element_at(named, n), F.concat(F.lit("&"), n, F.lit(";")))
    once = let(c, lambda s: _replace_each(s, r"&#[xX]([0-9a-fA-F]+);", hexa))
    twice = let(once, lambda s: _replace_each(s, r"&#([0-9]+);", dec))
    return F.when(F.contains(c, F.lit("&")), let(twice, lambda s: _replace_each(s, r"&([a-zA-Z]+);", name))).otherwise(c)


def deep_decode(c: Column) -> Column:
    """Decoded until stable, three times at most; a stable text is not changed by another pass."""
    again = F.aggregate(F.sequence(F.lit(1), F.lit(3)), c, lambda s, _: decode_entities(s))
    return F.when(F.contains(c, F.lit("&")), again).otherwise(c)


def un_cdata(c: Column) -> Column:
    return F.regexp_replace(c, r"<!\[CDATA\[([\s\S]*?)\]\]>", "$1")


def to_text(html: Column) -> Column:
    """HTML to text: references first, so that encoded markup goes too. Null gives ''."""
    s = let(un_cdata(F.coalesce(html, F.lit(""))), deep_decode)
    s = F.regexp_replace(s, rf"(?i)<({DROPPED_ELEMENTS})(?![A-Za-z0-9_])[\s\S]*?</\1>", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"<[^>]+>", " "), WS + "+", " ")
    s = F.regexp_replace(s, WS + r"+([,.;:!?…])", "$1")
    return trim(F.regexp_replace(s, rf"([(“‘]){WS}+", "$1"))


def clean_excerpt(html: Column) -> Column:
    """HTML to text without the feed's own closing phrases, cut at 700 characters on a word."""
    return without_closing(to_text(html))


def without_closing(plain: Column) -> Column:
    """Text without the feed's own closing phrases, cut at 700 characters on a word."""
    s = F.regexp_replace(plain, FEED_CREDIT, "")
    s = F.regexp_replace(s, rf"(?i){WS}*(?:{MORE_PHRASES})(?![A-Za-z0-9_])[^\n\r]*\z", "")
    s = trim(F.regexp_replace(s, rf"{WS}*\[(?:…|\.\.\.|&hellip;)\]{WS}*\z", "…"))
    return let(s, lambda t: F.when(F.length(t) > 700, F.concat(F.regexp_replace(F.left(t, F.lit(700)), rf"{WS}+[^\t\n\x0B\f\r \x{{00A0}}]*\z", ""), F.lit("…"))).otherwise(t))


def words_in(c: Column) -> Column:
    """Number of words of a collapsed text; '' has none."""
    return F.when(c == "", 0).otherwise(F.size(F.split(c, " ", -1)))


def make_short(text: Column, limit: int = 60, least: int = 18) -> Column:
    """The text's first whole sentences within ``limit`` words, if they come to ``least``; else its first ``limit`` words."""

    def cut(t: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(False).alias("stop"))

        def step(acc: Column, s: Column) -> Column:
            n = F.size(F.split(trim(s), " ", -1))
            stop = acc["stop"] | (acc["n"] + n > limit)
            return F.struct(F.when(stop, acc["out"]).otherwise(F.concat(acc["out"], s)).alias("out"), F.when(stop, acc["n"]).otherwise(acc["n"] + n).alias("n"), stop.alias("stop"))

        kept = F.aggregate(F.regexp_extract_all(t, F.lit(SENTENCE), F.lit(0)), start, step)
        head = F.array_join(F.slice(F.split(t, " ", -1), 1, limit), " ")
        whole = let(kept, lambda k: F.when(k["n"] >= least, trim(k["out"])).otherwise(F.concat(F.regexp_replace(head, r"[,;:\-–—]\z", ""), F.lit("…"))))
        return F.when(words_in(t) <= limit, t).otherwise(whole)

    return let(collapse(F.coalesce(text, F.lit(""))), cut)


def as_html(c: Column) -> Column:
    """What has no tag is taken for encoded and decoded once."""
    return F.when(c.rlike(r"(?i)<[a-z]"), c).otherwise(decode_entities(c))


def base36_hash(c: Column) -> Column:
    """Rolling hash (times 33 plus the UTF-16 code unit, modulo 2^32) in base 36. Null is taken for ''."""
    units = let(F.hex(F.encode(F.coalesce(c, F.lit("")), "UTF-16BE")), lambda h: F.transform(F.sequence(F.lit(0), F.floor(F.length(h) / 4).cast("int") - 1), lambda i: F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint")))
    folded = F.aggregate(units, F.lit(5381).cast("bigint"), lambda h, u: (h * 33 + u) % F.lit(4294967296))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("45h")).otherwise(F.lower(F.conv(folded.cast("string"), 10, 36)))


def clean_title(title: Column, source_name: Column | None = None) -> Column:
    """Collapsed, without one publication name appended after a dash or a bar: one of the list, or the source's own."""
    t = collapse(F.coalesce(title, F.lit("")))
    listed = F.regexp_replace(t, rf"(?i){WS}+[-–|]{WS}+(?:{PUBLICATIONS}){WS}*\z", "")
    if source_name is None:
        return listed
    name = collapse(F.coalesce(source_name, F.lit("")))
    head = F.rtrim(F.left(t, F.length(t) - F.length(name)))  # collapsed, so blanks are blanks
    own = (name != "") & F.endswith(F.lower(t), F.lower(name)) & head.rlike(r"[^ ] +[-–|]$") & (F.length(head) < F.length(t) - F.length(name))
    return F.when(own, F.rtrim(F.left(head, F.length(head) - 1))).otherwise(listed)


def iso_ms(ms: Column) -> Column:
    """Epoch milliseconds as an ISO time in UTC (the session's zone must be UTC)."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def link_key(link: Column) -> Column:
    """An address without query, fragment, one closing slash and case."""
    return F.lower(F.regexp_replace(F.regexp_replace(link, r"[?#][\s\S]*\z", ""), r"/\z", ""))


def title_key(source: Column, title: Column) -> Column:
    return F.concat(source, F.lit("|"), F.lower(F.left(title, F.lit(60))))


def age(ts_ms: Column, now_ms: int) -> Column:
    """How long ago, in words; the future is a minute ago."""
    s = F.greatest(F.lit(0), F.floor((F.lit(now_ms) - ts_ms) / 1000))
    days = F.floor(s / 86400)
    return (
        F.when(ts_ms.isNull(), F.lit(None).cast("string")).when(s < 3600, F.concat(F.greatest(F.lit(1), F.floor(s / 60)).cast("string"), F.lit("m ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))
        .when(days == 1, F.lit("Yesterday"))
        .otherwise(F.concat(days.cast("string"), F.lit("d ago")))
    )


def escape_html(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(ref))
    return out


def safe_url(c: Column) -> Column:
    """An https address, or ''."""
    return F.when(F.startswith(c, F.lit("https://")), c).otherwise("")


def absolute_url(u: Column, base: str | None = None) -> Column:
    """An https address: protocol-relative and http ones are raised, rooted ones need a base, others give null."""

    def of(t: Column) -> Column:
        out = F.when(F.startswith(t, F.lit("//")), F.concat(F.lit("https:"), t)).when(F.startswith(t, F.lit("http://")), F.concat(F.lit("https://"), F.substring(t, 8, 1 << 30))).when(F.startswith(t, F.lit("https://")), t)
        return out.when(F.startswith(t, F.lit("/")), F.concat(F.lit(base), t)) if base else out

    return F.when(u != "", let(deep_decode(trim(u)), of))


def ordinal(i: Column, total: Column) -> Column:
    return F.format_string("%02d / %02d", i, total)


def display_text(short: Column, excerpt: Column) -> Column:
    return F.coalesce(F.nullif(short, F.lit("")), F.nullif(excerpt, F.lit("")), F.lit(""))


def digest_excerpt(excerpt: Column) -> Column:
    """The first 140 characters, always with dots."""
    return F.concat(F.left(F.coalesce(excerpt, F.lit("")), F.lit(140)), F.lit("..."))


def long_date(day: Column) -> Column:
    return F.upper(F.date_format(day, "EEEE, MMMM d, yyyy"))


def email(c: Column) -> Column:
    return F.lower(trim(F.coalesce(c, F.lit(""))))


def uri_decode(c: Column) -> Column:
    """Percent-decoding that leaves + alone; null where malformed."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def css_quote(c: Column) -> Column:
    return F.replace(c, F.lit("'"), F.lit("%27"))


def color_or(color: Column, default: str = DEFAULT_COLOR) -> Column:
    return F.coalesce(color, F.lit(default))
