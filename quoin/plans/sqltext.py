"""Text rules in SQL: chains of common table expressions, each link (keys, s) made from the one before."""

from __future__ import annotations

from quoin import catalog as C
from quoin.functions import predicates

WS = r"[\t\n\v\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trim_sql(s: str) -> str:
    return f"regexp_replace({s}, '^{WS}+|{WS}+$', '', 'g')"


def collapse_sql(s: str) -> str:
    return trim_sql(f"regexp_replace({s}, '{WS}+', ' ', 'g')")


def esc_sql(c: str) -> str:
    return f"replace(replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _each(s: str, rx: str, fn: str) -> str:
    return f"""array_to_string(list_transform(list_zip(string_split_regex({s}, '{rx}'), list_transform(regexp_extract_all({s}, '{rx}', 1), lambda x: {fn})), lambda z: z[1] || coalesce(z[2], '')), '')"""


_NAMED = "map([" + ", ".join(quoted(k) for k in C.ENTITIES) + "], [" + ", ".join(quoted(v) for v in C.ENTITIES.values()) + "])"
_HEX = "case when length(ltrim(x, '0')) <= 8 and ('0x' || case when ltrim(x, '0') = '' then '0' else ltrim(x, '0') end)::bigint between 1 and 1114111 then chr(('0x' || ltrim(x, '0'))::bigint::int) else '' end"
_DEC = "case when length(ltrim(x, '0')) between 1 and 9 and x::bigint between 1 and 1114111 then chr(x::int) else '' end"
_NAME = f"coalesce({_NAMED}[x], '&' || x || ';')"
_PASSES = ((r"&#[xX]([0-9a-fA-F]+);", _HEX), (r"&#([0-9]+);", _DEC), (r"&([a-zA-Z]+);", _NAME))


def decoded(name: str, keys: str, source: str, rounds: int) -> tuple[list[str], str]:
    """References decoded, ``rounds`` times three passes; also the last link's name."""
    out, last = [], source
    for i in range(3 * rounds):
        rx, fn = _PASSES[i % 3]
        out.append(f"{name}{i} as materialized (select {keys}, case when contains(s, '&') then {_each('s', rx, fn)} else s end as s from {last})")
        last = f"{name}{i}"
    return out, last


def plain(name: str, keys: str, source: str) -> tuple[list[str], str]:
    """HTML to text of decoded strings: whole elements, tags, blanks."""
    s = "s"
    for el in ("script", "style", "figure", "figcaption", "iframe", "h1", "h2", "h3", "h4", "h5", "h6"):
        s = f"regexp_replace({s}, '(?i)<{el}\\b[\\s\\S]*?</{el}>', ' ', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '<[^>]+>', ' ', 'g'), '{WS}+', ' ', 'g')"
    s = f"regexp_replace(regexp_replace({s}, ' +([,.;:!?…])', '\\1', 'g'), '([(“‘]) +', '\\1', 'g')"
    return [f"{name} as materialized (select {keys}, regexp_replace({s}, '^ +| +$', '', 'g') as s from {source})"], name


def text_of(name: str, keys: str, source: str) -> tuple[list[str], str]:
    """(keys, s) to text: CDATA, three rounds of references, then tags and blanks."""
    first = f"{name}c as (select {keys}, regexp_replace(coalesce(s, ''), '<!\\[CDATA\\[([\\s\\S]*?)\\]\\]>', '\\1', 'g') as s from {source})"
    chain, last = decoded(f"{name}d", keys, f"{name}c", 3)
    rest, last = plain(f"{name}p", keys, last)
    return [first, *chain, *rest], last


def excerpt_of(name: str, keys: str, source: str) -> tuple[list[str], str]:
    """Plain text without the feed's closing phrases, cut at 700 characters on a word."""
    cut = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '(?i)The post [^\\n\\r]{{0,220}}? appeared first on [^\\n\\r]*$', ''),
    '(?i) *(?:{C.MORE_PHRASES})\\b[^\\n\\r]*$', ''), ' *\\[(?:…|\\.\\.\\.|&hellip;)\\] *$', '…'), '^ +| +$', '', 'g')"""
    return [f"{name}x as (select {keys}, {cut} as e from {source})", f"{name} as materialized (select {keys}, case when length(e) > 700 then regexp_replace(left(e, 700), ' +[^ ]*$', '') || '…' else e end as s from {name}x)"], name


_SENTENCES = r"""regexp_extract_all(t, '[^.!?…]+[.!?…]+["”’)]*\s*|[^.!?…]+$', 0)"""


def short_of(name: str, keys: str, source: str) -> tuple[list[str], str]:
    """The first whole sentences within 60 words, or the first 60 words."""
    return [
        f"{name}c as (select {keys}, regexp_replace(regexp_replace(coalesce(s, ''), '{WS}+', ' ', 'g'), '^ | $', '', 'g') as t from {source})",
        f"{name}f as (select *, string_split(t, ' ') as w, case when t = '' then 0 else len(string_split(t, ' ')) end as n from {name}c)",
        f"""{name}g as (select *, list_reduce(list_prepend({{'o': '', 'n': 0, 'stop': false}}, list_transform({_SENTENCES}, lambda x: {{'o': x, 'n': len(string_split(regexp_replace(x, '^ +| +$', '', 'g'), ' '))::int, 'stop': false}})),
      lambda a, x: case when a.stop or a.n + x.n > 60 then {{'o': a.o, 'n': a.n, 'stop': true}} else {{'o': a.o || x.o, 'n': (a.n + x.n)::int, 'stop': false}} end) as r from {name}f)""",
        f"""{name} as (select {keys}, case when n <= 60 then t when r.n >= 18 then regexp_replace(r.o, '^ +| +$', '', 'g') else regexp_replace(array_to_string(w[1:60], ' '), '[,;:\\-–—]$', '') || '…' end as s from {name}g)""",
    ], name


def hash_sql(s: str) -> str:
    """Rolling hash of UTF-16 units in base 36."""
    units = f"""list_concat([5381::bigint], flatten(list_transform(string_split({s}, ''), lambda c: case when c = '' then []::bigint[] when unicode(c) > 65535
                then [(55296 + ((unicode(c) - 65536) >> 10))::bigint, (56320 + ((unicode(c) - 65536) & 1023))::bigint] else [unicode(c)::bigint] end)))"""
    return f"lower(to_base(list_reduce({units}, lambda h, c: (h * 33 + c) % 4294967296), 36))"


ABSOLUTE = "case when starts_with(u, '//') then 'https:' || u when starts_with(u, 'http://') then 'https://' || substr(u, 8) when starts_with(u, 'https://') then u end"
BAD = predicates.BAD_IMAGE.replace("'", "''")


def good_sql(u: str) -> str:
    return f"coalesce(starts_with({u}, 'https://') and not regexp_matches({u}, '(?i){BAD}'), false)"


def title_sql(t: str, name: str = "''") -> str:
    """A collapsed title without one publication's name at its end."""
    listed = rf"regexp_replace(regexp_replace({t}, '(?i) +[-–|] +(?:{C.PUBLICATIONS.replace(chr(39), chr(39) * 2)}) *$', ''), '^ | $', '', 'g')"
    head = f"rtrim(left({t}, (length({t}) - length({name}))::int), ' ')"
    own = f"{name} <> '' and ends_with(lower({t}), lower({name})) and regexp_matches({head}, '[^ ] +[-–|]$') and length({head}) < length({t}) - length({name})"
    return f"case when {own} then rtrim(left({head}, (length({head}) - 1)::int), ' ') else {listed} end"
