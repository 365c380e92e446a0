"""The story table written out as publishers' answers: a landing table of all four kinds to parse, in Spark and in SQL.

Each story is an item of the answer that its source gave, by the way it came, in the run that fetched it: runs are blocks of
240 rows of arrival, so no answer holds more items than that, however hot a source is. The item's number chooses among the
layouts that publishers use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin import catalog as C
from quoin.functions import text as T
from quoin.operators.feed import plan_steps
from quoin.plans.sqltext import ABSOLUTE, collapse_sql, decoded, esc_sql, excerpt_of, good_sql, hash_sql, plain, quoted, short_of, text_of, title_sql, trim_sql
from quoin.runtime import table

RUN = 240
STEP_OF = {"rss": "rss", "wp": "wp", "page": "domus", "bing": "bing"}


def _e(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _data(c: str) -> Column:
    """A column inside a CDATA section."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("]]>"), F.lit(""))


def _x(c: str) -> Column:
    return T.escape_html(F.col(c))


def rss_item() -> Column:
    """RSS items, and Atom entries for every other row, with the image in one of three places."""
    k = F.col("row_id") % 3
    image = (
        F.when(k == 0, _e('<media:content url="', _x("image"), '" medium="image"/>'))
        .when(k == 1, _e('<media:content url="https://v.example/a.mp4" medium="video"/><enclosure url="', _x("image"), '" type="image/jpeg"/>'))
        .otherwise(_e("<content:encoded><![CDATA[<p>", _data("short"), '</p><img src="', _x("image"), '">]]></content:encoded>'))
    )
    item = _e("<item><title>", _x("title"), "</title><link>", _x("link"), "</link><description><![CDATA[", _data("excerpt"), "]]></description>", image, "<pubDate>", F.coalesce("pubDate", F.lit("")), "</pubDate></item>")
    entry = _e('<entry><title type="html"><![CDATA[', _data("title"), ']]></title><link rel="alternate" href="', _x("link"), '"/><summary>', _x("excerpt"), '</summary><content type="html">', _x("short"), '</content><media:thumbnail url="', _x("image"), '"/><updated>', F.coalesce("pubDate", F.lit("")), "</updated></entry>")
    return F.when(F.col("row_id") % 2 == 0, item).otherwise(entry)


def page_item() -> Column:
    """Blocks of a section page: two rows share an address; every seventh address is of an excluded section."""
    k = F.floor(F.col("row_id") / 2)
    href = _e("/en/", F.when(k % 7 == 0, "shop").otherwise("architecture"), "/2025/", F.lpad((k % 12 + 1).cast("string"), 2, "0"), "/", F.lpad((k % 28 + 1).cast("string"), 2, "0"), "/", k.cast("string"), ".html")
    image = F.when(F.col("row_id") % 3 == 0, _e('<img data-src="/content/', k.cast("string"), '.foto.rsmall.jpg.foto.rsmall.png" src="/blank.gif">')).otherwise(_e('<img src="', _x("image"), '">'))
    return _e('<article class="card c-article-prev wide"><a href="', href, '"><span class="inject-title">', _x("title"), '</span></a><p class="inject-desc">', _x("excerpt"), "</p>", image, "</article>")


def search_item() -> Column:
    link = F.replace(F.url_encode(F.coalesce("link", F.lit(""))), F.lit("+"), F.lit("%20"))
    day = F.date_format(F.timestamp_millis("timestamp"), "EEE, dd MMM yyyy HH:mm:ss")
    return _e("<item><title>", _x("title"), "</title><link>https://www.bing.com/news/apiclick.aspx?ref=x&amp;url=", link, "&amp;c=1</link><description>", _x("excerpt"), "</description><News:Image>http://www.bing.com/th?id=", F.col("row_id").cast("string"), "&amp;pid=News</News:Image><pubDate>", F.coalesce(_e(day, " GMT"), F.lit("")), "</pubDate></item>")


def wp_post() -> Column:
    """A post as JSON, its image at one of five levels."""
    k, im = F.col("row_id") % 5, F.col("image")
    at = lambda n: F.when(k == n, F.struct(im.alias("source_url")))
    sizes = F.when(k <= 2, F.struct(F.struct(at(0).alias("large"), at(1).alias("medium_large"), at(2).alias("full")).alias("sizes")))
    media = F.when(k <= 3, F.array(F.struct(F.when(k == 3, im).alias("source_url"), sizes.alias("media_details"))))
    yoast = F.struct(F.col("short").alias("description"), F.when(k == 4, F.array(F.struct(im.alias("url")))).alias("og_image"))
    excerpt = F.struct(F.when(F.col("row_id") % 3 != 0, F.col("excerpt")).otherwise("").alias("rendered"))
    day = F.date_format(F.timestamp_millis("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return F.to_json(F.struct(F.struct(F.coalesce("title", F.lit("")).alias("rendered")).alias("title"), F.coalesce("link", F.lit("")).alias("link"), day.alias("date_gmt"), excerpt.alias("excerpt"), yoast.alias("yoast_head_json"), F.struct(media.alias("wp:featuredmedia")).alias("_embedded")))


def landed_answers(spark: SparkSession, d: str) -> DataFrame:
    """(source_id, step_no, kind, url, url_no, body, fetch_no, status): all stories with a source, as landed answers.

    step_no is the source's first step of the kind, -1 where its plan has none. Lists come in four parts, pages in two.
    """
    firsts = plan_steps(table(spark, d, "sources")).groupBy(F.col("source_id"), F.col("kind")).agg(F.min("step_no").alias("step_no"))
    kind = F.create_map(*[F.lit(x) for kv in STEP_OF.items() for x in kv])[F.col("via")]
    item = F.when(F.col("via") == "rss", rss_item()).when(F.col("via") == "page", page_item()).when(F.col("via") == "bing", search_item()).otherwise(wp_post())
    part = F.when(F.col("via") == "wp", F.col("row_id") % 4).when(F.col("via") == "page", F.col("row_id") % 2).otherwise(0).cast("int")
    items = table(spark, d, "story").where("sourceId is not null and via is not null").select(F.col("sourceId").alias("source_id"), kind.alias("kind"), F.floor(F.col("row_id") / RUN).alias("fetch_no"), part.alias("url_no"), "row_id", item.alias("item"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("row_id", "item"))), lambda x: x["item"])  # RUN items at most
    joined = items.groupBy("source_id", "kind", "fetch_no", "url_no").agg(listed.alias("items"))
    body = F.when(F.col("kind") == "wp", _e("[", F.array_join("items", ","), "]")).when(F.col("kind") == "domus", _e("<html>", F.array_join("items", "\n"), "</html>")).otherwise(_e("<rss><channel>", F.array_join("items", "\n"), "</channel></rss>"))
    return joined.join(firsts, ["source_id", "kind"], "left").select("source_id", F.coalesce("step_no", F.lit(-1)).alias("step_no"), "kind", F.lit("").alias("url"), "url_no", body.alias("body"), "fetch_no", F.lit(200).alias("status"))


# The same in SQL: a chain of common table expressions from the story table to stories parsed of the answers.

def _cat(*parts: str) -> str:
    return " || ".join(parts)


def tag_sql(x: str, name: str) -> str:
    return trim_sql(rf"regexp_replace(regexp_extract({x}, '(?i)<{name}(?:\s[^>]*)?>([\s\S]*?)</{name}>', 1), '<!\[CDATA\[([\s\S]*?)\]\]>', '\1', 'g')")


def _data_sql(c: str) -> str:
    return f"replace(coalesce({c}, ''), ']]>', '')"


def _rss_sql() -> str:
    image = f"""case row_id % 3 when 0 then {_cat(quoted('<media:content url="'), esc_sql('image'), quoted('" medium="image"/>'))}
        when 1 then {_cat(quoted('<media:content url="https://v.example/a.mp4" medium="video"/><enclosure url="'), esc_sql('image'), quoted('" type="image/jpeg"/>'))}
        else {_cat(quoted('<content:encoded><![CDATA[<p>'), _data_sql('short'), quoted('</p><img src="'), esc_sql('image'), quoted('">]]></content:encoded>'))} end"""
    item = _cat(quoted("<item><title>"), esc_sql("title"), quoted("</title><link>"), esc_sql("link"), quoted("</link><description><![CDATA["), _data_sql("excerpt"), quoted("]]></description>"), f"({image})", quoted("<pubDate>"), "coalesce(pubDate, '')", quoted("</pubDate></item>"))
    entry = _cat(quoted('<entry><title type="html"><![CDATA['), _data_sql("title"), quoted(']]></title><link rel="alternate" href="'), esc_sql("link"), quoted('"/><summary>'), esc_sql("excerpt"), quoted('</summary><content type="html">'), esc_sql("short"), quoted('</content><media:thumbnail url="'), esc_sql("image"), quoted('"/><updated>'), "coalesce(pubDate, '')", quoted("</updated></entry>"))
    return f"case when row_id % 2 = 0 then {item} else {entry} end"


def _page_sql() -> str:
    k = "(row_id // 2)"
    href = _cat(quoted("/en/"), f"(case when {k} % 7 = 0 then 'shop' else 'architecture' end)", quoted("/2025/"), f"lpad(({k} % 12 + 1)::varchar, 2, '0')", quoted("/"), f"lpad(({k} % 28 + 1)::varchar, 2, '0')", quoted("/"), f"{k}::varchar", quoted(".html"))
    image = f"(case when row_id % 3 = 0 then {_cat(quoted('<img data-src="/content/'), f'{k}::varchar', quoted('.foto.rsmall.jpg.foto.rsmall.png" src="/blank.gif">'))} else {_cat(quoted('<img src="'), esc_sql('image'), quoted('">'))} end)"
    return _cat(quoted('<article class="card c-article-prev wide"><a href="'), href, quoted('"><span class="inject-title">'), esc_sql("title"), quoted('</span></a><p class="inject-desc">'), esc_sql("excerpt"), quoted("</p>"), image, quoted("</article>"))


_KEYS = "k, source_id, fetch_no, pos"
_STORY = "from story where sourceId is not null"


def _listed(*rx: str) -> str:
    """The first pattern's group that is found in x, else null."""
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(x, {quoted(r)}, 1), '')" for r in rx) + ")"


def _many(text: str, whole: str, unless: str, most: int | None = None) -> str:
    got = f"regexp_extract_all({text}, {quoted(whole)}, 0)" + (f"[1:{most}]" if most else "")
    return f"list_transform(list_filter({got}, lambda m: not regexp_matches(m, {quoted(unless)})), lambda m: regexp_extract(m, {quoted(C.URL_ATTRIBUTE)}, 1))"


def rss_sql() -> list[str]:
    """CTEs up to ``rss_items`` (source_id, fetch_no, pos, title, link, body_html, image, ms)."""
    chunks = "list_concat(" + ", ".join(f"regexp_extract_all(body, '(?i)<{n}[\\s>]([\\s\\S]*?)</{n}>', 1)" for n in ("item", "entry")) + ")[1:18]"
    out = [
        f"rss_body as (select sourceId as source_id, row_id // {RUN} as fetch_no, string_agg({_rss_sql()}, chr(10) order by row_id) as body {_STORY} and via = 'rss' group by 1, 2)",
        f"rss_list as (select source_id, fetch_no, {chunks} as xs from rss_body)",
        "rss_x as materialized (select source_id, fetch_no, i - 1 as pos, xs[i] as x, row_number() over () as k from rss_list, unnest(generate_series(1, len(xs))) as g(i))",
        "rss_b as (select k, i, s from (select k, unnest([1, 2, 3, 4]) as i, unnest([" + ", ".join(tag_sql("x", n) for n in ("description", "summary", "content:encoded", "content")) + "]) as s from rss_x))",
    ]
    once, last = decoded("rss_o", "k, i", "rss_b", 1)
    out += [*once, f"rss_h as materialized (select b.k, b.i, case when regexp_matches(b.s, '(?i)<[a-z]') then b.s else o.s end as s from rss_b b join {last} o using (k, i))"]
    texts, last = text_of("rss_t", "k, i", "rss_h")
    cuts, last = excerpt_of("rss_e", "k, i", last)
    out += [*texts, *cuts, f"rss_n as (select k, i, case when s = '' then 0 else len(string_split(s, ' ')) end as n from {last})"]
    out.append("rss_best as (select k, coalesce(min(i) filter (where n >= 45), min(i) filter (where n >= 8)) as i from rss_n group by k)")
    images = f"list_concat({_many('x', C.MEDIA, C.MEDIUM_NOT_IMAGE)}, {_many('x', C.ENCLOSURE, C.TYPE_NOT_IMAGE, 1)}, regexp_extract_all(html, {quoted(C.IMG_SRC)}, 1))"
    out += [
        "rss_html as (select k, string_agg(s, ' ' || chr(10) || ' ' order by i) as html from rss_h group by k)",
        f"rss_img as (select k, unnest(us) as s, generate_subscripts(us, 1) as j from (select k, {images} as us from rss_x join rss_html using (k)))",
        f"rss_raw as (select k, 'title' as f, 0 as j, {tag_sql('x', 'title')} as s from rss_x union all select k, 'link', 0, {tag_sql('x', 'link')} from rss_x union all select k, 'alt', 0, {_listed(C.ALTERNATE_LINK, C.ANY_LINK)} from rss_x union all select k, 'img', j, {trim_sql('s')} from rss_img where s <> '')",
    ]
    deep, last = decoded("rss_d", "k, f, j", "rss_raw", 3)
    title, named = plain("rss_title", "k, f, j", last)
    out += [*deep, *title]
    out.append(f"rss_pic as (select k, arg_min(u, j) as image from (select k, j, {ABSOLUTE} as u from (select k, j, s as u from {last} where f = 'img')) where {good_sql('u')} group by k)")
    ms = "epoch_ms(try_strptime(coalesce(nullif(" + tag_sql("x", "pubDate") + ", ''), nullif(" + tag_sql("x", "updated") + ", '')), '%Y-%m-%dT%H:%M:%S.%gZ'))"
    link = trim_sql("l.s")
    out.append(
        f"""rss_items as materialized (select x.source_id, x.fetch_no, x.pos, t.s as title, case when regexp_matches({link}, '^https?://') then {link} else coalesce(a.s, '') end as link, coalesce(h.s, '') as body_html, p.image, {ms} as ms
            from rss_x x join {named} t on t.k = x.k and t.f = 'title' join {last} l on l.k = x.k and l.f = 'link' left join {last} a on a.k = x.k and a.f = 'alt' join rss_best b on b.k = x.k left join rss_h h on h.k = b.k and h.i = b.i left join rss_pic p on p.k = x.k)"""
    )
    return out


def wp_sql() -> list[str]:
    """CTEs up to ``wp_items``."""
    out = [f"""wp_x as materialized (select row_id as k, sourceId as source_id, row_id // {RUN} as fetch_no, row_number() over (partition by sourceId, row_id // {RUN} order by row_id % 4, row_id) - 1 as pos, coalesce(link, '') as link,
            coalesce(nullif(case when row_id % 3 <> 0 then excerpt end, ''), nullif(short, ''), '') as body_html, image, ("timestamp" - "timestamp" % 1000) as ms, coalesce(title, '') as title {_STORY} and via = 'wp')""",
           f"wp_raw as (select k, 'title' as f, regexp_replace(title, '<!\\[CDATA\\[([\\s\\S]*?)\\]\\]>', '\\1', 'g') as s from wp_x union all select k, 'img', {trim_sql('image')} from wp_x where image <> '')"]
    deep, last = decoded("wp_d", "k, f", "wp_raw", 3)
    title, named = plain("wp_title", "k, f", last)
    out += [*deep, *title, f"wp_pic as (select k, {ABSOLUTE} as image from (select k, s as u from {last} where f = 'img'))"]
    out.append(f"wp_items as materialized (select source_id, fetch_no, pos, t.s as title, link, body_html, p.image, ms from wp_x join {named} t on t.k = wp_x.k and t.f = 'title' left join wp_pic p on p.k = wp_x.k)")
    return out


def page_sql() -> list[str]:
    """CTEs up to ``page_items``."""
    base = "https://www.domusweb.it"
    src = _listed(C.LAZY_SRC, C.PLAIN_SRC)
    at = f"strpos(src, '{C.SMALL_PHOTO}')"
    bigger = f"case when {at} > 0 then left(src, ({at} - 1)::int) || '{C.MEDIUM_PHOTO}' || substr(src, {at} + {len(C.SMALL_PHOTO)}) else src end"
    out = [
        f"page_b as (select sourceId as source_id, row_id // {RUN} as fetch_no, row_id % 2 as url_no, '<html>' || string_agg({_page_sql()}, chr(10) order by row_id) || '</html>' as body {_STORY} and via = 'page' group by 1, 2, 3)",
        f"page_l as (select source_id, fetch_no, url_no, regexp_extract_all(body, {quoted(C.SECTION_BLOCK)}, 0) as xs from page_b)",
        "page_u as (select source_id, fetch_no, url_no, i as nth, xs[i] as x from page_l, unnest(generate_series(1, len(xs))) as g(i))",
        f"page_h as (select *, regexp_extract(x, {quoted(C.SECTION_LINK)}, 1) as href from page_u)",
        f"page_o as (select * from page_h where href <> '' and not regexp_matches(href, '{C.EXCLUDED_PATHS}') qualify row_number() over (partition by source_id, fetch_no, href order by url_no, nth) = 1)",
        f"page_x as materialized (select *, row_number() over (partition by source_id, fetch_no order by url_no, nth) - 1 as pos, row_number() over () as k, {src} as src from page_o)",
        f"page_raw as (select k, 'title' as f, regexp_replace(regexp_extract(x, {quoted(C.SECTION_TITLE)}, 1), '<!\\[CDATA\\[([\\s\\S]*?)\\]\\]>', '\\1', 'g') as s from page_x union all select k, 'img', {trim_sql(bigger)} from page_x where src <> ''",
    ]
    out[-1] += ")"
    deep, last = decoded("page_d", "k, f", "page_raw", 3)
    title, named = plain("page_title", "k, f", last)
    day = "strptime(" + " || '-' || ".join(f"regexp_extract(x, {quoted(C.SECTION_LINK)}, {i})" for i in (2, 3, 4)) + ", '%Y-%m-%d')"
    out += [*deep, *title, f"page_pic as (select k, coalesce({ABSOLUTE}, case when starts_with(u, '/') then '{base}' || u end) as image from (select k, s as u from {last} where f = 'img'))"]
    out.append(f"""page_items as materialized (select source_id, fetch_no, pos, t.s as title, '{base}' || href as link, regexp_extract(x, {quoted(C.SECTION_TEXT)}, 1) as body_html, p.image, epoch_ms({day}) + 43200000 - pos * 60000 as ms
            from page_x x join {named} t on t.k = x.k and t.f = 'title' left join page_pic p on p.k = x.k)""")
    return out


def search_sql() -> list[str]:
    """CTEs up to ``search_items``."""
    out = [
        f"""search_x as materialized (select s.row_id as k, s.sourceId as source_id, s.row_id // {RUN} as fetch_no, row_number() over (partition by s.sourceId, s.row_id // {RUN} order by s.row_id) - 1 as pos, coalesce(s.link, '') as link, coalesce(s.title, '') as title, coalesce(s.excerpt, '') as excerpt,
             d.domain, (s."timestamp" - s."timestamp" % 1000) as ms from story s join sources d on d.id = s.sourceId where s.via = 'bing')""",
        f"search_raw as (select k, {trim_sql(esc_sql('title'))} as s from search_x)",
        f"search_body as (select k, {trim_sql(esc_sql('excerpt'))} as s from search_x)",
    ]
    title, named = text_of("search_t", "k", "search_raw")
    body, told = decoded("search_o", "k", "search_body", 1)
    out += [*title, *body]
    out.append(f"""search_items as materialized (select x.source_id, x.fetch_no, x.pos, t.s as title, case when contains(x.link, x.domain) then x.link else '' end as link, b.s as body_html, 'https://www.bing.com/th?id=' || x.k || '&pid=News{C.PICTURE_SIZE}' as image, x.ms
            from search_x x join {named} t using (k) join {told} b using (k))""")
    return out


def stories_sql(now_ms: int) -> list[str]:
    """CTEs of all four kinds up to ``landed``: stories as the engine makes them."""
    kinds = {"rss": "rss_items", "wp": "wp_items", "page": "page_items", "bing": "search_items"}
    out = [*rss_sql(), *wp_sql(), *page_sql(), *search_sql()]
    out.append("all_items as materialized (select *, row_number() over () as k from (" + " union all ".join(f"select '{v}' as via, source_id, fetch_no, pos, title, link, body_html, image, ms from {t}" for v, t in kinds.items()) + "))")
    out.append("body_s as (select k, body_html as s from all_items)")
    text, last = text_of("st_t", "k", "body_s")
    cut, last = excerpt_of("st_e", "k", last)
    short, shorter = short_of("st_s", "k", last)
    title = title_sql("t", "n")
    out += [*text, *cut, *short]
    out.append("steps as (select id as source_id, (i - 1) as step_no, plan[i].kind as kind from sources, unnest(generate_series(1, len(plan))) as g(i))")
    out.append("firsts as (select source_id, kind, min(step_no) as step_no from steps group by 1, 2)")
    out.append(
        f"""landed as materialized (select d.id || '-' || {hash_sql("coalesce(nullif(link, ''), tt)")} as id, d.id as sourceId, d.name as sourceName, d.color as sourceColor, d.domain as sourceDomain, tt as title, link, excerpt, short, case when {good_sql('image')} then image end as image,
            strftime(make_timestamp(ts * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as pubDate, ts as "timestamp", ms is not null as dated, via, coalesce(f.step_no, -1) as step_no, fetch_no, pos
            from (select *, {title} as tt, coalesce(ms, {now_ms} - 86400000 - pos * 3600000) as ts from (select a.via, a.source_id, a.fetch_no, a.pos, {trim_sql("coalesce(a.link, '')")} as link, a.image, a.ms, {collapse_sql('a.title')} as t, e.s as excerpt, h.s as short, {collapse_sql("coalesce(s.name, '')")} as n
                  from all_items a join {last} e using (k) join {shorter} h using (k) join sources s on s.id = a.source_id)) i
            join sources d on d.id = i.source_id left join firsts f on f.source_id = i.source_id and f.kind = case when i.via = 'page' then 'domus' else i.via end)"""
    )
    return out
