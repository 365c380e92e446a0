"""Queries of the engine over the whole test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin import catalog as C
from quoin.functions import dates, extract, predicates
from quoin.functions import text as T
from quoin.operators import feed as ops
from quoin.operators.interleave import interleave
from quoin.plans import consumers
from quoin.plans.landed import landed_answers, page_sql, rss_sql, search_sql, stories_sql, wp_sql
from quoin.plans.sqltext import ABSOLUTE, BAD, WS, esc_sql, excerpt_of, hash_sql, quoted, short_of, text_of, title_sql, trim_sql
from quoin.runtime import table, written
from quoin.sources import landing, sinks

#: The moment the queries are asked for: 2025-12-01 00:00 UTC.
NOW_MS = 1_764_547_200_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


JUNK = predicates.JUNK_TITLE
VALID = f"""(length(title) > 3 and starts_with(link, 'https://') and not regexp_matches(link, '{predicates.SEARCH_HOSTS}') and not regexp_matches(title, '(?i){JUNK}'))"""
LINK_KEY = r"lower(regexp_replace(regexp_replace(link, '[?#][\s\S]*$', ''), '/$', ''))"
TITLE_KEY = "case when title <> '' then coalesce(sourceId, '') || '|' || lower(left(title, 60)) end"
TOP = f"""select *, row_number() over (partition by sourceId order by "timestamp" desc nulls last, row_id) as src_rank
          from story where coalesce({VALID}, false) and sourceId is not null qualify src_rank <= 12"""
#: Sequential dedupe of the rows of ``seq`` (o, k, t): an ordered fold with the keys seen so far.
FOLD = """folded as (select list_reduce(list({'o': o, 'k': k, 't': t} order by o), lambda a, x: case when list_contains(a.ks, nullif(x.k, '')) or list_contains(a.ts, nullif(x.t, '')) then a
              else {'os': list_append(a.os, x.o), 'ks': case when x.k <> '' then list_append(a.ks, x.k) else a.ks end, 'ts': case when x.t <> '' then list_append(a.ts, x.t) else a.ts end} end,
              {'os': []::bigint[], 'ks': []::varchar[], 'ts': []::varchar[]}) as acc from seq), kept as (select unnest(acc.os) as o from folded)"""
FEED = f"""top as ({TOP}), numbered as (select *, row_number() over (order by sourceId, src_rank) as o from top),
           seq as (select o, {LINK_KEY} as k, {TITLE_KEY} as t from numbered), {FOLD},
           feed as (select *, row_number() over (order by "timestamp" desc, o) as "rank" from numbered semi join kept using (o)
                    where "timestamp" between {NOW_MS} - 90 * 86400000::bigint and {NOW_MS} + 86400000)"""


def _story(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "story")


def _feed(spark: SparkSession, d: str) -> DataFrame:
    return ops.build_feed(_story(spark, d), NOW_MS)


def _landed(spark: SparkSession, d: str) -> DataFrame:
    return landing.parse(landed_answers(spark, d), table(spark, d, "sources"), NOW_MS)


def _run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(feed, health) of the whole pipeline over the landed answers."""
    return ops.run_feed(written(_landed(spark, d), "landed"), table(spark, d, "sources"), table(spark, d, "article_page"), NOW_MS)


#: What the run's oracle needs: stories of the landed answers, winners, the feed with previews, health.
RUN = ", ".join(stories_sql(NOW_MS)) + f""", tried_steps as (select sourceId as source_id, step_no, count(*) as n from landed where coalesce({VALID}, false) group by 1, 2),
    counted as (select s.*, coalesce(n, 0) as n from steps s left join tried_steps using (source_id, step_no)),
    wins as (select source_id, min(step_no) filter (where n > 0) as winner from counted group by 1),
    won as (select id as source_id, w.winner, (select max(kind) from counted c where c.source_id = s.id and c.step_no = w.winner) as via,
            case when w.source_id is null then 'error' else (select string_agg(c.kind || ':' || c.n, ',' order by c.step_no) from counted c where c.source_id = s.id and (w.winner is null or c.step_no <= w.winner)) end as tried from sources s left join wins w on w.source_id = s.id),
    top as (select l.*, row_number() over (partition by l.sourceId order by l."timestamp" desc nulls last, l.fetch_no, l.pos) as src_rank from landed l join won w on w.source_id = l.sourceId and w.winner = l.step_no where coalesce({VALID}, false) qualify src_rank <= 12),
    numbered as (select *, row_number() over (order by sourceId, src_rank) as o from top), seq as (select o, {LINK_KEY} as k, {TITLE_KEY} as t from numbered), {FOLD},
    bare as (select *, row_number() over (order by "timestamp" desc, o) as "rank" from numbered semi join kept using (o) where "timestamp" between {NOW_MS} - 90 * 86400000::bigint and {NOW_MS} + 86400000)"""


@query(f"""with {FEED} select "rank", row_id, id, sourceId, title, link, "timestamp" from feed""")
def feed_stories(spark, d):
    return _feed(spark, d).select("rank", "row_id", "id", "sourceId", "title", "link", "timestamp")


@query(f"""select row_id, coalesce({VALID}, false) as valid, coalesce("timestamp" between {NOW_MS} - 90 * 86400000::bigint and {NOW_MS} + 86400000, false) as recent,
           coalesce(starts_with(image, 'https://') and not regexp_matches(image, '(?i){BAD}'), false) as good_image from story""")
def story_checks(spark, d):
    return _story(spark, d).select("row_id", predicates.valid_story(F.col("title"), F.col("link")).alias("valid"), predicates.recent(F.col("timestamp"), NOW_MS).alias("recent"), predicates.good_image(F.col("image")).alias("good_image"))


@query(f"with top as ({TOP}) select sourceId, src_rank, row_id from top")
def newest_per_source(spark, d):
    return ops.newest_per_source(_story(spark, d).where(ops.VALID()).where("sourceId is not null")).select("sourceId", "src_rank", "row_id")


@query(f"""with recent as (select *, row_number() over (partition by sourceId order by "timestamp" desc, row_id) as rn from story
           where coalesce({VALID}, false) and sourceId is not null and "timestamp" between {NOW_MS} - 90 * 86400000::bigint and {NOW_MS} + 86400000 qualify rn <= 12)
           select row_number() over (order by "timestamp" desc, row_id) as "rank", row_id, sourceId from recent""")
def recent_top12_per_source(spark, d):
    df = _story(spark, d).where(ops.VALID()).where("sourceId is not null").where(predicates.recent(F.col("timestamp"), NOW_MS))
    return ops.ranked(ops.newest_per_source(df), [F.desc("timestamp"), F.asc("row_id")]).select("rank", "row_id", "sourceId")


@query(f"with seq as (select row_id as o, case when link <> '' then {LINK_KEY} end as k, {TITLE_KEY} as t from story), {FOLD} select o as row_id from kept")
def greedy_dedupe(spark, d):
    return ops.greedy_dedupe(_story(spark, d), "row_id").select("row_id")


@query(f"select {LINK_KEY} as link_key, min(row_id) as row_id from story where link is not null group by 1")
def link_first_seen(spark, d):
    df = _story(spark, d).where("link is not null")
    return ops.first_seen(df, T.link_key(F.col("link")), "row_id").select(T.link_key(F.col("link")).alias("link_key"), "row_id")


@query("""select s.id as source_id, count(t.row_id) as stories from sources s left join story t on t.sourceId = s.id group by 1""")
def source_counts(spark, d):
    return ops.source_health(table(spark, d, "sources"), _story(spark, d)).select("source_id", "stories")


HEALTH = """select s.id as source_id, count(t.row_id) as stories, count(*) filter (where t.image is not null and t.image <> '') as with_image,
            count(*) filter (where t.short is not null and t.short <> '') as with_short from sources s left join feed t on t.sourceId = s.id group by 1"""


@query("select id as source_id, (i - 1)::int as step_no, plan[i].kind as kind, plan[i].arg[1] as arg from sources, unnest(generate_series(1, len(plan))) as g(i)")
def source_plans(spark, d):
    return ops.plan_steps(table(spark, d, "sources")).select("source_id", "step_no", "kind", F.try_element_at("arg", F.lit(1)).alias("arg"))


@query(f"""with steps as (select id as source_id, (i - 1) as step_no, plan[i].kind as kind from sources, unnest(generate_series(1, len(plan))) as g(i)),
           firsts as (select source_id, kind, min(step_no) as step_no from steps group by 1, 2),
           st as (select t.sourceId as source_id, f.step_no, count(*) as n from story t join firsts f on f.source_id = t.sourceId and f.kind = case when t.via = 'page' then 'domus' else t.via end where coalesce({VALID}, false) group by 1, 2),
           c as (select s.*, coalesce(n, 0) as n from steps s left join st using (source_id, step_no)),
           w as (select source_id, min(step_no) filter (where n > 0) as winner from c group by 1)
           select w.source_id, w.winner::int as winner, max(c.kind) filter (where c.step_no = w.winner) as via,
                  string_agg(c.kind || ':' || c.n, ',' order by c.step_no) filter (where w.winner is null or c.step_no <= w.winner) as tried from w join c using (source_id) group by 1, 2""")
def fallback_winner(spark, d):
    steps = ops.plan_steps(table(spark, d, "sources"))
    firsts = steps.groupBy(F.col("source_id").alias("sourceId"), F.col("kind").alias("k")).agg(F.min("step_no").alias("step_no"))
    st = _story(spark, d).withColumn("k", F.when(F.col("via") == "page", "domus").otherwise(F.col("via"))).join(firsts, ["sourceId", "k"])
    return ops.fallback(st, steps).select("source_id", "winner", "via", F.array_join("tried", ",").alias("tried"))


MIX = """mixed as (select list_reduce(list_prepend({'pool': []::struct(o bigint, s varchar)[], 'out': []::bigint[], 'last': chr(1)}, list_transform(list_concat(list({'o': o::bigint, 's': s} order by o), list_transform(range(8), lambda z: {'o': null::bigint, 's': null::varchar})),
      lambda x: {'pool': [x], 'out': []::bigint[], 'last': ''})), lambda a, y: case when y.pool[1].o is not null and len(a.pool) < 7 then {'pool': list_append(a.pool, y.pool[1]), 'out': a.out, 'last': a.last}
      when y.pool[1].o is null and len(a.pool) = 0 then a else list_transform([case when y.pool[1].o is null then a.pool else list_append(a.pool, y.pool[1]) end],
        lambda p: list_transform([coalesce(list_position(list_transform(p, lambda e: e.s <> a.last), true), 1)], lambda i: {'pool': list_concat(p[1:i - 1], p[i + 1:]), 'out': list_append(a.out, p[i].o), 'last': p[i].s})[1])[1] end) as r from {deck}),
    dealt as (select unnest(r.out) as o, generate_subscripts(r.out, 1) - 1 as place from mixed)"""


@query(f"""with {FEED}, deck as (select "rank" as o, coalesce(sourceId, '') as s from feed where id is not null and title <> ''), {MIX.replace('{deck}', 'deck')}
           select place, row_id, sourceId from dealt join feed on feed."rank" = dealt.o""")
def interleaved(spark, d):
    return consumers.view(_feed(spark, d), "all").select("place", "row_id", "sourceId")


@query(f"""with deck as (select row_id as o, coalesce(sourceId, '') as s from story where batch_no = 1), {MIX.replace('{deck}', 'deck')} select place, o as row_id from dealt""".replace("where batch_no = 1", ""))
def interleaved_table(spark, d):
    """The whole table as one deck, dealt in ranges."""
    return interleave(_story(spark, d), "row_id").select("place", "row_id")


@query(f"""with {FEED}, readers as (select reader_no from saved where reader_no is not null group by 1 order by count(*) desc, 1 limit 1),
           own as (select story_id from saved semi join readers using (reader_no) where story_id is not null group by 1 having count(*) % 2 = 1)
           select row_number() over (order by "rank") - 1 as place, row_id, sourceId from feed where id in (select story_id from own) and title <> ''""")
def view_of_saved(spark, d):
    saved = table(spark, d, "saved")
    busiest = saved.where("reader_no is not null").groupBy("reader_no").count().orderBy(F.desc("count"), "reader_no").limit(1).select("reader_no")
    return consumers.view(_feed(spark, d), "saved", consumers.saved_set(saved.join(busiest, "reader_no", "left_semi"))).select("place", "row_id", "sourceId")


@query(f"""with {FEED}, biggest as (select sourceId from feed group by 1 order by count(*) desc, sourceId limit 1)
           select row_number() over (order by "rank") - 1 as place, row_id from feed semi join biggest using (sourceId) where id is not null and title <> ''""")
def view_of_source(spark, d):
    f = _feed(spark, d)
    top = f.groupBy("sourceId").count().orderBy(F.desc("count"), "sourceId").limit(1)
    part = f.join(top.select("sourceId"), "sourceId", "left_semi").where(predicates.showable(F.col("id"), F.col("title"), F.col("link")))
    return ops.ranked(part, [F.col("rank")], "place").select((F.col("place") - 1).alias("place"), "row_id")


@query(f"""select row_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(title, ''), '{WS}+', ' ', 'g'), '^ | $', '', 'g'),
           '(?i) +[-–|] +(?:ArchDaily|Dezeen|Archinect|Metropolis(?: Magazine)?|Architectural Record|designboom|The Architect[’'']s Newspaper|Domus(?: Web)?) *$', ''), '^ | $', '', 'g') as title from story""")
def clean_titles(spark, d):
    return _story(spark, d).select("row_id", T.clean_title(F.col("title")).alias("title"))


@query(f"select row_id, {LINK_KEY} as link_key, sourceId || '|' || lower(left(title, 60)) as title_key from story")
def dedupe_keys(spark, d):
    return _story(spark, d).select("row_id", T.link_key(F.col("link")).alias("link_key"), T.title_key(F.col("sourceId"), F.col("title")).alias("title_key"))


@query(f"""select row_id, {hash_sql("coalesce(nullif(link, ''), title, '')")} as hash from story""")
def story_hashes(spark, d):
    return _story(spark, d).select("row_id", T.base36_hash(F.coalesce(F.nullif("link", F.lit("")), F.col("title"))).alias("hash"))


def _text_query(col: str, select: str) -> str:
    text, last = text_of("t", "row_id", "raw")
    cut, cut_last = excerpt_of("e", "row_id", last)
    return f"with raw as (select row_id, {col} as s from story), {', '.join([*text, *cut])} {select.replace('{plain}', last).replace('{excerpt}', cut_last)}"


@query(_text_query("excerpt", "select row_id, p.s as plain, e.s as excerpt from {plain} p join {excerpt} e using (row_id)"))
def clean_excerpts(spark, d):
    df = _story(spark, d).select("row_id", T.to_text(F.col("excerpt")).alias("plain"))
    return df.select("row_id", "plain", T.without_closing(F.col("plain")).alias("excerpt"))


@query(_text_query("title", "select row_id, s as title from {plain}"))
def title_text(spark, d):
    return _story(spark, d).select("row_id", T.to_text(F.col("title")).alias("title"))


_SHORT = short_of("g", "doc_id", "raw")


@query(f"with raw as (select doc_id, text as s from documents), {', '.join(_SHORT[0])} select doc_id, s as short from {_SHORT[1]}")
def sixty_word_shorts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.make_short(F.col("text")).alias("short"))


_OG = r"""coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]+(?:property|name)=["''](?:og:image|twitter:image)["''][^>]+content=["'']([^"'']+)["'']', 1), ''),
           nullif(regexp_extract(html, '(?i)<meta[^>]+content=["'']([^"'']+)["''][^>]+(?:property|name)=["''](?:og:image|twitter:image)["'']', 1), ''))"""
_PREVIEW = f"""raw as (select link, {_OG} as u from article_page where html is not null), absolute as (select link, {ABSOLUTE} as u from (select link, replace(trim(u), '&amp;', '&') as u from raw)),
    good as (select link, min(u) as u from absolute where starts_with(u, 'https://') and not regexp_matches(u, '(?i){BAD}') and not regexp_matches(u, '(?i){predicates.BAD_PREVIEW}') group by 1)"""


@query(f"with {_PREVIEW} select link, u as image from good")
def preview_images(spark, d):
    p = table(spark, d, "article_page").where("html is not null").select("link", T.absolute_url(extract.preview_image(F.col("html"))).alias("image"))
    return p.where(predicates.good_preview(F.col("image"))).groupBy("link").agg(F.min("image").alias("image"))


@query(f"""with {_PREVIEW} select s.row_id, coalesce(s.image, g.u) as image, case when s.image is null and g.u is not null then 'og' else s.imageVia end as imageVia from story s left join good g on g.link = s.link""")
def enriched_images(spark, d):
    return ops.with_previews(_story(spark, d), table(spark, d, "article_page"), "row_id", None).select("row_id", "image", "imageVia")


@query(f"""with {_PREVIEW}, need as (select row_id, link from story where image is null order by row_id limit 16) select s.row_id, coalesce(s.image, g.u) as image, case when s.image is null and g.u is not null then 'og' else s.imageVia end as imageVia
           from story s left join need n on n.row_id = s.row_id left join good g on g.link = n.link""")
def enriched_first_16(spark, d):
    return ops.with_previews(_story(spark, d), table(spark, d, "article_page"), "row_id").select("row_id", "image", "imageVia")


@query("""select row_id, case when dated then strftime(make_timestamp("timestamp" * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' end as iso, epoch_ms(try_strptime(pubDate, '%Y-%m-%dT%H:%M:%S.%gZ')) as parsed from story""")
def story_dates(spark, d):
    return _story(spark, d).select("row_id", F.when(F.col("dated"), T.iso_ms(F.col("timestamp"))).alias("iso"), dates.parse_ms(F.col("pubDate")).alias("parsed"))


_AGE = "case when {s} < 3600 then greatest(1, {s} // 60) || 'm ago' when {s} < 86400 then ({s} // 3600) || 'h ago' when {s} // 86400 = 1 then 'Yesterday' else ({s} // 86400) || 'd ago' end"


@query(f"""select row_id, case when s is not null then {_AGE.format(s="s")} end as age from (select row_id, case when "timestamp" is not null then greatest(0, ({NOW_MS} - "timestamp") // 1000) end as s from story)""")
def story_ages(spark, d):
    return _story(spark, d).select("row_id", T.age(F.col("timestamp"), NOW_MS).alias("age"))


@query("select reader_no, story_id, max(saved_at) as saved_at from saved where reader_no is not null and story_id is not null group by 1, 2 having count(*) % 2 = 1")
def saved_set(spark, d):
    return consumers.saved_set(table(spark, d, "saved"))


@query("""with s as (select reader_no, story_id from saved where reader_no is not null and story_id is not null group by 1, 2 having count(*) % 2 = 1)
          select reader_no, count(*) as saved, count(i.id) as present from s left join (select distinct id from story) i on i.id = s.story_id group by 1""")
def saved_counts(spark, d):
    return consumers.saved_counts(consumers.saved_set(table(spark, d, "saved")), _story(spark, d))


_MAIL = f"select distinct lower(regexp_replace(coalesce(email, ''), '^{WS}+|{WS}+$', '', 'g')) as email from subscriber where contains(coalesce(email, ''), '@')"


@query(_MAIL)
def subscriber_set(spark, d):
    return consumers.emails(table(spark, d, "subscriber"))


@query(f"""with {FEED} select '0' || f."rank" as ordinal, f.sourceName, coalesce(s.color, '#555') as color, f.title, left(coalesce(f.excerpt, ''), 140) || '...' as excerpt, f.link
           from feed f left join sources s on s.id = f.sourceId where f."rank" <= 5""")
def digest_rows(spark, d):
    return consumers.digest_rows(_feed(spark, d), table(spark, d, "sources"))


_CARD = f"""cards as (select f."rank" - 1 as place, format('{{:02d}} / {{:02d}}', f."rank", total) as ordinal, {esc_sql('coalesce(s.name, f.sourceName)')} as source_name, coalesce(s.color, '#333') as color,
    (select {_AGE.format(s="x.s")} from (select greatest(0, ({NOW_MS} - f."timestamp") // 1000) as s) x) as age, {esc_sql("f.title")} as title, {esc_sql("coalesce(nullif(f.short, ''), nullif(f.excerpt, ''), '')")} as text, {esc_sql("f.link")} as href,
    case when starts_with(f.image, 'https://') then 'url(' || chr(39) || replace({esc_sql("f.image")}, chr(39), '%27') || chr(39) || ')' else 'none' end as background, f.title as share_title, coalesce(f.short, '') as share_text, f.link as share_url
    from feed f cross join (select count(*) as total from feed) n left join sources s on s.id = f.sourceId)"""


def _cards(spark, d):
    return consumers.cards(_feed(spark, d).withColumn("place", F.col("rank") - 1), table(spark, d, "sources"), NOW_MS)


@query(f"""with {FEED}, {_CARD} select * from cards""")
def deck_cards(spark, d):
    return _cards(spark, d).select("place", "ordinal", "source_name", "color", "age", "title", "text", "href", "background", F.col("share.title").alias("share_title"), F.col("share.text").alias("share_text"), F.col("share.url").alias("share_url"))


@query(f"""with {FEED}, {_CARD} select place, '<section class="card" data-i="' || place || '">' || case when background = 'none' then '<div class="media none">' || source_name || '</div>' else '<div class="media" style="background-image:' || background || '"></div>' end
           || '<div class="count">' || ordinal || '</div><span class="pill" style="background:' || color || '">' || source_name || '</span><span>' || age || '</span><h2>' || title || '</h2>' || case when text <> '' then '<p class="short">' || text || '</p>' else '' end
           || '<a href="' || href || '"></a></section>' as html from cards union all select count(*), '<section class="card end"><h2>That is all for now</h2></section>' from cards""")
def deck_html(spark, d):
    return consumers.card_html(_cards(spark, d))


_DAY = "2025-12-01"
_DIGEST = f"""top5 as (select '0' || f."rank" as ordinal, f.sourceName, coalesce(s.color, '#555') as color, f.title, left(coalesce(f.excerpt, ''), 140) || '...' as excerpt, f.link from feed f left join sources s on s.id = f.sourceId where f."rank" <= 5),
    digest as (select '<div>' || 'MONDAY, DECEMBER 1, 2025' || '</div><table>' || string_agg('<tr><td><span style="background:' || color || '">' || sourceName || '</span><div>' || ordinal || '</div><h3>' || title || '</h3><p>' || excerpt || '</p><a href="' || link || '">READ FULL STORY →</a></td></tr>', '' order by ordinal) || '</table>' as html from top5)"""


def _outbox(spark, d):
    html = consumers.digest_html(consumers.digest_rows(_feed(spark, d), table(spark, d, "sources")), F.lit(_DAY).cast("date"))
    return consumers.outbox(consumers.emails(table(spark, d, "subscriber")), html, F.lit(_DAY).cast("date"))


@query(f"""with {FEED}, {_DIGEST}, s as ({_MAIL}) select (row_number() over (order by email) - 1) // 50 as batch_no, email, 'Weekly — December 1, 2025' as subject, html from s cross join digest where html is not null""")
def recipient_batches(spark, d):
    return _outbox(spark, d).select("batch_no", F.col("to").alias("email"), "subject", "html")


@query(f"""with s as ({_MAIL}) select {quoted(_DAY)} as last_sent, 1::bigint as emails_sent, count(*) as recipients, ((count(*) + 49) // 50)::bigint as batches from s""")
def digest_state(spark, d):
    log = written(consumers.digest_log(_outbox(spark, d), F.lit(_DAY)), "log")
    return consumers.digest_counters(log).crossJoin(log.agg(F.sum("batches").alias("batches")))


def _known(spark, d):
    return consumers.emails(table(spark, d, "subscriber").where("joined_at < timestamp '2025-01-01'"))


_BODY = """case row_id % 4 when 0 then '{"email":"Reader' || row_id || '@A.example "}' when 1 then '"{\\"email\\":\\"x' || row_id || '@b.example\\"}"' when 2 then '{"name":"x"}' else 'no json' end"""


@query("""select row_id, case row_id % 4 when 0 then 'Reader' || row_id || '@A.example ' when 1 then 'x' || row_id || '@b.example' else '' end as email from story""")
def sign_up_bodies(spark, d):
    k = F.col("row_id") % 4
    text = F.col("row_id").cast("string")
    body = F.when(k == 0, F.concat(F.lit('{"email":"Reader'), text, F.lit('@A.example "}'))).when(k == 1, F.concat(F.lit('"{\\"email\\":\\"x'), text, F.lit('@b.example\\"}"'))).when(k == 2, '{"name":"x"}').otherwise("no json")
    return consumers.sign_ups(_story(spark, d).select("row_id", body.alias("body")), keep=["row_id"])


_NEW = f"""known as (select distinct lower({trim_sql("coalesce(email, '')")}) as email from subscriber where contains(coalesce(email, ''), '@') and joined_at < timestamp '2025-01-01'), fresh as (select email from ({_MAIL}) where email not in (select email from known))"""


@query(f"with {_NEW} select email as \"to\", 'Welcome' as subject, '<p>Welcome, ' || {esc_sql('email')} || '</p>' as html from fresh")
def welcome_outbox(spark, d):
    return consumers.welcomes(consumers.new_subscribers(table(spark, d, "subscriber"), _known(spark, d)))


@query(f"with {_NEW} select (select count(*) from known) + (select count(*) from fresh) as count")
def subscriber_count(spark, d):
    return consumers.subscriber_counter(_known(spark, d), consumers.new_subscribers(table(spark, d, "subscriber"), _known(spark, d)))


@query("""with base as (select reader_no, story_id, max(saved_at) as saved_at from saved where reader_no is not null and story_id is not null and saved_at is not null group by 1, 2), taps as (select reader_no, story_id, saved_at + 1 as saved_at from base where saved_at % 2 = 0 union all select -1, story_id, max(saved_at) from base group by 2),
          old as (select * from base where saved_at % 3 <> 0)
          select coalesce(o.reader_no, t.reader_no) as reader_no, coalesce(o.story_id, t.story_id) as story_id, coalesce(o.saved_at, t.saved_at) as saved_at from old o full join taps t on t.reader_no = o.reader_no and t.story_id = o.story_id where o.saved_at is null or t.saved_at is null""")
def toggled_saves(spark, d):
    base = table(spark, d, "saved").where("reader_no is not null and story_id is not null and saved_at is not null").groupBy("reader_no", "story_id").agg(F.max("saved_at").alias("saved_at"))
    taps = base.where("saved_at % 2 = 0").withColumn("saved_at", F.col("saved_at") + 1).unionByName(base.groupBy("story_id").agg(F.max("saved_at").alias("saved_at")).withColumn("reader_no", F.lit(-1).cast("long")))
    return consumers.toggle(base.where("saved_at % 3 <> 0"), taps)


@query("""select s.reader_no, s.story_id, s.saved_at, s.story_id as requested, i.id is not null as found, case when i.id is not null then 'all' else 'saved' end as filter
          from saved s left join (select distinct id from story where id is not null) i on i.id = nullif(s.story_id, '')""")
def deep_links(spark, d):
    asked = table(spark, d, "saved").withColumn("fragment", F.concat(F.lit("#"), F.replace(F.url_encode("story_id"), F.lit("+"), F.lit("%20")))).withColumn("wanted", F.lit("saved"))
    return consumers.deep_links(asked, _story(spark, d)).select("reader_no", "story_id", "saved_at", "requested", "found", "filter")


@query("""with w as (select row_id, case row_id % 4 when 0 then 'all' when 1 then 'saved' when 2 then sourceId else 'gone' || row_id end as wanted from story), k as (select w.row_id, w.wanted, s.name, case when w.wanted in ('all', 'saved') or s.id is not null then w.wanted else 'all' end as filter from w left join sources s on s.id = w.wanted)
          select row_id, filter, case filter when 'all' then 'All' when 'saved' then 'Saved' else coalesce(name, '') end as label from k""")
def filter_choices(spark, d):
    k = F.col("row_id") % 4
    w = _story(spark, d).select("row_id", F.when(k == 0, "all").when(k == 1, "saved").when(k == 2, F.col("sourceId")).otherwise(F.concat(F.lit("gone"), F.col("row_id").cast("string"))).alias("wanted"))
    w = w.join(table(spark, d, "sources").select(F.col("id").alias("wanted"), "name", F.array("id").alias("known")), "wanted", "left")
    chosen = w.withColumn("filter", predicates.filter_or_all(F.col("wanted"), F.col("known")))
    return chosen.select("row_id", "filter", consumers.filter_label(F.col("filter"), F.col("name")).alias("label"))


@query("""select row_id, case row_id % 3 when 0 then row_id else 7 end as kept, greatest(0, least(9, row_id % 21 - 5)) as place, "timestamp" is not null and 1764547200000 - "timestamp" > 900000 as stale from story""")
def reader_state(spark, d):
    k = F.col("row_id") % 3
    value = F.when(k == 0, F.concat(F.lit('{"n":'), F.col("row_id").cast("string"), F.lit("}"))).when(k == 1, '{"n":')
    kept = consumers.stored(value, "n bigint", F.struct(F.lit(7).cast("long").alias("n")))["n"]
    return _story(spark, d).select("row_id", kept.alias("kept"), consumers.clamped(F.col("row_id") % 21 - 5, F.lit(9)).alias("place"), predicates.stale(F.col("timestamp"), NOW_MS).alias("stale"))


@query(f"""with {FEED} select count(*) as "count", case when count(*) >= 20 then 's-maxage=600, stale-while-revalidate=3600' else 'no-store' end as cache_control from feed""")
def cache_policy(spark, d):
    return _feed(spark, d).agg(F.count("*").alias("count")).select("count", sinks.cache_policy(F.col("count")).alias("cache_control"))


@query(f"""with {FEED} select "rank", id, title, link, "timestamp"::varchar as "timestamp", image from feed""")
def feed_document(spark, d):
    """The feed's JSON lines, read back."""
    lines = sinks.story_json(_feed(spark, d))
    return lines.select("rank", *[F.get_json_object("json", f"$.{c}").alias(c) for c in ("id", "title", "link", "timestamp", "image")])


_ITEM = "source_id, fetch_no, pos::int as pos, title, link, body_html, image, ms"


def _items(df: DataFrame) -> DataFrame:
    return df.select("source_id", "fetch_no", F.col("pos").cast("int").alias("pos"), "title", "link", "body_html", "image", "ms")


@query(f"with {', '.join(rss_sql())} select {_ITEM} from rss_items")
def rss_items(spark, d):
    return _items(landing.rss(landed_answers(spark, d)))


@query(f"with {', '.join(wp_sql())} select {_ITEM} from wp_items")
def wp_posts(spark, d):
    return _items(landing.wordpress(landed_answers(spark, d)))


@query(f"with {', '.join(page_sql())} select {_ITEM} from page_items")
def section_articles(spark, d):
    return _items(landing.section_pages(landed_answers(spark, d)))


@query(f"with {', '.join(search_sql())} select {_ITEM} from search_items")
def search_hits(spark, d):
    return _items(landing.search_hits(landed_answers(spark, d), table(spark, d, "sources")))


_STORY = ("id", "sourceId", "sourceName", "sourceColor", "sourceDomain", "title", "link", "excerpt", "short", "image", "pubDate", "timestamp", "dated", "via")


@query(f"""with {', '.join(stories_sql(NOW_MS))} select {', '.join(f'"{c}"' for c in _STORY)}, fetch_no, pos::int as pos from landed""")
def landed_stories(spark, d):
    """Landed answers of all kinds to stories with their source's attributes."""
    return _landed(spark, d).select(*_STORY, "fetch_no", F.col("pos").cast("int").alias("pos"))


_PREVIEWED = f"""{RUN}, {_PREVIEW}, need as (select "rank", link from bare where image is null order by "rank" limit 16),
    fed as (select b.* exclude (image), coalesce(b.image, g.u) as image, case when g.u is not null then 'og' end as imageVia from bare b left join need n on n."rank" = b."rank" left join good g on g.link = n.link)"""


@query(f"""with {_PREVIEWED} select "rank", {', '.join(f'"{c}"' for c in _STORY)}, imageVia from fed""")
def feed_run(spark, d):
    """The whole pipeline: landing, fallback, the newest of each source, dedupe, recency, rank, previews."""
    return _run(spark, d)[0].select("rank", *_STORY, "imageVia")


_HEALTH = """healthy as (select w.source_id, w.via, w.tried, count(f.id) as stories, count(*) filter (where f.image <> '') as with_image, count(*) filter (where f.short <> '') as with_short from won w left join fed f on f.sourceId = w.source_id group by 1, 2, 3)"""


@query(f"with {_PREVIEWED}, {_HEALTH} select * from healthy")
def feed_health(spark, d):
    return _run(spark, d)[1].withColumn("tried", F.array_join("tried", ","))


def _summary(spark, d):
    feed, health = _run(spark, d)
    return sinks.feed_summary(feed, health, NOW_MS)


def _entries(m: str, line) -> F.Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), line)), ",")


_HEALTH_LINE = "source_id || ':' || coalesce(via, '-') || ':' || coalesce(tried, '') || ':' || stories || ':' || with_image || ':' || with_short"


@query(f"""with {_PREVIEWED}, {_HEALTH} select true as success, 7 as version, (select count(*) from fed) as count, string_agg(source_id || ':' || stories, ',' order by source_id || ':' || stories) as sources, '2025-12-01T00:00:00.000Z' as updatedAt,
           case when (select count(*) from fed) >= 20 then 's-maxage=600, stale-while-revalidate=3600' else 'no-store' end as cache_control from healthy""")
def feed_summary(spark, d):
    line = lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))
    return _summary(spark, d).select("success", "version", "count", _entries("sources", line).alias("sources"), "updatedAt", "cache_control")


@query(f"""with {_PREVIEWED}, {_HEALTH} select 7 as version, (select count(*) from fed) as count, '2025-12-01T00:00:00.000Z' as updatedAt, string_agg({_HEALTH_LINE}, ',' order by {_HEALTH_LINE}) as health from healthy""")
def health_only(spark, d):
    v = lambda e, c: e["value"][c].cast("string")
    line = lambda e: F.concat_ws(":", e["key"], F.coalesce(v(e, "via"), F.lit("-")), F.array_join(F.coalesce(e["value"]["tried"], F.array()), ","), v(e, "stories"), v(e, "with_image"), v(e, "with_short"))
    return sinks.health_document(_summary(spark, d)).select("version", "count", "updatedAt", _entries("health", line).alias("health"))


_MS = '("timestamp" - "timestamp" % 1000)'


@query(f"""select row_id, case when row_id % 7 = 6 then {NOW_MS} - 86400000 - (row_id % 5) * 3600000 when row_id % 7 = 5 then {_MS} - {_MS} % 86400000 else {_MS} end as ms from story where "timestamp" is not null""")
def date_layouts(spark, d):
    """One layout a row, with zones and without, and what is no date."""
    t, k = F.timestamp_millis("timestamp"), F.col("row_id") % 7
    f = lambda x: F.date_format(t, x)
    there = lambda h: F.date_format(F.timestamp_millis(F.col("timestamp") + h * C.HOUR_MS), "EEE, d MMM yyyy HH:mm:ss")
    s = F.when(k == 0, F.concat(f("EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(k == 1, F.concat(there(2), F.lit(" +0200"))).when(k == 2, F.concat(there(-5), F.lit(" EST"))).when(k == 3, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k == 4, f("yyyy-MM-dd HH:mm:ss")).when(k == 5, f("MMMM d, yyyy")).otherwise("soon")
    return _story(spark, d).where("timestamp is not null").select("row_id", dates.ms_or_default(dates.parse_ms(s), F.col("row_id") % 5, NOW_MS).alias("ms"))


@query(f"""select row_id, strftime(make_timestamp("timestamp" * 1000), '%-d') || '|' || upper(strftime(make_timestamp("timestamp" * 1000), '%A, %B %-d, %Y')) as long_date, case when starts_with(image, 'https://') then image else '' end as safe, replace(coalesce(title, ''), chr(39), '%27') as quoted,
           coalesce(title, '') as decoded from story where "timestamp" is not null""")
def small_scalars(spark, d):
    t = F.timestamp_millis("timestamp")
    coded = F.replace(F.url_encode(F.coalesce("title", F.lit(""))), F.lit("+"), F.lit("%20"))
    return _story(spark, d).where("timestamp is not null").select("row_id", F.concat_ws("|", F.date_format(t, "d"), T.long_date(t)).alias("long_date"), T.safe_url(F.coalesce("image", F.lit(""))).alias("safe"), T.css_quote(F.coalesce("title", F.lit(""))).alias("quoted"), T.uri_decode(coded).alias("decoded"))


@query(f"""with t as (select row_id, regexp_replace(regexp_replace(coalesce(title, ''), '{WS}+', ' ', 'g'), '^ | $', '', 'g') || case row_id % 4 when 0 then ' - ' || s.name when 1 then ' – Arch-Record' when 2 then ' | Dezeen' else '' end as t, case when row_id % 4 = 1 then 'Arch-Record' else coalesce(s.name, '') end as n from story join sources s on s.id = sourceId)
           select row_id, {title_sql("t", "n")} as title from (select row_id, regexp_replace(t, '^ | $', '', 'g') as t, {trim_sql("n")} as n from t)""")
def titles_with_names(spark, d):
    k = F.col("row_id") % 4
    src = table(spark, d, "sources").select(F.col("id").alias("sourceId"), "name")
    df = _story(spark, d).join(src, "sourceId").select("row_id", F.concat(T.collapse(F.coalesce("title", F.lit(""))), F.when(k == 0, F.concat(F.lit(" - "), "name")).when(k == 1, " – Arch-Record").when(k == 2, " | Dezeen").otherwise("")).alias("t"), F.when(k == 1, "Arch-Record").otherwise(F.col("name")).alias("n"))
    return df.select("row_id", T.clean_title(F.col("t"), F.col("n")).alias("title"))


_URL = "case row_id % 5 when 0 then image when 1 then '/a/' || row_id || '.png' when 2 then '//h.example/' || row_id when 3 then 'http://h.example/' || row_id || '?a=1&amp;b=2' else 'a.png' end"


@query(f"""with u as (select row_id, replace({_URL}, '&amp;', '&') as u from story) select row_id, {ABSOLUTE} as plain, coalesce({ABSOLUTE}, case when starts_with(u, '/') then 'https://base.example' || u end) as based from u""")
def absolute_urls(spark, d):
    u = F.expr(_URL.replace("//", "//"))
    return _story(spark, d).select("row_id", T.absolute_url(u).alias("plain"), T.absolute_url(u, "https://base.example").alias("based"))
