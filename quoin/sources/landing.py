"""Strategies: landed answers of publishers to story rows.

A landing table has one row an answer: (source_id, step_no, kind, url, url_no, body) and, where the lander has them, fetch_no
(the number of the run that asked, 0 without) and status. A null body is a request that failed or timed out, and so is a
status that is none of success. Fetching is the lander's business, so any number of sources is parsed in parallel and again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin import catalog as C
from quoin.catalog import PER_FEED
from quoin.functions import dates, extract
from quoin.functions.predicates import allowed_path, good_image
from quoin.functions.text import absolute_url, as_html, base36_hash, clean_excerpt, clean_title, decode_entities, iso_ms, make_short, to_text, trim

KEYS = ["source_id", "step_no", "fetch_no"]
FIELDS = [*KEYS, "pos", "title", "link", "body_html", "image", "ms", "via"]

WP_POST = (
    "array<struct<title:struct<rendered:string>,link:string,date_gmt:string,excerpt:struct<rendered:string>,yoast_head_json:struct<description:string,og_image:array<struct<url:string>>>,"
    "_embedded:struct<`wp:featuredmedia`:array<struct<source_url:string,media_details:struct<sizes:struct<large:struct<source_url:string>,medium_large:struct<source_url:string>,full:struct<source_url:string>>>>>>>>"
)


def _of_kind(landing: DataFrame, kind: str) -> DataFrame:
    fetch = F.coalesce(F.col("fetch_no").cast("long"), F.lit(0)) if "fetch_no" in landing.columns else F.lit(0).cast("long")
    landed = landing.where(F.coalesce(F.col("status").between(200, 299), F.lit(True))) if "status" in landing.columns else landing
    return landed.withColumn("fetch_no", fetch).where((F.col("kind") == kind) & F.col("body").isNotNull())


def rss(landing: DataFrame) -> DataFrame:
    """RSS and Atom: the first 18 items in the order of the document, before anything is thrown away."""
    items = _of_kind(landing, "rss").where(extract.is_feed(F.col("body"))).select(*KEYS, F.posexplode(extract.feed_chunks(F.col("body"), PER_FEED)).alias("pos", "item"))
    item = F.col("item")
    # in steps, so that each value is worked out once and no expression outgrows a generated method
    cut = items.select(*KEYS, "pos", "item", extract.tag(item, "title").alias("title"), extract.tag(item, "link").alias("link_text"), extract.item_bodies(item).alias("bodies"), extract.item_date(item).alias("date"))
    read = cut.select(*KEYS, "pos", "item", "title", "link_text", "date", F.transform("bodies", as_html).alias("html"))
    html = F.array_join("html", " \n ")
    return read.select(
        *KEYS, "pos", to_text(F.col("title")).alias("title"), extract.item_link(item, F.col("link_text")).alias("link"), extract.best_body(F.col("html")).alias("body_html"),
        extract.item_image(item, html).alias("image"), dates.parse_ms(F.col("date")).alias("ms"), F.lit("rss").alias("via"),
    )


def wordpress(landing: DataFrame) -> DataFrame:
    """WordPress lists: one answer a post type, put together in the order of the types; what is no list counts as empty."""
    posts = _of_kind(landing, "wp").select(*KEYS, "url_no", F.from_json(F.when(trim(F.col("body")).startswith("["), F.col("body")), WP_POST).alias("posts"))
    each = posts.select(*KEYS, "url_no", F.posexplode("posts").alias("at", "p"))
    order = Window.partitionBy(*KEYS).orderBy("url_no", "at")  # a list is 6 posts a type
    media = F.try_element_at(F.col("p._embedded.`wp:featuredmedia`"), F.lit(1))
    sizes = media["media_details"]["sizes"]
    image = F.coalesce(*[F.nullif(c, F.lit("")) for c in (sizes["large"]["source_url"], sizes["medium_large"]["source_url"], sizes["full"]["source_url"], media["source_url"], F.try_element_at(F.col("p.yoast_head_json.og_image"), F.lit(1))["url"])])
    body = F.coalesce(F.nullif(F.col("p.excerpt.rendered"), F.lit("")), F.nullif(F.col("p.yoast_head_json.description"), F.lit("")), F.lit(""))
    return each.select(
        *KEYS, (F.row_number().over(order) - 1).alias("pos"), to_text(F.col("p.title.rendered")).alias("title"), F.col("p.link").alias("link"), body.alias("body_html"), absolute_url(image).alias("image"),
        dates.parse_ms(F.concat(F.col("p.date_gmt"), F.lit("Z"))).alias("ms"), F.lit("wp").alias("via"),
    )


def section_pages(landing: DataFrame, base: str = "https://www.domusweb.it") -> DataFrame:
    """Section pages: each address once, by its first place over all pages; dated by the address, in the page's order."""
    blocks = _of_kind(landing, "domus").select(*KEYS, "url_no", F.posexplode(extract.section_blocks(F.col("body"))).alias("at", "b"))
    b = F.col("b")
    hit = blocks.withColumn("href", F.regexp_extract(b, C.SECTION_LINK, 1)).where((F.col("href") != "") & allowed_path(F.col("href")))
    once = hit.withColumn("n", F.row_number().over(Window.partitionBy(*KEYS, "href").orderBy("url_no", "at"))).where("n = 1")
    out = once.withColumn("pos", F.row_number().over(Window.partitionBy(*KEYS).orderBy("url_no", "at")) - 1)
    date = [F.regexp_extract(b, C.SECTION_LINK, i).cast("int") for i in (2, 3, 4)]
    return out.select(
        *KEYS, "pos", to_text(F.regexp_extract(b, C.SECTION_TITLE, 1)).alias("title"), F.concat(F.lit(base), "href").alias("link"),
        F.regexp_extract(b, C.SECTION_TEXT, 1).alias("body_html"), extract.section_image(b, base).alias("image"), dates.path_ms(*date, F.col("pos")).alias("ms"), F.lit("page").alias("via"),
    )


def search_hits(landing: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits of a news search: the publisher's own address is taken out of the hit's."""
    items = _of_kind(landing, "bing").where(F.col("body").rlike(r"(?i)<item[\s>]")).join(sources.select(F.col("id").alias("source_id"), "domain"), "source_id")
    each = items.select(*KEYS, "domain", F.posexplode(F.regexp_extract_all("body", F.lit(C.SEARCH_ITEM), F.lit(0))).alias("pos", "item"))
    item = F.col("item")
    return each.select(
        *KEYS, "pos", to_text(extract.tag(item, "title")).alias("title"), extract.search_link(item, F.col("domain")).alias("link"), decode_entities(extract.tag(item, "description")).alias("body_html"),
        extract.search_image(item).alias("image"), dates.parse_ms(extract.tag(item, "pubDate")).alias("ms"), F.lit("bing").alias("via"),
    )


def as_stories(parsed: DataFrame, sources: DataFrame, now_ms: int) -> DataFrame:
    """Parsed items to stories with their source's attributes, cleaned texts, an id and a date."""
    src = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("color").alias("source_color"), F.col("domain").alias("source_domain"))
    link: Column = trim(F.coalesce("link", F.lit("")))
    df = parsed.select(*FIELDS).join(src, "source_id")
    df = df.withColumn("link", link).withColumn("title", clean_title(F.col("title"), F.col("source_name"))).withColumn("excerpt", clean_excerpt(F.col("body_html"))).withColumn("timestamp", dates.ms_or_default(F.col("ms"), F.col("pos"), now_ms))
    return df.select(
        F.concat("source_id", F.lit("-"), base36_hash(F.coalesce(F.nullif("link", F.lit("")), F.col("title")))).alias("id"), F.col("source_id").alias("sourceId"), F.col("source_name").alias("sourceName"), F.col("source_color").alias("sourceColor"),
        F.col("source_domain").alias("sourceDomain"), "title", "link", "excerpt", make_short(F.col("excerpt")).alias("short"), F.when(good_image(F.col("image")), F.col("image")).alias("image"), iso_ms(F.col("timestamp")).alias("pubDate"), "timestamp",
        F.col("ms").isNotNull().alias("dated"), "via", F.lit(None).cast("string").alias("imageVia"), "step_no", "fetch_no", "pos",
    )


def parse(landing: DataFrame, sources: DataFrame, now_ms: int) -> DataFrame:
    """All strategies over a landing table. Empty and failed answers give no rows; an empty table gives none."""
    parts = [rss(landing), wordpress(landing), section_pages(landing), search_hits(landing, sources)]
    out = parts[0].select(*FIELDS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*FIELDS))
    return as_stories(out, sources, now_ms)
