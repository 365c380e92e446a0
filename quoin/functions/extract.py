"""Extraction from landed feeds, pages and API answers, as Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoin import catalog as C
from quoin.functions.predicates import good_image
from quoin.functions.text import absolute_url, clean_excerpt, deep_decode, let, trim, un_cdata, uri_decode, words_in


def first(c: Column, *patterns: str, group: int = 1) -> Column:
    """The group's first match of the first pattern that has one; null without."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, rx, group), F.lit("")) for rx in patterns])


def tag(xml: Column, name: str) -> Column:
    """Body of the first element of a name, any case, CDATA unwrapped; '' without."""
    return trim(un_cdata(F.regexp_extract(xml, rf"(?i)<{name}(?:\s[^>]*)?>([\s\S]*?)</{name}>", 1)))


def feed_chunks(xml: Column, most: int) -> Column:
    """All item bodies, then all entry bodies, the first ``most`` in the order of the document."""
    items = [F.regexp_extract_all(xml, F.lit(rf"(?i)<{n}[\s>]([\s\S]*?)</{n}>"), F.lit(1)) for n in ("item", "entry")]
    return F.slice(F.concat(*items), 1, most)


def is_feed(xml: Column) -> Column:
    return F.coalesce(xml.rlike(C.FEED_ITEM), F.lit(False))


def item_link(item: Column, text: Column | None = None) -> Column:
    """The link element's text if it is an address, else the alternate link's, else the first link's href; '' without."""
    own = trim(deep_decode(tag(item, "link") if text is None else text))
    other = first(item, C.ALTERNATE_LINK, C.ANY_LINK)
    return let(own, lambda t: F.when(t.rlike(r"^https?://"), t).otherwise(F.coalesce(deep_decode(other), F.lit(""))))


def _urls(c: Column, element: str, attribute: str, unless: str | None) -> Column:
    whole = F.regexp_extract_all(c, F.lit(element), F.lit(0))
    kept = F.filter(whole, lambda m: ~m.rlike(unless)) if unless else whole
    return F.transform(kept, lambda m: F.regexp_extract(m, attribute, 1))


def item_bodies(item: Column) -> Column:
    return F.array(*[tag(item, n) for n in ("description", "summary", "content:encoded", "content")])


def image_candidates(item: Column, html: Column) -> Column:
    """Media elements that are no video or audio, the first enclosure if it is none, then every image of the body."""
    media = _urls(item, C.MEDIA, C.URL_ATTRIBUTE, C.MEDIUM_NOT_IMAGE)
    enclosure = F.filter(F.slice(F.regexp_extract_all(item, F.lit(C.ENCLOSURE), F.lit(0)), 1, 1), lambda m: ~m.rlike(C.TYPE_NOT_IMAGE))
    inline = F.regexp_extract_all(html, F.lit(C.IMG_SRC), F.lit(1))
    return F.concat(media, F.transform(enclosure, lambda m: F.regexp_extract(m, C.URL_ATTRIBUTE, 1)), inline)


def item_image(item: Column, html: Column) -> Column:
    """The first candidate that is a good https image; null without."""
    return F.try_element_at(F.filter(F.transform(image_candidates(item, html), lambda u: absolute_url(u)), lambda u: good_image(u)), F.lit(1))


def best_body(bodies: Column) -> Column:
    """The first body (as HTML) of eight words; if that has under 45, the first of 45, if any; '' without."""

    def of(counted: Column) -> Column:
        pick = lambda least: F.try_element_at(F.filter(counted, lambda x: x["n"] >= least), F.lit(1))
        return let(pick(8), lambda b: F.when(b.isNull(), "").when(b["n"] < 45, F.coalesce(pick(45)["b"], b["b"])).otherwise(b["b"]))

    return let(F.transform(bodies, lambda b: F.struct(b.alias("b"), words_in(clean_excerpt(b)).alias("n"))), of)


def item_date(item: Column) -> Column:
    """pubDate before published before dc:date before updated; null without."""
    named = [F.nullif(tag(item, n), F.lit("")) for n in ("pubDate", "published", "dc:date")]
    return F.coalesce(*named, F.nullif(F.regexp_replace(tag(item, "updated"), r"^>", ""), F.lit("")))


def preview_image(html: Column) -> Column:
    """The preview image a page names in its head, attributes in either order; null without."""
    return first(html, rf"(?i)<meta[^>]+{C.PREVIEW_NAME}[^>]+{C.CONTENT_ATTRIBUTE}", rf"(?i)<meta[^>]+{C.CONTENT_ATTRIBUTE}[^>]+{C.PREVIEW_NAME}")


def section_blocks(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(C.SECTION_BLOCK), F.lit(0))


def section_image(block: Column, base: str) -> Column:
    src = first(block, C.LAZY_SRC, C.PLAIN_SRC)
    at = F.instr(src, C.SMALL_PHOTO)
    bigger = F.when(at > 0, F.concat(F.substring(src, F.lit(1), at - 1), F.lit(C.MEDIUM_PHOTO), F.substring(src, at + len(C.SMALL_PHOTO), F.lit(1 << 30)))).otherwise(src)
    return absolute_url(bigger, base)


def search_link(item: Column, domain: Column) -> Column:
    """The publisher's address within a search hit's; '' if malformed or of another domain."""
    real = uri_decode(F.regexp_extract(deep_decode(tag(item, "link")), C.SEARCH_TARGET, 1))
    return let(F.coalesce(real, F.lit("")), lambda u: F.when(F.contains(u, domain), u).otherwise(""))


def search_image(item: Column) -> Column:
    """The hit's picture in the size asked for; null without."""
    return F.concat(absolute_url(F.nullif(deep_decode(tag(item, "News:Image")), F.lit(""))), F.lit(C.PICTURE_SIZE))
