"""Row predicates of the feed's rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoin.catalog import BAD_IMAGE, BAD_PREVIEW, DAY_MS, EXCLUDED_PATHS, JUNK_TITLE, RECENT_DAYS, SEARCH_HOSTS


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def good_image(u: Column) -> Column:
    return _sure(F.startswith(u, F.lit("https://")) & ~u.rlike(f"(?i){BAD_IMAGE}"))


def good_preview(u: Column) -> Column:
    return good_image(u) & _sure(~u.rlike(f"(?i){BAD_PREVIEW}"))


def valid_story(title: Column, link: Column) -> Column:
    """A title of more than three characters that is no interstitial's, and an https address of no search host."""
    return _sure((F.length(title) > 3) & F.startswith(link, F.lit("https://")) & ~link.rlike(SEARCH_HOSTS) & ~title.rlike(f"(?i){JUNK_TITLE}"))


def allowed_path(path: Column) -> Column:
    return ~path.rlike(EXCLUDED_PATHS)


def recent(ts_ms: Column, now_ms: int) -> Column:
    """From 90 days ago to a day ahead, both included."""
    return _sure(ts_ms.between(now_ms - RECENT_DAYS * DAY_MS, now_ms + DAY_MS))


def showable(row_id: Column, title: Column, link: Column) -> Column:
    """What a reader's deck takes: a row with a title and an https address."""
    return _sure(row_id.isNotNull() & (title != "") & F.startswith(link, F.lit("https://")))


def acceptable_email(c: Column) -> Column:
    return _sure((c != "") & F.contains(c, F.lit("@")))


def filter_or_all(wanted: Column, known: Column) -> Column:
    """A stored filter counts only if it is all, saved or a known source."""
    return F.when(wanted.isin("all", "saved") | _sure(F.array_contains(known, wanted)), wanted).otherwise("all")


def stale(loaded_ms: Column, now_ms: int, minutes: int = 15) -> Column:
    return _sure(F.lit(now_ms) - loaded_ms > minutes * 60_000)
