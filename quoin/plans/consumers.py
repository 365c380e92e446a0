"""What is made of a feed: reader decks, saved stories, the subscriber set and the digest's outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.catalog import DEFAULT_COLOR, DIGEST_COLOR, DIGEST_SIZE, MAIL_BATCH
from quoin.functions import text as T
from quoin.functions.text import uri_decode
from quoin.functions.predicates import acceptable_email, showable
from quoin.operators.feed import ranked
from quoin.operators.interleave import interleave


def view(feed: DataFrame, wanted: str, saved: DataFrame | None = None, order: str = "rank") -> DataFrame:
    """A reader's list with ``place``: all interleaved; the saved ones or one source's in feed order."""
    deck = loadable(feed)
    if wanted == "all":
        return interleave(deck, order)
    part = deck.join(saved.select(F.col("story_id").alias("id")).distinct(), "id", "left_semi") if wanted == "saved" else deck.where(F.col("sourceId") == wanted)
    return ranked(part, [F.col(order)], "place").withColumn("place", F.col("place") - 1)


def loadable(feed: DataFrame, required: bool = False) -> DataFrame:
    """The rows a reader can show. A feed without any is an error where rows are required."""
    deck = feed.where(showable(F.col("id"), F.col("title"), F.col("link")))
    if required and deck.isEmpty():
        raise ValueError("the feed has no story to show")
    return deck


def filter_label(wanted: Column, name: Column) -> Column:
    """What the chosen filter is called: all, saved, or the source's name ('' for an unknown one)."""
    return F.when(wanted == "all", "All").when(wanted == "saved", "Saved").otherwise(F.coalesce(name, F.lit("")))


def requested_id(fragment: Column) -> Column:
    """The story id of an address's fragment, decoded; null where malformed or empty."""
    return F.nullif(uri_decode(F.regexp_replace(fragment, "^#", "")), F.lit(""))


def deep_links(requests: DataFrame, feed: DataFrame, fragment: str = "fragment", wanted: str = "wanted") -> DataFrame:
    """Adds requested and filter: a requested story that is in the feed shows all of it, any other leaves the filter as it is."""
    ids = feed.select(F.col("id").alias("requested"), F.lit(True).alias("__here")).where("requested is not null").distinct()
    asked = requests.withColumn("requested", requested_id(F.col(fragment)))
    return asked.join(ids, "requested", "left").withColumn("filter", F.when(F.col("__here"), "all").otherwise(F.col(wanted))).withColumn("found", F.coalesce("__here", F.lit(False))).drop("__here")


def clamped(at: Column, cards: Column) -> Column:
    """A place within the deck: from the first card to the end card behind the last."""
    return F.greatest(F.lit(0), F.least(cards, at))


def stored(value: Column, schema: str, default: Column) -> Column:
    """A stored JSON value; the default where there is none or it can't be read. The schema is of a struct, map or array."""
    return F.coalesce(F.when(F.try_parse_json(value).isNotNull(), F.from_json(value, schema)), default)


def saved_set(log: DataFrame, keys: tuple[str, ...] = ("reader_no", "story_id")) -> DataFrame:
    """Toggles to a set: a pair is saved after an odd number of them; saved_at is the last time. Null keys take no part."""
    by = log.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("n"), F.max("saved_at").alias("saved_at"))
    return by.where("n % 2 = 1").drop("n")


def toggle(saved: DataFrame, taps: DataFrame, keys: tuple[str, ...] = ("reader_no", "story_id")) -> DataFrame:
    """One tap a pair: what is saved is removed, what is not is saved with the tap's time."""
    t = taps.groupBy(*keys).agg(F.max("saved_at").alias("__tap"))
    return saved.join(t, list(keys), "full_outer").where("saved_at is null or __tap is null").select(*keys, F.coalesce("saved_at", "__tap").alias("saved_at"))


def saved_counts(saved: DataFrame, feed: DataFrame) -> DataFrame:
    """(reader_no, saved, present): a reader's saved stories and how many of them are in the feed."""
    here = feed.select(F.col("id").alias("story_id"), F.lit(1).alias("here")).distinct()
    return saved.join(here, "story_id", "left").groupBy("reader_no").agg(F.count("*").alias("saved"), F.count("here").alias("present"))


def cards(deck: DataFrame, sources: DataFrame, now_ms: int, place: str = "place") -> DataFrame:
    """A row a card: ordinal, source's name and colour, age, escaped title and text, guarded addresses."""
    total = deck.agg(F.count("*").alias("__total"))
    dim = sources.select(F.col("id").alias("sourceId"), F.col("name").alias("__name"), F.col("color").alias("__color"))
    d = deck.crossJoin(total).join(dim, "sourceId", "left")
    image = T.safe_url(F.coalesce("image", F.lit("")))
    return d.select(
        place, T.ordinal((F.col(place) + 1).cast("int"), F.col("__total").cast("int")).alias("ordinal"), T.escape_html(F.coalesce("__name", "sourceName")).alias("source_name"), T.color_or(F.col("__color"), DEFAULT_COLOR).alias("color"),
        T.age(F.col("timestamp"), now_ms).alias("age"), T.escape_html(F.col("title")).alias("title"), T.escape_html(T.display_text(F.col("short"), F.col("excerpt"))).alias("text"), T.escape_html(T.safe_url(F.col("link"))).alias("href"),
        F.when(image != "", F.concat(F.lit("url('"), T.css_quote(T.escape_html(image)), F.lit("')"))).otherwise("none").alias("background"),
        F.struct(F.col("title"), F.coalesce("short", F.lit("")).alias("text"), T.safe_url(F.col("link")).alias("url")).alias("share"),
    )


def card_html(c: DataFrame, place: str = "place") -> DataFrame:
    """(place, html): the deck as rows of markup, written in parallel and concatenated by their order.

    A card without an image has its source's name in place of one; behind the last card comes the end card.
    """
    e = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    col = F.col
    text = F.when(col("text") != "", e('<p class="short">', col("text"), "</p>")).otherwise("")
    media = F.when(col("background") == "none", e('<div class="media none">', col("source_name"), "</div>")).otherwise(e('<div class="media" style="background-image:', col("background"), '"></div>'))
    html = e('<section class="card" data-i="', col(place).cast("string"), '">', media, '<div class="count">', col("ordinal"), '</div><span class="pill" style="background:', col("color"), '">', col("source_name"), "</span><span>", col("age"), "</span><h2>", col("title"), "</h2>", text, '<a href="', col("href"), '"></a></section>')
    n = c.agg(F.count("*").alias(place))
    end = n.select(place, F.lit('<section class="card end"><h2>That is all for now</h2></section>').alias("html"))
    return c.select(place, html.alias("html")).unionByName(end)


def sign_ups(bodies: DataFrame, column: str = "body", keep: list[str] | None = None) -> DataFrame:
    """(keep..., email) of request bodies: JSON objects, or JSON strings of such, with an optional email. What can't be read has ''."""
    inner = F.when(F.col(column).startswith('"'), F.from_json(F.concat(F.lit("["), F.col(column), F.lit("]")), "array<string>")[0]).otherwise(F.col(column))
    return bodies.select(*(keep or []), F.coalesce(F.get_json_object(F.when(F.try_parse_json(inner).isNotNull(), inner), "$.email"), F.lit("")).alias("email"))


def emails(raw: DataFrame, column: str = "email") -> DataFrame:
    """The set of acceptable addresses, trimmed and in lower case."""
    e = T.email(F.col(column))
    return raw.select(e.alias("email")).where(acceptable_email(F.col("email"))).distinct()


def new_subscribers(raw: DataFrame, known: DataFrame) -> DataFrame:
    """Sign-ups that are not in the set yet: what is appended and welcomed, once each."""
    return emails(raw).join(known.select("email").distinct(), "email", "left_anti")


def subscriber_counter(known: DataFrame, new: DataFrame) -> DataFrame:
    """(count): the counter after the new ones, one step each."""
    return known.select("email").distinct().unionByName(new.select("email")).agg(F.count("*").alias("count"))


def welcomes(new: DataFrame, subject: str = "Welcome") -> DataFrame:
    """(to, subject, html) for the mailer: one welcome for each new subscriber."""
    return new.select(F.col("email").alias("to"), F.lit(subject).alias("subject"), F.concat(F.lit("<p>Welcome, "), T.escape_html(F.col("email")), F.lit("</p>")).alias("html"))


def digest_log(outbox_rows: DataFrame, sent_at: Column) -> DataFrame:
    """(sent_at, recipients, batches, runs): one row a run that had anything to send, none otherwise; runs rise by one each."""
    n = outbox_rows.agg(F.count("*").alias("recipients"), F.count_distinct("batch_no").alias("batches")).where("recipients > 0")
    return n.select(sent_at.alias("sent_at"), "recipients", "batches", F.lit(1).alias("runs"))


def digest_counters(log: DataFrame) -> DataFrame:
    """(last_sent, emails_sent, recipients): the state after all runs; emails_sent counts runs."""
    return log.agg(F.max("sent_at").alias("last_sent"), F.coalesce(F.sum("runs"), F.lit(0)).alias("emails_sent"), F.coalesce(F.sum("recipients"), F.lit(0)).alias("recipients"))


def digest_rows(feed: DataFrame, sources: DataFrame, n: int = DIGEST_SIZE) -> DataFrame:
    """The first n stories as the digest shows them. A source without a colour takes the default."""
    top = feed.orderBy("rank").limit(n)
    dim = sources.select(F.col("id").alias("sourceId"), F.col("color").alias("__color"))
    place = F.row_number().over(Window.orderBy("rank"))  # n rows
    return top.join(dim, "sourceId", "left").select(F.concat(F.lit("0"), place.cast("string")).alias("ordinal"), "sourceName", T.color_or(F.col("__color"), DIGEST_COLOR).alias("color"), "title", T.digest_excerpt(F.col("excerpt")).alias("excerpt"), "link")


def digest_html(rows: DataFrame, day: Column) -> DataFrame:
    """(html): the digest's body, one row."""
    e = F.concat(F.lit('<tr><td><span style="background:'), "color", F.lit('">'), "sourceName", F.lit("</span><div>"), "ordinal", F.lit("</div><h3>"), "title", F.lit("</h3><p>"), "excerpt", F.lit('</p><a href="'), "link", F.lit('">READ FULL STORY →</a></td></tr>'))
    body = rows.select("ordinal", e.alias("h")).where("h is not null").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "h"))), lambda x: x["h"]), "").alias("rows")).where("rows <> ''")  # few rows; none, no digest
    return body.select(F.concat(F.lit("<div>"), T.long_date(day), F.lit("</div><table>"), "rows", F.lit("</table>")).alias("html"))


def outbox(subscribers: DataFrame, html: DataFrame, day: Column, subject: str = "Weekly", batch: int = MAIL_BATCH) -> DataFrame:
    """(batch_no, to, subject, html) for the mailer: batches of ``batch`` addresses in order. No rows without subscribers or html."""
    numbered = ranked(subscribers.select("email"), [F.col("email")], "n")
    line = F.concat(F.lit(subject + " — "), F.date_format(day, "MMMM d, yyyy"))
    return numbered.crossJoin(html.limit(1)).select(F.floor((F.col("n") - 1) / batch).alias("batch_no"), F.col("email").alias("to"), line.alias("subject"), "html")
