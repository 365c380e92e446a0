"""The source catalogue, the entity dictionary and the patterns of the feed's rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PER_SOURCE = 12
PER_FEED = 18
RECENT_DAYS = 90
ENRICH_MAX = 16
DIGEST_SIZE = 5
MAIL_BATCH = 50
CACHE_LEAST = 20
HOUR_MS, DAY_MS = 3_600_000, 86_400_000

#: Publishers with their retrieval plans in order of quality: fixed values.
SOURCES = [
    ("archdaily", "ArchDaily", "#bf2d0a", "archdaily.com", [("rss", ["https://www.archdaily.com/feed"], None), ("rss", ["https://feeds.feedburner.com/Archdaily"], None), ("bing", ["archdaily.com"], None)]),
    ("dezeen", "Dezeen", "#0a4fb8", "dezeen.com", [("rss", ["https://www.dezeen.com/feed/"], None), ("rss", ["https://feeds.feedburner.com/dezeen"], None), ("bing", ["dezeen.com"], None)]),
    ("archinect", "Archinect", "#0a8a35", "archinect.com", [("rss", ["https://archinect.com/feed/1/news"], None), ("rss", ["https://archinect.com/feed/news"], None), ("bing", ["archinect.com"], None)]),
    ("metropolis", "Metropolis", "#6b08a8", "metropolismag.com", [("wp", ["https://metropolismag.com/wp-json/wp/v2/"], ["metro_project", "metro_viewpoint", "metro_profile", "metro_product"]), ("bing", ["metropolismag.com"], None)]),
    ("archrecord", "Arch Record", "#b87008", "architecturalrecord.com", [("rss", ["https://www.architecturalrecord.com/rss/articles"], None), ("bing", ["architecturalrecord.com"], None)]),
    ("designboom", "Designboom", "#a80875", "designboom.com", [("rss", ["https://www.designboom.com/architecture/rss/"], None), ("rss", ["https://www.designboom.com/rss/"], None), ("bing", ["designboom.com"], None)]),
    ("archpaper", "Arch Paper", "#087ab8", "archpaper.com", [("rss", ["https://www.archpaper.com/feed/"], None), ("bing", ["archpaper.com"], None)]),
    ("domus", "Domus", "#5a5a3a", "domusweb.it", [("domus", ["https://www.domusweb.it/en/architecture.html", "https://www.domusweb.it/en/news.html"], None), ("bing", ["domusweb.it"], None)]),
]
SOURCE_SCHEMA = "id string, name string, color string, domain string, plan array<struct<kind string, arg array<string>, types array<string>>>"
DEFAULT_COLOR, DIGEST_COLOR = "#333", "#555"

#: Named character references that are decoded: fixed values.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»",
    "copy": "©", "reg": "®", "trade": "™", "deg": "°", "eacute": "é", "egrave": "è", "ecirc": "ê", "euml": "ë", "aacute": "á", "agrave": "à", "acirc": "â", "auml": "ä", "atilde": "ã", "aring": "å",
    "iacute": "í", "igrave": "ì", "icirc": "î", "iuml": "ï", "oacute": "ó", "ograve": "ò", "ocirc": "ô", "ouml": "ö", "otilde": "õ", "oslash": "ø", "uacute": "ú", "ugrave": "ù", "ucirc": "û", "uuml": "ü",
    "ntilde": "ñ", "ccedil": "ç", "szlig": "ß", "Eacute": "É", "Aacute": "Á", "Oacute": "Ó", "Uuml": "Ü", "Ouml": "Ö", "Auml": "Ä", "Ccedil": "Ç", "Ntilde": "Ñ", "times": "×", "middot": "·", "bull": "•",
}

#: Patterns of images that are no story images, of titles that are no stories, and of hosts that are no publishers: fixed values.
BAD_IMAGE = r"googleusercontent\.com|news\.google\.com|gravatar\.com|feedburner|pixel|tracking|1x1|spacer|blank\.gif|/emoji/|s\.w\.org|favicon|rsslogo|-411x411"
BAD_PREVIEW = r"/og/flat/|default|placeholder|logo"
JUNK_TITLE = r"^(?:log ?in|sign ?in|subscribe|create account|register to|login to|one moment|just a moment|access denied|page not found)"
SEARCH_HOSTS = r"news\.google\.com|bing\.com"
EXCLUDED_PATHS = r"/(?:speciali|shop|sponsored-content|advertorial)/"
#: Publication names that search engines append to titles: fixed values.
PUBLICATIONS = r"ArchDaily|Dezeen|Archinect|Metropolis(?: Magazine)?|Architectural Record|designboom|The Architect[’']s Newspaper|Domus(?: Web)?"

#: Patterns of the landed formats: fixed values.
FEED_ITEM = r"(?i)<(?:item|entry)[\s>]"
SEARCH_ITEM = r"(?i)<item[\s>][\s\S]*?</item>"
MEDIA = r"""(?i)<media:(?:content|thumbnail)\b[^>]*?\burl=["'][^"']+["'][^>]*>"""
ENCLOSURE = r"""(?i)<enclosure\b[^>]*?\burl=["'][^"']+["'][^>]*>"""
URL_ATTRIBUTE = r"""(?i)\burl=["']([^"']+)["']"""
MEDIUM_NOT_IMAGE = r"""(?i)medium=["'](?:video|audio)["']|type=["'](?:video|audio)"""
TYPE_NOT_IMAGE = r"""(?i)type=["'](?:video|audio)"""
IMG_SRC = r"""(?i)<img\b[^>]*?\bsrc=["']([^"']+)["']"""
ALTERNATE_LINK = r"""(?i)<link\b[^>]*rel=["']alternate["'][^>]*href=["']([^"']+)["']"""
ANY_LINK = r"""(?i)<link\b[^>]*href=["']([^"']+)["']"""
PREVIEW_NAME = r"""(?:property|name)=["'](?:og:image|twitter:image)["']"""
CONTENT_ATTRIBUTE = r"""content=["']([^"']+)["']"""
SECTION_BLOCK = r"""(?i)<article\b[^>]*class="[^"]*c-article-prev[\s\S]*?</article>"""
SECTION_LINK = r"""(?i)href="(/en/[a-z0-9\-/]+/(20\d\d)/(\d\d)/(\d\d)/[^"]+\.html)\""""
SECTION_TITLE = r"(?i)inject-title[^>]*>([\s\S]*?)</span>"
SECTION_TEXT = r"(?i)<p[^>]*inject-desc[^>]*>([\s\S]*?)</p>"
LAZY_SRC, PLAIN_SRC = r"""(?i)<img[^>]*data-src="([^"]+)\"""", r"""(?i)<img[^>]*src="([^"]+)\""""
SMALL_PHOTO, MEDIUM_PHOTO = ".foto.rsmall.", ".foto.rmedium."
SEARCH_TARGET = r"[?&]url=([^&]+)"
PICTURE_SIZE = "&w=900&h=600&c=14"
DROPPED_ELEMENTS = r"script|style|figure|figcaption|iframe|h[1-6]"
FEED_CREDIT = r"(?i)The post [^\n\r]{0,220}? appeared first on [^\n\r]*\z"
MORE_PHRASES = "Read more|Read the full story|Continue reading|Continued here"
SENTENCE = r"[^.!?…]+[.!?…]+[\"”’)]*\s*|[^.!?…]+$"


def source_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, SOURCE_SCHEMA)
