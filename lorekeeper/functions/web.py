"""Functions over urls, markup and source records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
VIDEO_HOSTS = ("youtube.com", "m.youtube.com", "music.youtube.com")
SEARCH_HOSTS = ("google.com", "googleusercontent.com", "gstatic.com")
REDIRECTS = ("youtube.com/redirect",)


def host(url: Column) -> Column:
    """The host in lower case without ``www.``; null if there is none."""
    return F.regexp_replace(F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1), F.lit(""))), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def video_id(url: Column) -> Column:
    """The eleven characters that name a video, from a bare id or a known form of url."""
    bare = F.rlike(url, F.lit(r"^[A-Za-z0-9_-]{11}$"))
    known = host(url).isin(*VIDEO_HOSTS)
    short = F.regexp_extract(path(url), r"^/([A-Za-z0-9_-]{11})$", 1)
    watch = F.regexp_extract(url, r"[?&]v=([A-Za-z0-9_-]{11})(?:[&#]|$)", 1)
    other = F.regexp_extract(path(url), r"^/(?:shorts|embed|live)/([A-Za-z0-9_-]{11})/?$", 1)
    found = F.when(bare, url).when(host(url) == "youtu.be", short).when(known, F.coalesce(F.nullif(watch, F.lit("")), other))
    return F.nullif(found, F.lit(""))


def canonical_video_url(identifier: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), identifier)


def channel_id(feed: Column) -> Column:
    return F.nullif(F.regexp_extract(feed, r"[?&]channel_id=([^&#]+)", 1), F.lit(""))


def source_type(url: Column) -> Column:
    """The family of a source that is given by url alone."""
    h, p = host(url), path(url)
    return (
        F.when(h.isNull(), F.lit(None).cast("string"))
        .when(h.isin(*VIDEO_HOSTS, "youtu.be"), "youtube")
        .when((h == "huggingface.co") & F.startswith(p, F.lit("/datasets/")), "huggingface")
        .when(F.endswith(h, F.lit(".substack.com")) | F.rlike(p, F.lit(r"/feed/?$")), "substack")
        .otherwise("web")
    )


# Types that a source may be given with its uri, and what engines say when they find nothing.
SOURCE_ENTRY_TYPES = ("substack_rss", "substack_article", "huggingface_dataset", "youtube_video", "youtube_rss", "web")
NOTHING_FOUND = ("did not match any documents", "did not match any", "no results found", "ничего не нашлось")


def uri_token(token: Column) -> Column:
    """uri and type of ``uri=type``; an end that is no known type belongs to the uri."""
    kind = F.regexp_extract(token, "=([^=]*)$", 1)
    typed = kind.isin(*SOURCE_ENTRY_TYPES)
    return F.struct(F.when(typed, F.regexp_replace(token, "=[^=]*$", "")).otherwise(token).alias("uri"), F.when(typed, kind).alias("type"))


def nothing_found(body: Column) -> Column:
    """Whether a page of results says that there are none, as against one that could not be read."""
    low = F.lower(F.coalesce(body, F.lit("")))
    found = F.lit(False)
    for words in NOTHING_FOUND:
        found = found | F.contains(low, F.lit(words))
    return found


def url_problem(url: Column) -> Column:
    """Why a url cannot be ingested, or null."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return (
        F.when(url.isNull() | (F.trim(url) == ""), "empty")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(host(url).isNull(), "host")
    )


def is_organic(url: Column) -> Column:
    """Whether a result leads away from the search engine's own hosts."""
    h = host(url)
    own = F.lit(False)
    for x in SEARCH_HOSTS:
        own = own | (h == x) | F.endswith(h, F.lit("." + x))
    for x in REDIRECTS:
        own = own | F.startswith(F.concat(h, path(url)), F.lit(x))
    return F.coalesce(~own, F.lit(False))


def links(html: Column) -> Column:
    """The distinct absolute links in the order of their first places."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""href=["'](https?://[^"']+)["']"""), F.lit(1)))


def meta(html: Column, name: str) -> Column:
    """The content of a meta tag by ``property``, else by ``name``."""

    def by(attribute: str) -> Column:
        return F.nullif(F.regexp_extract(html, rf"""<meta[^>]*{attribute}=["']{name}["'][^>]*content=["']([^"']*)["']""", 1), F.lit(""))

    return F.coalesce(by("property"), by("name"))


def page_title(html: Column) -> Column:
    title = F.nullif(F.trim(F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    return F.coalesce(meta(html, "og:title"), meta(html, "twitter:title"), title)


def markdown_title(text: Column, url: Column) -> Column:
    """The first heading, else the last part of the path in title case, else the host."""
    heading = F.nullif(F.regexp_extract(text, r"(?m)^\s*#\s+(.+?)\s*$", 1), F.lit(""))
    part = F.regexp_extract(path(url), r"([^/]+)/*$", 1)
    named = F.nullif(F.initcap(F.trim(F.regexp_replace(F.regexp_replace(part, r"\.[A-Za-z0-9]+$", ""), "[-_]+", " "))), F.lit(""))
    return F.coalesce(heading, named, host(url))


def authors(text: Column) -> Column:
    """Names between commas; ``Unknown`` if there is none."""
    names = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("Unknown")))


def parse_date(text: Column, fallback: Column) -> Column:
    """An ISO date or time, then RFC 2822, in UTC if no zone is given; else the fallback."""
    rfc = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"(GMT|UTC|Z)$", "+0000")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")), fallback)


def seconds(milliseconds: Column) -> Column:
    """Milliseconds as seconds, 0 if they are no number."""
    return F.coalesce(milliseconds.try_cast("double") / 1000, F.lit(0.0))


def html_text(html: Column) -> Column:
    """Text of markup: a line for each block, without tags and empty lines."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    broken = F.regexp_replace(bare, r"(?i)<br\s*/?>|</?(?:p|div|h[1-6]|li|ul|ol|blockquote|tr|table|article|section|header|footer|nav)[^>]*>", "\n")
    plain = F.regexp_replace(broken, r"(?s)<[^>]+>", "")
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(lines, "\n")


def search_url(query: Column, start: Column, language: str = "en") -> Column:
    """The url of a page of search results."""
    return F.concat(F.lit("https://www.google.com/search?q="), F.url_encode(query), F.lit(f"&num=10&hl={language}"), F.when(start > 0, F.concat(F.lit("&start="), start.cast("string"))).otherwise(F.lit("")))


#: Characters of a snippet, and fewer than are worth one.
SNIPPET_CHARS, LEAST_SNIPPET = 300, 20


def engine_url(query: Column, engine: str = "google", country: str | None = None, language: str | None = None, offset: Column | int = 0) -> Column:
    """The url of a page of results of an engine; pages begin at ``offset`` results."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    part = lambda name, value: F.lit("") if value is None else F.concat(F.lit(f"&{name}="), F.url_encode(F.lit(value)))
    if engine == "google":
        start = F.when(at > 0, F.concat(F.lit("&start="), at.cast("string"))).otherwise(F.lit(""))
        return F.concat(F.lit("https://www.google.com/search?q="), F.url_encode(query), part("gl", country), part("hl", language), start)
    if engine == "bing":
        return F.concat(F.lit("https://www.bing.com/search?q="), F.url_encode(query), part("cc", country), part("setLang", language), F.lit("&first="), (at + 1).cast("string"))
    if engine == "yandex":
        return F.concat(F.lit("https://yandex.com/search/?text="), F.url_encode(query), part("lr", country))
    raise ValueError(f"unknown engine {engine!r}")


def snippet(around: Column, title: Column) -> Column:
    """What the markup around a result says beside its title: empty if too short, cut with dots if long."""
    words = F.trim(F.regexp_replace(F.regexp_replace(around, "<[^>]+>", " "), r"\s+", " "))
    rest = F.when((title != "") & F.startswith(words, title), F.ltrim(F.substr(words, F.length(title) + 1))).otherwise(words)
    cut = F.concat(F.rtrim(F.substring(rest, 1, SNIPPET_CHARS)), F.lit("..."))
    return F.when(F.length(rest) < LEAST_SNIPPET, "").when(F.length(rest) > SNIPPET_CHARS, cut).otherwise(rest)


def json_field(raw: Column, schema: str, name: str, default: Column) -> Column:
    """A field of JSON text; the default where the text is malformed or has no such field."""
    return F.coalesce(F.from_json(raw, schema)[name], default)
