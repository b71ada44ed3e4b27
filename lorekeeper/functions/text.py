"""String functions over columns: keys, slugs, summaries, sanitising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and their plain forms.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def normalize_name(name: Column) -> Column:
    """Trimmed, in lower case, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def node_id(user: Column, kind: Column, name: Column) -> Column:
    return F.concat_ws(":", user, kind, name)


def edge_id(source: Column, kind: Column, target: Column) -> Column:
    return F.concat_ws("|", source, kind, target)


def entity_key(document: Column, kind: Column, name: Column) -> Column:
    return F.concat_ws("|", document, kind, name)


def slugify(text: Column, limit: int = 80) -> Column:
    """ASCII letters and digits in lower case, joined by hyphens.

    A slug over ``limit`` is cut at its last hyphen, if that keeps half of the limit.
    """
    ascii_text = F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(ascii_text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.substring(slug, 1, limit)
    at_word = F.regexp_replace(cut, "-[^-]*$", "")
    whole = (F.substring(slug, limit + 1, 1) == "-") | (F.length(at_word) < limit // 2)
    short = F.regexp_replace(F.when(whole, cut).otherwise(at_word), "-+$", "")
    return F.when(F.length(slug) <= limit, slug).otherwise(short)


def file_slug(text: Column, limit: int = 120, kept: int = 111) -> Column:
    """A file name: odd characters as underscores; a long one keeps a hash of the whole."""
    safe = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(F.length(safe) <= limit, safe).otherwise(F.concat(F.substring(safe, 1, kept), F.lit("-"), F.substring(F.sha2(text, 256), 1, 8)))


def truncate(text: Column, n: int) -> Column:
    """At most ``n`` characters, the last three dots if some are gone."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def truncate_bytes(text: Column, limit: int, marker: str = "...[truncated]") -> Column:
    """An audit value of at most ``limit`` bytes before the marker."""
    return F.when(F.octet_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def display_name(canonical: Column, identifier: Column) -> Column:
    """The canonical name, else what follows tenant and type in the id."""
    return F.coalesce(F.nullif(canonical, F.lit("")), F.element_at(F.split(identifier, ":", 3), -1))


def sanitize(text: Column) -> Column:
    """Without control characters but tab and line ends."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")


def token_estimate(text: Column) -> Column:
    """About one token for three characters; none for an empty text."""
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, F.lit(0)).otherwise(F.floor(F.length(text) / 3) + 1).cast("long")


def content_id(text: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 16))


def summary(text: Column, n: int = 300) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, n)


def embedding_text(kind: Column, headline: Column, properties: Column) -> Column:
    """``type: headline``, a line for each property in the order of keys, then the content."""
    entries = F.array_sort(F.map_entries(F.map_filter(properties, lambda k, v: (k != "content") & v.isNotNull() & (v != ""))))
    lines = F.transform(entries, lambda e: F.concat_ws(": ", e["key"], e["value"]))
    content = F.nullif(F.element_at(properties, "content"), F.lit(""))
    head = F.concat_ws(": ", kind, headline)
    return F.array_join(F.filter(F.concat(F.array(head), F.coalesce(lines, F.array().cast("array<string>")), F.array(content)), lambda x: x.isNotNull()), "\n")


def typed_embedding_text(kind: Column, headline: Column, properties: Column) -> Column:
    """A preference's statement or a fact's object, trimmed; for all else, or without one, the general text."""
    own = lambda name: F.nullif(F.trim(F.element_at(properties, name)), F.lit(""))
    general = embedding_text(kind, headline, F.map_filter(properties, lambda k, _: ~k.isin("aliases", "confidence")))
    return F.coalesce(F.when(kind == "preference", own("statement")).when(kind == "fact", F.coalesce(own("object"), own("object_"))), general)


def query_slug(text: Column, limit: int = 48) -> Column:
    """A file stem from a query, ``graph`` if nothing is left of it."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(slug, 1, limit), "^-+|-+$", ""), F.lit("")), F.lit("graph"))


def node_line(kind: Column, name: Column, properties: Column, n: int = 120) -> Column:
    """A node in one line: its content, else its properties in the order of their keys."""
    head = F.concat(kind, F.lit(": "), name)
    entries = F.array_sort(F.map_entries(F.map_filter(properties, lambda k, v: (k != "content") & v.isNotNull() & (v != ""))))
    detail = F.nullif(F.array_join(F.transform(entries, lambda e: F.concat_ws(": ", e["key"], e["value"])), "; "), F.lit(""))
    content = F.nullif(F.element_at(properties, "content"), F.lit(""))
    return F.when(content.isNotNull(), F.concat(head, F.lit(" — "), truncate(content, n))).otherwise(truncate(F.concat_ws(" — ", head, detail), n))


def edge_line(source: Column, kind: Column, target: Column) -> Column:
    return F.concat(source, F.lit(" —["), kind, F.lit("]→ "), target)


def per_key_merge(primary: Column, incoming: Column) -> Column:
    """Two string maps as one: a missing key is filled, of two values the longer stays."""

    def longer(_: Column, a: Column, b: Column) -> Column:
        return F.when(a.isNull(), b).when(b.isNull(), a).when(F.length(b) > F.length(a), b).otherwise(a)

    return F.map_zip_with(primary, incoming, longer)


def capped_union(a: Column, b: Column, n: int) -> Column:
    """The distinct values of two arrays in order, at most ``n``."""
    empty = F.array().cast("array<string>")
    return F.slice(F.array_sort(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty))), 1, n)


def merge_maps(entries: Column, order: list[str], value: str = "properties") -> Column:
    """Maps of an array of structs as one, in the order of the named fields; of equal keys the last stays."""
    key = lambda x: F.struct(*[x[c] for c in order])
    in_order = F.array_sort(entries, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))
    maps = F.transform(in_order, lambda x: x[value])
    fresh = lambda a, b: F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.aggregate(maps, F.create_map().cast("map<string,string>"), lambda a, b: F.map_concat(fresh(a, b), b))
