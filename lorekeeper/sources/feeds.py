"""RSS and Atom files as feed entries, read in tasks by Spark's XML source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BROKEN = "_broken"
# Elements of both formats as the XML source names them without their namespaces.
_RSS = f"title string, link string, description string, author string, creator string, pubDate string, date string, encoded string, {_BROKEN} string"
_ATOM = (
    "title string, link array<struct<_href: string, _rel: string>>, summary string, author array<struct<name: string>>, "
    f"published string, updated string, content string, {_BROKEN} string"
)


def _read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    # The tokenizing parser finds the end of a broken entry, so that the next ones are read.
    reader = spark.read.format("xml").option("useLegacyXMLParser", True).schema(schema).option("rowTag", tag).option("ignoreNamespace", True)
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN).option("recursiveFileLookup", True).load(path)
    return rows.select("*", F.col("_metadata.file_path").alias("feed"))


def read_feeds(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries (feed, title, link, summary, author, published, content: array<struct<value>>) and failures (feed, raw, error).

    All files below ``path`` are read; a large file is split over tasks at its entries.  An
    entry that is no well-formed XML, or has no link, is a failure and the others of its
    file go on.  An entry's full text comes from ``content:encoded`` or ``content``; a file
    without entries gives none.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    rss, atom = _read(spark, path, "item", _RSS), _read(spark, path, "entry", _ATOM)
    # The link of an entry is the one without a relation or its alternate.
    links = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    fields: dict[str, tuple[Column, Column]] = {
        "title": (F.col("title"), F.col("title")),
        "link": (F.col("link"), F.get(links, F.lit(0))["_href"]),
        "summary": (F.col("description"), F.col("summary")),
        "author": (F.coalesce(blank(F.col("creator")), blank(F.col("author"))), F.array_join(F.transform("author", lambda a: a["name"]), ", ")),
        "published": (F.coalesce(blank(F.col("pubDate")), blank(F.col("date"))), F.coalesce(blank(F.col("published")), blank(F.col("updated")))),
        "text": (F.col("encoded"), F.col("content")),
    }
    rows = rss.select("feed", _BROKEN, *[blank(a).alias(n) for n, (a, _) in fields.items()])
    rows = rows.unionByName(atom.select("feed", _BROKEN, *[blank(b).alias(n) for n, (_, b) in fields.items()]))
    error = F.when(F.col(_BROKEN).isNotNull(), "malformed_entry").when(F.col("link").isNull(), "missing_link")
    rows = rows.withColumn("error", error)
    content = F.when(F.col("text").isNotNull(), F.array(F.struct(F.col("text").alias("value")))).otherwise(F.array().cast("array<struct<value:string>>"))
    entries = rows.where("error is null").select("feed", "title", "link", "summary", "author", "published", content.alias("content"))
    return entries, rows.where("error is not null").select("feed", F.coalesce(_BROKEN, "title").alias("raw"), "error")
