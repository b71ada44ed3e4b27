"""Source records as documents: feeds, pages, datasets, files, conversations, videos."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import web as W

FILE_SUFFIXES = (".txt", ".md", ".html")


def page_documents(pages: DataFrame, now: Column) -> DataFrame:
    """A document for each scraped page: title, description, author, date and text."""
    h = F.col("html")
    published = F.coalesce(W.meta(h, "article:published_time"), F.lit(""))
    return pages.select(
        F.col("url").alias("source_uri"), F.lit("web").alias("source_type"), W.page_title(h).alias("title"),
        F.coalesce(W.meta(h, "og:description"), W.meta(h, "description"), F.lit("")).alias("description"),
        F.array(F.coalesce(W.meta(h, "author"), F.lit("Unknown"))).alias("authors"),
        W.parse_date(published, now).alias("published_at"), W.html_text(h).alias("content"),
    )


def feed_documents(entries: DataFrame, now: Column) -> DataFrame:
    """Feed entries (title, link, summary, author, published, content: array<struct<value>>) as documents."""
    body = F.coalesce(F.get("content", F.lit(0))["value"], F.lit(""))
    return entries.select(
        F.col("link").alias("source_uri"), F.lit("substack").alias("source_type"), F.coalesce("title", F.lit("Untitled")).alias("title"),
        F.coalesce("summary", F.lit("")).alias("description"), W.authors(F.col("author")).alias("authors"),
        W.parse_date(F.col("published"), now).alias("published_at"), W.html_text(body).alias("content"), W.links(body).alias("references"),
    )


def dataset_batches(rows: DataFrame, key: str, offset: int, max_samples: int, batch_size: int) -> DataFrame:
    """Rows ``offset`` to ``offset + max_samples`` in the order of ``key``, with their batch.

    The limit is what a caller asks of a dataset; only it is put in order.
    """
    taken = rows.orderBy(key).offset(offset).limit(max_samples)
    return taken.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(key)) - 1) / batch_size).cast("long"))


def dataset_documents(rows: DataFrame, now: Column) -> DataFrame:
    """Dataset rows (id, title, authors, abstract, update_date) as documents; rows without an id are dropped."""
    return rows.where(F.trim(F.coalesce("id", F.lit(""))) != "").select(
        F.concat(F.lit("https://arxiv.org/abs/"), F.trim("id")).alias("source_uri"), F.lit("huggingface").alias("source_type"),
        F.trim(F.coalesce("title", F.lit(""))).alias("title"), F.trim(F.coalesce("abstract", F.lit(""))).alias("description"),
        W.authors(F.col("authors")).alias("authors"), F.coalesce(F.try_to_timestamp("update_date", F.lit("yyyy-MM-dd")), now).alias("published_at"),
    )


def conversation_documents(turns: DataFrame) -> DataFrame:
    """One document a conversation: its turns in order and an id from their text."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), F.coalesce(x["text"], F.lit(""))))
    docs = turns.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("content"), F.count(F.lit(1)).alias("n_turns"))
    return docs.select("conv_id", "n_turns", T.content_id(F.col("content"), "conversation://").alias("source_uri"), "content")


def file_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text, markdown and HTML files under a path, one document each."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("source_uri"), F.col("_metadata.file_name").alias("title"), "value")
    suffix = F.lower(F.regexp_extract("title", r"(\.[^.]+)$", 1))
    content = F.when(suffix == ".html", W.html_text(F.col("value"))).otherwise(F.col("value"))
    return rows.where(suffix.isin(*FILE_SUFFIXES)).select("source_uri", F.lit("file").alias("source_type"), "title", content.alias("content"))


def scrape(urls: DataFrame, fetch: Callable[[str], str], max_chars: int = 20_000) -> DataFrame:
    """url, success, content (cut at ``max_chars``) and error for each url; a fetch that fails does not raise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    rows.append((url, True, fetch(url)[:max_chars], None))
                except Exception as e:  # becomes a row
                    rows.append((url, False, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "success", "content", "error"])

    return urls.select("url").mapInPandas(run, "url string, success boolean, content string, error string")


def transcripts(videos: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """A transcript for each video: the first primary one that is not blank, else the fallback's, else an error."""

    def first(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy("video_id").agg(F.min_by("text", "seq").alias(name))

    rows = videos.join(first(primary, "p"), "video_id", "left").join(first(fallback, "f"), "video_id", "left")
    found = F.coalesce("p", "f")
    return rows.select("video_id", found.alias("transcript"), F.when(F.col("p").isNotNull(), "primary").when(F.col("f").isNotNull(), "fallback").alias("provider"), F.when(found.isNull(), "no_transcript: neither provider has one").alias("ingest_error"))


def typed_sources(urls: DataFrame) -> DataFrame:
    """Untyped urls with their family; hosts of typed substack siblings count as substack too."""
    kind, host = W.source_type(F.col("url")), W.host(F.col("url"))
    rows = urls.select("url", F.coalesce("type", kind).alias("type"), host.alias("host"), F.col("type").isNotNull().alias("typed"))
    known = rows.where(F.col("typed") & (F.col("type") == "substack")).select("host").distinct().withColumn("sibling", F.lit(True))
    rows = rows.join(known, "host", "left")
    return rows.select("url", F.when(F.col("sibling") & ~F.col("typed"), "substack").otherwise(F.col("type")).alias("type"))


def search_results(pages: DataFrame, num_results: int) -> DataFrame:
    """Ranked organic results of captured search pages: rank, title and url for each query."""
    hit = F.regexp_extract_all("html", F.lit(r'(?s)<a[^>]*href="(https?://[^"]+)"[^>]*>\s*<h3[^>]*>(.*?)</h3>'), F.lit(0))
    rows = pages.select("query", "page", F.posexplode(hit).alias("pos", "hit"))
    url = F.regexp_extract("hit", r'href="(https?://[^"]+)"', 1)
    rows = rows.select("query", "page", "pos", url.alias("url"), F.regexp_replace(F.regexp_extract("hit", r"(?s)<h3[^>]*>(.*?)</h3>", 1), "<[^>]+>", "").alias("title"))
    first = rows.where(W.is_organic(F.col("url"))).groupBy("query", "url").agg(F.min(F.struct("page", "pos", "title")).alias("x"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("x.page", "x.pos"))
    return first.select("query", rank.alias("rank"), "url", "x.title").where(F.col("rank") <= num_results)


def union_all(tables: list[DataFrame]) -> DataFrame:
    """Records of several sources as one table; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def video_metadata(entries: DataFrame) -> DataFrame:
    """Entries of a video feed (link, title, author, published) with ids; entries without one are dropped."""
    rows = entries.withColumn("video_id", W.video_id(F.col("link"))).where("video_id is not null")
    return rows.select("video_id", W.canonical_video_url(F.col("video_id")).alias("source_uri"), "title", F.col("author").alias("channel"), W.parse_date(F.col("published"), F.lit(None)).alias("published_at"))


def split_videos(urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Urls with their video's id, and a failure row for each that names none."""
    rows = urls.withColumn("video_id", W.video_id(F.col("url")))
    return rows.where("video_id is not null"), rows.where("video_id is null").select("url", F.lit("invalid_video: no id in the url").alias("ingest_error"))


def embed_metadata(answers: DataFrame) -> DataFrame:
    """Title and channel from captured oEmbed answers (video_id, body as JSON); malformed ones have none."""
    j = F.from_json("body", "title string, author_name string")
    return answers.select("video_id", j["title"].alias("title"), j["author_name"].alias("channel"))


def source_rows(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """A configured list of sources as rows: type, uri and the rest as a map, in their order."""
    rows = [(i, s.get("type"), s["uri"], {k: str(v) for k, v in s.items() if k not in ("type", "uri")}) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, "position int, type string, url string, options map<string,string>")
