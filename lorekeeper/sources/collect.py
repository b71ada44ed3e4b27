"""Typed sources of a batch as documents: routing, guards, isolated fetches, and failures as rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import web as W
from . import documents as D

#: Bytes that a source may bring with it.
MAX_PAYLOAD = 400_000
Fetch = Callable[[str], str]
_FIELDS = ("user_id", "source_uri", "source_type", "title", "description", "authors", "published_at", "content")


def routed(urls: DataFrame, substack: DataFrame | None = None) -> DataFrame:
    """``urls`` with problem and handler (youtube, substack or web; null where there is a problem).

    ``substack(host)`` names configured hosts of that family beside its own.  A feed of a
    video channel stands for many documents and is no single one's url.
    """
    host, path = W.host(F.col("url")), W.path(F.col("url"))
    feed = host.isin("youtube.com", "m.youtube.com") & (path == "/feeds/videos.xml")
    rows = urls.withColumns({"problem": F.coalesce(W.url_problem(F.col("url")), F.when(feed, "feed")), "__host": host})
    own = F.lit(False)
    if substack is not None:
        known = substack.select(F.regexp_replace(F.lower("host"), r"^www\.", "").alias("__host"), F.lit(True).alias("__own")).distinct()
        rows, own = rows.join(known, "__host", "left"), F.coalesce("__own", F.lit(False))
    inside = lambda name: (F.col("__host") == name) | F.endswith(F.col("__host"), F.lit(f".{name}"))
    handler = F.when(inside("youtube.com") | (F.col("__host") == "youtu.be"), "youtube").when(inside("substack.com") | own, "substack").otherwise("web")
    return rows.withColumn("handler", F.when(F.col("problem").isNull(), handler)).drop("__host", "__own")


def payload_problem(*parts: Column) -> Column:
    """``payload`` where what a source brings is over the cap, else null."""
    size = sum((F.octet_length(F.coalesce(p, F.lit(""))) for p in parts), start=F.lit(0))
    return F.when(size > MAX_PAYLOAD, "payload")


def scoped(documents: DataFrame, ids: list[str] | None = None, user_id: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Documents of a tenant, of some ids, or all; ids without a tenant raise, as they belong to one."""
    if ids and user_id is None:
        raise ValueError("document ids belong to a tenant: give user_id too")
    rows = documents if user_id is None else documents.where(F.col("user_id") == user_id)
    return rows if not ids else rows.where(F.col(id_col).isin(*ids))


def to_ingest(results: DataFrame, top_k: int | None = None, urls: list[str] | None = None) -> DataFrame:
    """Urls of search results to ingest: the explicit ones, else those of the first ``top_k`` ranks, else all."""
    if urls is not None:
        return results.sparkSession.createDataFrame([(u,) for u in urls], "url string")
    rows = results if top_k is None else results.where(F.col("rank") <= top_k)
    return rows.select("url")


def article_body(html: Column) -> Column:
    """The markup of a page's ``body markup`` element, else of its article, else of all."""
    body = F.regexp_extract(html, r'(?is)<div[^>]*class="[^"]*body markup[^"]*"[^>]*>(.*?)</div>\s*(?:</div>|</article>|$)', 1)
    article = F.regexp_extract(html, r"(?is)<article[^>]*>(.*)</article>", 1)
    return F.coalesce(F.nullif(body, F.lit("")), F.nullif(article, F.lit("")), html)


@dataclass(frozen=True)
class Collected:
    """Documents of a batch, and user_id, uri, type and error of each source that gave none."""

    documents: DataFrame
    failures: DataFrame


def collect(sources: DataFrame, fetch: Fetch, now: Column, transcripts: DataFrame | None = None, substack: DataFrame | None = None) -> Collected:
    """Documents of typed ``sources`` (user_id, type: url, file or conversation, uri, content), one job for all.

    A url is fetched and read by its handler; what a file or conversation says comes with it.
    ``transcripts`` has video_id and transcript; a video without one is a failure, as are bad
    urls, fetches that fail, contents over the cap and unknown types.  Other sources go on.
    """
    problem = F.when(~F.coalesce(F.col("type"), F.lit("")).isin("url", "file", "conversation"), "unknown_type").otherwise(payload_problem(F.col("uri"), F.col("content")))
    rows = sources.select("user_id", "type", "uri", "content", problem.alias("error"))
    good = rows.where("error is null")
    failures = [rows.where("error is not null").select("user_id", "uri", "type", "error")]
    links = routed(good.where("type = 'url'").select("user_id", F.col("uri").alias("url")), substack)
    failures.append(links.where("problem is not null").select("user_id", F.col("url").alias("uri"), F.lit("url").alias("type"), F.col("problem").alias("error")))

    videos = links.where("handler = 'youtube'").withColumn("video_id", W.video_id(F.col("url")))
    said = videos.join(transcripts, "video_id", "left") if transcripts is not None else videos.withColumn("transcript", F.lit(None).cast("string"))
    error = F.when(F.col("video_id").isNull(), "invalid_video").when(F.trim(F.coalesce("transcript", F.lit(""))) == "", "no_transcript")
    said = said.withColumn("error", error)
    failures.append(said.where("error is not null").select("user_id", F.col("url").alias("uri"), F.lit("url").alias("type"), "error"))
    video_docs = said.where("error is null").select("user_id", W.canonical_video_url(F.col("video_id")).alias("source_uri"), F.lit("youtube").alias("source_type"), F.col("transcript").alias("content"))

    # A url that several tenants ask for is fetched once.
    asked = links.where("handler in ('substack', 'web')")
    pages = D.scrape(asked.select("url").distinct(), fetch, max_chars=2**31 - 1)
    got = asked.join(pages, "url")
    failures.append(got.where(~F.col("success")).select("user_id", F.col("url").alias("uri"), F.lit("url").alias("type"), "error"))
    html = got.where("success").select("user_id", "handler", "url", F.when(F.col("handler") == "substack", article_body(F.col("content"))).alias("body"), F.col("content").alias("html"))
    fields = D.page_documents(html.select("url", "html").distinct(), now)
    page_docs = html.join(fields.withColumnRenamed("source_uri", "url"), "url").select(
        "user_id", F.col("url").alias("source_uri"), F.col("handler").alias("source_type"), "title", "description", "authors", "published_at",
        F.when(F.col("body").isNotNull(), W.html_text(F.col("body"))).otherwise(F.col("content")).alias("content"),
    )

    own = good.where("type <> 'url'")
    uri = F.when(F.col("type") == "conversation", T.content_id(F.coalesce("content", F.lit("")), "conversation://")).otherwise(F.col("uri"))
    own_docs = own.select("user_id", uri.alias("source_uri"), F.col("type").alias("source_type"), F.col("uri").alias("title"), "content")
    documents = D.union_all([page_docs.select(*_FIELDS), video_docs, own_docs]).dropDuplicates(["user_id", "source_uri"])
    return Collected(documents, D.union_all(failures))


def ingest_dataset(rows: DataFrame, key: str, now: Column, offset: int, max_samples: int, batch_size: int, fetch: Fetch | None = None) -> DataFrame:
    """Documents of rows ``offset`` to ``offset + max_samples`` of a dataset, with their batch.

    With ``fetch`` each gets the text of its page; where that fails it passes through without content.
    """
    taken = D.dataset_batches(rows, key, offset, max_samples, batch_size)
    docs = D.dataset_documents(taken.drop("batch"), now).join(taken.select(F.concat(F.lit("https://arxiv.org/abs/"), F.trim("id")).alias("source_uri"), "batch").dropDuplicates(["source_uri"]), "source_uri")
    if fetch is None:
        return docs.withColumn("content", F.lit(None).cast("string"))
    pages = D.scrape(docs.select(F.col("source_uri").alias("url")).distinct(), fetch, max_chars=2**31 - 1)
    return docs.join(pages.select(F.col("url").alias("source_uri"), F.when(F.col("success"), W.html_text(F.col("content"))).alias("content")), "source_uri", "left")
