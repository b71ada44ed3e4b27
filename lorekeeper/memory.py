"""The tools of a tenant's memory, over its tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .functions import web as W
from .operators import dedup, search, traversal, writes
from .operators.filters import GraphQuery
from .operators.pipeline import ask, run_pipeline
from .sources import documents as D


def resolve_user(users: DataFrame, user_id: str | None = None, identifier: str | None = None, session_user: str | None = None) -> str:
    """The tenant to act for: an explicit id, else an identifier, else the session's user; one that is unknown raises.

    ``users`` has user_id and identifier.
    """
    for column, wanted in (("user_id", user_id), ("identifier", identifier), ("user_id", session_user)):
        if wanted:
            row = users.where(F.col(column) == wanted).select("user_id").first()
            if row is None:
                raise ValueError(f"no user with {column} {wanted!r}")
            return row[0]
    raise ValueError("no user is given and the session has none")


def deep_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, kind, path and one-line summary of each node and edge: the index of a deep search."""
    node = nodes.select("id", F.lit("node").alias("kind"), T.node_line(F.col("type"), F.col("name"), F.col("properties")).alias("summary"))
    edge = edges.select("id", F.lit("edge").alias("kind"), T.edge_line(F.col("source_node_id"), F.col("type"), F.col("target_node_id")).alias("summary"))
    rows = node.unionByName(edge)
    return rows.select("id", "kind", F.concat("kind", F.lit("s/"), T.file_slug(F.col("id")), F.lit(".md")).alias("path"), "summary")


def type_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, type and n: what a dashboard shows."""
    count = lambda df, kind: df.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


@dataclass
class Memory:
    """Nodes and edges bound to one tenant.  ``embed`` and ``translate`` are injected models."""

    user_id: str
    nodes: DataFrame
    edges: DataFrame
    embed: Callable[[str], list[float]] | None = None
    translate: Callable[[str, str | None], list[dict]] | None = None

    def __post_init__(self):
        self.graph = GraphQuery(self.user_id, self.nodes, self.edges)

    def query(self, question: str, max_results: int = 10) -> DataFrame:
        """A question, translated into a pipeline that runs within the tenant."""
        if self.translate is None:
            raise ValueError("a translator is needed")
        return ask(question, self.translate, lambda stages: run_pipeline(self.nodes, stages, self.user_id, max_results, edges=self.graph.edges))

    def search(self, question: str, top_k: int = 10) -> DataFrame:
        """id and score of the best nodes by text, and by vector if there is an embedder."""
        vectors = None
        if self.embed is not None and "embedding" in self.graph.nodes.columns:
            vectors = search.vector_search(self.graph.nodes, self.embed(question), top_k)
        texts = self.graph.nodes.withColumn("text", search.node_text(self.graph.nodes.columns))
        return search.hybrid_search(vectors, search.text_search(texts, question, top_k), top_k)

    def search_and_expand(self, question: str, top_k: int = 10, max_hops: int = 1) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges around the best nodes; both empty if nothing is found."""
        return traversal.expand_graph(self.graph.nodes, self.graph.edges, self.search(question, top_k), max_hops)

    def pending(self, limit: int = 20) -> DataFrame:
        """Pairs that wait for a review."""
        return dedup.pending_reviews(self.graph.edges.where("type = 'same_as'"), self.graph.nodes, limit)

    def payload(self) -> tuple[DataFrame, DataFrame]:
        """The whole graph for a viewer, with ends that are no nodes added."""
        nodes = self.graph.nodes.select("id", "name", "type")
        return nodes.unionByName(traversal.missing_endpoints(nodes, self.graph.edges)), self.graph.edges

    def search_memory(self, question: str, top_k: int = 10, max_hops: int = 1, max_results: int = 10) -> DataFrame:
        """kind, id and type of what is found around the best nodes: nodes first, then edges, at most ``max_results``."""
        nodes, edges = self.search_and_expand(question, top_k, max_hops)
        rows = nodes.select(F.lit(0).alias("place"), F.lit("node").alias("kind"), "id", "type").unionByName(edges.select(F.lit(1).alias("place"), F.lit("edge").alias("kind"), "id", "type"))
        return rows.orderBy("place", "id").limit(max_results).drop("place")

    def deep_search(self, question: str, top_k: int = 50, max_hops: int = 3) -> DataFrame:
        """The index of a broad search."""
        found, links = self.search_and_expand(question, top_k, max_hops)
        return deep_index(self.graph.nodes.join(found.select("id"), "id", "left_semi"), links)

    def dashboard(self) -> DataFrame:
        """Counts of the tenant's nodes and edges by type."""
        return type_counts(self.graph.nodes, self.graph.edges)

    def reject(self, edge: str) -> DataFrame:
        """The tenant's edges with one review rejected; one that is confirmed raises."""
        return self._reviewed(edge, "rejected")

    def confirm(self, edge: str, now: Column, strategy: str = "merge_properties") -> tuple[DataFrame, DataFrame]:
        """The tenant's nodes and edges after one review was confirmed and its pair merged; again it changes nothing."""
        edges = self._reviewed(edge, "confirmed")
        pair = edges.where(F.col("id") == edge).select(F.col("source_node_id").alias("a_id"), F.col("target_node_id").alias("b_id"))
        # The review itself joins both ends and would fall away as a self-loop.
        nodes, moved = dedup.confirm(self.graph.nodes, edges.where(F.col("id") != edge), pair, now, strategy)
        return nodes, moved.unionByName(edges.where(F.col("id") == edge), allowMissingColumns=True)

    def _reviewed(self, edge: str, status: str) -> DataFrame:
        same = self.graph.edges.where("type = 'same_as'")
        if same.where(F.col("id") == edge).isEmpty():
            raise ValueError(f"no review {edge!r}")
        return dedup.set_review(same, edge, status).unionByName(self.graph.edges.where("type <> 'same_as'"))

    def ingest(self, documents: DataFrame, incoming: DataFrame) -> DataFrame:
        """The tenant's documents after others came in, each with its ``outcome``.  Fields that records lack are null."""
        mine = documents.where(F.col("user_id") == self.user_id)
        new = incoming.withColumn("user_id", F.lit(self.user_id))
        fields = [F.col(c) if c in new.columns else F.lit(None).cast(documents.schema[c].dataType).alias(c) for c in documents.columns]
        return writes.upsert_documents(mine, new.select(*fields))

    def ingest_urls(self, documents: DataFrame, urls: list[str], fetch: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
        """Documents after pages were fetched, and url and error of those that could not be."""
        rows = documents.sparkSession.createDataFrame([(u,) for u in urls], "url string").withColumn("problem", W.url_problem(F.col("url")))
        pages = D.scrape(rows.where("problem is null"), fetch, max_chars=2**31 - 1)
        bad = rows.where("problem is not null").select("url", F.col("problem").alias("error")).unionByName(pages.where(~F.col("success")).select("url", "error"))
        html = pages.where("success").select("url", F.col("content").alias("html"))
        return self.ingest(documents, D.page_documents(html, F.current_timestamp())), bad

    def ingest_files(self, documents: DataFrame, path: str) -> DataFrame:
        """Documents after the files under a path."""
        return self.ingest(documents, D.file_documents(documents.sparkSession, path))

    def ingest_conversations(self, documents: DataFrame, turns: DataFrame) -> DataFrame:
        """Documents after conversations (conv_id, turn, role, text)."""
        return self.ingest(documents, D.conversation_documents(turns).withColumn("source_type", F.lit("conversation")))
