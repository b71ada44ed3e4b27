"""A sink that writes rows as a tree of markdown files, whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

BUCKETS = 256


@dataclass
class Written(WriterCommitMessage):
    """Where a task attempt has put its folders, and which."""

    attempt: str
    folders: list[str] = field(default_factory=list)


class _TreeWriter(DataSourceWriter):
    """Tasks write below a folder of their attempt; the commit moves their folders into a new tree and swaps it in.

    Each kind and bucket is one task's, so a commit moves folders and no single files.
    """

    def __init__(self, target: str):
        self.target = target.rstrip("/")
        self.staging = f"{self.target}.staging-{uuid.uuid4().hex}"

    def _files(self, path: str) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)

    def write(self, rows: Iterator) -> Written:
        files, root = self._files(self.staging)
        attempt = f"{root}/attempt-{uuid.uuid4().hex}"
        done, index, made = None, [], []

        def close() -> None:
            if done is not None:
                with files.open_output_stream(f"{attempt}/{done}/index.md") as out:
                    out.write("".join(index).encode())

        for row in rows:
            folder = f"{row['kind']}s/{row['bucket']:03}"
            if folder != done:
                close()
                done, index = folder, []
                made.append(folder)
                files.create_dir(f"{attempt}/{folder}")
            with files.open_output_stream(f"{attempt}/{folder}/{row['slug']}.md") as out:
                out.write(row["content"].encode())
            index.append(f"- [{row['id']}]({row['slug']}.md): {row['summary']}\n")
        close()
        return Written(attempt, made)

    def commit(self, messages: list) -> None:
        files, root = self._files(self.staging)
        target = self._files(self.target)[1]
        tree = f"{root}/tree"
        files.create_dir(tree)
        folders = sorted((f, m.attempt) for m in messages if m is not None for f in m.folders)
        for folder, attempt in folders:
            files.create_dir(f"{tree}/{folder.split('/')[0]}")
            files.move(f"{attempt}/{folder}", f"{tree}/{folder}")
        with files.open_output_stream(f"{tree}/index.md") as out:
            out.write("".join(f"- [{f}]({f}/index.md)\n" for f, _ in folders).encode())
        old = f"{root}/old"
        if files.get_file_info(target).type != pafs.FileType.NotFound:
            files.move(target, old)
        files.move(tree, target)
        files.delete_dir(root)

    def abort(self, messages: list) -> None:
        files, root = self._files(self.staging)
        if files.get_file_info(root).type != pafs.FileType.NotFound:
            files.delete_dir(root)


class MarkdownTree(DataSource):
    """``df.write.format("markdown_tree").mode("overwrite").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "markdown_tree"

    def schema(self) -> str:
        return "kind string, bucket int, slug string, id string, summary string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _TreeWriter(self.options["path"])


def write_markdown(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write ``rows`` (kind, id, path, summary, content) as ``kind``s/bucket/file.md, with an index a folder and one of folders.

    The file's name is that of ``path``.  Rows of one bucket go to one task; ids whose names
    fall together keep both, the later ones with a hash of their id.  A rerun replaces the
    tree by one rename; a failed task or job leaves the tree that was there.  The folder
    must be one that driver and executors share.
    """
    rows.sparkSession.dataSource.register(MarkdownTree)
    slug = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    dealt = rows.select("kind", "id", "summary", "content", slug.alias("slug"), F.pmod(F.xxhash64(slug), F.lit(buckets)).cast("int").alias("bucket"))
    first = dealt.groupBy("kind", "bucket", "slug").agg(F.min("id").alias("first"))
    named = dealt.join(first, ["kind", "bucket", "slug"])
    slug = F.when(F.col("id") == F.col("first"), F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.substring(F.sha2("id", 256), 1, 8)))
    out = named.select("kind", "bucket", slug.alias("slug"), "id", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("content", F.lit("")).alias("content"))
    out = out.dropDuplicates(["kind", "bucket", "slug"]).repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "slug")
    out.write.format("markdown_tree").mode("overwrite").save(path)


def node_pages(nodes: DataFrame, index: DataFrame) -> DataFrame:
    """kind, id, path, summary and content of nodes in a deep index: headline, properties in order, sources."""
    entries = F.array_sort(F.map_entries(F.coalesce("properties", F.create_map().cast("map<string,string>"))))
    lines = F.transform(entries, lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    text = F.concat(F.lit("# "), "name", F.lit("\n\n"), "type", F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n"))
    return index.where("kind = 'node'").join(nodes.select("id", text.alias("content")), "id").select("kind", "id", "path", "summary", "content")


def edge_pages(edges: DataFrame, index: DataFrame) -> DataFrame:
    """kind, id, path, summary and content of edges in a deep index: both ends and the type between them."""
    text = F.concat(F.lit("# "), "type", F.lit("\n\n- source: "), "source_node_id", F.lit("\n- target: "), "target_node_id", F.lit("\n"))
    return index.where("kind = 'edge'").join(edges.select("id", text.alias("content")), "id").select("kind", "id", "path", "summary", "content")
