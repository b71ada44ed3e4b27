"""Shards, windows, packing and failure-isolated maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..storage import materialise
from .ordering import even_shard, global_rank

MAX_INPUTS, MAX_TOKENS = 1000, 10_000


def balanced_shards(df: DataFrame, shards: int, order: str, group: list[str] | None = None) -> DataFrame:
    """Contiguous shards of equal size, the first ones larger by one; never more than rows."""
    if not group:
        ranked = global_rank(df, order, name="__rank")
        return ranked.withColumn("shard", even_shard(F.col("__rank"), F.lit(ranked.count()), shards)).drop("__rank")
    w = Window.partitionBy(*group).orderBy(order)
    return df.withColumn("shard", F.ntile(shards).over(w) - 1)


def offset_windows(total: Column, parts: int) -> Column:
    """Structs (offset, size) that tile ``total`` rows; the remainder goes to the last."""
    base = F.floor(total / parts).cast("long")
    last = F.lit(parts - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * base).alias("offset"), F.when(i == last, total - i * base).otherwise(base).cast("long").alias("size")))


class _Piece:
    """A run of rows' tokens, and what packing makes of it from any place on."""

    def __init__(self, tokens: np.ndarray, max_inputs: int, max_tokens: int):
        n = len(tokens)
        self.limits, self.n = (max_inputs, max_tokens), n
        self.upto = np.r_[0, np.cumsum(tokens)]
        at = np.arange(n)
        fits = np.searchsorted(self.upto, self.upto[:-1] + max_tokens, side="right") - 1
        # A row that is too large by itself is alone.
        self.next = np.minimum(np.clip(fits, at + 1, at + max_inputs), n)

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a batch that starts at each row: batches started up to the end, and rows and tokens of the last one."""
        started, rows, used = np.ones(self.n, np.int64), self.n - np.arange(self.n), self.upto[-1] - self.upto[:-1]
        for i in range(self.n - 1, -1, -1):
            if (k := self.next[i]) < self.n:
                started[i], rows[i], used[i] = started[k] + 1, rows[k], used[k]
        return started, rows, used


def _first_break(upto: np.ndarray, rows: int, used: int, max_inputs: int, max_tokens: int) -> int:
    """The row at which an open batch of ``rows`` and ``used`` tokens ends; 0 if none is open."""
    if not rows:
        return 0
    return max(0, min(max_inputs - rows, int(np.searchsorted(upto, max_tokens - used, side="right")) - 1))


def pack_batches(df: DataFrame, group: list[str], order: str, tokens: str, max_inputs: int = MAX_INPUTS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """The rows with ``batch``: greedy contiguous bins by count and tokens within each group; an oversize row is alone.

    Rows are sorted by ranges, so a group of any size lies in pieces of many tasks.  What
    packing makes of a piece depends only on the row at which the batch that is open at
    its start ends, which is among its first ``max_inputs``.  Each task works this out for all
    of them; the summaries, of a bounded size a piece, are folded along each group, and each
    piece is packed from the batch that the ones before it leave open.
    """
    keys = [F.col(c) for c in group]
    ranged = df.repartitionByRange(*keys, F.col(order)).sortWithinPartitions(*keys, order)
    rows = materialise(ranged.withColumns({"__piece": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "pieces")
    kinds = dict(df.dtypes)
    named = ", ".join(f"`{c}` {kinds[c]}" for c in group)
    whole, columns = [*group, "__piece"], df.columns

    def runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
        """Rows that agree in ``columns``, which are sorted by them."""
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            own = list(zip(*[batch.column(c).to_pylist() for c in columns], strict=True))
            cuts = [0, *[i for i in range(1, len(own)) if own[i] != own[i - 1]], len(own)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if own[a] != key and held:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = own[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield key, pa.Table.from_batches(held)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in runs(iter(batches), whole):
            piece = _Piece(table.column("__tokens").to_numpy(), max_inputs, max_tokens)
            few = slice(0, max_inputs + 1)
            found = [x[few].tolist() for x in (piece.upto[: max_inputs + 2], *piece.suffixes())]
            yield pa.RecordBatch.from_pylist([dict(zip(whole, key, strict=True)) | {"n": piece.n, "total": int(piece.upto[-1])} | dict(zip(("upto", "started", "rows", "used"), found, strict=True))], schema=summary)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows_, used, base = None, 0, 0, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                key = tuple(r[c] for c in group)
                if key != last:
                    last, rows_, used, base = key, 0, 0, 0
                out.append({c: r[c] for c in whole} | {"__rows": rows_, "__used": used, "__base": base})
                at = _first_break(np.array(r["upto"]), rows_, used, max_inputs, max_tokens)
                if at >= r["n"]:
                    rows_, used = rows_ + r["n"], used + r["total"]
                else:
                    base, rows_, used = base + r["started"][at], r["rows"][at], r["used"][at]
            yield pa.RecordBatch.from_pylist(out, schema=entry)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs(iter(batches), whole):
            piece = _Piece(table.column("__tokens").to_numpy(), max_inputs, max_tokens)
            open_, used, base = (table.column(c)[0].as_py() for c in ("__rows", "__used", "__base"))
            at, number = _first_break(piece.upto, open_, used, max_inputs, max_tokens), np.full(piece.n, base - 1, np.int64)
            while at < piece.n:
                number[at:] += 1
                at = int(piece.next[at])
            yield from table.select(columns).append_column("batch", pa.array(number)).combine_chunks().to_batches()

    summary_ddl = f"{named}, __piece int, n long, total long, upto array<long>, started array<long>, rows array<long>, used array<long>"
    entry_ddl = f"{named}, __piece int, __rows long, __used long, __base long"
    summary, entry = (to_arrow_schema(_parse_datatype_string(x)) for x in (summary_ddl, entry_ddl))
    counted = rows.withColumn("__tokens", F.col(tokens).cast("long"))
    dealt = lambda d: d.repartition(*whole).sortWithinPartitions(*whole, "__at")
    summaries = dealt(counted.select(*whole, "__at", "__tokens")).mapInArrow(summarise, summary_ddl)
    entries = materialise(summaries.repartition(*group).sortWithinPartitions(*whole).mapInArrow(fold, entry_ddl), "entries").withColumnsRenamed({c: f"__e_{i}" for i, c in enumerate(whole)})
    known = counted.join(entries, [F.col(c).eqNullSafe(F.col(f"__e_{i}")) for i, c in enumerate(whole)])
    return dealt(known).mapInArrow(pack, df.withColumn("batch", F.lit(0).cast("long")).schema)


def isolated_map(df: DataFrame, key: str, value: str, fn: Callable[[str], str]) -> DataFrame:
    """key, result and error: a call that fails yields its error and no result."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, v in zip(batch[key], batch[value], strict=True):
                try:
                    rows.append((k, fn(v), None))
                except Exception as e:  # isolated: other rows go on
                    rows.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "result", "error"])

    return df.select(key, value).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, result string, error string")


def embed_resilient(texts: list[str], embed: Callable[[list[str]], list[list[float]]]) -> list[list[float]]:
    """Vectors of a batch; a batch that is refused is halved until the one bad text is found, which has none."""
    try:
        return embed(texts)
    except ValueError:
        if len(texts) == 1:
            return [[]]
        half = len(texts) // 2
        return embed_resilient(texts[:half], embed) + embed_resilient(texts[half:], embed)


def embed_missing(nodes: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str = "text") -> DataFrame:
    """Nodes with a vector where one was missing or empty and could be had."""
    empty = F.coalesce(F.size("embedding"), F.lit(0)) <= 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "__vector": embed_resilient(batch[text].to_list(), embed)})

    made = nodes.where(empty).select("id", text).mapInPandas(run, "id string, __vector array<float>")
    rows = nodes.join(made, "id", "left")
    return rows.withColumn("embedding", F.when(empty & (F.size("__vector") > 0), F.col("__vector")).otherwise(F.col("embedding"))).drop("__vector")


def assert_dimension(nodes: DataFrame, dimension: int) -> DataFrame:
    """The rows, with an error at the first vector of another length."""
    size = F.size("embedding")
    bad = (size > 0) & (size != dimension)
    return nodes.where(F.when(bad, F.raise_error(F.lit(f"an embedding has not {dimension} values"))).otherwise(F.lit(True)).cast("boolean"))
