"""Exact and approximate nearest neighbours of tables of vectors, tile by tile.

Rows of a block (a tenant and type, or a cell of an index) are packed into tiles of about
``TILE`` rows.  Each tile of the left side meets each tile of the right side of its block
in one matrix product, of which only the best of each left row go on, so no pair of rows
is ever a row of the plan and a block of any size is spread over as many tasks as it has
tiles.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.similarity import norm
from ..storage import materialise, shared_folder
from .grouping import shuffled

TILE = 1024
#: Cells of an approximate index, the rows that its centroids are fitted on, and cells that a query visits.
#: On vectors without clusters 40 of 64 cells hold 95 % of the ten nearest rows; where there are clusters fewer do.
CELLS, SAMPLE, PROBES = 64, 20_000, 40


def _unit(vector: Column) -> Column:
    """The vector at length 1 as doubles; null, empty and zero vectors, and those with a null, have no length."""
    v = F.transform(F.coalesce(vector, F.array().cast("array<double>")), lambda x: x.cast("double"))
    return F.when(norm(v) > 0, F.transform(v, lambda x: x / norm(v)))


def _tiled(rows: DataFrame, block: list[str], side: str, tile: int) -> DataFrame:
    """block, tile, the number of tiles of the block, and arrays of ids and unit vectors."""
    sizes = rows.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    named = sizes.withColumnsRenamed({c: f"__{c}" for c in block})
    dealt = rows.join(named, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in block]).drop(*[f"__{c}" for c in block])
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    grouped = dealt.groupBy(*block, "tile", "tiles").agg(F.sort_array(F.collect_list(F.struct("id", "vector"))).alias("e"))
    return grouped.select(*block, F.col("tile").alias(f"{side}_tile"), F.col("tiles").alias(f"{side}_tiles"), F.col("e.id").alias(f"{side}_ids"), F.col("e.vector").alias(f"{side}_vectors"))


def _rows(vectors: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows that end in zeros, and their lengths; a vector without a direction has length 0."""
    lists = vectors.values
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    width = max(int(sizes.max(initial=0)), 1)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width), sizes
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out, sizes


def _cosines(left: pa.ListScalar, right: pa.ListScalar) -> np.ndarray:
    """Products of all unit vectors of two tiles; those of different lengths are 0."""
    (a, m), (b, n) = _rows(left), _rows(right)
    width = min(a.shape[1], b.shape[1])
    scores = a[:, :width] @ b[:, :width].T
    return scores if (m == width).all() and (n == width).all() else np.where(m[:, None] == n, scores, 0.0)


def nearest_in_tiles(left: DataFrame, right: DataFrame, block: list[str], k: int | None = None, least: float | None = None, clamp: bool = False, store: bool = False, tile: int = TILE) -> DataFrame:
    """left_id, right_id and score: pairs of a block by cosine, rounded to 9 digits.

    Both sides have ``id``, the columns of ``block`` and ``embedding``.  With ``k`` each
    left row keeps its ``k`` best, equal scores to the smaller id; with ``least`` all pairs that score as much
    are kept, after the cosine was held at 0 from below with ``clamp``.  With ``store`` the
    score is the index score ``(1 + cosine) / 2``.  A vector that is null,
    empty or zero has the cosine 0 with all others, as have vectors of different lengths.
    Blocks are compared null-safely; a row does meet itself.
    """
    if (k is None) == (least is None):
        raise ValueError("either k or least is needed")
    kind = left.schema["id"].dataType.simpleString()
    side = lambda df: df.select(*block, "id", _unit(F.col("embedding")).alias("vector"))
    a, b = _tiled(side(left), block, "left", tile), _tiled(side(right), block, "right", tile)
    # A block's left tiles are sent once to each of its right tiles, so a hot block has many keys.
    tiles = b.select(*[F.col(c).alias(f"r_{c}") for c in block], "right_tile", "right_tiles", "right_ids", "right_vectors")
    counts = tiles.groupBy(*[f"r_{c}" for c in block]).agg(F.max("right_tiles").alias("n"))
    on = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in block]
    sent = a.join(counts, on).drop(*[f"r_{c}" for c in block]).withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    # Dealt by a fixed number: tiles are small for the work that they make, so few tasks would be taken for enough.
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.repartition(parts, *block, "meets")
    tiles = shuffled(tiles.repartition(parts, *[f"r_{c}" for c in block], "right_tile"))
    pairs = sent.join(tiles, [*on, F.col("meets") == F.col("right_tile")]).select("left_ids", "left_vectors", "right_ids", "right_vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cosines = _cosines(batch.column("left_vectors")[i], batch.column("right_vectors")[i])
                scores = np.round((1 + cosines) / 2 if store else cosines, 9)
                if clamp:
                    scores = np.maximum(scores, 0)
                if k is None:
                    at, to = np.nonzero(scores >= least)
                else:
                    cut = np.partition(scores, -k, axis=1)[:, -k][:, None] if scores.shape[1] > k else -np.inf
                    at, to = np.nonzero(scores >= cut)
                    # Ids of a tile are sorted, so of equal scores the first columns stay.
                    order = np.lexsort((to, -scores[at, to], at))
                    at, to = at[order], to[order]
                    first = np.searchsorted(at, at)
                    keep = np.arange(len(at)) - first < k
                    at, to = at[keep], to[keep]
                ids = [batch.column(c)[i].values.take(pa.array(x)) for c, x in (("left_ids", at), ("right_ids", to))]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(scores[at, to])], ["left_id", "right_id", "score"])

    spark = left.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    found = pairs.mapInArrow(run, f"left_id {kind}, right_id {kind}, score double")
    if k is None:
        return found
    order = Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class VectorIndex:
    """The folder of a written inverted-file index: ``rows`` in their cells, and the centroids."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    id_col: str

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def definition(self) -> dict:
        """Dimension, number of cells and the columns that a search can filter by."""
        return {"dimension": int(self.centroids.shape[1]), "cells": len(self.centroids), "filters": sorted(set(self.rows.columns) - {"id", "vector", "cell"})}


def _cell_of(centroids: np.ndarray, probes: int):
    """The ``probes`` best cells of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            out = np.zeros((batch.num_rows, centroids.shape[1]))
            for i, v in enumerate(lists):
                if v.is_valid and len(v) == centroids.shape[1]:
                    out[i] = v.values.to_numpy(zero_copy_only=False)
            best = np.argsort(-(out @ centroids.T), axis=1, kind="stable")[:, :probes]
            cells = pa.array(list(best.astype(np.int32)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "cells"])

    return run


def _with_cells(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    schema = ", ".join([*[f"`{n}` {t}" for n, t in rows.dtypes], "cells array<int>"])
    return rows.mapInArrow(_cell_of(centroids, probes), schema)


def fit_cells(vectors: DataFrame, cells: int, sample: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of at most ``sample`` rows, drawn by a hash of their vectors."""
    drawn = vectors.where("vector is not null").orderBy(F.xxhash64("vector"), "id").limit(sample).select("vector").toArrow().column("vector").to_pylist()
    if not drawn:
        return np.zeros((1, 1))
    width = max(map(len, drawn))
    rows = np.array([v for v in drawn if len(v) == width])
    centroids = rows[: min(cells, len(rows))].copy()
    for _ in range(rounds):
        near = (rows @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, rows)
        size = np.sqrt((sums**2).sum(1, keepdims=True))
        centroids = np.where(size > 0, sums / np.where(size > 0, size, 1), centroids)
    return centroids


def build_vector_index(vectors: DataFrame, id_col: str = "id", keep: list[str] | None = None, cells: int = CELLS, sample: int = SAMPLE) -> VectorIndex:
    """Every row in the cell of its nearest centroid, with the columns ``keep`` for filters.

    Centroids are fitted on a bounded sample; all rows are indexed.  Cells are folders, so
    a search reads those that its queries visit.  A row without a direction (null, empty
    or zero) lies in the first cell.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), _unit(F.col("embedding")).alias("vector"), *(keep or []))
    rows = materialise(rows, "units")
    centroids = fit_cells(rows, cells, sample)
    path = f"{shared_folder(spark)}/vector-index-{uuid.uuid4().hex}"
    placed = _with_cells(rows, centroids, 1).withColumn("cell", F.col("cells")[0]).drop("cells")
    # Salted, so that a cell with many rows is written by several tasks.
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(path)
    return VectorIndex(spark, path, centroids, id_col)


def vector_search_probed(index: VectorIndex, queries: DataFrame, k: int, where: Column | None = None, probes: int = PROBES) -> DataFrame:
    """query_id, the index's id, score and rank (from 0) of about the ``k`` nearest rows of each query, from ``probes`` cells.

    ``queries`` has query_id and embedding.  Approximate: a row in a cell that is not
    visited is not found.  ``vector_search_all`` is the exact way; with all cells visited
    both agree.  The filter is applied before any score.
    """
    asked = queries.select(F.col("query_id").alias("id"), _unit(F.col("embedding")).alias("vector"))
    visits = _with_cells(asked, index.centroids, probes).select("id", F.col("vector").alias("embedding"), F.explode("cells").alias("cell"))
    rows = index.rows if where is None else index.rows.where(where)
    found = nearest_in_tiles(visits, rows.select("id", F.col("vector").alias("embedding"), "cell"), ["cell"], k, store=True)
    order = Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id")
    best = found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
    return best.select(F.col("left_id").alias("query_id"), F.col("right_id").alias(index.id_col), "score", "rank")


def reconcile_vector_index(index: VectorIndex | None, vectors: DataFrame, dimension: int, id_col: str = "id", keep: list[str] | None = None, cells: int = CELLS) -> tuple[VectorIndex, bool]:
    """An index of these vectors of the dimension and filters that are asked for, and whether it had to be made anew.

    Vectors of another length are an error, as no search could find them; those that are
    missing or empty are not.
    """
    size = F.coalesce(F.size("embedding"), F.lit(0))
    bad = vectors.where((size > 0) & (size != dimension)).select(id_col, size.alias("n")).first()
    if bad is not None:
        raise ValueError(f"the vector of {bad[0]!r} has {bad[1]} values, not {dimension}")
    if index is not None:
        now = index.definition()
        if now["dimension"] == dimension and now["filters"] == sorted(keep or []):
            return index, False
    return build_vector_index(vectors, id_col, keep, cells), True
