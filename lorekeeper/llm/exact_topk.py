"""Exact top-k by inner product as a Voronoi kNN join.

Inner products become distances: with ``M`` the largest norm, a row ``v`` is lifted to
``(v, sqrt(M² - |v|²))`` and a query ``q`` is stretched to length ``M``, so that
``|q' - v'|² = 2M² - 2(M/|q|) q·v`` and the largest products are the smallest distances.

Rows and queries are grouped by their nearest pivot.  A query knows its distance to every
pivot, and the products with the pivots, which are rows themselves, bound its k-th best
score.  From these a block of queries derives for each cell the distances to the pivot at
which a row can matter (triangle inequality, and the plane between two pivots); the rows
of a cell are summarised ring by ring with the distances they span, and only rings that a
block needs are sent to it.  Products themselves are exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import materialise

#: Rows drawn as pivots, by a hash of id and vector; what the driver holds is bounded by them.
PIVOTS = 256


def _lift(rows: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([rows, np.sqrt(np.maximum(top**2 - (rows**2).sum(1), 0))[:, None]])


def _stretch(rows: np.ndarray, top: float) -> np.ndarray:
    """Queries at length ``top``; a query of zeros stays where it is, at one distance from all rows."""
    norm = np.sqrt((rows**2).sum(1))
    return np.hstack([rows * (top / np.where(norm > 0, norm, 1))[:, None], np.zeros((len(rows), 1))])


class _Shape:
    """What all tasks know: the measures of the table and the pivots."""

    def __init__(self, about: dict, pivot_ids: np.ndarray, pivots: np.ndarray, k: int):
        self.dim, self.stored, self.k = about["dim"], about["stored"], k
        self.norm = about["norm"]
        self.top = self.norm * (1 + V.SLACK)
        self.slack = self.top * 1e-6
        self.bound = self.norm**2
        self.pivot_ids, self.pivots = pivot_ids, pivots
        self.lifted = _lift(pivots.astype(np.float64), self.top)
        gaps = V.distances(self.lifted, self.lifted)
        self.between = np.where(gaps > self.slack, gaps, np.inf)

    def nearest_row(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._nearest(_lift(rows, self.top))

    def nearest_query(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._nearest(_stretch(rows, self.top))

    def _nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gaps = V.distances(points, self.lifted)
        cell = gaps.argmin(1)
        return cell, gaps[np.arange(len(points)), cell]

    def least(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """A bound from below on each query's k-th best score: the k-th best among the pivots but for its own rows."""
        scores = V.products(rows, self.pivots, self.bound)
        scores = np.where(ids[:, None] == self.pivot_ids, -np.inf, scores)
        if scores.shape[1] < self.k:
            return np.full(len(ids), -np.inf, dtype=scores.dtype)
        return np.partition(scores, -self.k, axis=1)[:, -self.k]

    def reach(self, rows: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The distance within which all rows lie that score ``least`` or more with a query."""
        norm = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
        least = V.useful(least)
        least = np.where(least > -np.inf, least, 0) / np.where(norm > 0, norm, 1) + np.where(least > -np.inf, 0, -self.top)
        out = np.sqrt(np.maximum(2 * self.top * (self.top - least), 0))
        return np.where(norm > 0, out, self.top) + self.slack


def _needs(shape: _Shape, rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cell the distances to its pivot at which a row can be in a result of any of the queries."""
    low, high = np.full(len(shape.pivots), np.inf), np.full(len(shape.pivots), -np.inf)
    step = max(1, V.SLAB // len(shape.pivots))
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        gaps = V.distances(_stretch(part.astype(np.float64), shape.top), shape.lifted)
        reach = shape.reach(part, least[at : at + step])[:, None]
        own = gaps.argmin(1)
        # A row of another cell lies beyond the plane between the pivots.
        plane = (gaps**2 - gaps[np.arange(len(part)), own][:, None] ** 2) / (2 * shape.between[own])
        out = plane > reach + shape.slack
        low = np.minimum(low, np.where(out, np.inf, gaps - reach - shape.slack).min(0))
        high = np.maximum(high, np.where(out, -np.inf, gaps + reach + shape.slack).max(0))
    return low, high


def _pack_queries(shape: _Shape):
    def pack(table: pa.Table) -> pa.Table:
        ids, rows = table.column("id").to_numpy(), V.matrix(table.column("v"), shape.dim)
        low, high = _needs(shape, rows, shape.least(ids, rows))
        row = {
            "block": table.column("block")[0].as_py(),
            "queries": ids.astype("<i8").tobytes(),
            "hashes": table.column("hash").to_numpy().astype("<i8").tobytes(),
            "rows": rows.astype(shape.stored).tobytes(),
            "lows": low.tolist(),
            "highs": high.tolist(),
        }
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.table([pa.array([x], t) for x, t in zip(row.values(), kinds, strict=True)], names=list(row))

    return pack


BLOCK_SCHEMA = "block int, queries binary, hashes binary, rows binary, lows array<double>, highs array<double>"
FOUND_SCHEMA = "query_id long, hash long, vec_id long, score long"


class _Search:
    """One block of queries and the best rows of the pieces it has met."""

    def __init__(self, shape: _Shape, row: dict):
        self.shape = shape
        self.ids, self.hashes = np.frombuffer(row["queries"], "<i8"), np.frombuffer(row["hashes"], "<i8")
        self.rows = np.frombuffer(row["rows"], shape.stored).reshape(-1, shape.dim)
        least = shape.least(self.ids, self.rows)
        self.best = V.Best(len(self.ids), shape.k, least, least.dtype != object)
        self.points = _stretch(self.rows.astype(np.float64), shape.top)

    def visit(self, piece: dict) -> None:
        shape = self.shape
        ids, _, rows = V.unpack(piece, shape.stored, shape.dim)
        gap = V.distances(self.points, shape.lifted[piece["cell"]][None])[:, 0]
        reach = shape.reach(self.rows, self.best.least) + shape.slack
        use = np.flatnonzero((gap - reach <= piece["far"]) & (gap + reach >= piece["near"]))
        step = max(1, V.SLAB // len(ids))
        for at in range(0, len(use), step):
            q = use[at : at + step]
            scores = V.products(self.rows[q], rows, shape.bound)
            scores = np.where(self.ids[q][:, None] == ids, -np.inf, scores)
            i, j = V.best_columns(scores, self.best.least[q], shape.k)
            self.best.add(q[i], scores[i, j], ids[j])

    def results(self) -> pa.RecordBatch:
        b = self.best
        columns = [self.ids[b.q], self.hashes[b.q], b.ids, b.scores.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_id", "hash", "vec_id", "score"])


def top_k(df: DataFrame, is_query: Column, k: int = 5, pivots: int = PIVOTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` rows of the largest inner product with each query.

    ``is_query`` marks the queries among the rows by ``id_col``; all rows but those of the
    query's own id are candidates, and equal scores go to the smaller id.  Components are
    ``floor(256 * x)``.  A query has fewer rows where fewer exist.  Rows without id, with
    a null vector or with a null or non-finite component take no part; rows that agree in
    id and vector count once; an id with several vectors is a query with each of them.
    Short and empty vectors end in zeros.  Scores beyond a long become the nearest long.
    An empty table has no results.  Other columns are not read.
    """
    table = materialise(V.integer_vectors(df, id_col, vec_col), "vectors")
    about = V.measure(table)
    drawn = table.orderBy(F.xxhash64(F.lit("pivot"), "hash", "id"), "id", "hash").limit(max(pivots, 1)).select("id", "v").toArrow()
    ids = drawn.column("id").to_numpy()
    rows = V.matrix(drawn.column("v"), about["dim"])
    shape = _Shape(about, ids, rows, k) if len(ids) else _Shape(about, np.zeros(1, np.int64), np.zeros((1, about["dim"]), np.int64), k)

    # One more copy than the list is long, for the query's own.
    held = V.in_cells(V.without_spare_copies(table, k + 1), shape.nearest_row, shape.dim)
    pieces = V.pack_cells(materialise(held, "cells"), [], shape.stored, shape.dim)
    queries = materialise(V.in_cells(table.where(is_query.eqNullSafe(F.lit(True))), shape.nearest_query, shape.dim), "queries")
    counts = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    placed = queries.withColumn("block", V.block_of(V.group_cells(counts, shape.lifted, V.BLOCK)))
    blocks = materialise(placed.groupBy("block").applyInArrow(_pack_queries(shape), BLOCK_SCHEMA), "blocks")

    spans = F.posexplode(F.arrays_zip("lows", "highs")).alias("cell", "span")
    needs = blocks.select("block", spans).select("block", "cell", F.col("span.lows").alias("low"), F.col("span.highs").alias("high"))
    needs = needs.where("low <= high")
    parts = V.search_parts(about["rows"])
    sent = V.needed_pieces(pieces, needs, ["cell"], "low", parts)
    found = V.meet(blocks.drop("lows", "highs"), sent, parts, lambda row: _Search(shape, row), FOUND_SCHEMA)
    best = V.best_rows(found, ["query_id", "hash"], "score", "vec_id", k)
    return best.select("query_id", "rank", "vec_id", "score")
