"""Hard negatives from inverted lists of k-means clusters with stored radii.

Every row lies in the list of its nearest centroid ``c``; a list is packed in pieces that
store how far from ``c`` their rows lie at most (``far``).  By Cauchy-Schwarz a row of a
piece scores at most ``q·c + |q| far`` with an anchor ``q`` and at least ``q·c - |q| far``.
Pieces are visited by the largest bound of a block of anchors.  An anchor leaves out
pieces that lie wholly outside its windows, and is done with a piece as soon as the bound
is strictly below its k-th score, so equal scores are still seen.

First the lists of an anchor's own label give its positives; their scores make the
windows in which the lists of all labels are searched for negatives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import join_groups, materialise

#: Centroids, and the rows that they are fitted on, drawn by a hash of id and vector.
CLUSTERS, SAMPLE, ROUNDS = 256, 20_000, 8
#: A negative scores between these percentages of the positive.
WINDOW = (30, 90)
#: Visits of a block go by the largest score that any of its anchors can have in a piece.
FIRST = "-(top + longest * far)"


def fit_centroids(rows: np.ndarray, clusters: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's centroids of a bounded sample, from evenly spaced rows of it."""
    centroids = rows[np.linspace(0, len(rows) - 1, min(clusters, len(rows))).astype(int)].astype(np.float64)
    for _ in range(rounds):
        cell = V.distances(rows.astype(np.float64), centroids).argmin(1)
        count = np.bincount(cell, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, rows)
        centroids[count > 0] = sums[count > 0] / count[count > 0, None]
    return centroids


class _Index:
    """What all tasks know: the measures of the table and the centroids."""

    def __init__(self, about: dict, centroids: np.ndarray):
        self.dim, self.stored, self.norm = about["dim"], about["stored"], about["norm"]
        self.bound = self.norm**2
        self.centroids = centroids
        self.slack = self.bound * V.SLACK + 1e-6

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gaps = V.distances(rows, self.centroids)
        cell = gaps.argmin(1)
        # Squared differences of the own centroid alone: the radius must not suffer from cancellation.
        return cell, np.sqrt(((rows - self.centroids[cell]) ** 2).sum(1)) * (1 + V.SLACK)

    def sides(self, rows: np.ndarray, cell: int, far: float) -> tuple[np.ndarray, np.ndarray]:
        """Bounds from below and above on the scores of rows in a cell within ``far`` of its centroid."""
        rows = rows.astype(np.float64)
        middle = rows @ self.centroids[cell]
        spread = np.sqrt((rows**2).sum(1)) * far + self.slack
        return middle - spread, middle + spread


def _anchor_columns(index: _Index, table: pa.Table) -> tuple[dict, np.ndarray]:
    rows = V.matrix(table.column("v"), index.dim)
    row = {
        "block": table.column("block")[0].as_py(),
        "anchors": table.column("id").to_numpy().astype("<i8").tobytes(),
        "hashes": table.column("hash").to_numpy().astype("<i8").tobytes(),
        "own": table.column("label").to_numpy().astype("<i8").tobytes(),
        "rows": rows.astype(index.stored).tobytes(),
    }
    return row, rows


_ANCHORS = "block string, anchors binary, hashes binary, own binary, rows binary"
_ANCHOR_KINDS = [pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _one_row(row: dict, kinds: list) -> pa.Table:
    return pa.table([pa.array([x], t) for x, t in zip(row.values(), kinds, strict=True)], names=list(row))


def _pack_anchors(index: _Index):
    """Anchors of one label, with the order in which they visit the cells."""

    def pack(table: pa.Table) -> pa.Table:
        row, rows = _anchor_columns(index, table)
        tops = (rows.astype(np.float64) @ index.centroids.T).max(0)
        row |= {"label": table.column("label")[0].as_py(), "tops": tops.tolist(), "longest": float(np.sqrt((rows.astype(np.float64) ** 2).sum(1)).max())}
        return _one_row(row, [*_ANCHOR_KINDS, pa.int64(), pa.list_(pa.float64()), pa.float64()])

    return pack


def _pack_windows(index: _Index, window: tuple[int, int]):
    """Anchors with their windows, and how far from each centroid a row must lie to be in one."""

    def pack(table: pa.Table) -> pa.Table:
        row, rows = _anchor_columns(index, table)
        anchor, low, high, slot = [], [], [], []
        for i, positives in enumerate(table.column("positives").to_pylist()):
            for p in positives:
                # 100 n >= 30 p and 100 n <= 90 p in whole numbers; none for a negative p.
                lo, hi = -(-window[0] * p["score"] // 100), window[1] * p["score"] // 100
                if lo <= hi:
                    anchor.append(i), low.append(lo), high.append(hi), slot.append(p["rank"])
        lows, highs = np.full(len(rows), np.inf), np.full(len(rows), -np.inf)
        np.minimum.at(lows, anchor, np.array(low, dtype=float))
        np.maximum.at(highs, anchor, np.array(high, dtype=float))
        floats = rows.astype(np.float64)
        norm = np.sqrt((floats**2).sum(1))
        reach = np.full(len(index.centroids), np.inf)
        tops = np.full(len(index.centroids), -np.inf)
        step = max(1, V.SLAB // len(index.centroids))
        for at in range(0, len(rows), step):
            s = slice(at, at + step)
            middle = floats[s] @ index.centroids.T
            with np.errstate(invalid="ignore"):
                gap = np.maximum(lows[s][:, None] - middle, middle - highs[s][:, None]) - index.slack
                reach = np.minimum(reach, (gap / np.where(norm[s] > 0, norm[s], 1)[:, None]).min(0))
            tops = np.maximum(tops, middle.max(0))
        row |= {
            "at": np.array(anchor, "<i8").tobytes(),
            "low": np.array(low, "<i8").tobytes(),
            "high": np.array(high, "<i8").tobytes(),
            "slot": np.array(slot, "<i8").tobytes(),
            "reach": reach.tolist(),
            "tops": tops.tolist(),
            "longest": float(norm.max()),
        }
        return _one_row(row, [*_ANCHOR_KINDS, *[pa.binary()] * 4, pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()])

    return pack


class _Anchors:
    def __init__(self, index: _Index, row: dict):
        self.index = index
        self.ids, self.hashes, self.own = (np.frombuffer(row[c], "<i8") for c in ("anchors", "hashes", "own"))
        self.rows = np.frombuffer(row["rows"], index.stored).reshape(-1, index.dim)
        self.kind = V.products(self.rows[:1], self.rows[:1], index.bound).dtype

    def _scores(self, piece: dict, use: np.ndarray):
        ids, labels, rows = V.unpack(piece, self.index.stored, self.index.dim)
        step = max(1, V.SLAB // len(ids))
        for at in range(0, len(use), step):
            part = use[at : at + step]
            yield part, ids, labels, V.products(self.rows[part], rows, self.index.bound)


class _Positives(_Anchors):
    """The best rows of an anchor's own label."""

    def __init__(self, index: _Index, row: dict, k: int):
        super().__init__(index, row)
        self.best = V.Best(len(self.ids), k, np.full(len(self.ids), -np.inf, self.kind), self.kind != object)

    def visit(self, piece: dict) -> None:
        _, above = self.index.sides(self.rows, piece["cell"], piece["far"])
        for q, ids, _, scores in self._scores(piece, np.flatnonzero(above >= V.useful(self.best.least))):
            scores = np.where(self.ids[q][:, None] == ids, -np.inf, scores)
            i, j = V.best_columns(scores, self.best.least[q], self.best.k)
            self.best.add(q[i], scores[i, j], ids[j])

    def results(self) -> pa.RecordBatch:
        b = self.best
        columns = [self.ids[b.q], self.hashes[b.q], b.ids, b.scores.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["anchor_id", "hash", "row_id", "score"])


class _Negatives(_Anchors):
    """The best rows of other labels in each window of an anchor."""

    def __init__(self, index: _Index, row: dict, k: int):
        super().__init__(index, row)
        self.at, self.low, self.high, self.slot = (np.frombuffer(row[c], "<i8") for c in ("at", "low", "high", "slot"))
        # ``least`` starts at the window's lower end and becomes the k-th score in the window.
        self.best = V.Best(len(self.at), k, self.low.astype(self.kind), self.kind != object)
        self.slots = [np.flatnonzero(self.slot == s) for s in np.unique(self.slot)]

    def visit(self, piece: dict) -> None:
        below, above = self.index.sides(self.rows, piece["cell"], piece["far"])
        open_ = (above[self.at] >= V.useful(self.best.least)) & (below[self.at] <= self.high)
        if piece["label"] is not None:
            open_ &= self.own[self.at] != piece["label"]
        use = np.unique(self.at[open_])
        place = np.full(len(self.ids), -1)
        for q, ids, labels, scores in self._scores(piece, use):
            scores = np.where(self.own[q][:, None] == labels, -np.inf, scores)
            place[q] = np.arange(len(q))
            for windows in self.slots:
                w = windows[open_[windows]]
                w = w[place[self.at[w]] >= 0]
                if not len(w):
                    continue
                own = scores[place[self.at[w]]]
                i, j = V.best_columns(np.where(own <= self.high[w][:, None], own, -np.inf), self.best.least[w], self.best.k)
                self.best.add(w[i], own[i, j], ids[j])
            place[q] = -1

    def results(self) -> pa.RecordBatch:
        b = self.best
        at = self.at[b.q]
        columns = [self.ids[at], self.hashes[at], self.slot[b.q], b.ids, b.scores.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["anchor_id", "hash", "slot", "row_id", "score"])


def mine_hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    label: Column,
    n_positives: int = 5,
    n_negatives: int = 10,
    window: tuple[int, int] = WINDOW,
    clusters: int = CLUSTERS,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Positives of an anchor are the ``n_positives`` other rows of its label with the largest
    integer inner product; for each of them the ``n_negatives`` best rows of other labels
    whose score lies within ``window`` percent of the positive's, ends included.  Equal
    scores go to the smaller id.  ``is_anchor`` tells anchors by the columns ``id`` and
    ``label``, which hold ``id_col`` and ``label``.  A positive score below 0 has an empty
    window.  An anchor without positives, or a window without rows, has no result.

    Rows without id or label, with a null vector or with a null or non-finite component
    take no part; rows that agree in id, label and vector count once; rows that share an id
    but differ otherwise are rows of their own, though none is its own id's positive.
    Short vectors end in zeros, scores beyond a long become the nearest long, an empty
    table has no results, and other columns are not read.
    """
    table = materialise(V.integer_vectors(df, id_col, vec_col, label), "vectors")
    about = V.measure(table)
    drawn = table.orderBy(F.xxhash64(F.lit("sample"), "hash", "id"), "id", "label", "hash").limit(SAMPLE).select("v").toArrow()
    rows = V.matrix(drawn.column("v"), about["dim"]) if drawn.num_rows else np.zeros((1, about["dim"]))
    index = _Index(about, fit_centroids(rows, min(clusters, max(1, len(rows) // 16))))
    parts = V.search_parts(about["rows"])

    spare = V.without_spare_copies(table, max(n_positives + 1, n_negatives))
    cells = materialise(V.in_cells(spare, index.nearest, index.dim), "cells")
    anchors = V.in_cells(table.where(is_anchor.eqNullSafe(F.lit(True))), index.nearest, index.dim)
    anchors = materialise(anchors.withColumn("anchor", F.xxhash64("hash", "label")).drop("hash").withColumnRenamed("anchor", "hash"), "anchors")

    positives = materialise(_positives(index, cells, anchors, n_positives, parts), "positives")
    of = positives.groupBy("anchor_id", "hash").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("positives"))
    held = anchors.join(of.withColumnRenamed("anchor_id", "id"), ["id", "hash"])
    counts = {r["cell"]: r["n"] for r in held.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks = held.withColumn("block", V.block_of(V.group_cells(counts, index.centroids, V.BLOCK)).cast("string"))
    schema = f"{_ANCHORS}, at binary, low binary, high binary, slot binary, reach array<double>, tops array<double>, longest double"
    blocks = materialise(blocks.groupBy("block").applyInArrow(_pack_windows(index, window), schema), "blocks")

    pieces = V.pack_cells(cells, [], index.stored, index.dim)
    spans = blocks.select("block", "longest", F.posexplode(F.arrays_zip("reach", "tops")).alias("cell", "span"))
    needs = spans.select("block", "cell", F.col("span.reach").alias("low"), F.lit(float("inf")).alias("high"), "longest", F.col("span.tops").alias("top"))
    sent = V.needed_pieces(pieces, needs, ["cell"], FIRST, parts)
    found = V.meet(blocks.drop("reach", "tops", "longest"), sent, parts, lambda row: _Negatives(index, row, n_negatives), "anchor_id long, hash long, slot long, row_id long, score long")
    best = V.best_rows(found, ["anchor_id", "hash", "slot"], "score", "row_id", n_negatives)
    named = positives.select("anchor_id", "hash", F.col("rank").cast("long").alias("slot"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return best.join(named, ["anchor_id", "hash", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _positives(index: _Index, cells: DataFrame, anchors: DataFrame, k: int, parts: int) -> DataFrame:
    """anchor_id, hash, rank, row_id and score of the ``k`` best other rows of an anchor's label."""
    counts = anchors.groupBy("label").agg(F.count("*").alias("n"))
    placed = join_groups(anchors, counts, ["label"], "n")
    part = F.pmod(F.xxhash64("id", "hash"), F.ceil(F.col("n") / V.BLOCK))
    placed = placed.withColumn("block", F.concat_ws("/", "label", part))
    blocks = placed.groupBy("block").applyInArrow(_pack_anchors(index), f"{_ANCHORS}, label long, tops array<double>, longest double")
    blocks = materialise(blocks, "label_blocks")
    needs = blocks.select("block", "label", "longest", F.posexplode("tops").alias("cell", "top"))
    needs = needs.withColumns({"low": F.lit(0.0), "high": F.lit(float("inf"))})
    pieces = V.pack_cells(cells, ["label"], index.stored, index.dim)
    sent = V.needed_pieces(pieces, needs, ["cell", "label"], FIRST, parts)
    found = V.meet(blocks.drop("label", "tops", "longest"), sent, parts, lambda row: _Positives(index, row, k), "anchor_id long, hash long, row_id long, score long")
    return V.best_rows(found, ["anchor_id", "hash"], "score", "row_id", k)
