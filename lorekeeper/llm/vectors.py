"""Exact integer vectors, packed pieces of an index, and blocks of queries that meet them.

Both vector searches run in one shape.  Rows lie in cells, one a centre.  The rows of a
cell are packed into pieces of about ``PIECE`` rows with the distances that they span;
queries are packed into blocks of at most about ``BLOCK``.  A block's row says which part
of which cell it needs, so a join on the cell sends a block only those pieces.  A block is
searched in several salted parts side by side, each of which takes its pieces as a stream
in the order of the block's bound and keeps ``k`` best a query; a window joins the parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches

SCALE = 256
PIECE = 2048
BLOCK = 16_384
#: Scores of a matrix product that are held at once.
SLAB = 1 << 21
RINGS = 8
#: Parts that a block is searched in, one for so many rows.
MAX_PARTS, PART_ROWS = 256, 8192
#: Rounding of bounds: they are widened by this share of the largest value they can take.
SLACK = 1e-9
LONGS = (-(2**63), 2**63 - 1)

PIECE_SCHEMA = "cell int, near double, far double, label long, ids binary, labels binary, vectors binary"


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, label: Column | None = None) -> DataFrame:
    """id, label, v, hash and norm: each distinct row that takes part, components as ``floor(256 * x)``.

    Left out are rows without id, rows whose vector is null or holds a null or non-finite
    component, and with ``label`` those whose label is null.  Rows that agree in id, label
    and vector count once.  Components beyond a long become the nearest long.
    """
    vec = F.col(vec_col)
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    keep = F.col(id_col).isNotNull() & vec.isNotNull() & fine
    rows = df if label is None else df.where(label.isNotNull())
    rows = rows.where(keep).select(
        F.col(id_col).cast("long").alias("id"),
        (F.lit(0) if label is None else label).cast("long").alias("label"),
        F.transform(vec, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"),
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rows.distinct().select("id", "label", "v", F.xxhash64("v").alias("hash"), norm.alias("norm"))


def measure(vectors: DataFrame) -> dict:
    """Rows, the longest vector, the largest norm and component: what all tasks must agree on."""
    top = F.greatest(F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double")))
    row = vectors.agg(F.count("*"), F.max(F.size("v")), F.max("norm"), F.max(top)).first()
    n, dim, norm, top = (x or 0 for x in row)
    return {"rows": n, "dim": max(dim, 1), "norm": float(norm), "stored": "<i2" if top < 2**15 else "<i8"}


def without_spare_copies(vectors: DataFrame, keep: int) -> DataFrame:
    """Of rows with equal label and vector the ``keep`` smallest ids.

    Equal rows have equal scores, so no list of ``keep`` best, ties to the smaller id, can
    hold another one.  Each task limits its rows before the shuffle, so a vector that a
    third of all rows share sends ``keep`` rows a task.
    """
    first = Window.partitionBy("label", "v").orderBy("id")
    return vectors.withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= keep).drop("__k")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of integers as a matrix; short vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), dtype=values.dtype)
    out[np.arange(dim) < sizes[:, None]] = values
    return out


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of integer rows whose norms multiply to ``bound`` at most.

    By Cauchy-Schwarz no partial sum exceeds the bound, so floats hold all of them
    exactly up to their number of digits; beyond that Python's integers do.  Those
    beyond a long become the nearest long.
    """
    if bound >= 2**53:
        return np.clip(a.astype(object) @ b.astype(object).T, *LONGS)
    kind = np.float32 if bound < 2**24 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def useful(least: np.ndarray) -> np.ndarray:
    """The least scores of use as floats; scores beyond a long count as the least one, so that one rules nothing out."""
    return np.where(least > LONGS[0], least, -np.inf).astype(np.float64)


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances of float rows to all centres."""
    gaps = (rows**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * rows @ centres.T
    return np.sqrt(np.maximum(gaps, 0))


def in_cells(rows: DataFrame, nearest: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], dim: int) -> DataFrame:
    """``rows`` with the cell that ``nearest`` gives for their vectors, and the distance to its centre."""
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, dist = nearest(matrix(batch.column("v"), dim).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(dist, pa.float64())], [*batch.schema.names, "cell", "dist"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns)
    return rows.mapInArrow(run, f"{schema}, cell int, dist double")


def pack_cells(assigned: DataFrame, keys: list[str], stored: str, dim: int) -> DataFrame:
    """Pieces of the rows of a cell that agree in ``keys``, ring by ring.

    Rings are cut at approximate quantiles of the distances of a cell, from mergeable
    sketches; a ring with many rows is dealt over pieces by a hash.  So no task holds
    more than about ``PIECE`` rows at once, whatever a cell holds.
    """
    cuts = assigned.groupBy("cell").agg(F.percentile_approx("dist", [i / RINGS for i in range(1, RINGS)], 1000).alias("cuts"), F.count("*").alias("n"))
    ring = F.size(F.filter("cuts", lambda c: c < F.col("dist")))
    part = F.pmod(F.xxhash64("id", "hash"), F.ceil(F.col("n") / (RINGS * PIECE)))
    # One row a centre, so the cuts are as few as the documented number of centres.
    placed = assigned.join(F.broadcast(cuts), "cell").select("cell", ring.alias("ring"), part.alias("part"), "id", "label", "v", "dist")

    def pack(table: pa.Table) -> pa.Table:
        dist, label = table.column("dist").to_numpy(), table.column("label").to_numpy()
        same = label[0] if (label == label[0]).all() else None
        row = {
            "cell": table.column("cell")[0].as_py(),
            "near": dist.min(),
            "far": dist.max(),
            "label": same,
            "ids": table.column("id").to_numpy().astype("<i8").tobytes(),
            "labels": label.astype("<i8").tobytes(),
            "vectors": matrix(table.column("v"), dim).astype(stored).tobytes(),
        }
        kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array([x], t) for x, t in zip(row.values(), kinds, strict=True)], names=list(row))

    return placed.groupBy("cell", *keys, "ring", "part").applyInArrow(pack, PIECE_SCHEMA)


def unpack(row: dict, stored: str, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors of a packed row."""
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"), np.frombuffer(row["vectors"], stored).reshape(-1, dim)


def group_cells(counts: dict[int, int], centres: np.ndarray, block: int) -> dict[int, tuple[int, int]]:
    """Cell -> (first block, number of blocks): neighbouring cells share a block, large cells are split.

    ``counts`` has one entry a centre.  A block starts at the free cell that lies farthest
    from the one before and takes the nearest free cells until it is full.
    """
    found, free, at = {}, set(counts), 0
    last = centres[min(free)] if free else None
    while free:
        start = max(free, key=lambda c: (float(((centres[c] - last) ** 2).sum()), -c))
        near = sorted(free, key=lambda c: (c != start, float(((centres[c] - centres[start]) ** 2).sum()), c))
        room = block
        for cell in near:
            if cell != start and counts[cell] > room:
                break
            parts = -(-counts[cell] // block) if cell == start else 1
            found[cell] = (at, max(parts, 1))
            free.discard(cell)
            room -= counts[cell]
            if room <= 0:
                break
        at += found[start][1]
        last = centres[start]
    return found


def block_of(places: dict[int, tuple[int, int]]) -> Column:
    """The block of a query row by its cell, dealt by a hash where a cell has several."""
    table = F.create_map(*[F.lit(x) for c, (at, n) in places.items() for x in (c, at * 2**20 + n)])
    code = table[F.col("cell")]
    return (F.shiftright(code, 20) + F.pmod(F.xxhash64("id", "hash"), code.bitwiseAND(2**20 - 1))).cast("int")


def best_columns(scores: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of all entries that may be among the ``k`` best of a row and reach ``least`` of it."""
    fits = (scores >= least[:, None]) & (scores > -np.inf)
    many = np.flatnonzero(fits.sum(1) > 4 * k)
    if len(many) and scores.shape[1] > k:
        cut = np.partition(scores[many], -k, axis=1)[:, -k]
        fits[many] &= scores[many] >= cut[:, None]
    return np.nonzero(fits)


class Best:
    """The ``k`` best (score, id) of each of ``n`` queries, ties to the smaller id, and the least score still of use."""

    def __init__(self, n: int, k: int, least: np.ndarray, exact: bool):
        self.k, self.least = k, least
        self.q = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.scores = np.zeros(0, np.float64 if exact else object)

    def add(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        q, ids = np.concatenate([self.q, q]), np.concatenate([self.ids, ids])
        scores = np.concatenate([self.scores, scores.astype(self.scores.dtype)])
        order = np.lexsort((ids, -scores, q)) if scores.dtype != object else np.array(sorted(range(len(q)), key=lambda i: (q[i], -scores[i], ids[i])))
        q, scores, ids = q[order], scores[order], ids[order]
        new = np.r_[True, q[1:] != q[:-1]]
        start = np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
        place = np.arange(len(q)) - start
        keep = place < self.k
        last = place == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], scores[last])
        self.q, self.scores, self.ids = q[keep], scores[keep], ids[keep]


def search_parts(rows: int) -> int:
    return max(1, min(MAX_PARTS, rows // PART_ROWS))


def needed_pieces(pieces: DataFrame, needs: DataFrame, on: list[str], place: str, parts: int) -> DataFrame:
    """Each piece once for each block whose needs meet the distances it spans.

    ``needs`` has, for a block and a cell, the distances to the centre at which a row can
    matter (``low`` to ``high``); ``place`` is the SQL of what orders the visits of a block.
    """
    wanted = pieces.join(needs, on).where((F.col("far") >= F.col("low")) & (F.col("near") <= F.col("high")))
    salt = F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int")
    return wanted.select("block", salt.alias("salt"), F.lit(1).alias("kind"), F.expr(place).alias("place"), *pieces.columns)


def meet(blocks: DataFrame, pieces: DataFrame, parts: int, start: Callable, schema: str) -> DataFrame:
    """What ``start(block row)`` finds in the pieces of its block, for every part of every block.

    ``start`` gives an object with ``visit(piece row)`` and ``results()``, a record batch.
    A task holds one block and one piece at a time.
    """
    spark = blocks.sparkSession
    bound_batches(spark)
    salts = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("salt")
    heads = blocks.withColumns({"kind": F.lit(0), "place": F.lit(float("-inf"))}).select("*", salts)
    rows = heads.unionByName(pieces, allowMissingColumns=True)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["kind"] == 1:
                    state.visit(row)
                    continue
                if state is not None:
                    yield state.results()
                state = start(row)
        if state is not None:
            yield state.results()

    return rows.repartition(tasks, "block", "salt").sortWithinPartitions("block", "salt", "kind", "place").mapInArrow(run, schema)


def best_rows(found: DataFrame, query: list[str], score: str, row_id: str, k: int) -> DataFrame:
    """The ``k`` best rows of each query over all parts with their rank."""
    order = Window.partitionBy(*query).orderBy(F.col(score).desc(), row_id)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
