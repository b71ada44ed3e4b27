"""Exact Jaccard join of word shingles with count vectors and an R-tree.

Shingles are hashed into groups.  Two sets that link differ in at most ``d`` shingles,
``d`` following from their sizes, so of ``d + 1`` groups at least one holds the same
shingles in both: documents meet in the keys of such groups and nowhere else, and no
link is lost.  Each document that meets others is tested against the first of its key;
links so found join most of a group of copies, in work linear in its size.  Only
documents of one key that are still in different components are compared further: their
counts in the groups are points of an R-tree, whose boxes and points bound the possible
overlap by the sum of coordinate minima; pairs that survive are verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, join_groups, materialise, own_names
from .components import connected_components
from .shingles import mix, shingle_sets

WORDS = 5
SIMILARITY = Fraction(4, 5)
#: Coordinates of a count vector, a byte each where no count is larger than that.
GROUPS = 512
#: A band of sizes goes up to this times its smallest size.
BAND = Fraction(3, 2)
#: Groups beyond those that a link needs, for each shingle in which linked sets may differ.
SPARE = Fraction(2, 5)
#: Documents of one key are compared in blocks of so many.
BLOCK = 1024
#: Keys of fewer documents go to a task together, about so many of their rows at a time.
TOGETHER = 1024
#: Points of an R-tree leaf, and children of an inner node.
LEAF = 16
#: Pairs of a node and a probe that are bounded at a time.
PAIRS = 4096
#: Smallest keys of a document that go with it, to report a pair at one of its keys only.
LEAST = 8


def _groups(high: int, similarity: Fraction) -> tuple[int, int]:
    """Groups of a band up to size ``high``, and how many of them two sets that link share at least.

    Sets that link differ in at most ``d`` shingles, so ``d + 1`` groups would do; the
    others allow each set to go without keys for its smallest groups.
    """
    d = int((1 - similarity) / (1 + similarity) * 2 * high)
    groups = d + 1 + int(SPARE * d)
    return groups, groups - d


@lru_cache(maxsize=1 << 16)
def _bands(n: int, similarity: Fraction) -> tuple[tuple[int, int, int], ...]:
    """(band, groups, shared groups) in which a set of ``n`` shingles has keys: its own band and, where it can be the smaller of a pair, the next.

    Bands whose sets link only if they are equal have no keys.
    """
    low, band = 1, 0
    while True:
        high = max(low, int(low * BAND))
        if n <= high:
            break
        low, band = high + 1, band + 1
    found = [(band, *_groups(high, similarity))]
    if n >= similarity * (high + 1):
        found.append((band + 1, *_groups(max(high + 1, int((high + 1) * BAND)), similarity)))
    return tuple(f for f in found if f[1] > f[2])


def _ranges(groups: int) -> np.ndarray:
    """The first hash of each group but the first."""
    return np.array([(g << 64) // groups + (1 if (g << 64) % groups else 0) for g in range(1, groups)], dtype=np.uint64)


_SECOND = np.uint64(0x2545F4914F6CDD1D)
_edges: dict[int, np.ndarray] = {}


def _cut(hashes: np.ndarray, groups: int) -> np.ndarray:
    """Where each group of the sorted hashes begins, and their number at the end."""
    if groups not in _edges:
        _edges[groups] = _ranges(groups)
    return np.concatenate(([0], np.searchsorted(hashes, _edges[groups]), [len(hashes)]))


def _keys(hashes: np.ndarray, sums: np.ndarray, similarity: Fraction) -> np.ndarray:
    """A key for each group of each band, equal where the groups hold the same shingles.

    Small groups are shared by chance, and empty ones by many.  A set has no keys for groups
    smaller than its ``shared``-th smallest.  These are fewer than the groups that a link
    shares, so one shared group is not small for the set whose limit is the higher one, nor
    for the other: no link is lost.
    """
    keys = []
    for band, groups, shared in _bands(len(hashes), similarity):
        at = _cut(hashes, groups)
        counts = np.diff(at).astype(np.uint64)
        content = sums[at[1:]] - sums[at[:-1]]
        place = np.arange(groups, dtype=np.uint64) + np.uint64(band << 32)
        own = mix(content + mix(place + np.uint64(0x51ED270B)) + counts)
        keys.append(own[counts >= np.partition(counts, shared - 1)[shared - 1]])
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _profiles(k: int, similarity: Fraction):
    """Arrow batches of row_id, doc_id and text to set identity, size, keys and count vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                one, two, sizes, keys, counts = [], [], [], [], []
                for hashes in shingle_sets(batch.column("text"), k):
                    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
                    np.cumsum(mix(hashes), out=sums[1:])
                    one.append(sums[-1])
                    two.append(mix(hashes ^ _SECOND).sum(dtype=np.uint64))
                    sizes.append(len(hashes))
                    keys.append(_keys(hashes, sums, similarity).view(np.int64))
                    counts.append(_packed(np.diff(_cut(hashes, GROUPS))))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row_id"),
                        batch.column("doc_id"),
                        pa.array(np.array(sizes, dtype=np.int64)),
                        pa.array(np.array(one, dtype=np.uint64).view(np.int64)),
                        pa.array(np.array(two, dtype=np.uint64).view(np.int64)),
                        _lists(keys, np.int64),
                        pa.array(counts, pa.binary()),
                    ],
                    ["row_id", "doc_id", "n_shingles", "set_a", "set_b", "keys", "counts"],
                )

    return run


def _lists(arrays: list[np.ndarray], kind: type) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(kind) if arrays else np.zeros(0, kind)))


def _packed(counts: np.ndarray) -> bytes:
    """A count vector with a byte a coordinate, or four if one of them needs more."""
    return counts.astype(np.uint8 if counts.max() < 256 else "<i4").tobytes()


def _points(column: pa.Array) -> np.ndarray:
    """The count vectors that ``_packed`` made, one a row."""
    values = column.to_pylist()
    if all(len(v) == GROUPS for v in values):
        return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(-1, GROUPS)
    return np.stack([np.frombuffer(v, dtype=np.uint8 if len(v) == GROUPS else "<i4").astype(np.int32) for v in values])


def _sets(k: int):
    """Arrow batches of text to set identity and sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                sets = list(shingle_sets(batch.column("text"), k))
                one = np.array([mix(h).sum(dtype=np.uint64) for h in sets], dtype=np.uint64)
                two = np.array([mix(h ^ _SECOND).sum(dtype=np.uint64) for h in sets], dtype=np.uint64)
                arrays = [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), _lists([h.view(np.int64) for h in sets], np.int64)]
                yield pa.RecordBatch.from_arrays(arrays, ["set_a", "set_b", "hashes"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and row_id: each row of a key but the first, with the first."""
    last_key, last_first = None, None
    for batch in batches:
        key, row = batch.column("key").to_numpy(), batch.column("row_id").to_numpy()
        if not len(key):
            continue
        new = np.concatenate(([key[0] != last_key], key[1:] != key[:-1]))
        start = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        first = np.where(start >= 0, row[start], row[0] if last_first is None else last_first)
        last_key, last_first = key[-1], first[-1]
        yield pa.RecordBatch.from_arrays([pa.array(key[~new]), pa.array(row[~new]), pa.array(first[~new])], ["key", "row_id", "first"])


def _needed(n: np.ndarray, m: np.ndarray, similarity: Fraction) -> np.ndarray:
    """The least overlap with which sets of these sizes link."""
    p, q = similarity.numerator, similarity.denominator
    return -(-(p * (n + m)) // (p + q))


class RTree:
    """Count vectors packed by sort-tile-recursion; searched for points whose overlap may suffice."""

    def __init__(self, points: np.ndarray):
        self.order = self._tile(points, np.arange(len(points)), 0)
        self.points = points[self.order]
        self.sizes = self.points.sum(axis=1, dtype=np.int64)
        #: From the leaves up: the smallest size and the largest coordinates below each node.
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        least, high = self.sizes, self.points
        while not self.levels or len(high) > 1:
            at = np.arange(0, len(high), LEAF)
            least, high = np.minimum.reduceat(least, at), np.maximum.reduceat(high, at)
            self.levels.append((least, high))

    def _tile(self, points: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
        """Row numbers in an order that keeps near points together: halves along the widest coordinate."""
        if len(rows) <= LEAF:
            return rows
        wide = int((points[rows].max(axis=0) - points[rows].min(axis=0)).argmax())
        rows = rows[np.argsort(points[rows, wide], kind="stable")]
        half = (len(rows) // 2 + LEAF - 1) // LEAF * LEAF
        return np.concatenate((self._tile(points, rows[:half], depth + 1), self._tile(points, rows[half:], depth + 1)))

    def search(self, point: np.ndarray, similarity: Fraction) -> np.ndarray:
        """Row numbers of the points whose summed coordinate minima with ``point`` reach the needed overlap."""
        return self.search_all(np.asarray(point)[None], similarity)[1]

    def search_all(self, probes: np.ndarray, similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of ``probes``, row of the points) whose summed coordinate minima reach the needed overlap.

        All probes go down the tree together, a level at a time.
        """
        sizes = probes.sum(axis=1, dtype=np.int64)

        def hopeful(at: np.ndarray, who: np.ndarray, least: np.ndarray, high: np.ndarray) -> np.ndarray:
            """Which (node, probe) pairs may hold a link, computed for so many pairs at a time."""
            need = _needed(least[at], sizes[who], similarity)
            return np.concatenate([np.minimum(high[at[i : i + PAIRS]], probes[who[i : i + PAIRS]]).sum(axis=1, dtype=np.int64) >= need[i : i + PAIRS] for i in range(0, max(len(at), 1), PAIRS)])

        at, who = np.zeros(len(probes), dtype=np.int64), np.arange(len(probes))
        for i in reversed(range(len(self.levels))):
            keep = hopeful(at, who, *self.levels[i])
            at, who = (at[keep][:, None] * LEAF + np.arange(LEAF)).ravel(), np.repeat(who[keep], LEAF)
            there = at < (len(self.levels[i - 1][0]) if i else len(self.order))
            at, who = at[there], who[there]
        keep = hopeful(at, who, self.sizes, self.points)
        return who[keep], self.order[at[keep]]


def _padded(column: pa.ChunkedArray) -> np.ndarray:
    """``LEAST`` keys a row, the largest number where there are fewer."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    out = np.full((len(sizes), LEAST), np.iinfo(np.int64).max)
    out[np.arange(LEAST) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _seen_before(least: np.ndarray, x: np.ndarray, y: np.ndarray, key: int) -> np.ndarray:
    """Which pairs share a smaller key among their smallest ones: they are compared there too, as one of them is a probe of it."""
    parts = [np.zeros(0, dtype=bool)]
    for i in range(0, len(x), PAIRS):
        a, b = least[x[i : i + PAIRS]], least[y[i : i + PAIRS]]
        parts.append(((a[:, :, None] == b[:, None, :]) & (a < key)[:, :, None]).any(axis=(1, 2)))
    return np.concatenate(parts)


def _compare(similarity: Fraction):
    """Rows of keys, each with a pair of blocks, to pairs of documents of different components that may link."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("key", "ascending"), ("data_block", "ascending"), ("probe_block", "ascending")])
        key, data_block, probe_block, ids, labels, probe, stored = (table[c].to_numpy() for c in ("key", "data_block", "probe_block", "row_id", "label", "probe", "stored"))
        points, least = _points(table["counts"]), _padded(table["least"])
        new = (key[1:] != key[:-1]) | (data_block[1:] != data_block[:-1]) | (probe_block[1:] != probe_block[:-1])
        edges = np.concatenate(([0], np.flatnonzero(new) + 1, [len(key)]))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            probes, data = start + np.flatnonzero(probe[start:stop]), start + np.flatnonzero(stored[start:stop])
            if len(probes) and len(data):
                who, where = RTree(points[data]).search_all(points[probes], similarity)
                x, y = probes[who], data[where]
                apart = labels[x] != labels[y]
                apart[apart] = ~_seen_before(least, x[apart], y[apart], key[start])
                found.append((np.maximum(ids[x], ids[y])[apart], np.minimum(ids[x], ids[y])[apart]))
        pairs = np.unique(np.concatenate([np.stack(p, axis=1) for p in found]), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return run


def _dealt(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """Pairs (a, b) with ``value`` of both.  A row in very many pairs is copied for each ``BLOCK`` of them."""
    degree = pairs.groupBy("b").agg((F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).where("parts > 0")
    degree = materialise(degree, "degree")
    part = F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(0)) + 1).cast("int")
    split = pairs.join(degree, "b", "left").withColumn("part", part).drop("parts")
    left = rows.select(F.col("row_id").alias("a"), F.col(value).alias("x"))
    right = rows.select("row_id", value).join(degree.withColumnRenamed("b", "row_id"), "row_id", "left")
    right = right.select(F.col("row_id").alias("b"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(0)))).alias("part"), F.col(value).alias("y"))
    return split.join(left, "a").join(right, ["b", "part"])


def _bounded(pairs: DataFrame, profiles: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs whose summed coordinate minima allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = _points(batch.column("x")), _points(batch.column("y"))
                total = lambda v: v.sum(axis=1, dtype=np.int64)
                may = total(np.minimum(x, y)) >= _needed(total(x), total(y), similarity)
                yield batch.select(["a", "b"]).filter(pa.array(may))

    return _dealt(pairs, profiles, "counts").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, members: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """The pairs whose whole sets link.  Sets are made again from the texts of the rows in pairs, by then few."""
    p, q = similarity.numerator, similarity.denominator
    involved = pairs.select(F.explode(F.array("a", "b")).alias("row_id")).distinct()
    involved = materialise(members.join(involved, "row_id", "left_semi").select("row_id", "doc_id", "set_a", "set_b"), "involved")
    ids = involved.select(F.col("doc_id").alias("__id")).distinct()
    found = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    found = found.mapInArrow(_sets(words), "set_a long, set_b long, hashes array<long>").dropDuplicates(["set_a", "set_b"])
    sets = materialise(found.join(involved.drop("doc_id"), ["set_a", "set_b"]).select("row_id", "hashes"), "sets")
    inter = F.size(F.array_intersect("x", "y"))
    return _dealt(pairs, sets, "hashes").where((p + q) * inter >= p * (F.size("x") + F.size("y"))).select("a", "b")


def similar_groups(docs: DataFrame, words: int = WORDS, similarity: Fraction = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``.

    Two documents link when the Jaccard similarity of their sets of distinct ``words``-word
    shingles is at least ``similarity``.  ``component_id`` is the smallest doc_id that links
    reach.  A text with fewer words is one shingle; a text without words, or null, has none
    and links with nothing.  Rows that repeat a doc_id are documents of their own; a null
    doc_id never is the smallest one of a component with others.  Further columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    profiles = texts.withColumn("row_id", F.monotonically_increasing_id()).mapInArrow(
        _profiles(words, similarity), "row_id long, doc_id long, n_shingles long, set_a long, set_b long, keys array<long>, counts binary"
    )
    profiles = materialise(profiles, "profiles")

    identity = ["n_shingles", "set_a", "set_b"]
    same = profiles.where("n_shingles > 0").groupBy(*identity).agg(F.min("row_id").alias("rep"), F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    same = materialise(same, "same_sets")
    members = materialise(
        join_groups(profiles.select("row_id", "doc_id", *identity), same, identity, "n_rows").select("row_id", "doc_id", *identity, F.coalesce("rep", "row_id").alias("rep")), "members"
    )
    copies = members.where("rep <> row_id").select("row_id")
    keyed = profiles.where(F.size("keys") > 0).select("row_id", "keys").join(copies, "row_id", "left_anti")
    keyed = keyed.select(F.explode("keys").alias("key"), "row_id")
    met = keyed.repartition(tasks, "key").sortWithinPartitions("key", "row_id").mapInArrow(_meet, "key long, row_id long, first long")
    met = materialise(met, "met")

    pairs = met.select(F.col("row_id").alias("a"), F.col("first").alias("b")).distinct()
    bounded = materialise(_bounded(pairs, profiles, similarity), "bounded")
    links = materialise(_verified(bounded, texts, members, words, similarity), "links_first")
    labels = connected_components(links)
    rest = materialise(_rest(met, labels, profiles, similarity).join(bounded, ["a", "b"], "left_anti"), "rest")
    more = materialise(_verified(rest, texts, members, words, similarity), "links_more")
    if more.limit(1).count():
        labels = connected_components(links.unionByName(more))

    of = members.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("row_id", "doc_id", "n_shingles", F.coalesce("label", "rep").alias("label"))
    of = materialise(of, "labelled")
    least = of.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    least = materialise(least, "components")
    return join_groups(of, least, ["label"], "n_rows").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _rest(met: DataFrame, labels: DataFrame, profiles: DataFrame, similarity: Fraction) -> DataFrame:
    """Pairs of documents that share a key, are in different components and may link.

    The first of a key has been tested against all others of it.  Of the others of a
    key, only those outside its most frequent component are searched, against all.  Of
    keys that hold the same documents, one is enough.
    """
    of = labels.select(F.col("node").alias("row_id"), "label")
    rows = met.select("key", "row_id").join(of, "row_id", "left").select("key", "row_id", F.coalesce("label", "row_id").alias("label"))
    digests = [F.bit_xor(F.xxhash64("row_id", F.lit(i))).alias(f"digest_{i}") for i in range(2)]
    sizes = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), *digests)
    digests = [F.bit_xor(f"digest_{i}").alias(f"digest_{i}") for i in range(2)]
    sizes = sizes.groupBy("key").agg(F.sum("n").alias("n_key"), F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("n_labels"), *digests)
    alike = ["n_key", "digest_0", "digest_1"]
    mixed = sizes.where("n_labels > 1").groupBy(*alike).agg(F.min_by("key", "key").alias("key"), F.min_by("main", "key").alias("main"))
    mixed = materialise(mixed.select("key", "n_key", "main"), "mixed_keys")
    rows = join_groups(rows, mixed, ["key"], "n_key", "inner")
    blocks = (F.col("n_key") / BLOCK).cast("int") + 1
    block = lambda salt: F.pmod(F.xxhash64("row_id", F.lit(salt)), blocks).cast("int")
    # A document's keys together, so that its vector is sent once; their number is bounded by its size.
    held = rows.groupBy("row_id", "label").agg(F.collect_list(F.struct("key", "n_key", "main")).alias("held"))
    held = held.withColumn("least", F.slice(F.sort_array(F.transform("held", lambda x: x["key"])), 1, LEAST))
    rows = held.join(profiles.select("row_id", "counts"), "row_id").select("row_id", "label", "counts", "least", F.inline("held"))
    rows = materialise(rows.withColumns({"blocks": blocks, "probe": F.col("label") != F.col("main"), "own": block(1)}), "mixed_rows")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cols = ["key", "row_id", "label", "counts", "least", "blocks"]
    one = F.lit(0).alias("data_block"), F.lit(0).alias("probe_block")
    alone = rows.where("blocks = 1").select(*cols, "probe", F.lit(True).alias("stored"), *one)
    many = rows.where("blocks > 1")
    data = many.select(*cols, F.lit(False).alias("probe"), F.lit(True).alias("stored"), F.col("own").alias("data_block"), every.alias("probe_block"))
    probes = many.where("probe").select(*cols, "probe", F.lit(False).alias("stored"), every.alias("data_block"), F.col("own").alias("probe_block"))
    total = mixed.where(F.col("n_key") < BLOCK).agg(F.sum("n_key")).first()[0] or 0
    lot = F.when(F.col("blocks") > 1, F.xxhash64("key", "data_block", "probe_block")).otherwise(F.pmod(F.xxhash64("key"), F.lit(2 * total // TOGETHER + 1)))
    lots = alone.unionByName(data).unionByName(probes).withColumn("lot", lot).groupBy("lot")
    # Written, so that pairs are made distinct before they are joined to anything.
    return materialise(lots.applyInArrow(_compare(similarity), "a long, b long").distinct(), "found")


@own_names
def drop_similar(docs: DataFrame, words: int = WORDS, similarity: Fraction = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each component, with their columns.

    Rows that repeat a doc_id stay or go together.
    """
    groups = materialise(similar_groups(docs, words, similarity), "similar")
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"))
    gone = groups.select(F.col("doc_id").alias("__id")).join(stay, "__id", "left_anti").where("__id is not null").distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__id"), "left_anti").select(*docs.columns)
