"""The trie of conversation prefixes.

Prefixes are compared by polynomial rolling fingerprints: the sum of ``h(turn) * B^place``
modulo two primes, a running sum that numpy scans give for all turns of a partition at
once.  Turns with equal depth and fingerprint are candidates for one node.  Each candidate
is held turn by turn against the group's representative: by induction over the depth two
prefixes are equal if their last turns (SHA-256 of role and text) and their parents are,
so a group is verified when all its members have the representative's turn and parent.
Groups in which some have not are collisions, and are split by turn and parent until none is left.

A node is owned by its smallest member.  What a node adds to its ancestors lies on its
owner's path, so the roll-up to all parents is a running sum from the last turn to the
first of each conversation, added up over the members of a node: one scan for a trie of
any depth.

Sorted scans go over ranges of (conversation, place), so a conversation with a third of
all turns is spread over many tasks; only the sums at the ends of ranges are combined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, join_groups, materialise

#: Primes below 2^31, so that a product of two residues fits into a long, and bases.
PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (1_000_003, 805_306_457)
KEY = ["d", "f", "s"]
TURN = ["q1", "q2", "q3", "q4"]
#: Longest prefix that a conversation takes from the first of its five.
MAX_SHARED = 8
NODE_SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def running_sums(rows: DataFrame, ranges: list[Column], order: list[Column], keep: list[str], sums: list[str], name: str) -> DataFrame:
    """``keep`` of the rows, ``seen`` and ``sum_x`` for each ``x`` of ``sums``: rows and sums of ``conv_id`` up to each row.

    The rows are sorted by ranges of ``ranges``, which start with ``conv_id`` and which
    ``order`` refines.  Each partition sums by itself; the last sums of each partition,
    a row a partition, say what the first conversation of the next one has to add.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    spread = rows.repartitionByRange(*ranges).sortWithinPartitions(*order).select(*dict.fromkeys([*keep, *sums]), F.spark_partition_id().alias("pid"))
    made = ["seen", *[f"sum_{x}" for x in sums]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, [0] * len(made)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv_id").to_numpy()
            new = np.r_[conv[0] != last, conv[1:] != conv[:-1]]
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            goes_on = ~np.logical_or.accumulate(new)
            columns = []
            for values, before in zip([np.ones(n, np.int64), *[batch.column(x).to_numpy() for x in sums]], carry, strict=True):
                total = np.cumsum(values)
                columns.append(total + np.where(goes_on, before, -np.r_[0, total[:-1]][first]))
            last, carry = conv[-1], [c[-1] for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.int64()) for c in columns]], [*batch.schema.names, *made])

    schema = ", ".join([*[f"{n} {t}" for n, t in spread.dtypes], *[f"{x} long" for x in made]])
    out = materialise(spread.mapInArrow(run, schema), name)
    ends = out.groupBy("pid").agg(F.max(F.struct("conv_id", *made)).alias("end"), F.min("conv_id").alias("first")).collect()
    add, last, carry = [], None, [0] * len(made)
    for r in sorted(ends, key=lambda r: r["pid"]):
        if r["first"] == last:
            add.append((r["pid"], last, *carry))
        last, end = r["end"][0], r["end"][1:]
        goes_on = bool(add) and add[-1][:2] == (r["pid"], last)
        carry = [x + y for x, y in zip(end, carry, strict=True)] if goes_on else list(end)
    if not add:
        return out.drop("pid")
    given = spark.createDataFrame(add, ", ".join(["pid int, conv_id long", *[f"__{x} long" for x in made]]))
    # One row a partition at most.
    out = out.join(F.broadcast(given), ["pid", "conv_id"], "left")
    return out.withColumns({x: F.col(x) + F.coalesce(f"__{x}", F.lit(0)) for x in made}).select(*keep, *made)


def _powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """``base ** exponents`` modulo a prime below 2^31, by squaring all at once."""
    out, square, left = np.ones(len(exponents), np.int64) % prime, base % prime, exponents.copy()
    while left.any():
        out = np.where(left & 1, out * square % prime, out)
        square = square * square % prime
        left >>= 1
    return out


def with_terms(turns: DataFrame, primes: tuple[int, int]) -> DataFrame:
    """``turns`` with what each turn adds to the two fingerprints: its hash times the base to the power of its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, terms = batch.column("d").to_numpy(), []
            for turn, prime, base in zip(TURN, primes, BASES, strict=False):
                residue = (batch.column(turn).to_numpy().astype(np.uint64) % np.uint64(prime)).astype(np.int64)
                terms.append(pa.array(residue * _powers(base, place, prime) % prime, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *terms], [*batch.schema.names, "t1", "t2"])

    return turns.mapInArrow(run, ", ".join([*[f"{n} {t}" for n, t in turns.dtypes], "t1 long", "t2 long"]))


def ranked_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, seen (from 1), bytes and the four longs of the SHA-256 of each turn, in the order of turns.

    Null turns come first, equal turns go by role and text.  Ranges are cut by the first
    64 characters of a text, which order it as the whole does.
    """
    rows = df.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
    )
    at = F.col("turn").asc_nulls_first()
    framed = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    # Halves of 32 bits, as conv() gives unsigned numbers that a long cannot hold.
    half = [F.conv(F.substring(framed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(8)]
    longs = [F.shiftleft(half[2 * i], 32).bitwiseOR(half[2 * i + 1]).alias(q) for i, q in enumerate(TURN)]
    rows = rows.select("*", F.octet_length("text").cast("long").alias("bytes"), *longs)
    ranges = [F.col("conv_id"), at, F.col("role"), F.left("text", F.lit(64))]
    return running_sums(rows, ranges, [F.col("conv_id"), at, F.col("role"), F.col("text")], ["conv_id", "bytes", *TURN], [], "turns")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, d, last, bytes, hash) of the rebuilt conversations, and one row a conversation with its length.

    Conversation ``c`` is the first ``h`` turns of ``c - c % 5`` and what its own first
    ``h`` leave, where ``h`` is the CRC-32 of its decimal number modulo 9.
    """
    convs = turns.groupBy("conv_id").agg(F.max("seen").alias("n"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MAX_SHARED + 1)).alias("h")
    convs = convs.select("conv_id", "n", shared, (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    of = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(of, "base", "left").select("conv_id", "base", "n", "h", taken.alias("taken"))
    convs = materialise(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    heads = turns.where(F.col("seen") <= MAX_SHARED).withColumnRenamed("conv_id", "base")
    # At most 8 turns for each of at most 9 conversations of a base.
    prefix = convs.where("taken > 0").join(heads, "base").where("seen <= taken").withColumn("d", F.col("seen"))
    own = join_groups(turns, convs, ["conv_id"], "n", "inner").where("seen > h").withColumn("d", F.col("taken") + F.col("seen") - F.col("h"))
    columns = ["conv_id", F.col("d").cast("long").alias("d"), (F.col("d") == F.col("length")).alias("last"), "bytes", *TURN]
    return prefix.select(*columns).unionByName(own.select(*columns)), convs


def _grouped(steps: DataFrame) -> DataFrame:
    """Members, owner and bytes of each group, and whether any member differs from the others in turn or parent."""
    differs = [(F.min(c) != F.max(c)).cast("int") for c in ["pf", *TURN]]
    return steps.groupBy(*KEY, "ps").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("pf").alias("pf"), F.greatest(*differs).alias("mixed")
    )


def split_collisions(steps: DataFrame) -> DataFrame:
    """Steps whose groups (d, f, s) hold one sequence each: mixed groups are split by turn and parent.

    A split gives all rows of a mixed group the digest of their turn and of their parent's
    key, which changes the parent of their next steps, so rounds go on until no group is mixed.
    """
    while True:
        whole = F.struct("pf", "ps", *TURN)
        groups = steps.groupBy(*KEY).agg((F.min(whole) != F.max(whole)).alias("mixed"))
        mixed = materialise(groups.where("mixed").select(*KEY, F.lit(True).alias("mixed")), "mixed")
        if mixed.isEmpty():
            return steps
        own = F.sha2(F.concat_ws("|", "s", "pf", "ps", *TURN).cast("binary"), 256)
        split = steps.join(mixed, KEY, "left").withColumn("s", F.when(F.col("mixed"), own).otherwise(F.col("s"))).drop("mixed", "ps")
        up = split.select("conv_id", (F.col("d") + 1).alias("d"), F.col("s").alias("ps"))
        split = split.join(up, ["conv_id", "d"], "left").fillna("", ["ps"])
        steps = materialise(split.select(*steps.columns), "steps")


def _ends(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """Of each node in which conversations end, the SHA-256 of their numbers in order.

    Numbers are sorted by ranges and written as text piece by piece, so a node in which a
    third of all conversations end is a few pieces, which one task hashes as a stream.
    """
    ends = steps.where("last").select(*KEY, "conv_id")
    turnless = convs.where("length = 0").select(F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("f"), F.lit("").alias("s"), "conv_id")
    ends = ends.unionByName(turnless)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d, f, ids = (batch.column(c).to_numpy() for c in ("d", "f", "conv_id"))
            s = batch.column("s").to_pylist()
            cut = [i for i in range(len(s)) if not i or (d[i], f[i], s[i]) != (d[i - 1], f[i - 1], s[i - 1])]
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cut, [*cut[1:], len(s)], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(cut)) for c in KEY], pa.array(ids[cut]), pa.array(texts)], [*KEY, "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, found = None, None, []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in (*KEY, "ids")], strict=True):
                if row[:3] != key:
                    if key is not None:
                        found.append((*key, state.hexdigest()))
                    key, state = row[:3], hashlib.sha256()
                else:
                    state.update(b",")
                state.update(row[3].encode())
            if len(found) >= 10_000:
                yield done(found)
                found = []
        if key is not None:
            yield done([*found, (*key, state.hexdigest())])

    def done(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], [*KEY, "ends_sha256"])

    order = [*KEY, "conv_id"]
    texts = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "d long, f long, s string, first long, ids string")
    return texts.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, "d long, f long, s string, ends_sha256 string")


def prefix_trie(df: DataFrame, primes: tuple[int, int] = PRIMES, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are rebuilt as ``rebuilt_turns`` says.  Each distinct sequence of the
    first ``d`` turns is a node at depth ``d``, named by its smallest member; the root,
    at depth 0, has all conversations as members, also those without turns.  ``n_leaves``
    counts childless nodes of the subtree, ``saved_tokens`` sums ``(n_convs - 1)`` times
    the UTF-8 bytes of the last text over it, ``ends_sha256`` is the digest of the numbers
    of the members that end in the node.

    Rows without conv_id take no part; a null role or text is empty; null turns come
    first and equal turns go by role and text; repeated rows are turns of their own; an
    empty table has no nodes, not even a root.  Numbers below 0 go up to a multiple of 5.
    Other columns are not read.  ``primes`` only decides how often prefixes must be split.
    """
    turns = ranked_turns(df, conv_id, turn, role, text)
    rebuilt, convs = rebuilt_turns(turns)
    up = [F.col("conv_id"), F.col("d")]
    scanned = running_sums(with_terms(rebuilt, primes), up, up, ["conv_id", "d", "last", "bytes", *TURN, "t1", "t2"], ["t1", "t2"], "prints")

    def fingerprint(first: Column, second: Column) -> Column:
        return (first % primes[0]) * primes[1] + second % primes[1]

    steps = scanned.select(
        "conv_id", "d", "last", "bytes", *TURN,
        fingerprint(F.col("sum_t1"), F.col("sum_t2")).alias("f"), F.lit("").alias("s"),
        fingerprint(F.col("sum_t1") - F.col("t1"), F.col("sum_t2") - F.col("t2")).alias("pf"), F.lit("").alias("ps"),
    )
    groups = materialise(_grouped(steps), "groups")
    if not groups.where("mixed = 1").isEmpty():
        steps = split_collisions(steps)
        groups = materialise(_grouped(steps), "groups")

    children = groups.groupBy((F.col("d") - 1).alias("d"), F.col("pf").alias("f"), F.col("ps").alias("s")).agg(F.count("*").alias("n_children"))
    nodes = materialise(groups.join(children, KEY, "left").fillna(0, ["n_children"]), "nodes")
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("bytes")
    weights = nodes.select("conv_id", "d", leaf.alias("leaf"), saved.alias("saved"))
    paths = steps.select("conv_id", *KEY).join(weights, ["conv_id", "d"], "left").fillna(0, ["leaf", "saved"])
    down = [F.col("conv_id"), F.col("d").desc()]
    rolled = running_sums(paths, down, down, ["conv_id", *KEY], ["leaf", "saved"], "rolled")
    below = rolled.groupBy(*KEY).agg(F.sum("sum_leaf").alias("n_leaves"), F.sum("sum_saved").alias("saved_tokens"))

    top = convs.agg(F.min("conv_id"), F.count("*")).first()
    all_ = nodes.agg(F.count_if(F.col("d") == 1), F.sum(leaf), F.sum(saved)).first()
    if not top[1]:
        return df.sparkSession.createDataFrame([], NODE_SCHEMA)
    owners = nodes.where("n_children > 0").select(F.col("d").alias("pd"), F.col("f").alias("pf"), F.col("s").alias("ps"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    parents = join_groups(nodes.where("d > 1").select(*KEY, (F.col("d") - 1).alias("pd"), "pf", "ps"), owners, ["pd", "pf", "ps"], "n_children")
    ends = materialise(_ends(steps, convs), "ends")
    whole = nodes.join(below, KEY).join(parents.select(*KEY, "parent_conv_id"), KEY, "left").join(ends, KEY, "left")
    found = whole.select(
        "conv_id", F.col("d").alias("depth"), F.when(F.col("d") == 1, F.lit(top[0])).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    at_root = ends.where("d = 0").select("ends_sha256").first()
    root = (top[0], 0, None, top[1], all_[0] or 0, all_[1] or 1, all_[2] or 0, at_root[0] if at_root else NO_ENDS)
    return found.unionByName(df.sparkSession.createDataFrame([root], NODE_SCHEMA))
