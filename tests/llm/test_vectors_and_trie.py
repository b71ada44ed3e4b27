import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeeper.llm import exact_topk, hard_negatives, prefix_trie
from lorekeeper.llm import vectors as V

SCHEMA = "vec_id long, embedding array<double>, label int, id string, v int, hash string, cell int, block string, rank int, score double, place int, norm int"


def odd_vectors() -> list[tuple]:
    """(vec_id, embedding, label): clusters, copies, repeated rows, and rows that take no part."""
    rng = random.Random(3)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + rng.uniform(-0.2, 0.2) for x in centres[i % 4]], rng.randrange(4)) for i in range(0, 260)]
    rows += [(i, centres[0], i % 3) for i in range(300, 420)]
    rows += [
        (420, [0.0] * 6, 1),
        (421, [], 1),
        (425, [0.5, 0.25], 2),
        (450, [3.0, -2.0, 1.0, 0.0, 0.5, 9.0], 0),
        (450, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0], 0),
        (400, centres[1], 2),
        (400, centres[1], 2),
        (500, None, 1),
        (550, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1),
        (600, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], 1),
        (650, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0], 1),
        (None, centres[2], 1),
        (700, centres[3], None),
        (-50, centres[3], 3),
        (-100, centres[2], 3),
    ]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "h", 2, "b", 3, 0.5, 4, 5) for r in rows], SCHEMA).repartition(5)


@pytest.fixture
def small(monkeypatch):
    """Many pieces, blocks and parts on few rows."""
    monkeypatch.setattr(V, "PIECE", 4)
    monkeypatch.setattr(V, "BLOCK", 2)
    monkeypatch.setattr(V, "PART_ROWS", 100)


def whole(rows, label=None):
    """The distinct rows that take part, as (id, label, integers)."""
    out = set()
    for i, v, c in rows:
        c = label(i, c) if label and i is not None else c if label else 0
        if i is None or c is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        out.add((i, c, tuple(math.floor(x * 256) for x in v)))
    return sorted(out)


def dot(a, b):
    return min(max(sum(x * y for x, y in zip(a, b, strict=False)), -(2**63)), 2**63 - 1)


def brute_topk(rows, is_query, k):
    rows, out = whole(rows), Counter()
    for q, _, v in rows:
        if is_query(q):
            best = sorted((-dot(v, w), i) for i, _, w in rows if i != q)[:k]
            out.update((q, r, i, -s) for r, (s, i) in enumerate(best, 1))
    return out


def brute_negatives(rows, is_anchor, label, n_pos, n_neg):
    rows, out = whole(rows, label), Counter()
    for a, c, v in rows:
        if not is_anchor(a):
            continue
        for p, i in sorted((-dot(v, w), i) for i, d, w in rows if d == c and i != a)[:n_pos]:
            found = sorted((-dot(v, w), j) for j, d, w in rows if d != c and 30 * -p <= 100 * dot(v, w) <= 90 * -p)[:n_neg]
            out.update((a, i, r, j, -p, -s) for r, (s, j) in enumerate(found, 1))
    return out


def as_counter(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def found_topk(spark, rows, **kw):
    return as_counter(exact_topk.top_k(frame(spark, rows), F.col("id") % 50 == 0, **kw), "query_id", "rank", "vec_id", "score")


def test_topk_of_odd_rows(spark, small):
    rows = odd_vectors()
    want = brute_topk(rows, lambda i: i % 50 == 0, 5)
    assert found_topk(spark, rows, pivots=12) == want
    assert found_topk(spark, rows, pivots=1) == want


def test_topk_of_tied_few_and_no_rows(spark, small):
    rows = odd_vectors()
    tied = [(i, [1.0, 0.0], 0) for i in range(400)]
    assert found_topk(spark, tied, pivots=8) == brute_topk(tied, lambda i: i % 50 == 0, 5)
    few = rows[:3]
    assert found_topk(spark, few) == brute_topk(few, lambda i: i % 50 == 0, 5)
    assert found_topk(spark, []) == Counter()
    zeros = [(i, [0.0, 0.0], 0) for i in range(60)]
    assert found_topk(spark, zeros) == brute_topk(zeros, lambda i: i % 50 == 0, 5)


def test_topk_of_numbers_that_floats_cannot_hold(spark, small):
    rng = random.Random(5)
    for top in (1e6, 9e6, 1e9):
        rows = [(i, [rng.choice([-1, 1]) * rng.uniform(1e4, top) for _ in range(3)], 0) for i in range(120)]
        assert found_topk(spark, rows, pivots=6) == brute_topk(rows, lambda i: i % 50 == 0, 5)


def test_pieces_far_from_a_query_are_not_sent(spark, small):
    """Two far clusters: no piece of the other one is needed for the queries of one."""
    rng = random.Random(9)
    rows = [(i, [(1.0 if i % 2 else -1.0) + rng.uniform(-0.01, 0.01), rng.uniform(-0.01, 0.01)], 0) for i in range(1, 400)]
    vectors = np.array([[math.floor(x * 256) for x in r[1]] for r in rows])
    about = {"dim": 2, "norm": float(np.sqrt((vectors**2).sum(1)).max()), "stored": "<i2", "rows": len(rows)}
    shape = exact_topk._Shape(about, np.array([r[0] for r in rows[:12]]), vectors[:12], 3)
    low, high = exact_topk._needs(shape, vectors[[0, 2]], shape.least(np.array([1, 3]), vectors[[0, 2]]))
    cell, dist = shape.nearest_row(vectors.astype(float))
    sent = (low[cell] <= dist) & (dist <= high[cell])
    assert not sent[vectors[:, 0] < 0].any() and sent[vectors[:, 0] > 0].any()


def test_hard_negatives_of_odd_rows(spark, small):
    rows = odd_vectors()
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))

    def changed(i, c):
        return None if c is None else (c + 1) % 10 if i % 7 == 0 else c

    cols = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    mined = hard_negatives.mine_hard_negatives(frame(spark, rows), F.col("id") % 100 == 0, label, 5, 10, clusters=9)
    want = brute_negatives(rows, lambda i: i % 100 == 0, changed, 5, 10)
    assert as_counter(mined, *cols) == want and want
    none = hard_negatives.mine_hard_negatives(frame(spark, []), F.col("id") % 100 == 0, label)
    assert none.columns == mined.columns and none.isEmpty()
    alone = hard_negatives.mine_hard_negatives(frame(spark, rows[:1]), F.col("id") % 100 == 0, label)
    assert alone.isEmpty()


def test_bounds_hold(small):
    rng = np.random.default_rng(1)
    rows = rng.integers(-300, 300, (500, 8))
    about = {"dim": 8, "norm": float(np.sqrt((rows**2).sum(1)).max()), "stored": "<i2", "rows": 500}
    index = hard_negatives._Index(about, hard_negatives.fit_centroids(rows, 7))
    cell, dist = index.nearest(rows.astype(float))
    for c in range(7):
        inside = cell == c
        below, above = index.sides(rows[:50], c, dist[inside].max())
        scores = rows[:50] @ rows[inside].T
        assert (scores.max(1) <= above).all() and (scores.min(1) >= below).all()


def brute_trie(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append(((t is not None, t or 0), (r or "").encode(), (x or "").encode()))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in by.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = Counter(), Counter(), Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        if p:
            saved[p] += (len(members[p]) - 1) * len(p[-1][1])
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out[min(m), len(p), up, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def odd_turns() -> list[tuple]:
    rng = random.Random(11)
    rows = []
    for c in range(-12, 90):
        for t in range(rng.randrange(0, 12)):
            rows.append((c, t if t else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ä", None, ""])))
    rows += [(200 + i, t, "user", f"same {t}") for i in range(0, 150, 3) for t in range(4)]
    rows += [(1000, t, "user", f"long {t % 7}" * 50) for t in range(900)]
    rows += [(1002, t // 3, "user", "tied" + str(t % 2)) for t in range(60)]
    rows += [(1004, 1, "user", "twice"), (1004, 1, "user", "twice"), (None, 1, "user", "nobody's"), (1006, 5, None, None)]
    return rows


CONV = "conv_id long, turn long, role string, text string, d int, f string, s int, seen int, pid int, q1 string, n int"


@pytest.mark.parametrize("primes", [prefix_trie.PRIMES, (5, 1)])
def test_trie_of_odd_turns(spark, primes):
    """With small primes nearly all groups collide and must be split."""
    rows = [r for r in odd_turns() if primes == prefix_trie.PRIMES or r[0] is None or r[0] < 1000]
    df = spark.createDataFrame([(*r, 1, "f", 2, 3, 4, "q", 5) for r in rows], CONV).repartition(6)
    cols = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert as_counter(prefix_trie.prefix_trie(df, primes), *cols) == brute_trie(rows)


def test_trie_without_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(empty).isEmpty()
    nobody = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(nobody).isEmpty()


def test_running_sums_over_one_long_conversation(spark):
    """A conversation that is spread over all ranges has the sums of one scan."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 30).otherwise(7).alias("conv_id"), F.col("id").alias("d"), (F.col("id") % 13).alias("x")).repartition(9)
    order = [F.col("conv_id"), F.col("d")]
    got = prefix_trie.running_sums(rows, order, order, ["conv_id", "d"], ["x"], "sums").collect()
    sums, want = defaultdict(lambda: [0, 0]), {}
    for r in sorted(rows.collect(), key=lambda r: (r.conv_id, r.d)):
        now = sums[r.conv_id]
        now[0] += 1
        now[1] += r.x
        want[r.conv_id, r.d] = tuple(now)
    assert {(r.conv_id, r.d): (r.seen, r.sum_x) for r in got} == want
