"""Text and vector indexes, tiled neighbours and the fuzzy join, against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeeper.functions.similarity import indel_ratio
from lorekeeper.operators import fuzzy, neighbors, search, text_index

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu") for b in ("ra", "te", "si", "zo", "pu")] + ["x", "ähre", "the"]


def texts(n: int, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(WORDS, weights=[1 + j % 7 for j in range(len(WORDS))], k=rng.randrange(0, 30))) + "!") for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "the " * 500), (None, "the nobody")]


def brute_bm25(rows, queries, k):
    tokens = {i: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if len(w) >= 2] for i, t in rows if i is not None}
    mean = sum(map(len, tokens.values())) / len(tokens)
    out = {}
    for q, text in queries:
        words = {w for w in re.split(r"[^\w]+|_", (text or "").lower()) if len(w) >= 2}
        df = {w: sum(w in t for t in tokens.values()) for w in words}
        scores = []
        for i, t in tokens.items():
            s = sum(math.log(1 + (len(tokens) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in words if w in t)
            if any(w in t for w in words):
                scores.append((-round(s, 9), i))
        out |= {(q, r): (i, pytest.approx(-s, abs=2e-9)) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return out


QUERIES = [(0, "the kara"), (1, "Loste lo-te MISI"), (2, "nothing here"), (3, ""), (4, None), (5, "x ? c"), (6, "ähre the the zo"), (7, "nupu nute nusi nuzo nura kapu")]


def found(index, spark, k):
    rows = text_index.text_search_all(index, spark.createDataFrame(QUERIES, "query_id long, text string"), k).collect()
    return {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in rows}


def test_text_index(spark):
    rows = texts(300)
    docs = spark.createDataFrame(rows, "id long, text string").repartition(5)
    index = text_index.build_text_index(docs, buckets=4, block=16)
    assert index.postings.agg(F.max(F.size("ids"))).first()[0] < 64
    for k in (1, 3, 50):
        assert found(index, spark, k) == brute_bm25(rows, QUERIES, k)
    one = text_index.text_search_indexed(index, "the kara", 5).collect()
    assert [r["id"] for r in one] == [r["id"] for r in search.text_search(docs, "the kara", 5).where("id is not null").collect()]


def test_text_index_merge_replaces_and_adds(spark):
    first, second = texts(120), [(i, t) for i, t in texts(200, 2) if i is None or i >= 60]
    schema = "id long, text string"
    index = text_index.build_text_index(spark.createDataFrame(first, schema), buckets=4, block=16)
    gone = spark.createDataFrame([(3,), (5,)], "id long")
    merged = text_index.merge_text_index(index, spark.createDataFrame(second, schema), block=16, gone=gone)
    rows = {i: t for i, t in first if i is not None and i not in (3, 5)} | {i: t for i, t in second if i is not None}
    assert found(merged, spark, 4) == brute_bm25(list(rows.items()), QUERIES, 4)


def test_text_index_of_nothing(spark):
    index = text_index.build_text_index(spark.createDataFrame([], "id long, text string"))
    assert found(index, spark, 3) == {}


def test_text_search_without_terms(spark):
    docs = spark.createDataFrame(texts(5), "id long, text string")
    for query in ("?", "", "c"):
        assert search.text_search(docs, query, 3).collect() == []


def vectors(n: int = 150) -> list[tuple]:
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(6)]
    rows = [(f"v{i:03}", "a" if i % 3 else "b", [x + rng.gauss(0, 0.2) for x in centres[i % 6]]) for i in range(n)]
    return [*rows, ("w0", "a", None), ("w1", "a", []), ("w2", "b", [0.0] * 5), ("w3", None, [1.0] * 5), ("w4", None, [1.0, 2.0, 1.0, 1.0, 1.0]), ("w5", "a", centres[1]), ("w6", "a", centres[1]), ("w7", "a", [1.0, 2.0])]


def cosine(a, b):
    if not a or not b or len(a) != len(b):
        return 0.0
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / size, 9) if size else 0.0


def test_nearest_in_tiles(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "id string, kind string, embedding array<double>").repartition(4)
    got = {(r["left_id"], r["rank"]): (r["right_id"], r["score"]) for r in neighbors.nearest_in_tiles(df, df, ["kind"], 4, tile=8).collect()}
    want = {}
    for i, kind, v in rows:
        best = sorted((-cosine(v, w), j) for j, other, w in rows if other == kind)[:4]
        want |= {(i, r): (j, pytest.approx(-s, abs=1e-9)) for r, (s, j) in enumerate(best, 1)}
    assert got == want
    pairs = {(r["left_id"], r["right_id"]) for r in neighbors.nearest_in_tiles(df, df, ["kind"], least=0.9, clamp=True, tile=8).collect()}
    assert pairs == {(i, j) for i, a, v in rows for j, b, w in rows if a == b and cosine(v, w) >= 0.9}
    assert neighbors.nearest_in_tiles(df, df.where("false"), ["kind"], 4).isEmpty()


def test_vector_index_finds_most_and_with_all_cells_all(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8))
    rows = [(i, (centres[i % 40] + rng.normal(size=8) * 0.4).tolist(), i % 4) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    queries = df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = neighbors.build_vector_index(df, "vec_id", ["label"], cells=32, sample=500)
    assert index.rows.count() == 1500
    exact = {(r["query_id"], r["vec_id"]) for r in search.vector_search_all(df, queries, 10, id_col="vec_id").collect()}
    near = {(r["query_id"], r["vec_id"]) for r in neighbors.vector_search_probed(index, queries, 10, probes=10).collect()}
    assert len(near & exact) >= 0.9 * len(exact)
    every = neighbors.vector_search_probed(index, queries, 10, probes=32).collect()
    assert {(r["query_id"], r["vec_id"]) for r in every} == exact
    some = neighbors.vector_search_probed(index, queries, 10, F.col("label") == 2, 32).collect()
    assert {(r["query_id"], r["vec_id"]) for r in some} == {(r["query_id"], r["vec_id"]) for r in search.vector_search_all(df, queries, 10, F.col("label") == 2, "vec_id").collect()}


@pytest.mark.parametrize("least", [0.4, 0.7, 0.85, 0.95, 1.0])
def test_similar_names_loses_no_pair(spark, least):
    rng = random.Random(8)
    names = {"", "a", "ab", "ba", "aaaaaaaa", "aaaaaaa"}
    for _ in range(60):
        name = "".join(rng.choices("abcdeéf ", k=rng.randrange(1, 22)))
        names.add(name)
        for _ in range(3):
            at = rng.randrange(len(name) + 1)
            names.add(name[:at] + rng.choice(["", "x", "a"]) + name[at + rng.randrange(2) :])
    rows = [(n, "t", i % 2) for i, n in enumerate(sorted(names))] + [(None, "t", 1), ("abc", "other", 0)]
    df = spark.createDataFrame(rows, "name string, user string, half int")
    got = {(r["user"], r["left_name"], r["right_name"]): r["score"] for r in fuzzy.similar_names(df.where("half = 0"), df, ["user"], least).collect()}
    want = {}
    for a, u, half in rows:
        for b, w, _ in rows:
            if half == 0 and u == w and None not in (a, b) and round(indel_ratio(a, b), 9) >= least:
                want[u, a, b] = pytest.approx(indel_ratio(a, b), abs=1e-9)
    assert got == want


def test_signatures_leave_out_nearly_all_pairs():
    """Of random names fewer than one pair in fifty shares a key."""
    rng, counts = random.Random(1), np.zeros(fuzzy.GRAM_BUCKETS, dtype=np.int64)
    names = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=rng.randrange(6, 24))) for _ in range(500)]
    keys = [set(fuzzy.signature(n, 0.85, counts)) for n in names]
    met = sum(not keys[i].isdisjoint(keys[j]) for i in range(len(names)) for j in range(i))
    assert met < len(names) ** 2 / 2 / 50


def test_vector_index_is_reconciled(spark):
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0], i % 2) for i in range(30)], "id long, embedding array<double>, label int")
    index, made = neighbors.reconcile_vector_index(None, rows, 2, keep=["label"], cells=3)
    assert made and index.definition() == {"dimension": 2, "cells": 3, "filters": ["label"]}
    assert neighbors.reconcile_vector_index(index, rows, 2, keep=["label"], cells=3) == (index, False)
    other, made = neighbors.reconcile_vector_index(index, rows, 2, cells=3)
    assert made and other.definition()["filters"] == []
    with pytest.raises(ValueError, match="not 3"):
        neighbors.reconcile_vector_index(index, rows, 3)


def test_tables_written_once_and_deleted(spark):
    from lorekeeper.storage import delete_tables, materialise, written_once

    made = []

    def make():
        made.append(1)
        return spark.range(5)

    assert written_once(spark, "five", make).count() == written_once(spark, "five", make).count() == 5 and len(made) == 1
    materialise(spark.range(2), "two")
    assert delete_tables(spark) and not delete_tables(spark)
    assert written_once(spark, "five", make).count() == 5 and len(made) == 2
