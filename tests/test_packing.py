"""Packing over pieces against packing row by row."""

import random
from collections import defaultdict

import pytest

from lorekeeper.operators import batching


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    return [(rng.choice(["hot", "hot", "hot", "b", None, "c"]), i, rng.choice([1, 2, 5, 9, 30, 0]), "x") for i in range(2000)]


def brute(rows, max_inputs, max_tokens):
    by, out = defaultdict(list), set()
    for g, k, n, _ in sorted(rows, key=lambda r: r[1]):
        by[g].append((k, n))
    for g, members in by.items():
        batch = count = used = 0
        for k, n in members:
            if count and (count + 1 > max_inputs or used + n > max_tokens):
                batch, count, used = batch + 1, 0, 0
            out.add((g, k, batch))
            count, used = count + 1, used + n
    return out


@pytest.mark.parametrize("limits", [(4, 12), (1, 100), (50, 20), (1000, 10_000)])
def test_packed_batches(spark, rows, limits):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "g string, k long, n int, other string").repartition(5)
        packed = batching.pack_batches(df, ["g"], "k", "n", *limits)
        assert packed.columns == [*df.columns, "batch"]
        assert {(r.g, r.k, r.batch) for r in packed.collect()} == brute(rows, *limits)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_packing_of_nothing(spark, rows):
    df = spark.createDataFrame(rows[:1], "g string, k long, n int, other string")
    assert batching.pack_batches(df.where("false"), ["g"], "k", "n").isEmpty()
    assert [r.batch for r in batching.pack_batches(df, ["g"], "k", "n").collect()] == [0]
