"""A similarity join of strings by Indel ratio, from signatures that lose no pair.

The ratio of strings of lengths m and n is ``2 L / (m + n)``, where L is the length of
their longest common subsequence.  A ratio of ``t`` or more needs ``L >= t (m + n) / 2``,
and as ``L <= min(m, n)`` the longer is at most ``(2 - t) / t`` times as long.

Of the grams of q characters of the first string, ``m - q + 1``, each of the ``m - L``
characters that are left out breaks at most q, and each of the ``n - L`` that are put in at
most q - 1 of those that remain.  So both strings share, counting repeats, at least

    o = (2q - 1) L - (q - 1) (m + n) - (q - 1)

grams.  In any order of grams that both keep, two bags that share ``o`` share one of the
first ``m - q + 1 - o + 1`` of the one and of the first ``n - q + 1 - o + 1`` of the other:
otherwise one of them would have to find all ``o`` among its last ``o - 1``.  Which q is
used depends on the two lengths alone.

Short strings have few grams, which most others share.  Two strings have a common
subsequence of length L exactly if some L characters of the one, in order, are some of the
other; where neither length has more than ``CHOICES`` such choices, these are the keys.

A string therefore has a key for each length that a
partner can have and each gram of its prefix for it; two strings whose ratio reaches ``t``
share a key, and only those that share one are compared.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import indel_similarity
from ..storage import materialise
from .grouping import shuffled

#: Gram counts are kept for so many hashes: rare grams come first in prefixes.
GRAM_BUCKETS = 1 << 16
#: Subsequences are keys where a string has at most so many of the length that both must share.
CHOICES = 64
_EDGE = 1e-9


def _common(m: int, n: int, least: float) -> int:
    """The least length of a common subsequence with which strings of these lengths reach the ratio."""
    return math.ceil((least - _EDGE) * (m + n) / 2)


def _overlap(m: int, n: int, q: int, least: float) -> int:
    common = _common(m, n, least)
    return (2 * q - 1) * common - (q - 1) * (m + n) - (q - 1)


def _q(m: int, n: int, least: float) -> int:
    """The longest grams of which at least two must be shared; single characters otherwise."""
    return next((q for q in (3, 2) if _overlap(m, n, q, least) >= 2), 1)


def _bucket(gram: str) -> int:
    value = 0
    for c in gram:
        value = (value * 1_000_003 + ord(c)) % 2_147_483_647
    return value % GRAM_BUCKETS


def signature(name: str, least: float, counts: np.ndarray) -> list[str]:
    """The keys of a string: lengths of both strings, and a gram of the prefix with its place among equal ones."""
    m = len(name)
    if not m:
        return ["empty"]
    keys, ordered, chosen = [], {}, {}
    for n in range(math.ceil(m * (least - _EDGE) / (2 - least + _EDGE)), math.floor(m * (2 - least + _EDGE) / (least - _EDGE)) + 1):
        common = _common(m, n, least)
        if n >= 1 and max(math.comb(m, common), math.comb(n, common)) <= CHOICES:
            if common not in chosen:
                chosen[common] = {"".join(c) for c in combinations(name, common)}
            keys += [f"{min(m, n)}|{max(m, n)}|{c}" for c in sorted(chosen[common])]
            continue
        q = _q(m, n, least)
        if n < 1 or m < q:
            continue
        if q not in ordered:
            seen, grams = Counter(), []
            for i in range(m - q + 1):
                gram = name[i : i + q]
                grams.append((int(counts[_bucket(gram)]), gram, seen[gram]))
                seen[gram] += 1
            ordered[q] = sorted(grams)
        first = m - q + 1 - max(_overlap(m, n, q, least), 1) + 1
        keys += [f"{min(m, n)}|{max(m, n)}|{gram}|{k}" for _, gram, k in ordered[q][: max(first, 0)]]
    return keys


def _gram_counts(names: DataFrame) -> np.ndarray:
    """How often the grams of each bucket occur: at most ``GRAM_BUCKETS`` rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(GRAM_BUCKETS, dtype=np.int64)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                for q in (1, 2, 3):
                    for i in range(len(name) - q + 1):
                        found[_bucket(name[i : i + q])] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at])], ["bucket", "n"])

    counts = np.zeros(GRAM_BUCKETS, dtype=np.int64)
    for r in names.select("name").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def similar_names(left: DataFrame, right: DataFrame, block: list[str], least: float) -> DataFrame:
    """The columns of ``block``, left_name, right_name and score: all pairs of a block whose ratio is ``least`` or more.

    Both sides have the columns of ``block`` and ``name``; equal names of a block count
    once, null names are like nothing, and two empty names are alike.  The score is rounded to 9 digits.
    """
    if not 0 < least <= 1:
        raise ValueError("the least ratio lies above 0 and is 1 at most")
    named = [df.where(F.col("name").isNotNull()).select(*block, "name").distinct() for df in (left, right)]
    # Only names of blocks that both sides have can meet.
    sides = [materialise(named[0].join(named[1].select(*block).distinct(), block, "left_semi"), "names")]
    sides.append(materialise(named[1].join(sides[0].select(*block).distinct(), block, "left_semi"), "names"))
    counts = _gram_counts(sides[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [signature(name, least, counts) for name in batch.column("name").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.string()))], [*batch.schema.names, "keys"])

    kinds = dict(sides[0].dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in block], "name string, keys array<string>"])
    a, b = (side.mapInArrow(run, schema).select(*block, F.col("name").alias(f"{s}_name"), F.explode("keys").alias("key")) for s, side in zip(("left", "right"), sides, strict=True))
    pairs = a.join(shuffled(b), [*block, "key"]).select(*block, "left_name", "right_name").distinct()
    scored = pairs.withColumn("score", F.round(indel_similarity("left_name", "right_name"), 9))
    return scored.where(F.col("score") >= least)
