"""Scores of strings and vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """The raw cosine, 0 where a vector is null, empty or zero."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def cosine_clamped(a: Column, b: Column) -> Column:
    """The cosine held in [0, 1], as entity resolution compares embeddings."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(a, b)))


def store_score(raw: Column) -> Column:
    """The score (1 + cosine) / 2 that a vector index reports."""
    return (1 + raw) / 2


def raw_cosine(score: Column) -> Column:
    """The cosine behind an index score, held in [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * score - 1))


def lcs_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, one bit a character."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & where.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str | None, b: str | None) -> float:
    """2 LCS / (m + n); two empty strings are alike, a null is like nothing."""
    if a is None or b is None:
        return 0.0
    n = len(a) + len(b)
    return 2 * lcs_length(a, b) / n if n else 1.0


def token_sort(name: Column) -> Column:
    """The words of a string in order, joined by one space."""
    return F.array_join(F.array_sort(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")), " ")


@pandas_udf(DoubleType())
def indel_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """``indel_ratio`` over Arrow batches."""
    return pd.Series([indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return indel_similarity(token_sort(a), token_sort(b))
