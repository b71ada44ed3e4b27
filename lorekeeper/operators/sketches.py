"""Run counters as mergeable sketches: distinct ids and quantiles, stored a run and merged over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of the distinct counts (an error of about 1.04 / sqrt(2^n)), and the size of quantile sketches.
LG_REGISTERS, QUANTILE_SIZE = 14, 400
#: The error that holds for nearly all counts: three standard errors.
COUNT_ERROR = 3 * 1.04 / 2 ** (LG_REGISTERS / 2)
#: The error of a quantile's rank at that size, with 99 % confidence.
RANK_ERROR = 0.01


def run_sketches(rows: DataFrame, run: list[str], key: str, value: Column | None = None) -> DataFrame:
    """One row a run: n, and sketches of the distinct ``key`` and, with ``value``, of its quantiles.

    Both are aggregated in each task before the shuffle and have a bounded size whatever a
    run holds.  Null keys and values count nothing.
    """
    aggs = [F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.col(key), LG_REGISTERS).alias("keys")]
    if value is not None:
        aggs.append(F.kll_sketch_agg_double(value.cast("double"), QUANTILE_SIZE).alias("values"))
    return rows.groupBy(*run).agg(*aggs)


def merge_sketches(runs: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of several runs as one row a group; no row of any run is read again."""
    aggs = [F.sum("n").alias("n"), F.hll_union_agg("keys").alias("keys")]
    if "values" in runs.columns:
        aggs.append(F.kll_merge_agg_double("values").alias("values"))
    return runs.groupBy(*by).agg(*aggs)


def estimates(runs: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """n, n_distinct and, if there are values, ``q50`` and the like, in place of the sketches."""
    out = runs.withColumn("n_distinct", F.hll_sketch_estimate("keys")).drop("keys")
    if "values" in runs.columns:
        out = out.withColumns({f"q{round(q * 100)}": F.kll_sketch_get_quantile_double("values", F.lit(q)) for q in quantiles}).drop("values")
    return out
