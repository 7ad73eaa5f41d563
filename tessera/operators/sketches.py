"""Sketches that are stored by part of a table and merged later: distinct values, quantiles and frequent items.

A part's sketches have a fixed size whatever its rows. Merging is associative, so days merge into months and months into
years without reading rows again. Estimates come with bounds, which hold with the confidence that is named there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: lg of the registers of a distinct sketch, k of a quantile sketch, items that a frequency sketch tracks.
REGISTERS, RANKS, ITEMS = 14, 1600, 10_000
#: Relative error of six standard deviations at 2 ** 14 registers; rank error of a quantile sketch, more than seven standard
#: deviations at k = 1600. So bounds hold in each of millions of groups, not only in most.
DISTINCT_ERROR, RANK_ERROR = 6 * 1.04 / 128, 0.005


def parts(df: DataFrame, by: list[str], distinct: str, value: str, item: str) -> DataFrame:
    """A row for each group of `by`: n and three sketches, as bytes and a struct. Nulls are in no sketch."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(distinct, REGISTERS).alias("distinct"), F.kll_sketch_agg_double(F.col(value).cast("double"), RANKS).alias("ranks"),
        F.expr(f"approx_top_k_accumulate(`{item}`, {ITEMS})").alias("items"))


def merged(stored: DataFrame, by: list[str]) -> DataFrame:
    """Stored parts made one for each group of fewer columns."""
    return stored.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("ranks").alias("ranks"), F.expr(f"approx_top_k_combine(items, {ITEMS})").alias("items"))


def estimates(stored: DataFrame, by: list[str], at: float = 0.5, k: int = 3) -> DataFrame:
    """Bounds of the distinct count and of the quantile, and the k most frequent items, by count, then item."""
    distinct = F.hll_sketch_estimate("distinct").cast("double")
    quantile = lambda q: F.kll_sketch_get_quantile_double("ranks", F.lit(min(1.0, max(0.0, q))))
    return stored.select(
        *by, "n", F.floor(distinct * (1 - DISTINCT_ERROR)).alias("distinct_low"), F.ceil(distinct * (1 + DISTINCT_ERROR)).alias("distinct_high"),
        quantile(at - RANK_ERROR).alias("quantile_low"), quantile(at + RANK_ERROR).alias("quantile_high"), F.expr(f"approx_top_k_estimate(items, {k})").alias("frequent"))
