"""Overlap joins of intervals without a key of their own.

An interval has the level of its length: the power of two above it. At any level from its own on it lies in at most two
bins of that width. A pair meets at the higher of its two levels, in the first bin that both lie in, and nowhere else. So
short intervals get narrow bins and long ones wide bins, and an interval is copied at most twice for each higher level
that the other side has, whatever its length. Bins are join keys like others; a crowded one is a skewed key, which
adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level_of(start: Column, end: Column) -> Column:
    """Bits of the length: an interval is shorter than 2 ** level."""
    return F.length(F.bin(end - start))


def overlaps(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """(l, r): structs of the rows whose closed intervals of whole numbers share a point, each pair once. Intervals with a null
    end, or that end before they start, overlap with nothing. Lengths must fit into a long."""

    def placed(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        start, end = (df[f"`{c}`"].cast("bigint") for c in span)
        out = df.where(start <= end).select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(name), start.alias("start"), end.alias("end"))
        return out.withColumn("level", level_of(F.col("start"), F.col("end")))

    l, r = placed(left, left_span, "l"), placed(right, right_span, "r")
    levels = lambda df: sorted(x[0] for x in df.select("level").distinct().collect())  # noqa: E731  at most 64 numbers
    own_l, own_r = levels(l), levels(r)

    def binned(df: DataFrame, own: bool, others: list[int], name: str) -> DataFrame:
        """Rows by the bins of their own level, or of the other side's levels above it."""
        at = F.array("level") if own else F.filter(F.array(*[F.lit(m) for m in others]) if others else F.array().cast("array<int>"), lambda m: m > F.col("level"))
        out = df.select(name, F.col("start").alias(f"{name}s"), F.col("end").alias(f"{name}e"), F.explode(at).alias("m"))
        low, high = (F.expr(f"shiftright({name}{x}, m)") for x in "se")
        return out.withColumn("bin", F.explode(F.sequence(low, high)))

    first = F.greatest(F.expr("shiftright(ls, m)"), F.expr("shiftright(rs, m)")) == F.col("bin")
    met = (F.col("ls") <= F.col("re")) & (F.col("rs") <= F.col("le"))

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, ["m", "bin"]).where(first & met).select("l", "r")

    same = joined(binned(l, True, [], "l"), binned(r, True, [], "r"))
    wider_l = joined(binned(l, True, [], "l"), binned(r, False, own_l, "r"))
    wider_r = joined(binned(l, False, own_r, "l"), binned(r, True, [], "r"))
    return same.unionByName(wider_l).unionByName(wider_r)
