"""Ranking by cosine with a bonus for shared words; the best k come from a bounded heap in each task. Running totals within groups
of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import graph


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def nearest(vectors: DataFrame, query: list[float], k: int = 6, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, cosine(F.col(vector_col), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def keyword_bonus(query: Column, text: Column, each: float = 0.1) -> Column:
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2))
    return each * F.size(F.array_intersect(words(query), words(text)))


def router(capabilities: DataFrame, query: str, k: int = 6) -> DataFrame:
    """Capabilities (id, when_to_use) by the words that they share with a wish."""
    score = keyword_bonus(F.lit(query), F.concat_ws(" ", "id", "when_to_use"))
    return capabilities.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def running(df: DataFrame, by: list[str], order: list[Column], weight: Column | None = None) -> DataFrame:
    """df with `before`: the weight (1 if none is given) of the rows of its group that come earlier. Ranges of (by, order) are
    summed by themselves, so no task holds a group; what is summed over all of a group is a row for each of its ranges."""
    w = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    ranged = graph.cut(df.withColumn("weight", w).repartitionByRange(*[F.col(c) for c in by], *order).withColumn("range", F.spark_partition_id()))
    total = lambda c, window: F.coalesce(F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranged.groupBy(*by, "range").agg(F.sum("weight").alias("sum"))
    earlier = ranges.select(*by, "range", total("sum", Window.partitionBy(*by).orderBy("range")).alias("earlier")).alias("e")
    within = ranged.withColumn("within", total("weight", Window.partitionBy(*by, "range").orderBy(*order))).alias("w")
    same = F.col("w.range") == F.col("e.range")
    for c in by:
        same = same & F.col(f"w.{c}").eqNullSafe(F.col(f"e.{c}"))
    return within.join(earlier, same).select(*[f"w.{c}" for c in df.columns], (F.col("within") + F.col("earlier")).alias("before"))


def percentiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """by and a column for each share of `at`: the exact percentile, between its two neighbours in proportion. Equal values are one
    with their number, and values are placed by `running`, so no task holds a group's. Groups without a value are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    placed = running(counts, by, [F.asc("value")], F.col("n")).alias("p")
    totals = df.groupBy(*by).agg(F.count(value).alias("total")).alias("t")
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"t.{c}"))
    holds = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("n"))
    position = lambda share: (F.col("total") - 1) * F.lit(float(share))
    low, high = (lambda share: F.floor(position(share))), (lambda share: F.ceil(position(share)))
    needed = F.lit(False)
    for share in at.values():
        needed = needed | holds(low(share)) | holds(high(share))
    found = placed.join(totals, same).where(needed).select(*[f"p.{c}" for c in by], "value", "n", "before", "total")

    def read(share: float) -> Column:
        below, above = (F.max(F.when(holds(place(share)), F.col("value").cast("double"))) for place in (low, high))
        part = F.max(position(share))
        return F.when(below == above, below).otherwise((F.ceil(part) - part) * below + (part - F.floor(part)) * above)

    return found.groupBy(*by).agg(*[read(share).alias(name) for name, share in at.items()])
