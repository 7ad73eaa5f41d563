"""Connected components of an edge table, in rounds of joins; nothing of it reaches the driver but counts.

Each round (large-star and small-star, Kiveris et al. 2014) hangs every node's neighbours on the smallest label around it;
tables stay linear in the edges. A node with very many neighbours is one group only in a minimum, which Spark combines
before the shuffle; in the join that hands the minimum out, a node's edges are dealt to SALTS tasks by their other end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dropped, written

SALTS = 8


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b), a > b. large: each node's larger neighbours go to the smallest of the node and its neighbours;
    otherwise its smaller neighbours and itself do."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    dealt = (both.where("b > a") if large else both).withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    told = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hung = dealt.join(told, ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        hung = hung.unionByName(least.select("a", F.col("m").alias("b")))
    return hung.where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node that has an edge to another; both ids bigint."""
    pairs = edges.select(F.col(a).cast("bigint").alias("x"), F.col(b).cast("bigint").alias("y")).where("x <> y")
    now = written(pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        before, now = now, written(star(star(now, True), False), "edges")
        dropped(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
