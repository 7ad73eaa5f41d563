"""Longest runs of path segments that name a module: a trie as a table of edges, walked a level a join.

Every place in a target starts a walk at the root. A level joins the walks that go on with the trie's edges by (node,
segment), so rows stay linear in the segments of the targets, and walks that find no edge are gone. A walk carries no more
segments than the deepest module has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import cut

#: Fixed value: what parts the segments of a target.
SEPARATORS = r"""[/.:\\ {};"'<>]"""


def segments(target: Column, separators: str = SEPARATORS) -> Column:
    return F.filter(F.transform(F.split(target, separators), F.trim), lambda s: s != "")


def trie(modules: DataFrame) -> DataFrame:
    """(node, segment, child, ends) from (module): nodes are named by the path to them, `ends` says that a module ends in child."""
    parts = F.split("module", "/")
    paths = modules.where("module <> ''").select("module").distinct().select("module", parts.alias("parts"), F.posexplode(parts).alias("i", "segment"))
    upto = lambda n: F.array_join(F.slice("parts", 1, n), "/")
    edges = paths.select(upto(F.col("i")).alias("node"), "segment", upto(F.col("i") + 1).alias("child"), (F.col("i") + 1 == F.size("parts")).alias("ends"))
    return edges.groupBy("node", "segment", "child").agg(F.bool_or("ends").alias("ends"))


def resolve(targets: DataFrame, modules: DataFrame, separators: str = SEPARATORS) -> DataFrame:
    """(target, module), each distinct target once: the module that its longest run of segments names, the earliest of equal
    runs; a target of one segment that names none takes the only module that ends in it. Other targets are left out."""
    edges = cut(trie(modules))
    depth = edges.agg(F.max(F.size(F.split("child", "/")))).first()[0] or 0
    parts = cut(targets.select("target").distinct().select("target", segments(F.col("target"), separators).alias("parts")).where(F.size("parts") > 0))
    walks = parts.select("target", F.posexplode("parts").alias("start", "_"), "parts").select("target", "start", F.lit("").alias("node"), F.slice("parts", F.col("start") + 1, depth or 1).alias("rest"))
    met = None
    for level in range(1, depth + 1):
        on = walks.where(F.size("rest") > 0).withColumns({"segment": F.element_at("rest", 1), "rest": F.expr("slice(rest, 2, size(rest))")})
        walks = cut(on.join(edges, ["node", "segment"]).select("target", "start", F.col("child").alias("node"), "rest", "ends"))
        if walks.isEmpty():
            break
        hits = walks.where("ends").select("target", "start", F.lit(level).alias("n"), F.col("node").alias("module"))
        met = hits if met is None else met.unionByName(hits)
        walks = walks.drop("ends")
    single = parts.where(F.size("parts") == 1).select("target", F.col("parts")[0].alias("last"))
    if met is None:
        return by_last(single, modules)
    best = met.groupBy("target").agg(F.max_by("module", F.struct("n", -F.col("start"))).alias("module"))
    return best.unionByName(by_last(single.join(best, "target", "left_anti"), modules))


def by_last(single: DataFrame, modules: DataFrame) -> DataFrame:
    last = F.element_at(F.split("module", "/"), -1)
    unique = modules.where("module <> ''").select("module").distinct().groupBy(last.alias("last")).agg(F.count("*").alias("n"), F.first("module").alias("module")).where("n = 1")
    return single.join(unique, "last").select("target", "module")
