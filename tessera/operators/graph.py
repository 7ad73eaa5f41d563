"""Closures over edge tables (src, dst), in rounds of joins whose frontier shrinks; nothing but counts reaches the driver.

The lineage is cut each round by checkpoint() where the session names a folder for it.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. A temporary one only where none is set and all runs on one machine."""
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage as `cut` does, and also where a plan can't be checkpointed because its
    partitioning names columns that its optimised form no longer has."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def reachable(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(src, dst): dst can be reached from src by one edge or more. Grows as the reachable pairs."""
    e = cut(edges.select("src", "dst").distinct())
    seen = frontier = e
    for _ in range(most_rounds):
        step = frontier.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst")).distinct()
        frontier = cut(step.join(seen, ["src", "dst"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))
    raise RuntimeError("the closure did not settle")


def closure_from(start: DataFrame, edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node): everything that the start nodes reach, themselves included; a breadth-first search."""
    e = edges.select("src", "dst").distinct()
    seen = frontier = cut(start.select("node").distinct())
    for _ in range(most_rounds):
        step = frontier.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))
    raise RuntimeError("the closure did not settle")


def blast_radius(changed: DataFrame, calls: DataFrame) -> DataFrame:
    """(node): callers, direct or not, of what changed, without what changed."""
    back = calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure_from(changed, back).join(changed.select("node"), "node", "left_anti")


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges that may lie on a cycle: again and again without those whose start nothing enters or whose end nothing
    leaves."""
    n = None
    while True:
        there = edges.count()
        if there == n or not there:
            return edges
        n = there
        entered, left = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = cut(edges.join(entered, "src", "left_semi").join(left, "dst", "left_semi").select("src", "dst"))


def cycles(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(node, component, size): nodes of strongly connected components of more than one; a component is named by its
    smallest node.

    Every node gets the smallest node that reaches it as its colour. Those of a colour that reach the node that names it
    are its component; they go, and what is left is trimmed and coloured again. Tables stay linear in the edges."""
    spark, parts = edges.sparkSession, []
    left = trimmed(cut(edges.select("src", "dst").where("src <> dst").distinct()))
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        colours = cut(left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct().withColumn("colour", F.col("node")))
        while True:
            offered = left.join(colours, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("at")).agg(F.min("colour").alias("offer"))
            least = F.least("colour", F.coalesce("offer", "colour"))
            now = cut(colours.join(offered, F.col("node") == F.col("at"), "left").select("node", least.alias("colour"), (least < F.col("colour")).alias("moved")))
            colours = now.select("node", "colour")
            if now.where("moved").isEmpty():
                break
        of = lambda end: colours.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))  # noqa: E731, B023
        inside = cut(left.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour").select("src", "dst"))
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = cut(closure_from(colours.where("node = colour"), back).join(colours, "node"))
        parts.append(found.select("node", F.col("colour").alias("component")))
        gone = found.select("node")
        left = trimmed(cut(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")))
    else:
        raise RuntimeError("the components did not settle")
    if not parts:
        return spark.createDataFrame([], f"node {edges.schema['src'].dataType.simpleString()}, component {edges.schema['src'].dataType.simpleString()}, size bigint")
    named = reduce(DataFrame.unionByName, parts)
    return named.join(named.groupBy("component").agg(F.count("*").alias("size")).where("size > 1"), "component").select("node", "component", "size")


def call_edges(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """Calls (caller, callee) of names that are defined."""
    return calls.join(defs.select(F.col("name").alias("callee")).distinct(), "callee", "left_semi").select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()


def unresolved(calls: DataFrame, defs: DataFrame) -> DataFrame:
    return calls.join(defs.select(F.col("name").alias("callee")), "callee", "left_anti").select("callee").distinct()


#: Names that a runtime calls, beginnings of such names, files whose exports a framework calls, and its hooks.
ENTRY, ENTRY_STARTS = ("main", "init"), ("Test", "Benchmark", "Example", "Fuzz")
FRAMEWORK_FILES = (
    "page.tsx", "page.jsx", "page.ts", "page.js", "route.ts", "route.js", "layout.tsx", "layout.jsx", "middleware.ts", "middleware.js", "+page.svelte", "+server.ts",
)
HOOKS = ("getServerSideProps", "getStaticProps", "getStaticPaths", "generateMetadata", "generateStaticParams", "generateViewport")


def is_entry(name: Column, path: Column) -> Column:
    """Whether a test runner, a runtime or a framework calls a definition, so that nothing in the project need."""
    low = F.lower(path)
    base = F.regexp_extract(low, r"([^/]*)$", 1)
    test = low.rlike(r"_test\.go$|/test|__tests__|\.test\.|\.spec\.") | base.startswith("test_")
    framework = base.isin(*FRAMEWORK_FILES) | base.rlike(r"\.config\.(?:ts|js|mjs)$") | name.isin(*HOOKS)
    started = name.isin(*ENTRY)
    for s in ENTRY_STARTS:
        started = started | name.startswith(s)
    return test | framework | started


def unreachable(defs: DataFrame, calls: DataFrame) -> DataFrame:
    """Defined functions that nothing calls, without entry points, names defined twice and those that dispatch may call."""
    twice = defs.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    own = calls.where("caller <> callee").select(F.col("callee").alias("name")).distinct()
    alone = defs.where("NOT entry AND NOT dispatched")
    return alone.join(own, "name", "left_anti").join(twice, "name", "left_anti").select("name", "path")


def diff_scope(changed: DataFrame, defs: DataFrame, calls: DataFrame) -> DataFrame:
    """(name, role): the functions that changed files (path) define, and all that call them, directly or not."""
    centre = defs.join(changed.select("path").distinct(), "path", "left_semi").select(F.col("name").alias("node")).distinct()
    reached = blast_radius(centre, call_edges(calls, defs))
    return centre.select(F.col("node").alias("name"), F.lit("changed").alias("role")).unionByName(reached.select(F.col("node").alias("name"), F.lit("affected").alias("role")).where("name <> ''"))


def mermaid(edges: DataFrame, most: int = 20_000) -> DataFrame:
    """One row: the graph as a Mermaid text, edges in order. A picture of more than `most` edges is none, which raises."""
    line = F.concat(F.lit('  "'), F.col("src"), F.lit('" --> "'), F.col("dst"), F.lit('"'))
    few = edges.select("src", "dst").distinct().limit(most + 1)
    text = F.array_join(F.concat(F.array(F.lit("graph LR")), F.sort_array(F.collect_list(line))), "\n")
    return few.agg(F.when(F.count("*") > most, F.raise_error(F.lit(f"more than {most} edges"))).otherwise(text).alias("diagram"))
