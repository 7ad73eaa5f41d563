"""Nested values of unknown shape: documents parsed once into variants and walked a level at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph

#: Levels of nesting that are walked; what is deeper is an error.
DEPTH = 64


def nodes(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, type, value) of every value in the documents, the document itself at `$`; objects' members by name in the
    order of names, arrays' by number. Texts that are no JSON have no rows. `value` is a variant. Objects and arrays are
    stored by level, whatever their number; what they hold is read off them, so plain values are stored nowhere."""
    spark = df.sparkSession
    typed = lambda level: level.select("key", "path", F.regexp_replace(F.schema_of_variant("value"), "<.*", "").alias("type"), "value")
    levels = [typed(df.select(F.col(key).alias("key"), F.lit("$").alias("path"), F.try_parse_json(json).alias("value")).where("value IS NOT NULL"))]
    for _ in range(DEPTH + 1):
        holders = graph.cut(levels[-1].where("type IN ('OBJECT', 'ARRAY')"))
        if holders.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        held = spark.sql("SELECT h.key, h.path || CASE WHEN e.key IS NULL THEN '[' || e.pos || ']' ELSE '.' || e.key END AS path, e.value FROM {holders} h, LATERAL variant_explode(h.value) AS e", holders=holders)
        levels.append(typed(held))
    raise RuntimeError(f"values are nested deeper than {DEPTH} levels")


def shapes(df: DataFrame, key: str, json: str) -> DataFrame:
    """(path, type, n) with the numbers of arrays' members left out: what documents look like, and how often."""
    path = F.regexp_replace("path", r"\[\d+\]", "[*]")
    return nodes(df, key, json).groupBy(path.alias("path"), "type").agg(F.count("*").alias("n"))


def locked(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, name, version) of packages in lock files of nested dependencies, at any depth: an object with a `version`, named by
    the last step of its path."""
    found = nodes(df, key, json).where("type = 'OBJECT'").withColumn("version", F.try_variant_get("value", "$.version", "string")).where("version IS NOT NULL AND path <> '$'")
    name = F.regexp_extract("path", r"(?:\.dependencies\.|\.packages\.(?:.*node_modules/)?)([^$]+?)$", 1)
    return found.select("key", F.element_at(F.split(name, r"\.dependencies\."), -1).alias("name"), "version").where("name <> ''").distinct()
