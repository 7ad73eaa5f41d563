"""Sinks: SARIF 2.1.0, record stores, marked blocks in documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rank and level of a severity, from information to critical.
RANKS, LEVELS = (10, 25, 55, 85, 100), ("note", "note", "warning", "error", "error")


def sarif_rows(findings: DataFrame) -> DataFrame:
    """One result a row, worst first, ties in the order of files and lines."""
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("severity") + 1)
    out = findings.select("rule", "severity", "path", "line_no", pick(LEVELS).alias("level"), pick(RANKS).alias("rank"))
    return out.orderBy(F.desc("severity"), "path", "line_no", "rule")


def sarif_lines(findings: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Each result as JSON, beside some columns to order by; a writer puts the head and the foot around them, so no task holds
    them all."""
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_no").alias("startLine")).alias("region")).alias("physicalLocation")))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("severity") + 1)
    told = findings.withColumns({"level": pick(LEVELS), "rank": pick(RANKS)}) if keep else sarif_rows(findings)
    return told.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), "level", "rank", F.struct(F.col("rule").alias("text")).alias("message"), place.alias("locations"))).alias("value"), *(keep or []))


def append_record(spark: SparkSession, root: str, namespace: str, name: str, body: str) -> None:
    spark.createDataFrame([(name, body)], "name string, body string").withColumn("written_at", F.current_timestamp()).write.mode("append").json(f"{root}/{namespace}")


def read_records(spark: SparkSession, root: str, namespace: str) -> DataFrame:
    """The last body of each name; of those of one moment the greatest."""
    raw = spark.read.schema("name string, body string, written_at timestamp").json(f"{root}/{namespace}")
    return raw.groupBy("name").agg(F.max_by("body", F.struct("written_at", "body")).alias("body")).orderBy("name")


def next_id(spark: SparkSession, root: str, namespace: str, prefix: str) -> str:
    """The number after the last record's. Two writers at a time would get one number: they use append_records of committed."""
    top = read_records(spark, root, namespace).agg(F.max(F.regexp_extract("name", rf"^{prefix}-(\d+)$", 1).try_cast("int"))).first()[0]
    return f"{prefix}-{(top or 0) + 1:04d}"


def marked_block(document: str, name: str, body: str) -> tuple[str, str]:
    """The document with the named block created or replaced, and what was done to it."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    block = f"{start}\n{body.strip()}\n{end}"
    found = re.search(re.escape(start) + ".*?" + re.escape(end), document, re.S)
    if not found:
        return (document.rstrip("\n") + "\n\n" if document.strip() else "") + block + "\n", "created"
    return (document, "unchanged") if found[0] == block else (document[: found.start()] + block + document[found.end() :], "updated")
