"""Verdicts over what the rules find in the given documents: buckets, categories, axes of a delivery, usages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import codeintel, gate, scan
from tessera.plans import oracle
from tessera.plans.queries import PLAIN, doc_files, doc_findings, query
from tessera.sources import files as src

#: The analyses whose rules apply to plain documents.
ANALYSES = tuple(dict.fromkeys(r.cap for r in PLAIN))
_CHECKS = """, checks AS (SELECT id, CASE WHEN (SELECT count(*) FROM documents) = 0 THEN 'skipped' ELSE 'ran' END AS state
  FROM (VALUES ('security.scan/secret'), ('security.scan/pii'), ('quality.check/smell')) v(id))"""
_AXES = oracle.FINDINGS.rstrip() + _CHECKS + ", " + oracle.AXES.replace("FROM found WHERE verified AND", "FROM found WHERE")


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_findings(spark, sf_dir).withColumn("verified", F.lit(True))


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, state) of the analyses as the scan itself states it."""
    return scan.summary(doc_findings(spark, sf_dir), doc_files(spark, sf_dir), list(ANALYSES)).select(F.col("cap").alias("id"), "state")


@query(oracle.FINDINGS + """SELECT rule, severity, CASE WHEN severity >= 3 THEN 'blocking' WHEN rule NOT IN ('debt-marker', 'ssn-us', 'panic-path', 'credit-card', 'email-literal') THEN 'warning' ELSE 'advisory' END AS bucket, count(*) AS n FROM found GROUP BY 1, 2, 3""")
def finding_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.bucketed(verified(spark, sf_dir)).groupBy("rule", "severity", "bucket").agg(F.count("*").alias("n"))


@query(oracle.FINDINGS.rstrip() + f", {oracle.CATEGORIES} SELECT category, count(found.rule) AS n, count(*) FILTER (WHERE found.severity >= 3) AS n_high FROM c LEFT JOIN found ON c.rule = found.rule GROUP BY category")
def document_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.matrix(doc_findings(spark, sf_dir))


@query(_AXES + " SELECT * FROM states")
def document_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.axis_states(verified(spark, sf_dir), checks(spark, sf_dir), gate.axes(spark))


@query(_AXES + " SELECT bool_and(NOT hard OR state = 'confirmed') AS confirmed, count(*) FILTER (WHERE hard AND state = 'failed') AS hard_failed, count(*) FILTER (WHERE hard AND state = 'not run') AS hard_not_run FROM states")
def document_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.done(document_axes(spark, sf_dir))


@query(oracle.FINDINGS + "SELECT v.id AS cap, CASE WHEN (SELECT count(*) FROM documents) = 0 THEN 'skipped' ELSE 'ran' END AS state, (SELECT count(*) FROM found WHERE cap = v.id) AS findings FROM (VALUES ('security.scan/secret'), ('security.scan/pii'), ('quality.check/smell')) v(id)")
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.summary(doc_findings(spark, sf_dir), doc_files(spark, sf_dir), list(ANALYSES))


@query(oracle.FINDINGS + "SELECT rule, path, line_no, severity, cap FROM found WHERE severity < 4")
def dedup_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two analyses that report the same places, the later one with another severity: the first one's findings stay."""
    found = doc_findings(spark, sf_dir).where("severity < 4")
    again = found.withColumns({"cap_ord": F.col("cap_ord") + 100, "severity": F.lit(4), "cap": F.lit("again")})
    return gate.keep_first(again.unionByName(found)).select("rule", "path", "line_no", "severity", "cap")


@query(f"""WITH {oracle.LINES}, h AS (SELECT path, line_no FROM lines WHERE regexp_matches(line, '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}}])tion($|[^\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}}])'))
SELECT path, CAST(line_no AS INTEGER) AS line_no, (SELECT count(*) FROM h) AS total FROM h ORDER BY path, line_no LIMIT 500""")
def word_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 lines that hold a whole word, and their true number."""
    shown, total = codeintel.find_usages(src.lines(doc_files(spark, sf_dir)), "tion")
    return shown.select("path", "line_no").crossJoin(total)
