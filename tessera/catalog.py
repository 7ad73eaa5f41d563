"""Every query of the engine by name, with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import tables, verdicts  # noqa: F401  they register their queries
from tessera.plans.queries import ORACLE_SQL, QUERIES, gate_score

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to lines, rules, findings, buckets and a score."""
    return gate_score(spark, sf_dir)
