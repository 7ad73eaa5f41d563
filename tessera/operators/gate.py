"""From findings to a verdict: keep-first, confidence, buckets, score, categories, axes, rigor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.rules import CATEGORIES, HEURISTIC, HIGH, PRECISE

#: What a severity takes from the score of 100.
WEIGHTS = (0, 1, 4, 12, 25)


@dataclass(frozen=True)
class Policy:
    block_at: int = HIGH
    weights: tuple[int, ...] = WEIGHTS

    def problems(self) -> list[str]:
        bad = [f"weight {w} is negative or not finite" for w in self.weights if not 0 <= w < float("inf")]
        return bad + ([] if 0 <= self.block_at <= 4 else ["no such severity"])

    def weaker_than(self, other: Policy) -> list[str]:
        """Named reasons for which this policy lets more pass."""
        out = ["blocks later"] if self.block_at > other.block_at else []
        return out + [f"weight of severity {i} lowered" for i, (a, b) in enumerate(zip(self.weights, other.weights, strict=True)) if a < b]


def keep_first(findings: DataFrame) -> DataFrame:
    """One finding for a rule, file and line: the first by registration and emission. Those without a place all stay."""
    frame = Window.partitionBy("rule", "path", "line_no").orderBy("cap_ord", "phase", "rule_ord")
    numbered = findings.withColumn("__n", F.row_number().over(frame))
    return numbered.where("__n = 1 OR path IS NULL OR line_no IS NULL").drop("__n")


def confidence(rule: Column) -> Column:
    """0 for hints, 2 for proof, 1 for all others, unlisted ones included."""
    sure = rule.isin(*PRECISE) | rule.startswith("sast/") | rule.startswith("taint")
    return F.when(rule.isin(*HEURISTIC), 0).when(sure, 2).otherwise(1)


def bucketed(findings: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """`bucket`: dropped if unverified, blocking from the policy's severity on whatever the confidence, else warning, or
    advisory for mere hints."""
    level = confidence(F.col("rule"))
    bucket = F.when(~F.col("verified"), "dropped").when(F.col("severity") >= policy.block_at, "blocking").when(level >= 1, "warning").otherwise("advisory")
    return findings.withColumn("confidence", level).withColumn("bucket", bucket)


def weight(severity: Column, policy: Policy = Policy()) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in policy.weights]), severity + 1)


def verdict(bucketed_: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One row: counts of the buckets, the score, and whether it passes."""
    counts = {b: F.count_if(F.col("bucket") == b).alias(b) for b in ("blocking", "warning", "advisory", "dropped")}
    cost = F.coalesce(F.sum(F.when(F.col("bucket").isin("blocking", "warning"), weight(F.col("severity"), policy))), F.lit(0))
    return bucketed_.agg(*counts.values(), F.greatest(F.lit(0), F.least(F.lit(100), 100 - cost)).cast("bigint").alias("score")).withColumn("passed", F.col("blocking") == 0)


def category(rule: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, ids in CATEGORIES.items():
        if ids:
            out = F.when(rule.isin(*ids), name).otherwise(out)
    return out


def matrix(findings: DataFrame) -> DataFrame:
    """Findings and severe ones by category; categories without any keep a row of zeros."""
    spark = findings.sparkSession
    names = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    counted = findings.withColumn("category", category(F.col("rule"))).where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("severity") >= HIGH).alias("n_high"))
    return names.join(counted, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_high", F.lit(0)).alias("n_high"))


def by_source(findings: DataFrame) -> DataFrame:
    return findings.groupBy("cap").agg(F.count("*").alias("n"), F.count_if(F.col("severity") >= HIGH).alias("n_high"))


def rigor(checks: DataFrame) -> DataFrame:
    """Share of the attempted checks that ran, in percent; checks has `state`."""
    ran, skipped = F.count_if(F.col("state") == "ran"), F.count_if(F.col("state") == "skipped")
    return checks.agg(ran.alias("n_ran"), skipped.alias("n_skipped"), F.count_if(F.col("state") == "failed").alias("n_failed"), F.when(ran + skipped > 0, 100.0 * ran / (ran + skipped)).alias("rigor"))


#: Fixed values: (axis, capability, hard).
AXES = (
    ("Конституция", "quality.check/constitution", True), ("Тесты", "verify/test", True), ("Секреты", "security.scan/secret", True), ("OWASP HIGH", "security.scan/owasp", True),
    ("SAST (AST)", "security.scan/sast", True), ("Taint-поток", "security.scan/taint", True), ("Запахи кода", "quality.check/smell", False), ("Недоделанное", "quality.check/completeness", True),
    ("Анти-паттерны", "quality.check/antipattern", False), ("Циклы зависимостей", "quality.check/cycles", False), ("Мёртвый код", "quality.check/dead-code", False),
    ("Доки/Спека актуальны", "spec.check/drift", True), ("Контракт API не сломан", "verify/api-break", True),
)
#: The axis that bears findings below HIGH.
LENIENT = "security.scan/owasp"


def axes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AXES, "axis string, source string, hard boolean")


def axis_states(findings: DataFrame, checks: DataFrame, axes_: DataFrame) -> DataFrame:
    """Each axis: whether its check ran, and what of its findings (rule, severity, verified, cap) blocks or warns. One whose
    check did not run is not clean but 'not run'; one that ran fails by any finding, the lenient one by one of HIGH."""
    ran = checks.where("state = 'ran'").select(F.col("id").alias("source")).distinct().withColumn("ran", F.lit(True))
    counted = by_source(bucketed(findings).where("bucket IN ('blocking', 'warning')")).withColumnRenamed("cap", "source")
    all_ = F.broadcast(axes_).join(ran, "source", "left").join(counted, "source", "left")
    n, n_high = F.coalesce("n", F.lit(0)), F.coalesce("n_high", F.lit(0))
    bad = F.when(F.col("source") == LENIENT, n_high).otherwise(n) > 0
    state = F.when(F.col("ran").isNull(), "not run").when(bad, "failed").otherwise("confirmed")
    return all_.select("axis", "hard", state.alias("state"), n.alias("n"), n_high.alias("n_high"))


def done(states: DataFrame) -> DataFrame:
    """One row: done if no hard axis failed and none was left out, and something ran at all."""
    return states.agg(
        F.coalesce(F.bool_and(~F.col("hard") | (F.col("state") == "confirmed")), F.lit(False)).alias("confirmed"),
        F.count_if(F.col("hard") & (F.col("state") == "failed")).alias("hard_failed"), F.count_if(F.col("hard") & (F.col("state") == "not run")).alias("hard_not_run"))


def confusion(pairs: DataFrame) -> DataFrame:
    """Measures of `predicted` against `actual`, both boolean."""
    p, a = F.col("predicted"), F.col("actual")
    c = pairs.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    recall, fpr = F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.col("fp") / F.nullif(F.col("fp") + F.col("tn"), F.lit(0))
    precision = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))
    return c.select("*", recall.alias("recall"), fpr.alias("fpr"), precision.alias("precision"), (recall - fpr).alias("youden"))


def outcome(state: Column, text: Column) -> Column:
    """What a check's own words say: 'failed' for tool errors, else the state given."""
    #: Words by which tools report that they could not run.
    return F.when(F.lower(text).rlike("command not found|no such file|permission denied|timed out|not installed|cannot find|traceback|panicked|out of memory|failed to start|usage:"), "failed").otherwise(state)


def proves_tests(text: Column) -> Column:
    """'N passed' with N above zero, or the plain words; a denial wins."""
    counts = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]+) passed"), F.lit(1)), lambda x: x.cast("int"))
    return ~F.lower(text).rlike(r"no tests (?:ran|found|collected)|[1-9][0-9]* failed") & (F.exists(counts, lambda n: n > 0) | F.lower(text).rlike("all tests passed|tests? ok"))
