"""Tables of other operators as findings (rule, severity, path, line_no, verified, cap), and what is said of a verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import codeintel

FINDING = "rule string, severity int, path string, line_no int, verified boolean, cap string"
#: Fixed value: the share of documented public definitions below which there is a finding, in percent.
DOCUMENTED_FLOOR = 50.0
#: Whose findings block a delivery whatever their severity, and the families that they belong to.
UNFINISHED = ("quality.check/completeness", "spec.check/drift", "verify/api-break")
FAMILIES = ("quality", "spec", "verify")


def as_findings(df: DataFrame, rule: str | Column, severity: int | Column, cap: str, path: str | None = "path", line_no: str | None = None, verified: bool = True) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        lit(rule).cast("string").alias("rule"), lit(severity).cast("int").alias("severity"), (F.col(path) if path else F.lit(None)).cast("string").alias("path"),
        (F.col(line_no) if line_no else F.lit(None)).cast("int").alias("line_no"), F.lit(verified).alias("verified"), F.lit(cap).alias("cap"))


def dead_exports(symbols: DataFrame, files: DataFrame) -> DataFrame:
    return as_findings(codeintel.dead_exports(symbols, files), "dead-export", 1, "quality.check/dead-code", line_no="line_no")


def god_files(symbols: DataFrame) -> DataFrame:
    return as_findings(codeintel.god_files(symbols), "god-file", 1, "quality.check/antipattern")


def deep_nesting(lines: DataFrame, deepest: int = codeintel.DEEP) -> DataFrame:
    return as_findings(codeintel.deepest(lines).where(F.col("depth") > deepest), "deep-nesting", 2, "quality.check/antipattern", line_no="line_no")


def metrics(metrics_: DataFrame) -> DataFrame:
    return as_findings(codeintel.metric_findings(metrics_), F.col("rule"), F.col("severity"), "quality.check/complexity")


def import_cycles(cycles: DataFrame) -> DataFrame:
    """One finding a component, at its smallest module."""
    return as_findings(cycles.where("node = component"), "import-cycle", 2, "quality.check/cycles", path="node")


def layer_violations(violations: DataFrame) -> DataFrame:
    return as_findings(violations, "layer-violation", 2, "quality.check/layers", path="src")


def constitution(broken: DataFrame) -> DataFrame:
    rule = F.when(F.col("directive") == "FORBID", "constitution-forbid").otherwise("constitution-require")
    return as_findings(broken, rule, F.when(F.col("directive") == "FORBID", 3).otherwise(2), "quality.check/constitution")


def api_break(changes: DataFrame) -> DataFrame:
    return as_findings(changes.where("change = 'removed'"), "api-break", 2, "verify/api-break", path=None)


def drift(drifted: DataFrame) -> DataFrame:
    return as_findings(drifted, F.col("rule"), F.when(F.col("rule") == "doc-missing", 0).otherwise(1), "spec.check/drift", path="name")


def vulnerable(matches: DataFrame) -> DataFrame:
    """Versions within a range are confirmed; what can't be compared is told as uncertain and not confirmed."""
    level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in {"LOW": 1, "MED": 2, "MEDIUM": 2, "HIGH": 3, "CRIT": 4, "CRITICAL": 4}.items() for x in kv]), F.upper("severity")), F.lit(2))
    sure = as_findings(matches.where("certain"), "vulnerable-dependency", level, "security.scan/deps", path="name")
    return sure.unionByName(as_findings(matches.where("NOT certain"), "vulnerable-dependency-uncertain", level, "security.scan/deps", path="name", verified=False))


def copyleft(licences: DataFrame) -> DataFrame:
    return as_findings(licences, "copyleft-license", F.col("severity"), "security.scan/licenses", path="package")


def undocumented(lines: DataFrame, symbols: DataFrame, floor: float = DOCUMENTED_FLOOR) -> DataFrame:
    """One finding for a project whose share of documented public definitions is below the floor, at the first that has no
    comment."""
    marked = codeintel.documentation(lines, symbols)
    told = marked.agg(F.count("*").alias("n"), F.count_if("documented").alias("n_documented"), F.min(F.when(~F.col("documented"), F.struct("path", "line_no"))).alias("first"))
    low = told.where((F.col("n") > F.col("n_documented")) & (100.0 * F.col("n_documented") / F.col("n") < floor)).select("first.path", "first.line_no")
    return as_findings(low, "undocumented-api", 0, "quality.check/undocumented", line_no="line_no")


def failing_tests(checks: DataFrame) -> DataFrame:
    return as_findings(checks.where("id = 'verify/test' AND state = 'ran' AND NOT proven"), "tests-failing", 3, "verify/test", path=None)


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def escalated(bucketed: DataFrame) -> DataFrame:
    """Warnings and advisories of what is left unfinished block."""
    rises = F.col("cap").isin(*UNFINISHED) & F.col("bucket").isin("warning", "advisory")
    return bucketed.withColumn("bucket", F.when(rises, "blocking").otherwise(F.col("bucket")))


def unfinished_warning(families: list[str]) -> str | None:
    """What a policy that names only some families leaves without escalation."""
    missing = [cap for cap, family in zip(UNFINISHED, FAMILIES, strict=True) if family not in families]
    return f"not escalated, as their families are left out: {', '.join(missing)}" if families and missing else None


def test_status(checks: DataFrame, findings: DataFrame, serious: bool) -> DataFrame:
    """(tests): 'failing', 'passing', why they were skipped, 'not run' where that matters, else null."""
    mine = checks.where("id = 'verify/test'")
    told = mine.agg(F.bool_or(F.col("state") == "ran").alias("ran"), F.min(F.when(F.col("state") == "skipped", F.col("reason"))).alias("why"))
    failed = findings.where("cap = 'verify/test'").agg(F.count("*").alias("n"))
    status = F.when(F.col("ran") & (F.col("n") > 0), "failing").when(F.col("ran"), "passing").when(F.col("why").isNotNull(), F.col("why")).when(F.lit(serious), "not run")
    return told.crossJoin(failed).select(status.alias("tests"))


def headline(verdict: DataFrame, checks: DataFrame, tests: DataFrame, artifacts: int = 0) -> DataFrame:
    """(headline): one sentence; a verdict passes in words only if a check ran at all."""
    counts = checks.agg(F.count_if(F.col("state") == "ran").alias("ran"), F.count_if(F.col("state") == "skipped").alias("skipped"))
    all_ = verdict.crossJoin(counts).crossJoin(tests)
    end = F.when(F.col("tests").isNotNull(), F.concat(F.lit(" Tests: "), "tests", F.lit("."))).otherwise("")
    text = (
        F.when(~F.col("passed"), F.format_string("Not ready to ship. Quality %d/100, %d blocker(s) need your decision.", "score", "blocking"))
        .when(F.col("ran") > 0, F.format_string("Ready to ship. Quality %d/100, %d checks passed, no blockers.", "score", "ran"))
        .when(F.col("skipped") > 0, F.format_string("Quality NOT confirmed: no check ran (%d skipped).", "skipped"))
        .when(F.lit(artifacts > 0), F.lit(f"Artifacts created ({artifacts}). No quality checks ran, no score assigned."))
        .otherwise("Quality NOT confirmed: no checks ran.")
    )
    return all_.select(F.concat(text, end).alias("headline"))


def alert(verdict: DataFrame, decisions: int, advisories: int, most_decisions: int = 8, most_advisories: int = 6) -> DataFrame:
    """(alert, blocking, decisions, advisories): whether someone must look, and how many of each are shown."""
    need = (F.col("blocking") > 0) | F.lit(decisions > 0) | F.lit(advisories > 0)
    return verdict.select(need.alias("alert"), "blocking", F.lit(min(decisions, most_decisions)).alias("decisions"), F.lit(min(advisories, most_advisories)).alias("advisories"))


def waves(steps: dict[str, list[str]]) -> tuple[list[list[str]], list[str]]:
    """Steps in waves, each after what it needs; and those that wait for each other, which are told instead of waited for."""
    done, out, left = set(), [], dict(steps)
    while left:
        ready = sorted(s for s, needs in left.items() if all(n in done or n not in steps for n in needs))
        if not ready:
            return out, sorted(left)
        out.append(ready)
        done |= set(ready)
        left = {s: n for s, n in left.items() if s not in done}
    return out, []


#: Kinds of definitions that hold others.
CONTAINERS = ("class", "type")


def asked(names: DataFrame) -> DataFrame:
    """(query, leaf, container) from (name): the last part of a qualified name and the one before it, null for a plain name."""
    parts = F.filter(F.split("name", r"[.:/\\]"), lambda p: p != "")
    return names.where("name <> ''").select(F.col("name").alias("query"), F.coalesce(F.get(parts, F.size(parts) - 1), F.col("name")).alias("leaf"), F.get(parts, F.size(parts) - 2).alias("container")).distinct()


def symbol_definitions(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """(query, path, line_no, kind, name, owned): definitions that bear a name asked for, by its full form or else by its last part; `owned`
    says that this one answers the question: the full name, a plain name, or below a definition of the container in the
    same file."""
    q = asked(names)
    s = symbols.select("path", "line_no", "kind", "name")
    exact = q.join(s, F.col("query") == F.col("name")).select("query", "path", "line_no", "kind", "name", F.lit(True).alias("owned"))
    rest = q.join(exact.select("query"), "query", "left_anti")
    holders = s.where(F.col("kind").isin(*CONTAINERS)).groupBy(F.col("path").alias("in"), F.col("name").alias("holder")).agg(F.min("line_no").alias("from"))
    leaves = rest.join(s, F.col("leaf") == F.col("name"))
    held = leaves.join(holders, (F.col("path") == F.col("in")) & (F.col("container") == F.col("holder")), "left")
    owned = F.col("container").isNull() | F.coalesce(F.col("from") <= F.col("line_no"), F.lit(False))
    return exact.unionByName(held.select("query", "path", "line_no", "kind", "name", owned.alias("owned")))


def symbol_findings(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """A finding for each name asked for that no definition answers: one of its last part stands elsewhere, or nowhere."""
    met = symbol_definitions(symbols, names).groupBy("query").agg(F.bool_or("owned").alias("owned"))
    open_ = asked(names).join(met, "query", "left").where("NOT coalesce(owned, false)")
    elsewhere = F.col("owned").isNotNull()
    rule, severity = F.when(elsewhere, "symbol-container-unconfirmed").otherwise("symbol-not-found"), F.when(elsewhere, 2).otherwise(3)
    return open_.select("query", rule.alias("rule"), severity.cast("int").alias("severity"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line_no"), F.lit(True).alias("verified"), F.lit("verify/symbol").alias("cap"))
