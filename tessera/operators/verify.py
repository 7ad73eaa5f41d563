"""Refutation of findings: each is joined with its line and the line above, and dropped if these speak against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import shown
from tessera.plans.rules import PRECISE

#: What stands in place of a secret; rules whose form proves a secret; rules that a comment refutes whatever
#: their source; what a file with a hardened XML parser holds.
PLACEHOLDERS = (
    "changeme", "change-me", "change me", "your_", "your-", "<your", "example", "placeholder", "todo", "dummy", "fake", "sample", "xxxxxxxx", "смени", "замени", "вставь", "измени",
)
STRICT = ("aws-access-key", "llm-api-key", "github-token", "stripe-key", "gitlab-token", "slack-token", "sendgrid-key", "npm-token", "azure-account-key", "google-api-key", "private-key")
IN_CODE = ("panic-path", "swallowed-error", "unimplemented-stub", "empty-catch", "empty-except", "empty-function")
HARDENED = ("import defusedxml", "from defusedxml", "disallow-doctype-decl", "feature_secure_processing")
#: Signs that a line states a search pattern; the first two kinds are beyond doubt.
FLAGS = ("(?i)", "(?m)", "(?s)", "(?x)", "(?:")
MAKERS = ("Regex::new(", "regexp.MustCompile(", "re.compile(")
TESTS = ('.contains("', '.ends_with("', '.starts_with("', '.find("')
#: Where the value stands in a line that a secret rule has found: pattern and group.
VALUES = {
    "aws-access-key": (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", 0), "github-token": (r"\bgh[pousr]_[0-9A-Za-z]{36}\b", 0), "stripe-key": (r"\bsk_(?:live|test)_[0-9A-Za-z]{16,}\b", 0), "google-api-key": (r"\bAIza[0-9A-Za-z_\-]{35}\b", 0),
    "gitlab-token": (r"\bglpat-[0-9A-Za-z_\-]{20,}", 0), "slack-token": (r"\bxox[abposr]-[0-9A-Za-z\-]{10,}\b", 0), "sendgrid-key": (r"\bSG\.[0-9A-Za-z_\-]{16,}\.[0-9A-Za-z_\-]{16,}\b", 0), "npm-token": (r"\bnpm_[0-9A-Za-z]{36}\b", 0),
    "azure-account-key": (r"(?i)AccountKey=([0-9A-Za-z+/=]{40,})", 1), "llm-api-key": (r"\bsk-[A-Za-z0-9_\-]{20,}\b|\bhf_[A-Za-z0-9]{30,}\b", 0), "private-key": (r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", 0), "twilio-sid": (r"\bAC[0-9a-f]{32}\b", 0),
    "jwt": (r"\beyJ[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,}\b", 0),
    "generic-secret": (r"""(?i)\b(?:password|passwd|secret|api[_-]?key|apikey|access[_-]?key|client[_-]?secret|auth[_-]?token|token)\b\s*[:=]\s*["']([^"'\s]{12,})["']""", 1), "aws-secret-key": (r"""(?i)\baws.{0,20}["']([0-9A-Za-z/+]{40})["']""", 1),
}


def with_context(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds the finding's line and the one above it, where the scan hasn't (`lines(files, above=True)`)."""
    if "above" in findings.columns:
        return findings
    frame = Window.partitionBy("path").orderBy("line_no")
    context = lines.withColumn("above", F.lag("line").over(frame)).select("path", "line_no", "line", "above")
    return findings.join(context, ["path", "line_no"], "left")


def ignored(rule: Column, line: Column) -> Column:
    """A marker without a list speaks of every rule, one with a list of those named. The first marker of a line counts."""
    names = F.transform(F.split(F.regexp_extract(line, r"^.*?tessera:ignore\[([^\]]*)\]", 1), ","), F.trim)
    listed = line.rlike(r"^(?:(?!tessera:ignore).)*tessera:ignore\[[^\]]*\]")
    return F.coalesce(F.when(listed, F.array_contains(names, rule)).otherwise(line.rlike("tessera:ignore")), F.lit(False))


def digit_run(value: Column) -> Column:
    """The longest run of equal or of ascending digits."""
    digits = F.filter(F.split(value, ""), lambda c: c != "")
    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("same"), F.lit(0).alias("up"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        same = F.when(~is_digit, 0).when(c == acc["last"], acc["same"] + 1).otherwise(1)
        up = F.when(~is_digit, 0).when(acc["last"].rlike("^[0-9]$") & (c.try_cast("int") == acc["last"].try_cast("int") + 1), acc["up"] + 1).otherwise(1)
        return F.struct(c.alias("last"), same.alias("same"), up.alias("up"), F.greatest(acc["most"], same, up).alias("most"))

    return F.aggregate(digits, zero, step, lambda acc: acc["most"])


def numeric_placeholder(value: Column) -> Column:
    return digit_run(value) >= F.greatest(F.lit(6), F.ceil(F.length(value) / 2).cast("int"))


def value_of(rule: Column, line: Column) -> Column:
    """The value that a finding is about: by its rule's form, else the first quoted text, else what follows the first sign
    of assignment, else the line."""
    out = F.lit(None).cast("string")
    for name, (pattern, group) in VALUES.items():
        out = F.when(rule == name, F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))).otherwise(out)
    quoted = F.nullif(F.regexp_extract(line, r"""["']([^"']{1,200})["']""", 1), F.lit(""))
    assigned = F.nullif(F.trim(F.regexp_extract(line, r"^[^=:]*[=:](.*)$", 1)), F.lit(""))
    return F.coalesce(out, quoted, assigned, line)


def _holds(line: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | line.contains(n)
    return out


def refuted_by(rule: Column, cap: Column, line: Column, above: Column, hardened: Column) -> Column:
    """Why a finding falls, or null; the first reason counts."""
    security = cap.contains("security") | cap.contains("pii")
    strict = rule.isin(*STRICT)
    critical = cap.startswith("security.ai") | (security & (rule.isin(*PRECISE) | rule.startswith("sast/") | rule.startswith("taint")))
    sure = _holds(line, (*FLAGS, *MAKERS))
    stated = F.ltrim(line).rlike("^(?:FORBID|REQUIRE) ") | sure | _holds(line, TESTS)
    comment = F.ltrim(line).rlike(r"^(//|#|\*|/\*|<!--)")
    value = value_of(rule, line)
    return (
        F.when(ignored(rule, line) | ignored(rule, above), "ignored")
        .when((rule == "xxe-parser-default") & hardened, "hardened")
        .when(~strict & stated & (~critical | sure), "rule-definition")
        .when((security | rule.isin(*IN_CODE)) & comment, "comment")
        .when(security & ~strict & _holds(F.lower(value), PLACEHOLDERS), "placeholder")
        .when(security & ~strict & numeric_placeholder(value), "number")
    )


def hardened_files(lines: DataFrame) -> DataFrame:
    """(path): files that show that their XML parser resolves no entities."""
    low = F.lower("line")
    return lines.where(_holds(low, HARDENED) | F.replace(low, F.lit(" "), F.lit("")).contains("resolve_entities=false")).select("path").distinct()


def verify(findings: DataFrame, lines: DataFrame, parsers: bool = True) -> DataFrame:
    """With `parsers`, lines are read once more for files whose XML parser is hardened; rules on parsers need that.

    Findings with `verified` and `refuted_by`; what is shown of confirmed ones is cleared of control characters and cut."""
    seen = with_context(findings, lines)
    if parsers:
        safe = hardened_files(lines).select(F.col("path").alias("safe"))
        seen = seen.join(safe, (F.col("rule") == "xxe-parser-default") & (F.col("path") == F.col("safe")), "left")
    else:
        seen = seen.withColumn("safe", F.lit(None).cast("string"))
    why = refuted_by(F.col("rule"), F.col("cap"), F.coalesce("line", F.lit("")), F.coalesce("above", F.lit("")), F.col("safe").isNotNull())
    out = seen.withColumn("refuted_by", why).withColumn("verified", F.col("refuted_by").isNull()).drop("line", "above", "safe")
    if "evidence" in findings.columns:
        out = out.withColumn("evidence", F.when(F.col("verified"), shown(F.col("evidence"))).otherwise(F.col("evidence")))
    return out
