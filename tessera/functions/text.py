"""Catalyst expressions over text: entropy, evidence, line and byte measures, slugs, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes beyond which a line is out of scope of line rules. Fixed value.
LONG_LINE = 2000


def entropy(text: Column) -> Column:
    """Shannon bits per character; 0 for empty text. One pass over the sorted characters adds c * log2(c) of each run."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.size(chars).cast("double")
    zero = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    of = lambda acc: F.when(acc["run"] > 1, acc["run"] * F.log2(acc["run"])).otherwise(0.0)

    def step(acc: Column, c: Column) -> Column:
        same = c == acc["c"]
        return F.struct(c.alias("c"), F.when(same, acc["run"] + 1).otherwise(1.0).alias("run"), F.when(same, acc["sum"]).otherwise(acc["sum"] + of(acc)).alias("sum"))

    total = F.aggregate(chars, zero, step, lambda acc: acc["sum"] + of(acc))
    return F.when(F.length(text) > 0, F.log2(n) - total / n).otherwise(0.0)


def evidence(line: Column, width: int = 120) -> Column:
    return F.substring(F.trim(line), 1, width)


def shown(text: Column, width: int = 300) -> Column:
    """Control characters become spaces, white space collapses, long text is cut with an ellipsis."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, r"\p{Cc}", " "), r"\s+", " "))
    return F.when(F.length(clean) > width, F.concat(F.substring(clean, 1, width), F.lit("…"))).otherwise(clean)


def occurrences(text: Column, token: str) -> Column:
    """Non-overlapping occurrences of a plain string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)).cast("bigint")


def slug(text: Column, width: int = 50) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", ""), 1, width), "-+$", "")


def extension(path: Column) -> Column:
    """Lower-case extension; container files without one get a name of their own."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(base.rlike(r"^(Dockerfile|Containerfile)(\..*)?$"), "dockerfile").otherwise(F.lower(F.regexp_extract(base, r"\.([^.]+)$", 1)))


def module_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("(root)")


def without_credentials(url: Column) -> Column:
    return F.regexp_replace(url, r"(://)[^/@\s]*@", "$1")


def diagram_label(text: Column) -> Column:
    return F.regexp_replace(text, r'["\[\]{}|<>]', "'")
