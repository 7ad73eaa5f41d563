"""Rules against files: one pass over the lines for all line rules, windows for window rules, whole files for the rest.

Rules never join on a pattern column. Each pattern is a literal of one expression, so it compiles once, and the lines are
read once whatever the number of rules. Where a rule names plain strings of which every match holds one, these are looked
for first, in the lower-cased text that all rules share, and spare most texts the pattern.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import LONG_LINE, entropy, evidence
from tessera.operators.graph import cut
from tessera.plans.rules import Rule
from tessera.sources.files import lines, split_lines

FINDING = ["path", "line_no", "rule", "severity", "cap", "cap_ord", "phase", "rule_ord", "evidence"]
PHASES = {"line": 0, "file": 1, "entropy": 1, "window": 2}
#: The finding's line and the one above it, where `lines` has them (`lines(files, above=True)`).
CONTEXT = ("line", "above")


def _exts(rule: Rule) -> Column:
    return F.col("ext").isin(*rule.exts) if rule.exts else F.lit(True)


def _needles(rule: Rule, text: Column, lower: Column) -> Column:
    out = F.lit(not rule.needles)
    for n in rule.needles:
        out = out | (lower if n == n.lower() else text).contains(n)
    return out


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def bound(value: Column, test: Callable[[Column], Column]) -> Column:
    """A test of a value that is computed once a row, however often the test names it; a filter would put it in at each place."""
    return F.exists(F.array(value), test)


def _hit(rule: Rule, text: Column, lower: Column | None = None) -> Column:
    hit = _exts(rule) if lower is None else _exts(rule) & _needles(rule, text, lower)
    hit = hit & text.rlike("(?d)" + rule.pattern)
    if rule.also:
        hit = hit & text.rlike("(?d)" + rule.also)
    return hit & ~text.rlike(rule.unless) if rule.unless else hit


def _facts(found: DataFrame, rules: list[Rule], order: dict[str, int]) -> DataFrame:
    """Rule columns by the number of the rule, from literals."""
    pick = lambda f, kind: F.element_at(F.array(*[F.lit(f(r)).cast(kind) for r in rules]), F.col("rule_no") + 1)
    context = [c for c in CONTEXT if c in found.columns]
    return found.select(
        "path", "line_no", pick(lambda r: r.id, "string").alias("rule"), pick(lambda r: r.severity, "int").alias("severity"), pick(lambda r: r.cap, "string").alias("cap"),
        pick(lambda r: order[r.cap], "int").alias("cap_ord"), pick(lambda r: PHASES[r.kind], "int").alias("phase"), F.col("rule_no").alias("rule_ord"), "evidence", *context,
    )


def line_findings(lines: DataFrame, rules: list[Rule], order: dict[str, int]) -> DataFrame:
    """At most one finding for a rule and line; lines beyond the byte limit are out of scope."""
    # Few lines hold what a match of some rule must hold; only these are put to the rules one by one.
    some = bound(F.lower("line"), lambda low: any_of([_exts(r) & _needles(r, F.col("line"), low) for r in rules if r.needles]))
    some = any_of([some, *[_exts(r) & F.col("line").rlike("(?d)" + r.pattern) for r in rules if not r.needles]])
    inside = lines.where((F.octet_length("line") <= LONG_LINE) & some)
    hits = lambda low: F.array_compact(F.array(*[F.when(_hit(r, F.col("line"), low), F.lit(k)) for k, r in enumerate(rules)]))
    numbers = F.flatten(F.transform(F.array(F.lower("line")), hits))
    context = [c for c in CONTEXT if c in lines.columns and "above" in lines.columns]
    found = inside.select("path", "line_no", *dict.fromkeys(["line", *context]), F.explode(numbers).alias("rule_no")).withColumn("evidence", evidence(F.col("line")))
    return _facts(found if context else found.drop("line"), rules, order)


def window_findings(files: DataFrame, rules: list[Rule], order: dict[str, int]) -> DataFrame:
    """The first match of each frame of lines, at the line where it starts, once for a rule and line. Frames are slices of the
    file's own lines, so no line leaves its row."""
    out = None
    for w in sorted({r.window for r in rules}):
        some = [r for r in rules if r.window == w]
        own = files.where(F.lit(any(not r.exts for r in some)) | F.col("ext").isin(*{e for r in some for e in r.exts})).select("path", "ext", split_lines(F.col("content")).alias("own"))
        frames = F.transform("own", lambda _, i: F.array_join(F.slice("own", i + 1, w), "\n"))
        text = own.select("path", "ext", F.posexplode(frames).alias("i", "frame")).withColumn("line_no", F.col("i") + 1).where(F.octet_length("frame") <= LONG_LINE * w)
        hits = [F.when(_hit(r, F.col("frame")), F.struct(F.lit(k).alias("rule_no"), F.expr(f"regexp_instr(frame, '{_quoted('(?d)' + r.pattern)}')").alias("start"))) for k, r in enumerate(some)]
        found = text.select("path", "line_no", "frame", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("hit"))
        before = F.substring(F.col("frame"), 1, F.col("hit.start") - 1)
        placed = found.select("path", (F.col("line_no") + newlines(before)).cast("int").alias("line_no"), F.col("hit.rule_no").alias("rule_no"), F.substring(F.regexp_replace("frame", r"\s*\n\s*", " | "), 1, 160).alias("evidence"))
        first = placed.groupBy("path", "line_no", "rule_no").agg(F.min("evidence").alias("evidence"))
        one = _facts(first, some, order)
        out = one if out is None else out.unionByName(one)
    return out


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


#: Fixed value: the seam between two literals of one kind of quotes that are one string, with or without a plus.
SEAM = r""""[ \t\r\n]*\+?[ \t\r\n]*"|'[ \t\r\n]*\+?[ \t\r\n]*'"""


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def hit_files(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """(path, ext, content, joined) of files with a match in the text or in `joined`, the text without its seams; null if it has none."""
    joined = F.when(F.col("content").rlike(SEAM), F.regexp_replace("content", SEAM, ""))
    hit = lambda text: bound(F.lower(text), lambda low: any_of([_exts(r) & _needles(r, text, low) & text.rlike("(?d)" + r.pattern) for r in rules]))
    return files.where(hit(F.col("content")) | F.coalesce(bound(joined, hit), F.lit(False))).select("path", "ext", "content", joined.alias("joined"))


def matches(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(path, rule_no, joined, start, breaks, found, value): every match with its place and the line breaks before it, both counted
    in the text that it is in. A match's place is the sum of what stands between the matches before it and of these."""

    def of(r: Rule, k: int, text: str) -> Column:
        p = F.lit("(?d)" + r.pattern)
        found = F.regexp_extract_all(text, p, F.lit(0))
        value = F.regexp_extract_all(text, p, F.lit(1)) if r.kind == "entropy" else found
        gaps = F.transform(F.split(text, "(?d)" + r.pattern, -1), lambda g: F.struct(F.length(g).alias("n"), newlines(g).alias("breaks")))
        return F.when(_exts(r) & F.col(text).rlike("(?d)" + r.pattern), F.struct(F.lit(k).alias("rule_no"), F.lit(text == "joined").alias("joined"), F.arrays_zip(found.alias("found"), value.alias("value"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap")).alias("m")))

    told = F.array_compact(F.array(*[of(r, k, text) for k, r in enumerate(rules) for text in ("content", "joined")]))
    each = texts.select("path", F.explode(told).alias("t")).select("path", "t.rule_no", "t.joined", F.posexplode("t.m").alias("i", "m"))
    upto = Window.partitionBy("path", "rule_no", "joined").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c, own: F.sum(c).over(upto) - own
    size, broken = F.length("m.found"), newlines(F.col("m.found"))
    return each.select("path", "rule_no", "joined", total(F.col("m.gap.n") + size, size).alias("start"), total(F.col("m.gap.breaks") + broken, broken).alias("breaks"), F.col("m.found").alias("found"), F.col("m.value").alias("value"))


def seams(texts: DataFrame) -> DataFrame:
    """(path, start, breaks): where in the joined text a seam was, and the line breaks that it held."""
    found = F.regexp_extract_all("content", F.lit(SEAM), F.lit(0))
    sizes = F.transform(F.split("content", SEAM, -1), F.length)
    each = texts.where("joined IS NOT NULL").select("path", F.posexplode(F.arrays_zip(F.slice(sizes, F.lit(1), F.size(found)).alias("n"), F.transform(found, newlines).alias("breaks"))).alias("i", "s"))
    upto = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("path", F.sum("s.n").over(upto).alias("start"), F.col("s.breaks").alias("breaks"))


def file_findings(files: DataFrame, rules: list[Rule], order: dict[str, int], context: bool = False) -> DataFrame:
    """All matches in a text and in the text with its literals joined, one for a rule and line, the text's own first. The files
    with a match are set aside first, so that all else works on these alone."""
    texts = cut(hit_files(files, rules))
    found = matches(texts, rules)
    bits = [(k, r.bits) for k, r in enumerate(rules) if r.kind == "entropy"]
    if bits:
        least = F.coalesce(F.element_at(F.create_map(*[F.lit(float(x) if i else x) for kb in bits for i, x in enumerate(kb)]), F.col("rule_no")), F.lit(0.0))
        found = found.where(F.when(F.col("rule_no").isin([k for k, _ in bits]), entropy(F.col("value")) >= least).otherwise(True))
    found = found.select("path", "rule_no", "joined", "start", "breaks", F.substring(F.trim(F.regexp_replace("found", r"\s+", " ")), 1, 120).alias("evidence"))
    # In the joined text, breaks within the seams up to a match come on top.
    marks = seams(texts).select("path", F.lit(None).cast("int").alias("rule_no"), F.lit(True).alias("joined"), "start", F.col("breaks").alias("held"), F.lit(None).cast("bigint").alias("breaks"), F.lit(None).cast("string").alias("evidence"))
    upto = Window.partitionBy("path", "joined").orderBy("start", F.col("rule_no").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = found.withColumn("held", F.lit(0)).unionByName(marks).withColumn("above", F.sum("held").over(upto)).where("rule_no IS NOT NULL")
    line_no = (1 + F.col("breaks") + F.col("above")).cast("int")
    once = placed.groupBy("path", line_no.alias("line_no"), "rule_no").agg(F.min_by("evidence", F.struct("joined", "start")).alias("evidence"))
    if context:
        once = once.join(lines(texts, above=True).select("path", "line_no", *CONTEXT), ["path", "line_no"], "left")
    return _facts(once, rules, order)


def scan(files: DataFrame, lines: DataFrame, rules: list[Rule], exts: set[str] | None = None) -> DataFrame:
    """Findings of all rules; with exts, rules that could hit none of these extensions are left out of the plan."""
    order = {c: i for i, c in enumerate(dict.fromkeys(r.cap for r in rules))}
    live = [r for r in rules if exts is None or not r.exts or set(r.exts) & exts]
    context = "above" in lines.columns
    whole = lambda source, some, order: file_findings(source, some, order, context)
    out = None
    for kinds, run, source in ((("line",), line_findings, lines), (("file", "entropy"), whole, files), (("window",), window_findings, files)):
        some = [r for r in live if r.kind in kinds]
        if some:
            one = run(source, some, order)
            if context and "above" not in one.columns:
                one = one.join(lines.select("path", "line_no", *CONTEXT), ["path", "line_no"], "left")
            out = one if out is None else out.unionByName(one)
    return out


def secrets_by_entropy(lines: DataFrame, pattern: str, least: float) -> DataFrame:
    """Lines whose group 1 reaches `least` bits per character; native throughout."""
    value = F.regexp_extract("line", pattern, 1)
    return lines.where(F.octet_length("line") <= LONG_LINE).withColumn("value", value).where(F.length("value") > 0).withColumn("bits", entropy(F.col("value"))).where(F.col("bits") >= least)


def coverage(files: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: files scanned and lines out of scope."""
    return files.agg(F.count("*").alias("files_scanned")).crossJoin(lines.agg(F.count_if(F.octet_length("line") > LONG_LINE).alias("long_lines_out_of_scope"), F.count("*").alias("n_lines")))


def summary(findings: DataFrame, files: DataFrame, caps: list[str]) -> DataFrame:
    """(cap, state, findings): what each analysis counted; one that had no file to read is skipped, not clean."""
    counted = findings.groupBy("cap").agg(F.count("*").alias("findings"))
    read = files.agg(F.count("*").alias("files"))
    named = files.sparkSession.createDataFrame([(c,) for c in caps], "cap string")
    state = F.when(F.col("files") == 0, "skipped").otherwise("ran")
    return named.crossJoin(read).join(counted, "cap", "left").select("cap", state.alias("state"), F.coalesce("findings", F.lit(0)).alias("findings"))
