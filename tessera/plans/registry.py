"""The catalogue of analyses, queryable as a table: id, family, engine, tier, whether it writes, when to use it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (engine, writes, id, when to use it); the family is what stands before the slash.
ROWS = (
    ("scan", False, "security.scan/secret", "find leaked secrets, keys and tokens in any text"),
    ("scan", False, "security.scan/owasp", "web application risks with a matrix of ten categories"),
    ("scan", False, "security.scan/pii", "personal data: cards, numbers, mails, logs"),
    ("scan", False, "quality.check/smell", "swallowed errors, panics, debt markers"),
    ("codeintel", False, "quality.check/dead-code", "public definitions that nothing uses"),
    ("codeintel", False, "quality.check/cycles", "import cycles between modules"),
    ("codeintel", False, "code.intel/symbols", "list definitions and count them by language"),
    ("codeintel", False, "code.intel/module_card", "what a folder defines and exports"),
    ("codeintel", False, "code.intel/map", "folders, entry points, totals and languages of a project"),
    ("codeintel", False, "code.intel/find_usages", "lines that use a name"),
    ("codeintel", False, "code.intel/call_graph", "functions, calls, unresolved and unreachable ones"),
    ("runner", False, "verify/test", "run the tests and ask for positive proof"),
    ("runner", False, "verify/lint", "run the linter"),
    ("generator", True, "generate/docs", "write the project's documentation block"),
    ("metric", False, "quality.check/complexity", "long and complex files"),
    ("metric", False, "code.intel/metrics", "totals and the ten most complex files"),
    ("diagram", False, "code.intel/diagram", "show the module graph"),
    ("diagram", True, "generate/diagram", "write the module graph"),
    ("scan", False, "quality.check/constitution", "words that a project forbids or requires"),
    ("codeintel", False, "quality.check/layers", "imports that the layer map does not allow"),
    ("runner", False, "verify/mobile", "detect, analyse and build mobile projects"),
    ("scan", False, "security.scan/mobile-config", "unsafe settings of mobile projects"),
    ("runner", False, "verify/desktop", "detect, analyse and build desktop projects"),
    ("scan", False, "security.scan/injection", "raw markup and built queries"),
    ("scan", False, "security.scan/iac", "unsafe settings of containers and clusters"),
    ("runner", False, "security.scan/deps", "known vulnerabilities of locked dependencies"),
    ("codeintel", False, "security.scan/sast", "dangerous calls by the shape of their arguments"),
    ("codeintel", False, "security.scan/taint", "untrusted data that reaches a sink"),
    ("scan", False, "security.scan/web", "web security patterns"),
    ("scan", False, "security.scan/api", "interface security patterns"),
    ("scan", False, "security.ai/prompt-injection", "untrusted input within prompts"),
    ("scan", False, "security.ai/insecure-output", "model output that is run or shown raw"),
    ("scan", False, "security.ai/insecure-output-taint", "variables of model output within functions"),
    ("runner", False, "verify/coverage", "run the coverage tool"),
    ("codeintel", False, "verify/symbol", "whether a name exists, within its container"),
    ("codeintel", False, "quality.check/antipattern", "files with too many definitions or too deep nesting"),
    ("generator", True, "generate/adr", "write a decision record"),
    ("store", False, "deliver/branch-name", "a branch name from a title"),
    ("runner", False, "deliver/commit-draft", "a commit message from what is staged"),
    ("generator", True, "setup/init", "write the folder of settings"),
    ("scan", False, "quality.check/completeness", "stubs and empty handlers"),
    ("codeintel", False, "quality.check/undocumented", "share of public definitions with comments"),
    ("codeintel", False, "code.intel/surface", "routes, settings, services and models"),
    ("generator", True, "generate/spec", "write a specification"),
    ("generator", True, "generate/architecture", "write an architecture document"),
    ("generator", True, "generate/c4", "write the levels of an architecture as diagrams"),
    ("generator", True, "generate/data-model", "write the list of models"),
    ("generator", True, "generate/glossary", "write a glossary of types"),
    ("codeintel", False, "spec.check/drift", "documents that no longer match the code"),
    ("generator", True, "spec/feature", "write a feature's specification"),
    ("generator", True, "generate/api-baseline", "keep the public interface"),
    ("codeintel", False, "verify/api-break", "what was taken from the public interface"),
    ("codeintel", False, "code.intel/diff-scope", "what a change reaches through calls"),
    ("generator", True, "generate/sbom", "write a bill of materials"),
    ("scan", False, "security.scan/licenses", "copyleft licences of dependencies"),
    ("generator", True, "generate/release-notes", "group commits by type"),
    ("generator", True, "setup/cicd", "write a workflow"),
    ("scan", False, "compliance.ru/pdn-logs", "personal data in log calls"),
    ("scan", False, "compliance.ru/localization", "databases and regions abroad"),
    ("scan", False, "compliance.ru/cross-border", "trackers abroad"),
    ("scan", False, "compliance.ru/consent", "consent that is given beforehand"),
    ("scan", False, "compliance.ru/gost-crypto", "foreign cryptographic primitives"),
    ("codeintel", False, "compliance.ru/pdn-logs-ast", "personal data in log calls by syntax"),
    ("store", False, "memory/read", "list what is remembered"),
    ("store", True, "memory/update", "remember something"),
    ("store", True, "memory/decision-log", "add a decision"),
    ("store", True, "backlog/add", "add an item of work"),
    ("store", False, "backlog/list", "list items of work"),
    ("scan", False, "quality.ui/a11y-markup", "markup that assistive tools can't read"),
    ("scan", False, "quality.ui/responsive", "pages without a usable viewport"),
    ("scan", False, "quality.ui/dark-theme", "fixed colours without a dark theme"),
    ("scan", False, "quality.ui/focus-visible", "removed focus outlines"),
    ("scan", False, "quality.ui/touch-target", "touch targets that are too small"),
    ("scan", False, "quality.ui/native-a11y", "native interfaces that assistive tools can't read"),
)
ENTERPRISE = ("security.scan/sast", "security.scan/taint", "compliance.ru/gost-crypto")


def registry(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "ordinal int, engine string, mutates boolean, id string, when_to_use string")
    return df.withColumn("family", F.substring_index("id", "/", 1)).withColumn("tier", F.when(F.col("id").isin(*ENTERPRISE), "enterprise").otherwise("core"))


def selected(registry_: DataFrame, families: list[str], tier: str = "enterprise", mutating: bool = False) -> DataFrame:
    """Analyses of the families that a policy names, within a tier, those that write only on request."""
    wanted = F.lit(False)
    for f in families:
        wanted = wanted | F.col("family").startswith(f)
    return registry_.where(wanted & (F.lit(tier == "enterprise") | (F.col("tier") == "core")) & (F.lit(mutating) | ~F.col("mutates")))
