"""What a project is made of: stack, entry points, containers, calls abroad; documents generated from it and their drift."""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import diagram_label, module_of, without_credentials
from tessera.operators.gate import Policy
from tessera.operators.graph import cut, stored
from tessera.sources.files import is_test_path

#: Files that mark a stack, and endings that do.
MARKERS = {
    "Cargo.toml": "Rust", "go.mod": "Go", "package.json": "Node/JS/TS", "pyproject.toml": "Python", "requirements.txt": "Python", "setup.py": "Python", "pom.xml": "Java/Maven", "build.gradle": "JVM/Gradle",
    "build.gradle.kts": "Kotlin/Gradle", "build.sbt": "Scala/sbt", "Gemfile": "Ruby", "composer.json": "PHP", "Package.swift": "Swift/SwiftPM", "Podfile": "iOS/CocoaPods", "pubspec.yaml": "Flutter/Dart",
    "CMakeLists.txt": "C/C++ (CMake)", "Makefile": "Make",
}
ENDINGS = {".csproj": "C#/.NET", ".sln": "C#/.NET", ".xcodeproj": "Swift/Xcode"}


def stacks(files: DataFrame) -> DataFrame:
    """(stack, n): stacks by their marker files in the root folder; a folder that marks one counts by any file below it."""
    names = F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv])
    top = F.regexp_extract("path", r"^([^/]*)", 1)
    stack = F.when(top == F.col("path"), F.element_at(names, top))
    for ending, name in ENDINGS.items():
        stack = F.coalesce(stack, F.when(top.endswith(ending), F.lit(name)))
    return files.select(stack.alias("stack"), top.alias("marker")).where("stack IS NOT NULL").distinct().groupBy("stack").agg(F.count("*").alias("n"))


def entry_points(lines: DataFrame) -> DataFrame:
    """(path): files that start a program, tests aside."""
    named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(r"^(main|index|app|server|manage|__main__)\.[a-z]+$")
    main = F.col("line").rlike(r"^\s*(?:func main\(|fn main\(|if __name__ ==|public static void main|int main\(|fun main\()")
    return lines.where(~is_test_path(F.col("path"))).groupBy("path").agg(F.bool_or(named | main).alias("entry")).where("entry").select("path")


#: Extensions by how their comments begin; those of all others begin with two slashes.
HASH, SLASH = ("py", "rb", "ex", "exs"), ("go", "rs", "ts", "tsx", "js", "jsx", "mjs", "cjs", "java", "kt", "kts", "swift", "cs", "c", "cc", "cpp", "h", "hpp", "scala", "dart")
_STRINGS = r""""(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)"""
_BLOCK, _SLASHES, _HASHES, _TRIPLE = r"/\*.*?(?:\*/|\Z)", r"//[^\n]*", r"#[^\n]*", r'"""' + r'.*?(?:"""|\Z)'


def hidden(ext: str) -> re.Pattern:
    """Comments and strings of a language."""
    kinds = [_TRIPLE] if ext == "py" else [_BLOCK] if ext in (*SLASH, "php") else []
    kinds += {"php": [_SLASHES, _HASHES], "clj": [r";[^\n]*"]}.get(ext, [_HASHES] if ext in HASH else [_SLASHES])
    return re.compile("|".join([*kinds, _STRINGS]), re.S)


def masked(content: Column, ext: Column) -> Column:
    """The text with every character of its comments and strings blanked, line feeds aside: what is left is code, at its
    place. One pass of one pattern a text, in Arrow batches."""

    @F.pandas_udf("string")
    def blanked(texts: pd.Series, exts: pd.Series) -> pd.Series:
        patterns = {e: hidden(e) for e in exts.unique()}
        blank = re.compile(r"[^\n]")
        return pd.Series([None if t is None else patterns[e].sub(lambda m: blank.sub(" ", m[0]), t) for t, e in zip(texts, exts, strict=True)])

    return blanked(content, ext)


def rust_test_regions(lines: DataFrame) -> DataFrame:
    """(path, line_no): lines of Rust modules under a test attribute, up to the brace that closes them at their indent."""
    frame = Window.partitionBy("path").orderBy("line_no")
    mark = lines.where("ext = 'rs'").withColumn("opens", F.lag(F.trim("line")).over(frame).startswith("#[cfg(test)]"))
    indent = F.length(F.regexp_extract("line", r"^(\s*)", 1))
    opened = F.last(F.when(F.col("opens"), F.struct("line_no", indent.alias("i"))), ignorenulls=True).over(frame.rowsBetween(Window.unboundedPreceding, 0))
    placed = mark.withColumn("open", opened).where("open IS NOT NULL")
    close = placed.where((F.trim("line") == "}") & (F.length(F.regexp_extract("line", r"^(\s*)", 1)) == F.col("open.i"))).groupBy(F.col("path").alias("file"), F.col("open.line_no").alias("at")).agg(F.min("line_no").alias("until"))
    return placed.join(close, (F.col("path") == F.col("file")) & (F.col("open.line_no") == F.col("at")) & (F.col("line_no") <= F.col("until"))).select("path", "line_no")


def containers(lines: DataFrame) -> DataFrame:
    """(kind, name, path): base images, the services of compose files, and the objects of cluster files by kind and name."""
    image = F.regexp_extract("line", r"(?i)^\s*FROM\s+(\S+)", 1)
    base = lines.where("ext = 'dockerfile'").select(F.lit("image").alias("kind"), image.alias("name"), "path").where("name <> ''")
    frame = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    top = F.nullif(F.regexp_extract("line", r"^(\w+):", 1), F.lit(""))
    compose = lines.where(F.col("ext").isin("yml", "yaml")).withColumn("section", F.last(top, ignorenulls=True).over(frame))
    service = compose.where("section = 'services'").select(F.lit("service").alias("kind"), F.regexp_extract("line", r"^  ([\w\-]+):\s*$", 1).alias("name"), "path").where("name <> ''")
    # Documents of a file are parted by three dashes; within one, the first kind and the first name below metadata count.
    part = F.sum((F.trim("line") == "---").cast("int")).over(frame)
    told = compose.withColumn("part", part).groupBy("path", "part").agg(
        F.min_by(F.regexp_extract("line", r"^kind:\s*(\w+)", 1), F.when(F.col("line").rlike(r"^kind:\s*\w"), F.col("line_no"))).alias("object"),
        F.min_by(F.regexp_extract("line", r"^  name:\s*[\"']?([\w.\-]+)", 1), F.when((F.col("section") == "metadata") & F.col("line").rlike(r"^  name:"), F.col("line_no"))).alias("called"))
    objects = told.where("object <> '' AND called <> ''").select(F.lit("object").alias("kind"), F.concat_ws("/", "object", "called").alias("name"), "path")
    return base.unionByName(service).unionByName(objects).distinct()


CALLS = ((r"(?:requests|httpx|axios|http)\.(?:get|post|put|delete|patch)\(\s*[rbf]?['\"`]([^'\"`]+)", "http"), (r"\bfetch\(\s*['\"`]([^'\"`]+)", "http"), (r"http\.(?:Get|Post|NewRequest)\([^\"]*\"([^\"]+)\"", "http"), (r"grpc\.(?:Dial|NewClient|insecure_channel)\(\s*['\"]([^'\"]+)", "rpc"), (r"@FeignClient\([^)]*\"([^\"]+)\"", "feign"), (r"(?:WebClient|RestTemplate).*\"(https?://[^\"]+)\"", "http"), (r"reqwest::(?:get|Client).*\"(https?://[^\"]+)\"", "http"))


def outbound_calls(lines: DataFrame) -> DataFrame:
    """(module, target, protocol, path, line_no)"""
    hits = F.array_compact(F.array(*[F.when(F.length(F.regexp_extract("line", p, 1)) > 0, F.struct(F.regexp_extract("line", p, 1).alias("target"), F.lit(k).alias("protocol"))) for p, k in CALLS]))
    found = lines.where(~is_test_path(F.col("path"))).select("path", "line_no", F.explode(hits).alias("h"))
    return found.select(module_of(F.col("path")).alias("module"), without_credentials(F.col("h.target")).alias("target"), "h.protocol", "path", "line_no").distinct()


#: Calls whose result is a model's output, and what must not get it.
MODEL_CALLS = (
    "openai", "anthropic", "chatcompletion", "chat.completions", ".messages.create", "client.messages", ".generate(", "generatecontent", ".complete(", ".completion(", ".invoke(", ".predict(", "llm(", ".chat(", ".ask(",
)


def regions(lines: DataFrame) -> DataFrame:
    """Lines with `region`: the first line of the top-level block that a line is in, 0 for statements outside any. Python has a block
    from a definition at the margin to the next line at the margin; in the other languages, braces say where it ends."""
    running = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    change = F.length(F.regexp_replace("line", r"[^{]", "")) - F.length(F.regexp_replace("line", r"[^}]", ""))
    depth = F.sum(change).over(running)
    at_margin = F.when(F.col("ext") == "py", F.col("line").rlike(r"^[^\s#)\]}]")).otherwise((depth - change <= 0) & (F.trim("line") != ""))
    opens = F.when(F.col("ext") == "py", F.col("line").rlike(r"^(?:async\s+)?(?:def|class)\b")).otherwise(depth > 0)
    marked = lines.withColumn("start", F.when(at_margin, F.when(opens, F.col("line_no")).otherwise(0)))
    return marked.withColumn("region", F.coalesce(F.last("start", ignorenulls=True).over(running), F.lit(0))).drop("start")


def model_output_findings(lines: DataFrame) -> DataFrame:
    """(path, line_no, rule, severity): variables that hold model output, directly or by any number of aliases, and reach an exec
    or a raw markup sink further down in the same region. A line is tested before what it assigns counts, so none taints itself."""
    region = regions(lines.where(F.col("ext").isin("py", "js", "ts", "jsx", "tsx")))
    called = F.lit(False)
    for c in MODEL_CALLS:
        called = called | F.lower("line").contains(c)
    name = F.regexp_extract("line", r"^\s*(?:const|let|var)?\s*(\w+)\s*=[^=]", 1)
    region = stored(region.withColumn("to", name))
    assigned = region.where("to <> ''").select("path", "region", "to", F.regexp_extract("line", r"=\s*(?:await\s+)?(\w+)[.\[]?", 1).alias("var"), "line_no")
    tainted = new = cut(region.where(called & (F.col("to") != "")).select("path", "region", F.col("to").alias("var"), F.col("line_no").alias("since")).distinct())
    while not new.isEmpty():
        step = assigned.join(new, ["path", "region", "var"]).where("line_no > since").select("path", "region", F.col("to").alias("var"), F.col("line_no").alias("since")).distinct()
        new = cut(step.join(tainted, ["path", "region", "var", "since"], "left_anti"))
        tainted = cut(tainted.unionByName(new))
    met = region.join(tainted, ["path", "region"]).where("line_no > since")
    in_call = F.expr(r"line RLIKE concat('(?:\\beval|\\bexec|subprocess\\.\\w+|os\\.system|child_process\\.\\w+)\\([^)]*\\b', var, '\\b')")
    shown = F.expr(r"line RLIKE '(?:innerHTML\\s*=|dangerouslySetInnerHTML|document\\.write\\()' AND line RLIKE concat('\\b', var, '\\b')")
    rule = F.when(in_call, "taint-llm-output-exec").when(shown, "taint-llm-output-raw-html")
    return met.withColumn("rule", rule).where("rule IS NOT NULL").select("path", "line_no", "rule", F.when(F.col("rule") == "taint-llm-output-exec", 4).otherwise(3).alias("severity")).distinct()


def load_policy(text: str, pin: str | None = None, trusted: Policy | None = None) -> tuple[Policy, list[str]]:
    """A policy from TOML and what is wrong with it; any fault gives the default policy whole. A pin is the text's SHA-256.
    A trusted policy, which comes from outside the project, stands where the project's would let more pass."""
    if trusted is not None:
        own, faults = load_policy(text, pin)
        weaker = own.weaker_than(trusted)
        return (trusted, [*faults, *weaker]) if weaker or faults else (own, [])
    if pin and hashlib.sha256(text.encode()).hexdigest() != pin:
        return Policy(), ["the text does not match its pin"]
    try:
        raw = tomllib.loads(text)
        names = ("info", "low", "medium", "high", "critical")
        policy = Policy()
        if "block_at" in raw:
            policy = replace(policy, block_at=names.index(str(raw["block_at"]).lower()))
        if "weights" in raw:
            policy = replace(policy, weights=tuple(raw["weights"].get(n, w) for n, w in zip(names, policy.weights, strict=True)))
    except (tomllib.TOMLDecodeError, ValueError, AttributeError) as fault:
        return Policy(), [str(fault)]
    return (Policy(), faults) if (faults := policy.problems()) else (policy, [])


def glossary(symbols: DataFrame, most: int = 60) -> DataFrame:
    """(name, path): public types of three letters or more, the first of each name, in order; a report of `most` rows."""
    first = Window.partitionBy("name").orderBy("path", "line_no")
    types = symbols.where("exported AND kind IN ('class', 'type') AND length(name) >= 3").withColumn("k", F.row_number().over(first)).where("k = 1")
    return types.select("name", "path").orderBy("name").limit(most)


def module_graph(edges: DataFrame, symbols: DataFrame, modules: int = 12, most_edges: int = 30) -> DataFrame:
    """(diagram): the modules with most definitions, ties by name, and the edges between them."""
    top = symbols.groupBy(module_of(F.col("path")).alias("module")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "module").limit(modules)
    inside = edges.join(top.select(F.col("module").alias("src")), "src", "left_semi").join(top.select(F.col("module").alias("dst")), "dst", "left_semi").orderBy("src", "dst").limit(most_edges)
    line = F.concat(F.lit('  "'), diagram_label(F.col("src")), F.lit('" --> "'), diagram_label(F.col("dst")), F.lit('"'))
    return inside.agg(F.array_join(F.concat(F.array(F.lit("graph LR")), F.sort_array(F.collect_list(line))), "\n").alias("diagram"))


def drift(stored: DataFrame, generated: DataFrame) -> DataFrame:
    """(name, rule): blocks (name, body) that differ from what would be generated, and those that are missing."""
    both = generated.select("name", F.col("body").alias("now")).join(stored.select("name", F.col("body").alias("then")), "name", "left")
    rule = F.when(F.col("then").isNull(), "doc-missing").when(F.trim("then") != F.trim("now"), "doc-drift")
    return both.select("name", rule.alias("rule")).where("rule IS NOT NULL")


def fix_accepted(before: DataFrame, after: DataFrame, rule: str) -> DataFrame:
    """(accepted): a fix stands if its rule has fewer findings and there are no more in all."""
    counts = lambda df, p: df.agg(F.count("*").alias(f"{p}_all"), F.count_if(F.col("rule") == rule).alias(f"{p}_rule"))
    return counts(before, "b").crossJoin(counts(after, "a")).select(((F.col("a_rule") < F.col("b_rule")) & (F.col("a_all") <= F.col("b_all"))).alias("accepted"))


def obligations(rules: DataFrame, flags: list[str]) -> DataFrame:
    """Rules (id, flag, text) of the flags that a profile has; those without a flag hold for all."""
    return rules.where(F.col("flag").isNull() | F.col("flag").isin(*flags)).select("id", "text")


#: Fixed values: (kind, platform, pattern of the paths that mark it).
PLATFORMS = (
    ("mobile", "android", r"(^|/)AndroidManifest\.xml$"), ("mobile", "ios", r"(^|/)[^/]+\.xcodeproj(/|$)|(^|/)Podfile$"), ("mobile", "flutter", r"(^|/)pubspec\.yaml$"),
    ("desktop", "tauri", r"(^|/)tauri\.conf\.json$"), ("desktop", "electron", r"(^|/)electron(?:-builder)?\.(?:json|js|yml|config\.[jt]s)$"),
)


def platforms(files: DataFrame) -> DataFrame:
    """(kind, platform, folder): mobile and desktop projects, nested ones too, by their marker files."""
    hits = F.array_compact(F.array(*[F.when(F.col("path").rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(n).alias("platform"))) for k, n, p in PLATFORMS]))
    return files.select(F.explode(hits).alias("h"), module_of(F.col("path")).alias("folder")).select("h.kind", "h.platform", "folder").distinct()


def coverage_tool(files: DataFrame) -> DataFrame:
    """(stack, command): how the stacks found measure coverage."""
    #: Commands by stack.
    plans = {"Rust": "cargo llvm-cov", "Go": "go test -cover ./...", "Python": "python -m pytest --cov", "Node/JS/TS": "npm test -- --coverage", "Java/Maven": "mvn verify", "JVM/Gradle": "gradle test jacocoTestReport", "C#/.NET": "dotnet test --collect:\"XPlat Code Coverage\"", "Ruby": "bundle exec rspec", "PHP": "vendor/bin/phpunit --coverage-text", "Flutter/Dart": "flutter test --coverage"}
    command = F.element_at(F.create_map(*[F.lit(x) for kv in plans.items() for x in kv]), F.col("stack"))
    return stacks(files).select("stack", command.alias("command")).where("command IS NOT NULL")


def changed_files(text: str) -> list[tuple[str, str]]:
    """(path, status) of `git diff --name-status` or `--name-only`; a rename counts by its new name."""
    out = []
    for line in text.splitlines():
        cells = line.strip().split("\t")
        if cells and cells[-1]:
            out.append((cells[-1], cells[0][:1] if len(cells) > 1 else "M"))
    return out


def load_vulnerabilities(text: str, digest: str | None = None) -> list[tuple]:
    """(id, ecosystem, package, introduced, fixed, severity) of a JSON snapshot: a list, or an object with a list `vulns`. A
    text that does not match its SHA-256, or a record without its parts, is an error: a damaged base would hide matches."""
    if digest and hashlib.sha256(text.encode()).hexdigest() != digest:
        raise ValueError("the snapshot does not match its digest")
    found = json.loads(text)
    records = found.get("vulns", []) if isinstance(found, dict) else found
    out = []
    for r in records:
        if not all(isinstance(r.get(k), str) and r[k] for k in ("id", "ecosystem", "package")):
            raise ValueError(f"a record lacks its id, ecosystem or package: {r}")
        out.append((r["id"], r["ecosystem"], r["package"], r.get("introduced"), r.get("fixed"), r.get("severity") or "MED"))
    return out
