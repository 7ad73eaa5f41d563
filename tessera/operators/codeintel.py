"""What code and text consist of: identifiers, size and complexity, nesting, symbols, routes, settings, API and layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import module_of, occurrences, without_credentials
from tessera.sources.files import is_test_path, language

#: Tokens that open a branch, counted per line without overlap.
BRANCHES = (" if ", " elif ", " for ", " while ", " case ", " match ", " when ", "catch", " and ", " or ", "&&", "||")
LONG_FILE, COMPLEX_FILE, MANY_DEFS, DEEP = 400, 50, 30, 6
IDENTIFIER = r"([\p{L}_][\p{L}\p{N}_]+)"


def identifiers(files: DataFrame) -> DataFrame:
    """(ident, n): identifiers of two characters or more."""
    return files.select(F.explode(F.regexp_extract_all("content", F.lit(IDENTIFIER), F.lit(1))).alias("ident")).groupBy("ident").agg(F.count("*").alias("n"))


def complexity(line: Column) -> Column:
    total = F.lit(0)
    for token in BRANCHES:
        total = total + occurrences(line, token)
    return total


def file_metrics(lines: DataFrame) -> DataFrame:
    """(path, n_lines, complexity): one more than the branch tokens."""
    return lines.groupBy("path").agg(F.count("*").alias("n_lines"), (1 + F.sum(complexity(F.col("line")))).cast("bigint").alias("complexity"))


def metric_totals(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("*").alias("files"), F.sum("n_lines").alias("lines"), F.sum("complexity").alias("complexity"), F.max("complexity").alias("most"))


def top_complex(metrics: DataFrame, n: int = 10) -> DataFrame:
    return metrics.orderBy(F.desc("complexity"), "path").limit(n)


def metric_findings(metrics: DataFrame) -> DataFrame:
    long_, complex_ = F.col("n_lines") > LONG_FILE, F.col("complexity") > COMPLEX_FILE
    hits = F.array_compact(F.array(F.when(long_, F.struct(F.lit("long-file").alias("rule"), F.lit(1).alias("severity"))), F.when(complex_, F.struct(F.lit("high-complexity").alias("rule"), F.lit(2).alias("severity")))))
    return metrics.select("path", F.explode(hits).alias("f")).select("path", "f.rule", "f.severity")


def deepest(lines: DataFrame) -> DataFrame:
    """(path, depth, line_no): the deepest indent of a file in its own unit, and the first line that reaches it."""
    solid = lines.where(F.trim("line") != "").withColumn("indent", F.length(F.regexp_replace(F.regexp_extract("line", r"^([ \t]*)", 1), "\t", "    ")))
    first = solid.groupBy("path", "indent").agg(F.min("line_no").alias("line_no"))
    levels = first.groupBy("path").agg(F.coalesce(F.min(F.when(F.col("indent") > 0, F.col("indent"))), F.lit(1)).alias("unit"), F.collect_list(F.struct("indent", "line_no")).alias("levels"))
    depth = lambda x: F.floor(x["indent"] / F.col("unit")).cast("int")
    most = F.array_max(F.transform("levels", depth))
    return levels.select("path", most.alias("depth"), F.array_min(F.transform(F.filter("levels", lambda x: depth(x) == most), lambda x: x["line_no"])).alias("line_no"))


#: Definitions by language: (kind, pattern of the name, pattern of what makes it public).
DEFINITIONS = {
    "python": (("class", r"^\s*class\s+(\w+)", r"^\s*class\s+[^_]"), ("function", r"^(?:async\s+)?def\s+(\w+)", r"def\s+[^_]"), ("method", r"^\s+(?:async\s+)?def\s+(\w+)", r"def\s+[^_]")),
    "go": (("function", r"^func\s+(\w+)", r"^func\s+[A-Z]"), ("method", r"^func\s+\([^)]*\)\s*(\w+)", r"\)\s*[A-Z]"), ("type", r"^type\s+(\w+)", r"^type\s+[A-Z]")),
    "rust": (("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", r"^\s*pub\b"), ("type", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)", r"^\s*pub\b")),
    "javascript": (("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)", r"^\s*export\b"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)", r"^\s*export\b")),
    "typescript": (("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)", r"^\s*export\b"), ("class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)", r"^\s*export\b"), ("type", r"^\s*(?:export\s+)?(?:interface|type|enum)\s+(\w+)", r"^\s*export\b")),
    "java": (("class", r"\b(?:class|interface|enum|record)\s+(\w+)", r"\bpublic\b"), ("method", r"^\s*(?:public|protected|private)\s+(?:static\s+)?[\w<>\[\]]+\s+(\w+)\s*\(", r"\bpublic\b")),
    "csharp": (("class", r"\b(?:class|interface|enum|struct|record)\s+(\w+)", r"\bpublic\b"), ("method", r"^\s*(?:public|protected|private|internal)\s+(?:static\s+|async\s+)*[\w<>\[\]]+\s+(\w+)\s*\(", r"\bpublic\b")),
    "kotlin": (("function", r"^\s*(?:public\s+|internal\s+|private\s+)?(?:suspend\s+)?fun\s+(\w+)", r"^(?!\s*(?:private|internal))"), ("class", r"\b(?:class|interface|object)\s+(\w+)", r"^(?!\s*(?:private|internal))")),
    "swift": (("function", r"\bfunc\s+(\w+)", r"\b(?:public|open)\b"), ("class", r"\b(?:class|struct|enum|protocol)\s+(\w+)", r"\b(?:public|open)\b")),
    "scala": (("function", r"\bdef\s+(\w+)", r"^(?!\s*private)"), ("class", r"\b(?:class|object|trait)\s+(\w+)", r"^(?!\s*private)")),
    "ruby": (("class", r"^\s*(?:class|module)\s+(\w+)", r"."), ("method", r"^\s*def\s+(?:self\.)?(\w+)", r".")),
    "php": (("function", r"\bfunction\s+(\w+)", r"^(?!.*\b(?:private|protected)\b)"), ("class", r"\b(?:class|interface|trait)\s+(\w+)", r".")),
    "dart": (("class", r"^\s*(?:abstract\s+)?class\s+(\w+)", r"class\s+[^_]"),),
    "c": (("function", r"^[\w*]+[\w\s*]*\s\*?(\w+)\s*\([^;]*$", r"^(?!static)"), ("type", r"^(?:typedef\s+)?(?:struct|enum|union)\s+(\w+)", r".")),
    "cpp": (("function", r"^[\w:*&<>]+[\w\s:*&<>]*\s[*&]?(\w+)\s*\([^;]*$", r"^(?!static)"), ("type", r"^\s*(?:class|struct|enum)\s+(\w+)", r".")),
}


def defined(text: Column, kind: str, pattern: str, public: str) -> Column:
    """All that a pattern defines on a line."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda name: F.struct(F.lit(kind).alias("kind"), name.alias("name"), text.rlike(public).alias("exported")))


def symbols(lines: DataFrame) -> DataFrame:
    """(path, line_no, lang, kind, name, exported) of definitions, by line patterns: all on a line, each name once."""
    found = F.array().cast("array<struct<kind:string,name:string,exported:boolean>>")
    text = F.col("line")
    for lang, rows in DEFINITIONS.items():
        here = F.flatten(F.array(*[defined(text, k, p, public) for k, p, public in rows]))
        found = F.when(F.col("lang") == lang, here).otherwise(found)
    tagged = lines.withColumn("lang", language(F.col("ext"))).where(F.col("lang").isin(*DEFINITIONS))
    told = tagged.select("path", "line_no", "lang", found.alias("all")).where(F.size("all") > 0)
    new = F.filter("all", lambda s, i: ~F.exists(F.slice("all", 1, i), lambda t: t["name"] == s["name"]))
    return told.select("path", "line_no", "lang", F.explode(new).alias("s")).select("path", "line_no", "lang", "s.kind", "s.name", "s.exported")


def module_cards(symbols_: DataFrame, shown: int = 5) -> DataFrame:
    """Per folder: definitions, public ones, languages, the first public names in order of appearance."""
    s = symbols_.withColumn("module", module_of(F.col("path")))
    first = Window.partitionBy("module").orderBy("path", "line_no", "name")
    top = s.where("exported").withColumn("k", F.row_number().over(first)).where(F.col("k") <= shown)
    names = top.groupBy("module").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("first_exports"))
    counts = s.groupBy("module").agg(F.count("*").alias("n"), F.count_if("exported").alias("n_exported"), F.sort_array(F.collect_set("lang")).alias("langs"))
    return counts.join(names, "module", "left").select("module", "n", "n_exported", "langs", F.coalesce("first_exports", F.array().cast("array<string>")).alias("first_exports"))


def symbol_counts(symbols_: DataFrame) -> DataFrame:
    """(level, name, n, n_exported): definitions by language, by file and by folder."""
    s = symbols_.withColumn("module", module_of(F.col("path")))
    out = s.groupingSets([["lang"], ["path"], ["module"]], "lang", "path", "module").agg(F.count("*").alias("n"), F.count_if("exported").alias("n_exported"))
    level = F.when(F.col("lang").isNotNull(), "language").when(F.col("path").isNotNull(), "file").otherwise("module")
    return out.select(level.alias("level"), F.coalesce("lang", "path", "module").alias("name"), "n", "n_exported")


def folder_map(lines: DataFrame, symbols_: DataFrame) -> DataFrame:
    """(folder, files, lines, langs, symbols): what the folders of a project hold."""
    tagged = lines.withColumn("lang", language(F.col("ext"))).where("lang <> 'text'").withColumn("folder", module_of(F.col("path")))
    held = tagged.groupBy("folder", "path", "lang").agg(F.count("*").alias("lines")).groupBy("folder").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sort_array(F.collect_set("lang")).alias("langs"))
    counted = symbols_.groupBy(module_of(F.col("path")).alias("folder")).agg(F.count("*").alias("symbols"))
    return held.join(counted, "folder", "left").select("folder", "files", "lines", "langs", F.coalesce("symbols", F.lit(0)).alias("symbols"))


def homonyms(symbols_: DataFrame) -> DataFrame:
    """(name, n): names that several definitions bear."""
    return symbols_.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def dead_exports(symbols_: DataFrame, files: DataFrame) -> DataFrame:
    """Public definitions, methods aside, whose name occurs nowhere else; tests and entry points are none."""
    from tessera.operators.graph import is_entry

    once = symbols_.where("exported AND kind <> 'method'").where(~is_test_path(F.col("path")) & ~is_entry(F.col("name"), F.col("path")))
    return once.join(identifiers(files), F.col("name") == F.col("ident"), "left").where(F.coalesce("n", F.lit(0)) <= 1).select("path", "line_no", "name")


def god_files(symbols_: DataFrame) -> DataFrame:
    return symbols_.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > MANY_DEFS)


def find_usages(lines: DataFrame, name: str, cap: int = 500) -> tuple[DataFrame, DataFrame]:
    """Lines that hold the whole word, the first `cap` of them, and their true number."""
    hits = lines.where(F.col("line").rlike(rf"(?U)(?<![\w]){name}(?![\w])"))
    return hits.orderBy("path", "line_no").limit(cap), hits.agg(F.count("*").alias("total"))


def symbol_in_container(symbols_: DataFrame, container: str, leaf: str) -> DataFrame:
    """Definitions of leaf with a definition of container at or above them in the same file: a self join on a range."""
    a, b = symbols_.where(F.col("name") == leaf).alias("a"), symbols_.where(F.col("name") == container).alias("b")
    return a.join(b, (F.col("a.path") == F.col("b.path")) & (F.col("b.line_no") <= F.col("a.line_no")), "left_semi")


def documentation(lines: DataFrame, symbols_: DataFrame, head_lines: int = 6) -> DataFrame:
    """Public symbols with `documented`. In Python a docstring is the first line of the body, whose head may take some lines; in
    other languages a comment stands right above, decorators and attributes aside, and a blank line ends the search."""
    frame = Window.partitionBy("path").orderBy("line_no")
    text = F.trim("line")
    above = F.last(F.when(~text.rlike(r"^(?:@|#\[)"), text), ignorenulls=True).over(frame.rowsBetween(Window.unboundedPreceding, -1))
    below = F.collect_list(text).over(frame.rowsBetween(0, head_lines))
    near = lines.select("path", "line_no", above.alias("above"), below.alias("below"))
    s = symbols_.where("exported").join(near, ["path", "line_no"], "left")
    commented = F.coalesce(F.col("above").rlike(r"^(?://|/\*|\*|#)"), F.lit(False))
    head = F.array_position(F.transform(F.slice("below", 1, head_lines), lambda x: x.endswith(":")), True).cast("int")
    opened = F.coalesce((head > 0) & F.get("below", head).rlike("^r?(?:\"{3}|'{3})"), F.lit(False))
    return s.select(*symbols_.columns, F.when(F.col("lang") == "python", opened).otherwise(commented).alias("documented"))


def documented(lines: DataFrame, symbols_: DataFrame) -> DataFrame:
    """One row: public symbols, those that are documented, and the share in percent."""
    s = documentation(lines, symbols_)
    return s.agg(F.count("*").alias("n"), F.count_if("documented").alias("n_documented")).withColumn("percent", F.when(F.col("n") > 0, 100.0 * F.col("n_documented") / F.col("n")))


VERBS = "get|post|put|delete|patch|head|options"
#: Patterns for what a program offers and needs; group 1 is the value, and of a route with two groups the method stands first.
ROUTES = (
    r"(?i)\b\w+\.(" + VERBS + r")\(\s*['\"`](/[^'\"`]*)['\"`]",  # Express, Ktor, Vapor with a path, echo
    r"@\w+\.(?:route|" + VERBS + r"|websocket)\(\s*['\"]([^'\"]+)['\"]",  # Flask, FastAPI
    r"@(?:Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\{?\"([^\"]+)\"",  # Spring
    r"\.route\(\s*\"([^\"]+)\"",  # Axum
    r"\b(?:re_)?path\(\s*r?['\"]([^'\"]*)['\"]",  # Django
    r"@(?:Get|Post|Put|Delete|Patch|All)\(\s*['\"`]([^'\"`]*)['\"`]",  # NestJS
    r"\[Http(?:Get|Post|Put|Delete|Patch)\(\"([^\"]+)\"", r"\[Route\(\"([^\"]+)\"", r"\.Map(?:Get|Post|Put|Delete|Patch)\(\s*\"([^\"]+)\"",  # ASP.NET
    r"Route::(?:" + VERBS + r"|any|resource)\(\s*['\"]([^'\"]+)['\"]",  # Laravel
    r"^\s*(?:get|post|put|delete|patch)\s+['\"]([^'\"]+)['\"]", r"^\s*resources?\s+:(\w+)",  # Rails
    r"\b(?:app|routes)\.(?:" + VERBS + r")\(\s*\"([^/\"][^\"]*)\"",  # Vapor
    r"^\s*(?:get|post|put|delete|patch)\(\s*\"([^\"]+)\"",  # Ktor
    r"\b\w+\.(?:GET|POST|PUT|DELETE|PATCH)\(\s*\"([^\"]+)\"",  # Go
    r"^\s*rpc\s+(\w+)\s*\(",  # gRPC
    r"^(?:GET|POST|PUT|DELETE|PATCH)\s+(/\S*)\s+\S",  # Play
)
SETTINGS = (
    r"os\.environ(?:\.get\(|\[)\s*['\"](\w+)['\"]", r"os\.getenv\(\s*['\"](\w+)['\"]", r"process\.env\.(\w+)", r"process\.env\[\s*['\"](\w+)['\"]", r"import\.meta\.env\.(\w+)", r"os\.(?:Getenv|LookupEnv)\(\s*\"(\w+)\"",
    r"env::var(?:_os)?\(\s*\"(\w+)\"", r"\benv!\(\s*\"(\w+)\"", r"System\.getenv\(\s*\"(\w+)\"", r"\bENV(?:\[|\.fetch\()\s*['\"](\w+)['\"]", r"(?<![\w.])(?:std::)?getenv\(\s*['\"](\w+)['\"]", r"\$_ENV\[\s*['\"](\w+)['\"]",
    r"Environment\.GetEnvironmentVariable\(\s*\"(\w+)\"", r"sys\.env(?:\.get)?\(\s*\"(\w+)\"", r"(?:ProcessInfo\.processInfo|Platform)\.environment\[\s*['\"](\w+)['\"]",
)
SERVICES = (
    r"((?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis(?:s)?|amqps?|kafka)://[^\s'\"`]+)", r"(https?://(?:[^/@\s'\"`]+@)?[a-z0-9.\-]+\.[a-z]{2,}[^\s'\"`]*)", r"(grpcs?://[^\s'\"`]+)", r"(wss?://[^\s'\"`]+)", r"(nats://[^\s'\"`]+)", r"(s3://[^\s'\"`]+)",
)
#: Settings whose name says that a service stands behind them.
SERVICE_SETTING = r"(?:_URL|_URI|_DSN|_HOST|_ENDPOINT|_BROKERS?)$"
MODELS = (
    r"^\s*model\s+(\w+)\s*\{", r"(?i)^\s*create\s+table\s+(?:if\s+not\s+exists\s+)?[`\"]?(\w+)", r"^class\s+(\w+)\(.*(?:models\.Model|Base|db\.Model)\)", r"^class\s+(\w+)\s*<\s*(?:ApplicationRecord|ActiveRecord::Base)", r"class\s+(\w+)\s+extends\s+Model\b",
    r"\bDbSet<(\w+)>", r"class\s+(\w+)\s+extends\s+Table\b", r"class\s+(\w+)\(\s*\w+\s*:\s*Tag\)\s+extends\s+Table\[",
)


def surface(lines: DataFrame) -> DataFrame:
    """(category, value, path, line_no): routes, settings, services and models; tests and prose aside; each once."""
    text = lines.where(~is_test_path(F.col("path")) & ~F.col("ext").isin("md", "rst") & ~F.col("path").startswith("docs/"))
    named = []
    for category, patterns in (("route", ROUTES), ("env", SETTINGS), ("service", SERVICES), ("model", MODELS)):
        for p in patterns:
            two = category == "route" and p.startswith(r"(?i)\b\w+\.(")
            value = F.regexp_extract("line", p, 2 if two else 1)
            named.append(F.when(F.length(value) > 0, F.struct(F.lit(category).alias("category"), value.alias("value"))))
    found = text.select("path", "line_no", F.explode(F.array_compact(F.array(*named))).alias("s")).select("s.category", "s.value", "path", "line_no")
    behind = found.where((F.col("category") == "env") & F.upper("value").rlike(SERVICE_SETTING)).select(F.lit("service").alias("category"), F.concat(F.lit("env:"), "value").alias("value"), "path", "line_no")
    every = found.unionByName(behind).unionByName(graphql_fields(text))
    return every.select("category", without_credentials(F.col("value")).alias("value"), "path", "line_no").distinct()


def graphql_fields(lines: DataFrame) -> DataFrame:
    """Fields of the root types of GraphQL schemas as routes."""
    frame = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("line").rlike(r"^\s*(?:extend\s+)?(?:type|input|interface|enum|union|scalar)\s+\w+"), F.regexp_extract("line", r"type\s+(\w+)", 1)).when(F.trim("line") == "}", F.lit(""))
    held = lines.where(F.col("ext").isin("graphql", "gql")).withColumn("root", F.last(opened, ignorenulls=True).over(frame))
    field = F.regexp_extract("line", r"^\s+(\w+)\s*[(:]", 1)
    found = held.where(F.col("root").isin("Query", "Mutation", "Subscription") & (field != ""))
    return found.select(F.lit("route").alias("category"), F.concat("root", F.lit("."), field).alias("value"), "path", "line_no")


def marked_models(lines: DataFrame) -> DataFrame:
    """Types whose line above names them a model: an annotation or a derive."""
    frame = Window.partitionBy("path").orderBy("line_no")
    seen = lines.withColumn("above", F.lag("line").over(frame))
    name = F.regexp_extract("line", r"\b(?:class|struct)\s+(\w+)", 1)
    return seen.where(F.col("above").rlike(r"@Entity|@Table|@Model\b|#\[derive\([^)]*(?:Queryable|FromRow|Model)")).select(F.lit("model").alias("category"), name.alias("value"), "path", "line_no").where("value <> ''")


def carried_type(lines: DataFrame) -> DataFrame:
    """Each line with the last type named at or above it in its file."""
    frame = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    name = F.nullif(F.regexp_extract("line", r"^type\s+(\w+)\s+struct", 1), F.lit(""))
    return lines.withColumn("type", F.last(name, ignorenulls=True).over(frame))


def brace_depth(lines: DataFrame) -> DataFrame:
    frame = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("depth", F.sum(occurrences(F.col("line"), "{") - occurrences(F.col("line"), "}")).over(frame))


def api_keys(symbols_: DataFrame) -> DataFrame:
    return symbols_.where("exported").select(F.concat_ws(" ", "lang", "kind", "name").alias("key")).distinct()


def api_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, change): what was taken from or added to an API."""
    return old.select("key").subtract(new.select("key")).withColumn("change", F.lit("removed")).unionByName(new.select("key").subtract(old.select("key")).withColumn("change", F.lit("added")))


def layer_violations(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Edges between two modules that layers govern and of which the first may not use the second."""
    known = layers.select(F.col("module").alias("m")).distinct()
    inside = edges.join(known, F.col("src") == F.col("m"), "left_semi").join(known, F.col("dst") == F.col("m"), "left_semi").where("src <> dst")
    return inside.join(layers, (F.col("src") == F.col("module")) & (F.col("dst") == F.col("allowed")), "left_anti").select("src", "dst").distinct()


def constitution(files: DataFrame, rules: DataFrame, most_rules: int = 2000) -> DataFrame:
    """(directive, needle, path): forbidden words and where they stand, required ones that no file has, and files that lack
    what each must have. Only the code of sources counts, not comments, strings and tests.

    rules is what a project states by hand; beyond most_rules it is no such statement, which raises. So the rules become
    literals of one projection, and the files are read once for each kind of rule, without a join."""
    from tessera.operators.project import masked

    stated = rules.select("directive", "needle").distinct().limit(most_rules + 1).collect()
    if len(stated) > most_rules:
        raise ValueError(f"more than {most_rules} rules")
    source = files.where((language(F.col("ext")) != "text") & ~is_test_path(F.col("path")))
    code = source.select("path", masked(F.col("content"), F.col("ext")).alias("code"))
    holds = lambda needle: F.col("code").contains(F.lit(needle))
    each = [F.when(holds(r.needle) if r.directive == "FORBID" else ~holds(r.needle), F.struct(F.lit(r.directive).alias("directive"), F.lit(r.needle).alias("needle"))) for r in stated if r.directive != "REQUIRE"]
    told = F.array_compact(F.array(*each)) if each else F.array().cast("array<struct<directive:string,needle:string>>")
    here = code.select("path", F.explode(told).alias("r")).select("r.directive", "r.needle", "path")
    required = [r.needle for r in stated if r.directive == "REQUIRE"]
    if not required:
        return here
    seen = code.agg(*[F.coalesce(F.bool_or(holds(n)), F.lit(False)).alias(f"n{i}") for i, n in enumerate(required)])
    absent = F.array_compact(F.array(*[F.when(~F.col(f"n{i}"), F.lit(n)) for i, n in enumerate(required)]))
    return here.unionByName(seen.select(F.lit("REQUIRE").alias("directive"), F.explode(absent).alias("needle"), F.lit(None).cast("string").alias("path")))


def imports(lines: DataFrame) -> DataFrame:
    """(src, dst): modules and the modules they import: the longest run of a target's segments that names one, or, for a target of
    one segment, the only module that ends in it."""
    from tessera.operators import trie

    patterns = {"python": r"^\s*(?:from|import)\s+([\w.]+)", "javascript": r"(?:from|require\()\s*['\"]([^'\"]+)['\"]", "typescript": r"from\s+['\"]([^'\"]+)['\"]", "java": r"^import\s+(?:static\s+)?([\w.]+)", "kotlin": r"^import\s+([\w.]+)", "scala": r"^import\s+([\w.]+)", "go": r"^\s*(?:import\s+)?\"([^\"]+)\"", "rust": r"^\s*(?:pub\s+)?use\s+(?:crate::)?([\w:]+)", "csharp": r"^using\s+([\w.]+)", "php": r"^use\s+([\w\\]+)", "ruby": r"^require(?:_relative)?\s+['\"]([^'\"]+)['\"]", "dart": r"^import\s+['\"]([^'\"]+)['\"]"}
    target = F.lit("")
    for lang, p in patterns.items():
        target = F.when(F.col("lang") == lang, F.regexp_extract("line", p, 1)).otherwise(target)
    found = lines.withColumn("lang", language(F.col("ext"))).select(module_of(F.col("path")).alias("src"), target.alias("target")).where("target <> ''").distinct()
    modules = lines.select(module_of(F.col("path")).alias("module")).distinct().where("module <> '(root)'")
    named = trie.resolve(found, modules).withColumnRenamed("module", "dst")
    return found.join(named, "target").where("src <> dst").select("src", "dst").distinct()


def commits_by_type(commits: DataFrame) -> DataFrame:
    """Conventional commits (ord, message) by type, in order of appearance."""
    kind = F.regexp_extract("message", r"^(\w+)(?:\([^)]*\))?!?:\s*", 1)
    text = F.regexp_replace("message", r"^\w+(?:\([^)]*\))?!?:\s*", "")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", text.alias("text")))), lambda x: x["text"])
    return commits.groupBy(F.when(kind == "", "other").otherwise(kind).alias("type")).agg(F.count("*").alias("n"), listed.alias("messages"))
