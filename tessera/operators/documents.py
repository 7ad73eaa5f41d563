"""Documents from a project's tables: Markdown blocks, records and configuration. Lists are reports of a stated length, so
what reaches the driver is bounded; the tables behind them are counted whole."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import codeintel, deps, graph, project
from tessera.sources.reports import marked_block, sarif_lines

#: How many routes, services, settings, models and files a list shows.
ROUTES, SERVICES, SETTINGS, MODELS, STAGED = 40, 20, 30, 30, 20
MODULES = 200


def bullets(found: DataFrame, column: str, most: int) -> str:
    """The first values in order as a list, and how many more there are."""
    shown, rest = first(found, column, most)
    lines = [f"- {v}" for v in shown] + more(rest)
    return "\n".join(lines) if lines else "- none found"


def more(rest: int) -> list[str]:
    """Says how many a list leaves out."""
    return [f"- ... {rest} more"] if rest > 0 else []


def first(found: DataFrame, column: str, most: int) -> tuple[list[str], int]:
    """The first values in order, and how many there are beyond them."""
    values = found.select(column).distinct()
    shown = [r[0] for r in values.orderBy(column).limit(most).collect()]
    return shown, values.count() - len(shown)


def modules_block(cards: DataFrame, exports: bool = True) -> str:
    rows, rest = cards.orderBy("module").limit(MODULES).collect(), max(0, cards.count() - MODULES)
    out = []
    for r in rows:
        named = f". Among them: {', '.join(sorted(r.first_exports))}" if exports and r.first_exports else ""
        out.append(f"- **{r.module}**: {r.n} definitions ({r.n_exported} public){named}")
    return "\n".join(out + more(rest)) if out else "- no modules found"


def spec_block(symbols: DataFrame, lines: DataFrame) -> str:
    """What a system consists of and offers: modules, routes, languages, services, settings, models."""
    cards, surface = codeintel.module_cards(symbols), codeintel.surface(lines)
    of = lambda category: surface.where(F.col("category") == category)
    languages = [r[0] for r in symbols.select("lang").distinct().orderBy("lang").collect()]
    public = symbols.where("exported").count()
    return "\n".join([
        "## Composition and interfaces (from the code)", "", "### Modules", modules_block(cards), "", "### Functions and interfaces", f"Public symbols: {public}.", "", "Routes:", bullets(of("route"), "value", ROUTES), "",
        "### Means", f"Languages: {', '.join(languages) or 'none'}.", "", "Services:", bullets(of("service"), "value", SERVICES), "", "Settings:", bullets(of("env"), "value", SETTINGS), "", "### Data model", bullets(of("model"), "value", MODELS)])


def architecture_block(files: DataFrame, lines: DataFrame, symbols: DataFrame, edges: DataFrame, decisions: int = 0) -> str:
    surface = codeintel.surface(lines)
    stack = ", ".join(r.stack for r in project.stacks(files).orderBy("stack").collect()) or "unknown"
    starts, others = first(project.entry_points(lines), "path", STAGED)
    entries = ", ".join(starts + ([f"{others} more"] if others else [])) or "none found"
    rings = graph.cycles(edges).groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    told = "\n".join([f"- {' -> '.join(r.nodes)}" for r in rings.orderBy("component").limit(MODULES).collect()] + more(rings.count() - MODULES)) or "No cycles between modules."
    return "\n".join([
        "## From the code", "", "### Context", "Services:", bullets(surface.where("category = 'service'"), "value", SERVICES), "", "Settings:", bullets(surface.where("category = 'env'"), "value", SETTINGS), "",
        "### Building blocks", modules_block(codeintel.module_cards(symbols), exports=False), "", "### Deployment", f"Stack: {stack}. Entry points: {entries}.", "", "### Decisions", f"Recorded: {decisions}.", "", "### Risks", told])


def data_model_block(lines: DataFrame) -> str:
    found = codeintel.surface(lines).where("category = 'model'").select("value").unionByName(codeintel.marked_models(lines).select("value"))
    return "## Data model\n" + bullets(found, "value", MODULES)


def overview_block(symbols: DataFrame, edges: DataFrame) -> str:
    languages = symbols.groupBy("lang").count().orderBy("lang").collect()
    rings = graph.cycles(edges).select("component").distinct().count()
    return "\n".join(["## Overview", modules_block(codeintel.module_cards(symbols), exports=False), "", "Languages: " + (", ".join(f"{r['lang']} ({r['count']})" for r in languages) or "none") + ".", f"Cycles between modules: {rings}."])


def c4_block(files: DataFrame, lines: DataFrame, symbols: DataFrame, edges: DataFrame) -> str:
    """Context, containers and components as diagrams."""
    services, unnamed = first(codeintel.surface(lines).where("category = 'service'"), "value", SERVICES)
    boxes, unboxed = first(project.containers(lines).select(F.concat_ws(": ", "kind", "name").alias("box")), "box", SERVICES)
    services, boxes = services + [f"{unnamed} more"] * (unnamed > 0), boxes + [f"{unboxed} more"] * (unboxed > 0)
    label = lambda text: re.sub(r'["\[\]{}|<>]', "'", text)
    context = ["graph LR"] + [f'  "system" --> "{label(s)}"' for s in services]
    holders = ["graph LR"] + [f'  "system" --> "{label(b)}"' for b in boxes]
    parts = project.module_graph(edges, symbols).first()[0]
    return "\n".join(x for title, body in (("Context", "\n".join(context)), ("Containers", "\n".join(holders)), ("Components", parts)) for x in (f"## {title}", "```mermaid", body, "```"))


def decision_record(number: int, title: str, context: str = "", decision: str = "", consequences: str = "") -> str:
    return f"# {number:04d}. {title}\n\nStatus: proposed\n\n## Context\n{context or 'To be written.'}\n\n## Decision\n{decision or 'To be written.'}\n\n## Consequences\n{consequences or 'To be written.'}\n"


def feature_spec(title: str) -> str:
    parts = ("Why", "Scenarios", "Requirements", "Acceptance", "Out of scope")
    return f"# {title}\n\n" + "\n\n".join(f"## {p}\nTo be written." for p in parts) + "\n"


def workflow(command: str = "python -m pytest -q", report: str = "report.sarif") -> str:
    """A workflow that runs the checks on every push and hands the report on."""
    return "\n".join([
        "name: quality", "on: [push, pull_request]", "jobs:", "  check:", "    runs-on: ubuntu-latest", "    steps:", "      - uses: actions/checkout@v4", "      - uses: actions/setup-python@v5", "        with:", "          python-version: '3.x'",
        f"      - run: {command}", "      - uses: github/codeql-action/upload-sarif@v3", "        if: always()", "        with:", f"          sarif_file: {report}", ""])


def settings(block_at: str = "high") -> dict[str, str]:
    """Files of a new project's settings: policy, rules, decisions, work."""
    return {"policy.toml": f'block_at = "{block_at}"\n', "constitution.md": "# Rules\n# FORBID <text>, REQUIRE <text>, REQUIRE_EACH <text>\n", "decisions/README.md": "# Decisions\n", "backlog/README.md": "# Work\n"}


def commit_draft(changes: DataFrame) -> str:
    """A conventional commit for changed files (path, status): the type by what they are, the scope by their folder."""
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    kind = (
        F.when(F.col("path").rlike(r"(^|/)tests?/|_test\.|\.test\.|test_"), "test").when(F.lower("path").rlike(r"\.(?:md|rst|txt)$|(^|/)docs?/"), "docs")
        .when(base.isin("Dockerfile", "Makefile") | F.col("path").rlike(r"(^|/)\.github/|\.(?:ya?ml|toml|lock)$"), "chore").when(F.col("status") == "A", "feat").otherwise("fix")
    )
    told = changes.select(kind.alias("kind"), F.when(F.instr("path", "/") > 0, F.regexp_extract("path", r"^([^/]+)/", 1)).alias("scope"))
    n = changes.count()
    if not n:
        return ""
    top = told.groupBy("kind").count().orderBy(F.desc("count"), "kind").first()["kind"]
    scopes = [r[0] for r in told.select("scope").distinct().limit(2).collect()]
    scope = f"({scopes[0]})" if len(scopes) == 1 and scopes[0] else ""
    body = [f"- {r.status} {r.path}" for r in changes.orderBy("path").limit(STAGED).collect()]
    return f"{top}{scope}: change {n} file{'s' if n > 1 else ''}\n\n" + "\n".join(body + ([f"- ... {n - STAGED} more"] if n > STAGED else []))


def sarif_document(findings: DataFrame, folder: str, tool: str = "tessera") -> None:
    """Writes a SARIF 2.1.0 document in parts: head, one line a result, foot. Parts in the order of their names are the
    document, so no task holds all results."""
    rules = [{"id": r.rule} for r in findings.select("rule").distinct().orderBy("rule").collect()]
    head = json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": []}]})
    spark = findings.sparkSession
    numbered = graph.cut(sarif_lines(findings).withColumn("n", F.monotonically_increasing_id()))
    first = numbered.agg(F.min("n")).first()[0]
    line = lambda text: spark.range(1).select(F.lit(text).alias("value")).coalesce(1)
    line(head[:-4]).write.mode("overwrite").text(f"{folder}/0-head")
    numbered.select(F.when(F.col("n") == F.lit(first), F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value")).write.mode("overwrite").text(f"{folder}/1-results")
    line(head[-4:]).write.mode("overwrite").text(f"{folder}/2-foot")


def delivery_text(states: DataFrame) -> list[str]:
    """The axes of a delivery as lines, hard ones first, and the verdict; the axes are a fixed list."""
    rows = sorted(states.collect(), key=lambda r: (not r.hard, r.axis))
    out = [f"[{'x' if r.state == 'confirmed' else ' '}] {r.axis}: {r.state}" + (f", {r.n} finding(s)" if r.n else "") for r in rows]
    failed, absent = [r.axis for r in rows if r.hard and r.state == "failed"], [r.axis for r in rows if r.hard and r.state == "not run"]
    return [*out, "Done." if not failed and not absent else "Not done: " + ", ".join(failed) if failed else "Not confirmed: " + ", ".join(absent) + " did not run."]


def skills_pack(registry: DataFrame) -> dict[str, str]:
    """A page for each family of the catalogue: what there is and when to use it."""
    pages: dict[str, list[str]] = {}
    for r in registry.orderBy("ordinal").collect():
        pages.setdefault(r.family, [f"# {r.family}", ""]).append(f"- `{r.id}`: {r.when_to_use}" + (" (writes)" if r.mutates else ""))
    return {f"{family}.md": "\n".join(lines) + "\n" for family, lines in pages.items()}


def sbom_document(dependencies: DataFrame, name: str = "project", most: int = 100_000) -> str:
    """A CycloneDX 1.5 document; a project's dependencies are a list that a person reads, beyond `most` it is no such list."""
    rows = deps.components(dependencies.distinct()).orderBy("ecosystem", "name", "version").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} components")
    return json.dumps({"bomFormat": "CycloneDX", "specVersion": "1.5", "version": 1, "metadata": {"component": {"type": "application", "name": name}}, "components": [json.loads(r.component) for r in rows]}, indent=1)


def updated(document: str, blocks: dict[str, str]) -> str:
    """A document with its named blocks brought up to date; what stands outside them stays."""
    for name, body in blocks.items():
        document, _ = marked_block(document, name, body)
    return document
