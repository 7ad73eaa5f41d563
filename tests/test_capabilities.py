"""Every capability of the catalogue computes something of a small project; documents and verdicts say what they should."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import codeintel, derived, documents, gate, graph, project, taint
from tessera.plans.capabilities import CAPABILITIES, Project, findings
from tessera.plans.registry import ROWS, registry
from tessera.sources import files as src

FILES = {
    "app/main.py": "import app.util.tool\nfrom app import util\n\nclass Shop(models.Model):\n    pass\n\ndef main():\n    helper(1)\n    q = request.args['q']\n    run(q)\n\ndef helper(x):\n    return x\n\ndef run(c):\n    os.system(c)\n\ndef lonely():\n    logger.info(user.snils)\n",
    "app/util/tool.py": "import app.main\n\n@app.get('/x')\ndef route():\n    helper(2)\n    key = os.environ['KEY']\n    u = 'https://api.example.com/v1'\n    token = \"0123456789abcdef0123456789abcdef9a\"\n",
    "web/a.html": "<html><img src=x></html>", "web/a.css": "a { outline: none; color: #fff; height: 20px }", "requirements.txt": "requests==2.18.0\nflask==2.0.0\n",
    "web/b.js": "el.innerHTML = userData; const s = openai.chat('x'); eval(s)\nconst p = `${a}`; llm(f\"x\");\n", "Dockerfile": "FROM a:latest\n", "k.yaml": "spec:\n  hostNetwork: true\n", "AndroidManifest.xml": '<a android:debuggable="true"/>', "pyproject.toml": "",
    "package-lock.json": '{"packages": {"": {}, "node_modules/g": {"version": "1.0.0", "license": "GPL-3.0"}}}', "tauri.conf.json": '{"csp": null}', "lib.rs": "fn a() {\n  todo!()\n}\n#[cfg(test)]\nmod t {\n  fn b() {\n    todo!()\n  }\n}\n",
}


@pytest.fixture(scope="module")
def shop(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string").select("path", src.extension(F.col("path")).alias("ext"), "content").cache()
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    made = Project(
        files, vulnerabilities=frame([("V-1", "PyPI", "requests", "0", "2.20.0", "HIGH")], "id string, ecosystem string, package string, introduced string, fixed string, severity string"),
        constitution_rules=frame([("FORBID", "os.system"), ("REQUIRE", "never")], "directive string, needle string"), layer_map=frame([("app", "none"), ("app/util", "none")], "module string, allowed string"),
        baseline=frame([("python function gone",)], "key string"), changed=frame([("app/util/tool.py", "M"), ("app/new.py", "A")], "path string, status string"), commits=frame([(1, "feat: x")], "ord int, message string"),
        outcomes=frame([("verify/test", "ran", "3 passed"), ("verify/lint", "ran", "bash: x: command not found")], "id string, state string, text string"), stored=frame([("spec", "old")], "name string, body string"),
        records=frame([("backlog", "B-1", "x"), ("memory", "m", "y")], "kind string, name string, body string"), title="Sell more", name="helper")
    made.__dict__ |= {"lines": made.lines.cache()}
    made.__dict__ |= {"symbols": made.symbols.coalesce(1).cache(), "edges": made.edges.coalesce(1).cache()}
    return made


def test_every_id_of_the_catalogue_is_bound():
    assert set(CAPABILITIES) == {r[2] for r in ROWS}


EMPTY = {"verify/symbol", "verify/coverage", "security.scan/web", "security.scan/api", "compliance.ru/pdn-logs", "compliance.ru/localization", "compliance.ru/cross-border", "compliance.ru/consent", "compliance.ru/gost-crypto", "security.ai/insecure-output-taint", "quality.ui/native-a11y", "security.scan/owasp", "security.scan/pii", "security.ai/insecure-output", "quality.check/smell", "quality.check/complexity", "quality.check/antipattern", "security.scan/sast"}


@pytest.mark.parametrize("name", sorted(CAPABILITIES))
def test_capability_runs(shop, name):
    assert CAPABILITIES[name](shop).limit(1).count() == 1 or name in EMPTY


def test_call_graph(shop):
    assert {(r.src, r.dst) for r in CAPABILITIES["code.intel/call_graph"](shop).collect()} == {("main", "helper"), ("main", "run"), ("route", "helper")}
    assert {r.callee for r in graph.unresolved(shop.calls, shop.defs).collect()} >= {"system", "info"}
    assert {r.name for r in graph.unreachable(shop.defs, shop.calls).collect()} == {"lonely", "route", "a", "b"}
    scope = {(r.name, r.role) for r in graph.diff_scope(shop.spark.createDataFrame([("app/main.py",)], "path string"), shop.defs, shop.calls).collect()}
    assert ("helper", "changed") in scope and ("route", "affected") in scope


def test_findings_of_all(shop):
    some = ["security.scan/taint", "security.scan/deps", "security.scan/licenses", "security.scan/iac", "quality.check/completeness", "verify/api-break", "spec.check/drift", "quality.check/cycles", "quality.check/constitution", "quality.check/undocumented", "quality.check/layers", "quality.ui/responsive"]
    got = {(r.rule, r.path) for r in findings(shop, some).collect()}
    assert {("sast/taint-command-exec", "app/main.py"), ("pdn-log-dynamic", "app/main.py"), ("vulnerable-dependency", "requests"), ("copyleft-license", "g"), ("host-network", "k.yaml"), ("unimplemented-stub", "lib.rs"), ("api-break", None), ("doc-drift", "spec"), ("import-cycle", "app"), ("constitution-forbid", "app/main.py"), ("constitution-require", None), ("undocumented-api", "app/main.py"), ("layer-violation", "app")} <= got
    rows = [r for r in findings(shop, ["quality.check/completeness"]).collect()]
    assert [r.line_no for r in rows if r.path == "lib.rs"] == [2]  # not the one within the test module


def test_documents(shop):
    spec = documents.spec_block(shop.symbols, shop.lines)
    assert "**app**" in spec and "- /x" in spec and "- KEY" in spec and "- https://api.example.com/v1" in spec and "- Shop" in spec
    arch = documents.architecture_block(shop.files, shop.lines, shop.symbols, shop.edges, decisions=2)
    assert "Stack: Python." in arch and "Recorded: 2." in arch and "- app -> app/util" in arch and "app/main.py" in arch
    assert "Cycles between modules: 1." in documents.overview_block(shop.symbols, shop.edges) and "- Shop" in documents.data_model_block(shop.lines)
    assert documents.c4_block(shop.files, shop.lines, shop.symbols, shop.edges).count("```mermaid") == 3
    bom = json.loads(documents.sbom_document(shop.dependencies, "shop"))
    assert bom["specVersion"] == "1.5" and {c["purl"] for c in bom["components"]} >= {"pkg:pypi/requests@2.18.0", "pkg:npm/g@1.0.0"}
    assert documents.commit_draft(shop.changed).startswith("f") and documents.commit_draft(shop.changed.limit(0)) == "" and "(app): change 2 files" in documents.commit_draft(shop.changed)
    text = documents.updated("# T\n", {"a": "x", "b": "y"})
    assert documents.updated(text, {"a": "z"}) == text.replace("x", "z")
    assert "0007. Why" in documents.decision_record(7, "Why") and "upload-sarif" in documents.workflow()


def test_sarif_document(spark, tmp_path):
    rows = [("r1", 3, "a.py", 1), ("r2", 0, 'b "q".py', 2)]
    documents.sarif_document(spark.createDataFrame(rows, "rule string, severity int, path string, line_no int"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").rglob("part-*"), key=lambda p: (p.parent.name, p.name)))
    run = json.loads(text)["runs"][0]
    assert [r["ruleId"] for r in run["results"]] == ["r1", "r2"] and run["tool"]["driver"]["rules"] == [{"id": "r1"}, {"id": "r2"}]
    documents.sarif_document(spark.createDataFrame(rows[:0], "rule string, severity int, path string, line_no int"), str(tmp_path / "none"))
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").rglob("part-*"), key=lambda p: (p.parent.name, p.name))))["runs"][0]["results"] == []


def test_delivery_text_and_skills(spark):
    states = spark.createDataFrame([("b", True, "confirmed", 0), ("a", True, "failed", 2), ("c", False, "not run", 0)], "axis string, hard boolean, state string, n int")
    assert documents.delivery_text(states) == ["[ ] a: failed, 2 finding(s)", "[x] b: confirmed", "[ ] c: not run", "Not done: a"]
    assert documents.delivery_text(states.where("axis <> 'a'"))[-1] == "Done." and documents.delivery_text(states.selectExpr("axis", "true AS hard", "if(axis = 'a', 'confirmed', state) AS state", "n"))[-1] == "Not confirmed: c did not run."
    pages = documents.skills_pack(registry(spark))
    assert "security.scan.md" in pages and "`security.scan/secret`" in pages["security.scan.md"] and sum(p.count("- `") for p in pages.values()) == 74


def test_deadline_cancels_jobs(spark):
    from tessera.session import within

    assert within(spark, 60, lambda: spark.range(10).count()) == 10
    slow = spark.range(4).repartition(4).selectExpr("id", "java_method('java.lang.Thread', 'sleep', 20000L) AS x")
    with pytest.raises(TimeoutError):
        within(spark, 1.0, lambda: slow.collect())


def test_words_of_a_verdict(spark):
    checks = lambda *rows: spark.createDataFrame(list(rows), "id string, state string, reason string")
    found = spark.createDataFrame([("tests-failing", 3, None, None, True, "verify/test"), ("unimplemented-stub", 2, "a", 1, True, "quality.check/completeness"), ("doc-drift", 1, "b", 1, True, "spec.check/drift")], derived.FINDING)
    ran, skipped = checks(("verify/test", "ran", "")), checks(("verify/test", "skipped", "no tool"))
    tests = lambda c, f, s=True: derived.test_status(c, f, s).first().tests
    assert [tests(ran, found), tests(ran, found.limit(0)), tests(skipped, found), tests(checks(("x", "ran", "")), found), tests(checks(("x", "ran", "")), found, False)] == ["failing", "passing", "no tool", "not run", None]
    bucketed = gate.bucketed(found)
    assert {r.rule: r.bucket for r in derived.escalated(bucketed).collect()} == {"tests-failing": "blocking", "unimplemented-stub": "blocking", "doc-drift": "blocking"}
    verdict = gate.verdict(bucketed)
    say = lambda v, c, n=0: derived.headline(v, c, derived.test_status(c, found, False), n).first().headline
    assert say(verdict, ran) == "Not ready to ship. Quality 84/100, 1 blocker(s) need your decision. Tests: failing."
    clean = gate.verdict(bucketed.limit(0))
    assert say(clean, skipped).startswith("Quality NOT confirmed: no check ran (1 skipped).") and say(clean, checks(("a", "ran", ""))) == "Ready to ship. Quality 100/100, 1 checks passed, no blockers."
    assert say(clean, checks().limit(0), 2).startswith("Artifacts created (2)") and say(clean, checks().limit(0)) == "Quality NOT confirmed: no checks ran."
    assert derived.alert(verdict, 9, 7).first().alert and not derived.alert(clean, 0, 0).first().alert and derived.alert(verdict, 9, 7).first().decisions == 8
    assert derived.unfinished_warning(["quality"]) == "not escalated, as their families are left out: spec.check/drift, verify/api-break" and derived.unfinished_warning([]) is None
    assert derived.waves({"a": [], "b": ["a"], "c": ["a"], "d": ["b", "e"], "e": ["d"]}) == ([["a"], ["b", "c"]], ["d", "e"])


def test_uncertain_versions_are_told(spark):
    m = spark.createDataFrame([("V", "Go", "m", "1.0", "HIGH", False), ("W", "Go", "n", "1.0", "CRIT", True)], "id string, ecosystem string, name string, version string, severity string, certain boolean")
    assert {(r.rule, r.severity, r.verified) for r in derived.vulnerable(m).collect()} == {("vulnerable-dependency-uncertain", 3, False), ("vulnerable-dependency", 4, True)}


def test_platforms_and_coverage(shop):
    assert {(r.kind, r.platform) for r in project.platforms(shop.files).collect()} == {("mobile", "android"), ("desktop", "tauri")}
    assert [(r.stack, r.command) for r in project.coverage_tool(shop.files).collect()] == [("Python", "python -m pytest --cov")]


def test_counts_of_symbols(shop):
    got = {(r.level, r.name): r.n for r in codeintel.symbol_counts(shop.symbols).collect()}
    assert got["language", "python"] == 6 and got["module", "app"] == 5 and got["file", "app/util/tool.py"] == 1
    assert {(r.folder, r.files, r.symbols) for r in codeintel.folder_map(shop.lines, shop.symbols).collect()} >= {("app", 1, 5), ("app/util", 1, 1)}
    assert {r.name for r in codeintel.homonyms(shop.symbols.unionByName(shop.symbols.where("name = 'run'"))).collect()} == {"run"}
    assert taint.definitions(shop.events).count() == 7
