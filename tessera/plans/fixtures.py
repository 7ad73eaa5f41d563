"""Small tables that both engines can state, for operators that need source code or project data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (columns, rows); rows are SQL literals that Spark and DuckDB read alike.
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "found": ("cap_ord, rule, severity, path, line_no, verified, cap", (
        "(0, 'aws-access-key', 4, 'a.py', 3, true, 'security.scan/secret')", "(1, 'cors-wildcard', 3, 'a.py', 9, true, 'security.scan/owasp')", "(9, 'cors-wildcard', 2, 'a.py', 9, true, 'security.scan/web')",
        "(1, 'weak-hash', 3, 'b.py', 1, true, 'security.scan/owasp')", "(1, 'insecure-random', 2, 'b.py', 2, true, 'security.scan/owasp')", "(3, 'debt-marker', 0, 'b.py', 7, true, 'quality.check/smell')",
        "(2, 'ssn-us', 3, 'c.go', 4, true, 'security.scan/pii')", "(1, 'sql-injection', 3, 'c.go', 5, false, 'security.scan/owasp')", "(5, 'ui-img-without-alt', 2, 'd.html', 1, true, 'quality.ui/a11y')", "(1, 'ssrf', 3, 'c.go', 8, true, 'security.scan/owasp')")),
    "checks": ("id, state, reason", ("('security.scan/secret', 'ran', '')", "('security.scan/owasp', 'ran', '')", "('security.scan/deps', 'skipped', 'no lock file')", "('verify/test', 'failed', 'timed out')", "('quality.check/smell', 'ran', '')", "('compliance.ru/consent', 'ran', '')", "('security.scan/injection', 'ran', '')")),
    "vulns": ("id, ecosystem, package, introduced, fixed, severity", (
        "('V-1', 'PyPI', 'requests', '0', '2.20.0', 'HIGH')", "('V-2', 'npm', 'lodash', '4.0.0', '4.17.21', 'CRIT')", "('V-3', 'npm', 'minimist', '0', '1.2.6', 'MED')", "('V-4', 'Go', 'golang.org/x/net', '0', '0.7.0', 'HIGH')", "('V-5', 'crates.io', 'time', '0.1.0', '0.2.23', 'MED')")),
    "deps": ("ecosystem, name, version", ("('PyPI', 'requests', '2.18.0')", "('PyPI', 'requests', '2.20.0')", "('PyPI', 'flask', '2.0.0')", "('npm', 'lodash', '4.17.20')", "('npm', 'Lodash', '3.9.9')", "('npm', 'minimist', '1.2.5')", "('Go', 'golang.org/x/net', '0.10.0')", "('crates.io', 'time', '0.1.44')", "('Pub', 'http', '1.0.0')", "('npm', 'requests', '1.0.0')")),
    "licences": ("package, licence", ("('a', 'MIT')", "('b', 'GPL-3.0')", "('c', 'AGPL-3.0-only')", "('d', 'LGPL-2.1')", "('e', 'Apache-2.0')", "('f', 'MIT')")),
    "edges": ("src, dst", ("('a', 'b')", "('b', 'a')", "('c', 'd')", "('d', 'e')", "('e', 'c')", "('e', 'f')", "('f', 'g')", "('x', 'x')", "('b', 'c')")),
    "defs": ("name, path, entry, dispatched", ("('main', 'm.py', true, false)", "('helper', 'm.py', false, false)", "('orphan', 'm.py', false, false)", "('twice', 'm.py', false, false)", "('twice', 'n.py', false, false)", "('on_event', 'n.py', false, true)", "('caller', 'n.py', false, false)", "('looped', 'n.py', false, false)")),
    "calls": ("caller, callee", ("('main', 'caller')", "('caller', 'helper')", "('caller', 'print')", "('looped', 'looped')", "('helper', 'len')")),
    "api_old": ("key", ("('go function Alpha')", "('go function Beta')", "('go type Conf')")),
    "api_new": ("key", ("('go function Alpha')", "('go function Gamma')", "('go type Conf')")),
    "layers": ("module, allowed", ("('a', 'b')", "('b', 'c')", "('c', 'd')", "('d', 'd')", "('e', 'c')")),
    "code": ("path, ext, content", (
        "('a.py', 'py', 'import os\ndef f(a):\n    # TODO later\n    os.system(a)\n    return eval(a)')", "('b.js', 'js', 'const x = 1;\nel.innerHTML = x;\nif (x && y) { go(); }')", "('c.yaml', 'yaml', 'spec:\n  hostNetwork: true\n  image: web:latest')",
        "('d.txt', 'txt', 'nothing here')", "('e.py', 'py', 'class Model:\n    pass\nprint(1)')")),
    "constitution": ("directive, needle", ("('FORBID', 'eval(')", "('REQUIRE', 'LICENSE')", "('REQUIRE', 'class')", "('REQUIRE_EACH', 'e')", "('REQUIRE_EACH', 'class')", "('FORBID', 'later')")),
    "sources": ("path, ext, content", (
        "('v.py', 'py', 'def view():\n    q = request.args.get(''q'')\n    run(q)\n    os.system(shlex.quote(q))\n\ndef run(x):\n    os.system(''ls '' + x)\n')",
        "('a.js', 'js', 'function f(req, db) {\n  const q = req.query.q;\n  db.query(q);\n  g(parseInt(q));\n}\nfunction g(n) { eval(n); }\n')",
        "('b.go', 'go', 'func h(r *Request) {\n  n := r.FormValue(\"n\")\n  os.Open(n)\n}\nfunc lonely() {\n  h(nil)\n}\n')",
        "('c.c', 'c', 'void k(char* p) {\n  char b[9];\n  gets(b);\n  system(b);\n  free(p);\n  free(p);\n}\n')",
        "('lib/D.java', 'java', 'class D {\n  void m(HttpServletRequest req) {\n    String p = req.getParameter(\"p\");\n    Runtime.getRuntime().exec(p);\n    logger.info(user.passportNumber);\n  }\n}\n')")),
    "shop": ("path, ext, content", (
        "('app/main.py', 'py', 'import app.util.tool\n\nclass Shop(models.Model):\n    pass\n\n# Starts all.\ndef main():\n    helper(1)\n    requests.get(''https://u:p@h.example/x'')\n\ndef helper(x):\n    return x\n')",
        "('app/util/tool.py', 'py', 'import app.main\n\n@app.get(''/x'')\ndef route():\n    \"\"\"Says x.\"\"\"\n    r = client.messages.create(q)\n    eval(r)\n    return os.environ[''KEY'']\n')",
        "('core/a.go', 'go', 'package core\n\nimport (\n    \"app/util\"\n)\n\nfunc Alpha() {\n    http.Get(\"https://api.example.com/v1\")\n}\n')",
        "('go.mod', 'mod', 'module m')", "('requirements.txt', 'txt', 'requests[socks]==2.18.0\nflask>=2\nFoo_Bar==1\n')", "('Cargo.lock', 'lock', '[[package]]\nname = \"foo\"\nversion = \"1.2.3\"\n')",
        "('package-lock.json', 'json', '{\"packages\": {\"\": {}, \"node_modules/g\": {\"version\": \"1.0.0\", \"license\": \"GPL-3.0\"}}}')",
        "('Dockerfile', 'dockerfile', 'FROM base:1\nRUN x')", "('c.yml', 'yml', 'services:\n  web:\n    image: y\n  db:\n')", "('k.yaml', 'yaml', 'kind: Service\nmetadata:\n  name: web\n')",
        "('AndroidManifest.xml', 'xml', '<m><intent-filter><action android:name=\"android.intent.action.VIEW\"/><data android:scheme=\"https\"/></intent-filter></m>')", "('i.plist', 'plist', '<key>get-task-allow</key><true/>')",
        "('lib.rs', 'rs', 'fn a() {\n}\n#[cfg(test)]\nmod t {\n    fn b() {}\n}\n')")),
    "walked": ("path, bytes", ("('a.py', 10)", "('node_modules/b.js', 10)", "('.git/c', 10)", "('.well-known/d', 10)", "('big.bin', 2000000)", "('vendor/big.go', 2000000)")),
    "blocks_then": ("name, body", ("('spec', 'old')", "('c4', 'same')")),
    "blocks_now": ("name, body", ("('spec', 'new')", "('c4', 'same ')", "('glossary', 'fresh')")),
    "outcomes": ("id, state, text", ("('verify/test', 'ran', '12 passed in 3s')", "('verify/lint', 'ran', 'sh: eslint: command not found')", "('verify/coverage', 'ran', 'no tests ran')")),
    "pages_made": ("path, ext, content", (
        "('p.html', 'html', '<html><head><meta name=\"viewport\" content=\"user-scalable=no\"></head><img src=\"x\"><img src=\"y\" alt=\"y\"><a href=\"https://a.example/x\">a</a><a href=\"//b.example\">b</a><a href=\"https://a.example/y\">c</a></html>')",
        "('q.html', 'html', '<html><input type=\"text\"><div onclick=\"go()\">x</div></html>')")),
    "changed": ("path", ("('v.py')", "('b.go')")),
    "commits": ("ord, message", ("(1, 'feat: one')", "(2, 'fix(core): two')", "(3, 'feat!: three')", "(4, 'loose words')", "(5, 'fix: four')")),
    "marks": ("path, line_no, line", ("('m', 1, 'tessera:ignore')", "('m', 2, 'bad')", "('m', 3, 'bad')", "('m', 4, 'bad # tessera:ignore')", "('n', 1, 'bad')", "('n', 2, 'type Alpha struct {')", "('n', 3, 'x')", "('n', 4, 'type Beta struct {')", "('n', 5, 'y }')")),
}


def values(name: str, quote_newlines: bool = True) -> str:
    columns, rows = TABLES[name]
    text = ", ".join(rows)
    return f"SELECT * FROM (VALUES {text}) AS t({columns})"


def fixture(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(values(name).replace("\n", "\\n"))


def sql(*names: str) -> str:
    """The tables as the head of a WITH clause."""
    return ",\n".join(f"{n} AS ({values(n)})" for n in names)
