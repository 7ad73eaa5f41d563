"""Every language reads its own sources, calls and sinks; names that are cleaned, constant or of other functions stay silent."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.flow import Reader
from tessera.operators.taint import taint_findings
from tessera.sources import files as src

#: language: (extension, how a function with these statements looks, a source, how a name is set, calls for a command, a query and a file, a cast)
SHAPES = {
    "javascript": ("js", "function f(req, db) {{\n{0}\n}}", "req.query.a", "const {0} = {1};", ("eval({0});", "db.query({0});", "fs.readFileSync({0});"), "parseInt({0})"),
    "typescript": ("ts", "function f(req: any, db: any): void {{\n{0}\n}}", "req.params.a", "let {0}: string = {1};", ("child_process.exec({0});", "db.execute({0});", "res.sendFile({0});"), "Number({0})"),
    "go": ("go", "func f(r *http.Request, db *sql.DB) {{\n{0}\n}}", 'r.URL.Query().Get("a")', "{0} := {1}", ('exec.Command("sh", "-c", {0})', "db.QueryContext(ctx, {0})", "os.ReadFile({0})"), "strconv.Atoi({0})"),
    "java": ("java", "class C {{ void f(HttpServletRequest req, Statement st) {{\n{0}\n}} }}", 'req.getParameter("a")', "String {0} = {1};", ("new ProcessBuilder({0});", "st.executeQuery({0});", "new java.io.FileReader({0});"), "Integer.parseInt({0})"),
    "ruby": ("rb", "def f(conn)\n{0}\nend", "params[:a]", "{0} = {1}", ("system({0})", "conn.execute({0})", "File.read({0})"), "Integer.float({0})"),
    "php": ("php", "<?php\nfunction f($db) {{\n{0}\n}}", "$_POST['a']", "${0} = {1};", ("shell_exec(${0});", "$db->query(${0});", "readfile(${0});"), "intval(${0})"),
    "csharp": ("cs", "class C {{ void F() {{\n{0}\n}} }}", 'Request.Form["a"]', "var {0} = {1};", ("Process.Start({0});", "new SqlCommand({0});", "File.ReadAllText({0});"), "Convert.ToInt32({0})"),
    "rust": ("rs", "fn f() {{\n{0}\n}}", 'std::env::var("A").unwrap()', "let {0} = {1};", ('Command::new("sh").arg({0});', "sqlx::query(&{0});", "File::open({0});"), "i64::number({0})"),
    "kotlin": ("kt", "fun f(call: ApplicationCall, st: Statement) {{\n{0}\n}}", 'call.parameters["a"]', "val {0} = {1}", ("ProcessBuilder({0})", "st.execute({0})", "File({0}).readText()"), "Integer.parseInt({0})"),
    "scala": ("scala", "def f(request: Request, st: Statement): Unit = {{\n{0}\n}}", 'request.getQueryString("a")', "val {0} = {1}", ("Process({0})", "st.executeUpdate({0})", "Source.fromFile({0})"), "Integer.parseInt({0})"),
    "c": ("c", "void f(MYSQL* conn) {{\n{0}\n}}", 'getenv("A")', "char* {0} = {1};", ("popen({0}, m);", "mysql_query(conn, {0});", 'fopen({0}, "r");'), "atoi({0})"),
    "cpp": ("cpp", "void f(MYSQL* conn) {{\n{0}\n}}", 'std::getenv("A")', "const char* {0} = {1};", ("system({0});", "sqlite3_exec(db, {0}, 0, 0, 0);", "open({0}, 0);"), "std::atoi({0})"),
    "swift": ("swift", "func f(req: Request, db: Connection) throws {{\n{0}\n}}", 'req.query["a"]!', "let {0} = {1}", ("system({0})", "try db.run({0})", "let h = FileHandle(forReadingAtPath: {0})"), "Int({0})"),
    "dart": ("dart", "void f(request, db) {{\n{0}\n}}", "request.url.queryParameters['a']", "var {0} = {1};", ("Process.run({0}, []);", "db.rawQuery({0});", "File({0}).readAsString();"), "int({0})"),
}
RULES = ("sast/taint-command-exec", "sast/taint-sql", "sast/taint-path")


def texts():
    for lang, (ext, shape, source, binding, calls, cast) in SHAPES.items():
        value = lambda x, lang=lang: "$" + x if lang == "php" else x
        for rule, call in zip(RULES, calls, strict=True):
            tag = f"{lang}-{rule[11:]}"
            yield f"{tag}-dirty.{ext}", shape.format(binding.format("a", source) + "\n" + binding.format("b", value("a")) + "\n" + call.format("b")), rule
            yield f"{tag}-clean.{ext}", shape.format(binding.format("a", source) + "\n" + binding.format("b", cast.format("a")) + "\n" + call.format("b")), None
            yield f"{tag}-constant.{ext}", shape.format(binding.format("a", source) + "\n" + binding.format("b", '"x"') + "\n" + call.format("b")), None
            yield f"{tag}-scoped.{ext}", shape.format(binding.format("b", source)) + "\n" + shape.replace("f(", "g(").replace("F(", "G(").format(call.format("b")), None


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(p, t) for p, t, _ in texts()], "path string, content string").withColumn("ext", src.extension(F.col("path")))
    out = {}
    for r in taint_findings(files.repartition(4)).collect():
        out.setdefault(r.path, set()).add(r.rule)
    return out


@pytest.mark.parametrize(("path", "rule"), [(p, r) for p, _, r in texts()])
def test_matrix(found, path, rule):
    assert found.get(path, set()) == ({rule} if rule else set())


def rules(lang, text):
    return [(e[2], e[4]) for e in Reader(lang, text).read() if e[1] == "finding" or (e[1] == "sink" and e[3] == "source")]


def test_memory_and_buffers():
    assert rules("c", "void f() {\n char b[9];\n gets(b);\n char d[3];\n strcpy(d, b);\n printf(b);\n printf(\"%s\", b);\n}") == [(5, "sast/taint-buffer"), (6, "sast/taint-format-string")]
    assert rules("c", "void f(char* p) {\n free(p);\n use(p);\n free(p);\n p = malloc(3);\n use(p);\n}") == [(3, "sast/use-after-free"), (4, "sast/double-free")]
    assert rules("cpp", "void f() {\n int n;\n scanf(\"%d\", &n);\n malloc(n * 4);\n malloc(4);\n malloc(atoi(getenv(\"N\")));\n}") == [(4, "sast/taint-alloc-size"), (6, "sast/taint-alloc-size")]


def test_strings_branches_and_comments():
    assert rules("javascript", "function f(req) {\n const a = req.body.x;\n db.query(`select ${a}`);\n // db.query(a)\n let c = a;\n if (x) { c = 'k'; }\n eval(c);\n const d = true ? 'k' : a;\n eval(d);\n}") == [(3, "sast/taint-sql"), (7, "sast/taint-command-exec")]
    assert rules("php", "<?php\nfunction f() {\n system(\"ls {$_GET['d']}\");\n system(escapeshellarg($_GET['d']));\n $x = htmlspecialchars($_GET['d']);\n system($x);\n}") == [(3, "sast/taint-command-exec"), (6, "sast/taint-command-exec")]
    assert rules("java", "class C { void f(R req) { List<String> l = new ArrayList<>(); l.add(req.getParameter(\"a\")); st.execute(l.get(0)); logger.info(user.passportNumber); } }") == [(1, "sast/taint-sql"), (1, "pdn-log-dynamic")]
    assert rules("go", "func f() {\n  if x {\n") == [] and rules("kotlin", "}}}} ((((") == []


def test_calls_across_functions(spark):
    js = "function a(req) { b(req.query.q, 1); const v = c(req); eval(v); }\nfunction b(x, y) { d(y, x); }\nfunction d(p, q) { db.query(q); }\nfunction c(r) { return r.body || req.body; }\nfunction e(z) { d(z, 'k'); }"
    files = spark.createDataFrame([("x.js", "js", js)], "path string, ext string, content string")
    assert sorted((r.func, r.rule) for r in taint_findings(files).collect()) == [("a", "sast/taint-command-exec"), ("a", "sast/taint-sql")]


def test_shapes_of_calls():
    def shapes(lang, text):
        return [(e[2], e[4]) for e in Reader(lang, text).read() if e[1] == "shape"]

    assert shapes("java", "class C { void f() {\n st.executeQuery(\"select \" + x);\n st.executeQuery(\"select ?\");\n new ObjectInputStream(in);\n st.query(\"a\" + \"b\");\n} }") == [(2, "sast/sql-injection"), (4, "sast/unsafe-deserialize")]
    assert shapes("javascript", "db.query(`select ${x}`);\ndb.query(`select 1`);\ncp.execSync(cmd);\ncp.execSync('ls');") == [(1, "sast/sql-injection"), (3, "sast/dynamic-exec")]
    assert shapes("php", "<?php\n$db->query(\"select $x\");\n$db->query('select 1');\nunserialize($x);\nsystem('ls');\nsystem($c);") == [(2, "sast/sql-injection"), (4, "sast/unsafe-deserialize"), (6, "sast/dynamic-exec")]
    assert shapes("ruby", "def f\n  db.execute(\"select #{x}\")\n  system(\"ls\")\nend") == [(2, "sast/sql-injection")]


#: Own cases, each dangerous text beside a harmless one of the same kind: (file, content, whether there is a finding, whether by
#: taint).
CASES = (
    ("ci/token.py", 'TOKEN = "ghp_' + "a1B2c3D4e5F6" * 3 + '"\n', True, False), ("ci/token_env.py", 'TOKEN = os.environ["TOKEN"]\n', False, False),
    ("net/fetch.py", "r = session.send(ask, verify=False)\n", True, False), ("net/fetch_ok.py", "r = session.send(ask, verify=True)\n", False, False),
    ("hash/sum.go", "h := md5.New()\n", True, False), ("hash/sum_ok.go", "h := sha256.New()\n", False, False),
    ("img/a/Dockerfile", "FROM node:latest\n", True, False), ("img/b/Dockerfile", "FROM node:22.3-slim\n", False, False),
    ("k8s/net.yaml", "spec:\n  hostNetwork: true\n", True, False), ("k8s/net_ok.yaml", "spec:\n  hostNetwork: false\n", False, False),
    ("ui/row.jsx", "const r = <p dangerouslySetInnerHTML={{__html: row}} />\n", True, False), ("ui/row_ok.jsx", "const r = <p>{row}</p>\n", False, False),
    ("t/find.rb", "def find\n  q = params[:q]\n  system(q)\nend\n", True, True), ("t/find_ok.rb", 'def find\n  q = "ls"\n  system(q)\nend\n', False, True),
    ("t/list.js", "function list(req) {\n  const id = req.query.id;\n  const again = id;\n  db.query('select ' + again);\n}\n", True, True), ("t/list_ok.js", "function list(req) {\n  const id = parseInt(req.query.id);\n  db.query('select ' + id);\n}\n", False, True),
    ("t/run.go", 'func run(r *http.Request) {\n  dir := r.URL.Query().Get("dir")\n  exec.Command("du", dir).Run()\n}\n', True, True), ("t/run_ok.go", 'func run(r *http.Request) {\n  exec.Command("du", "/srv").Run()\n}\n', False, True),
    ("t/page.php", "<?php\nfunction page() { $p = $_POST['p']; echo shell_exec($p); }\n", True, True), ("t/page_ok.php", "<?php\nfunction page() { $p = escapeshellarg($_POST['p']); echo shell_exec($p); }\n", False, True),
)

#: Dangerous, but beyond the fixed patterns: weak hashes are told by a call of their name, not by a constructor in its package.
MISSED = ["hash/sum.go"]


def test_own_cases(spark):
    from tessera.operators import gate, scan, verify
    from tessera.plans import rules as R

    files = spark.createDataFrame([(p, t) for p, t, _, _ in CASES], "path string, content string").withColumn("ext", src.extension(F.col("path")))
    lines = src.lines(files)
    plain = {r.path for r in verify.verify(scan.scan(files, lines, R.ALL), lines).where("verified").collect()}
    traced = {r.path for r in taint_findings(files).collect()}
    told = {p: p in (traced if by_taint else plain) for p, _, _, by_taint in CASES}
    row = gate.confusion(spark.createDataFrame([(told[p], want) for p, _, want, _ in CASES], "predicted boolean, actual boolean")).first()
    assert [p for p, _, want, _ in CASES if told[p] != want] == MISSED
    assert (row.tp, row.fp, row.fn, row.tn) == (10 - len(MISSED), 0, len(MISSED), 10)


def test_texts_nested_too_deeply_are_told_and_do_no_harm(spark):
    from tessera.operators.taint import fold, structural_findings, unread

    good = "import os\ndef h():\n    os.system(request.args.get('c'))\n"
    texts = [("sum.py", "x = " + " + ".join(["a"] * 1500) + "\n"), ("chain.py", "x = a" + ".f()" * 1200 + "\n"), ("elif.py", "if a: pass\n" + "elif a: pass\n" * 1500), ("deep.js", "x = " + "(" * 1500 + ")" * 1500), ("good.py", good)]
    files = spark.createDataFrame(texts, "path string, content string").withColumn("ext", src.extension(F.col("path")))
    assert {r.path for r in taint_findings(files).collect()} == {"good.py"}
    assert {r.path for r in unread(fold(files)).collect()} <= {"sum.py", "chain.py", "elif.py", "deep.js"}
    assert "good.py" in {r.path for r in structural_findings(files).collect()}
