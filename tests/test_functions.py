"""Masking, sketches, nested values, table functions and documentation against plain versions."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import masking
from tessera.functions import tables as functions
from tessera.operators import codeintel, nested, rank, sketches
from tessera.plans import queries, tables
from tessera.sources import files as src


def walked(html):
    """A character at a time."""
    out, state, i = [], "text", 0
    starts = [("<!--", "(?i)<!--"), ("-->", "-->"), ("<script", r"(?i)<script\b"), ("<style", r"(?i)<style\b"), ("</script>", r"(?i)</script\s*>"), ("</style>", r"(?i)</style\s*>"), ("<", "(?i)<[a-z/!]"), (">", ">"), ('"', '"'), ("'", "'")]
    close = {"tag": "text", "script tag": "script", "style tag": "style"}
    hidden = lambda s: s in ("comment", "script", "style") or s[-1] in "\"'"
    blank = lambda t: re.sub(r"[^\r\n]", " ", t)
    while i < len(html):
        hit = next(((n, m[0]) for n, p in starts if (m := re.compile(p).match(html, i))), None)
        if not hit:
            out.append(blank(html[i]) if hidden(state) else html[i])
            i += 1
            continue
        name, text = hit
        after = state
        if name == "<!--" and state == "text":
            after = "comment"
        elif name == "-->":
            after = "text" if state == "comment" else close.get(state, state)
        elif name in ("<script", "<style") and state == "text":
            after = name[1:] + " tag"
        elif name in ("</script>", "</style>") and state == name[2:-1]:
            after = "text"
        elif name == "<" and state == "text":
            after = "tag"
        elif name == ">":
            after = close.get(state, state)
        elif name in "\"'":
            after = state + name if state in close else state[:-1] if state.endswith(name) else state
        out.append(blank(text) if hidden(state) and after == state else text)
        state, i = after, i + len(text)
    return "".join(out)


def test_masked_markup_equals_a_walk_by_characters(spark):
    random.seed(3)
    pieces = ["<!--", "-->", "<script>", "<script src='a'>", "</script >", "<STYLE>", "</style>", "<a href=\"x>y\">", "<p ", "'", '"', ">", "< 3", "text é\n", "é", "<b>", "</b>", "<scripty>", "\r\n"]
    texts = ["".join(random.choice(pieces) for _ in range(random.randrange(14))) for _ in range(300)] + ["", None, "<!-- open\nend", "<a b='c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, html string")
    out = df.select("i", masking.masked_markup(F.col("html")).alias("m"))
    assert {r.i: r.m for r in out.collect()} == {i: None if t is None else walked(t) for i, t in enumerate(texts)}
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_sketches_merge_in_any_order(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("day"), F.col("id").alias("d"), (F.col("id") / 7).alias("v"), F.when(F.col("id") % 10 < 6, "often").otherwise(F.concat(F.lit("i"), F.col("id") % 20)).alias("item"))
    stored = sketches.parts(df, ["g", "day"], "d", "v", "item")
    by_day = sketches.estimates(sketches.merged(stored, ["g"]), ["g"])
    twice = sketches.estimates(sketches.merged(sketches.merged(stored.withColumn("half", F.col("day") < 25), ["g", "half"]), ["g"]), ["g"])
    for out in (by_day, twice):
        for r in out.collect():
            assert r.n == 20_000 and r.distinct_low <= 20_000 <= r.distinct_high and r.distinct_high - r.distinct_low < 2500
            assert r.quantile_low <= 59_999 / 14 <= r.quantile_high and r.quantile_high - r.quantile_low < 200
            assert r.frequent[0].item == "often" and r.frequent[0]["count"] == 12_000
    empty = sketches.parts(df.where("false"), ["g"], "d", "v", "item")
    assert sketches.merged(empty, ["g"]).count() == 0


def test_sketch_bounds_hold_in_an_unlucky_group(spark):
    """Of 1500 groups of 16000 numbers one lies beyond three standard deviations at 2 ** 12 registers: here it is, with its neighbours."""
    n, near = 16_000, (1158, 1163)
    df = spark.range(near[0] * n, near[1] * n, 1, 4).select(F.expr(f"id div {n}").alias("g"), (F.col("id") % 20).alias("day"), F.col("id").alias("d"), F.col("id").alias("v"), F.lit("x").alias("item"))
    rows = sketches.estimates(sketches.merged(sketches.parts(df, ["g", "day"], "d", "v", "item"), ["g"]), ["g"]).collect()
    assert len(rows) == 5
    for r in rows:
        assert r.distinct_low <= n <= r.distinct_high and r.distinct_high - r.distinct_low < 0.11 * n
        assert r.quantile_low <= r.g * n + n // 2 <= r.quantile_high


def steps(value, path="$"):
    yield path, value
    for key, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield from steps(v, f"{path}[{key}]" if isinstance(value, list) else f"{path}.{key}")


def test_nested_values_at_any_depth(spark):
    deep = 1
    for _ in range(40):
        deep = {"a": [deep]} if random.random() < 0.5 else [deep]
    docs = [{"x": {"y": [1, {"z": None}]}, "t": True}, [], 3, "s", {"e": {}}]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(90, None), (91, "{broken"), (92, "")]
    df = spark.createDataFrame(rows, "id int, j string")
    got = sorted((r.key, r.path) for r in nested.nodes(df, "id", "j").select("key", "path").collect())
    assert got == sorted((i, p) for i, d in enumerate(docs) for p, _ in steps(d))
    one = spark.createDataFrame([(0, json.dumps(deep))], "id int, j string")
    assert nested.nodes(one, "id", "j").count() == len(list(steps(deep)))
    assert nested.shapes(df.limit(0), "id", "j").count() == 0


def test_nested_values_are_not_bounded_in_number(spark):
    df = spark.range(0, 400_000, 1, 4).select("id", F.format_string('{"a": [%d, null]}', "id").alias("j"))
    got = {(r.path, r.type): r.n for r in nested.shapes(df, "id", "j").collect()}
    assert got == {("$", "OBJECT"): 400_000, ("$.a", "ARRAY"): 400_000, ("$.a[*]", "BIGINT"): 400_000, ("$.a[*]", "VOID"): 400_000}
    with pytest.raises(Exception, match="nested deeper"):
        nested.nodes(spark.createDataFrame([(0, "[" * 70 + "]" * 70)], "id int, j string"), "id", "j")


def test_lock_files_are_walked_the_same_way(spark):
    lock = {"version": "9.9.9", "dependencies": {"a": {"version": "1.0.0", "dependencies": {"b.c": {"version": "2.0.0"}, "@s/d": {"version": "3.0.0"}}}}}
    v2 = {"packages": {"": {"version": "1"}, "node_modules/e": {"version": "4.0.0"}, "node_modules/e/node_modules/f": {"version": "5.0.0"}}}
    df = spark.createDataFrame([(1, json.dumps(lock)), (2, json.dumps(v2))], "id int, j string")
    got = sorted((r.key, r.name, r.version) for r in nested.locked(df, "id", "j").collect())
    assert got == [(1, "@s/d", "3.0.0"), (1, "a", "1.0.0"), (1, "b.c", "2.0.0"), (2, "e", "4.0.0"), (2, "f", "5.0.0")]


def test_table_function_takes_any_table(spark):
    functions.register(spark)
    df = spark.createDataFrame([(1, "x", "a 1\nb\nc 22"), (2, "x", None), (3, "y", "9"), (4, None, "7")], "k int, line_no string, body string")
    run = lambda text, pattern: spark.sql(f"SELECT * FROM find_lines(TABLE(SELECT * FROM {{df}}) PARTITION BY line_no ORDER BY k, text => '{text}', pattern => '{pattern}')", df=df)
    out = run("body", "[0-9]+")
    assert out.columns == ["k", "line_no", "found", "hit"]
    assert sorted(map(tuple, out.collect())) == [(1, 1, "1", 1), (1, 3, "22", 2), (3, 1, "9", 1), (4, 1, "7", 1)]
    for text, pattern in (("nothing", "x"), ("body", "[")):
        with pytest.raises(Exception):
            run(text, pattern).collect()


def test_lines_of_a_language_are_found_by_more_than_one_task(spark, tmp_path, monkeypatch):
    number = lambda i: f"{i:016d}"
    docs = spark.createDataFrame([(i, None if i % 5 == 0 else "en", f"a\n{number(i)}\nb {number(i + 1)}") for i in range(200)], "doc_id bigint, lang string, text string")
    docs.repartition(4, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, tables.lines_by_function(spark, str(tmp_path)).collect()), key=lambda r: (r[0] or "", r[4]))
    want = [(lang, i, n + 2, number(i + n), k) for lang in (None, "en") for k, (i, n) in enumerate([(i, n) for i in range(200) if (i % 5 == 0) == (lang is None) for n in (0, 1)], 1)]
    assert got == want

    class Where(functions.FindLines):
        def eval(self, rows, text, pattern):
            from pyspark import TaskContext

            yield from ((*r[:-2], str(TaskContext.get().partitionId()), r[-1]) for r in super().eval(rows, text, pattern))

    monkeypatch.setattr(functions, "FindLines", Where)
    assert tables.lines_by_function(spark, str(tmp_path)).where("lang = 'en'").select("found").distinct().count() > 1


def test_running_totals_in_groups_of_any_size(spark):
    random.seed(5)
    rows = [(random.choice(["a"] * 20 + ["b", None]), i, random.randrange(4)) for i in random.sample(range(1000), 1000)] + [("c", None, 3), ("c", 7, 2)]
    df = spark.createDataFrame(rows, "g string, k int, w int")
    after = lambda r: (r[1] is None, r[1] or 0)
    for weight in (None, F.col("w")):
        got = {(r.g, r.k): r.before for r in rank.running(df, ["g"], [F.asc_nulls_last("k")], weight).collect()}
        assert got == {(g, k): sum(1 if weight is None else x[2] for x in rows if x[0] == g and after(x) < after((g, k))) for g, k, _ in rows}
    assert rank.running(df.limit(0), ["g"], [F.asc("k")]).count() == 0


def test_percentiles_hold_no_group_in_a_task(spark):
    random.seed(6)
    rows = [(random.choice(["a"] * 9 + ["b", None]), random.choice([None, 1.0, random.random() * 50])) for _ in range(2000)] + [("one", 4.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = rank.percentiles(df, ["g"], "v", {"low": 0.0, "mid": 0.5, "p90": 0.9, "top": 1.0})
    want = df.where("v IS NOT NULL").groupBy("g").agg(*[F.percentile("v", s).alias(n) for n, s in (("low", 0.0), ("mid", 0.5), ("p90", 0.9), ("top", 1.0))])
    show = lambda df: sorted((str(r.g), *[round(x, 9) for x in r[1:]]) for r in df.collect())
    assert show(out) == show(want) and len(show(out)) == 4
    plan = queries.percentiles(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan


def test_documentation(spark):
    texts = [
        ("a.py", 'def one(\n    a,\n):\n    """Doc."""\n# Not a docstring.\ndef two():\n    pass\ndef three():\n\n    """After a blank line."""\nclass Four:\n    r\'\'\'Doc.\'\'\'\n', {"one", "Four"}),
        ("b.go", "// Doc.\nfunc One() {}\n// A blank line ends the search.\n\nfunc Two() {}\nfunc Three() {}\n", {"One"}),
        ("c.rs", "/// Doc.\n#[inline]\npub fn one() {}\n#[inline]\npub fn two() {}\n", {"one"}),
        ("d.java", "/** Doc.\n */\n@Deprecated\npublic class One {}\n", {"One"}),
    ]
    files = spark.createDataFrame([(p, t) for p, t, _ in texts], "path string, content string").withColumn("ext", src.extension(F.col("path")))
    lines = src.lines(files)
    found = codeintel.documentation(lines, codeintel.symbols(lines)).where("documented").collect()
    assert {(r.path, r.name) for r in found} == {(p, n) for p, _, names in texts for n in names}


def test_lines_with_the_one_above_equal_plain_lines(spark):
    files = spark.createDataFrame([("a", "", "x\r\ny\n\nz"), ("b", "", ""), ("c", "", "\n"), ("d", "", "é\r")], "path string, ext string, content string")
    plain, above = src.lines(files), src.lines(files, above=True)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, above.drop("above").collect()))
    assert {(r.path, r.line_no): r.above for r in above.collect()}[("a", 2)] == "x"


def test_several_definitions_on_a_line(spark):
    files = spark.createDataFrame([("a.kt", "kt", "class A; class B\n"), ("b.java", "java", "public record P(int x) {}\n")], "path string, ext string, content string")
    assert sorted((r.path, r.name) for r in codeintel.symbols(src.lines(files)).collect()) == [("a.kt", "A"), ("a.kt", "B"), ("b.java", "P")]


def test_symbol_verdicts(spark):
    from tessera.operators import derived

    files = spark.createDataFrame([("a.py", "py", "def lone():\n    pass\nclass Foo:\n    def bar(self):\n        pass\n"), ("b.py", "py", "def bar():\n    pass\n\nclass Late:\n    pass\n")], "path string, ext string, content string")
    symbols = codeintel.symbols(src.lines(files))
    names = spark.createDataFrame([(n,) for n in ("lone", "Foo.bar", "pkg::Foo::bar", "Late.bar", "Foo/lone", "made_up", "Foo.made_up", "Gone\\bar", "", "bar", "bar", "::")], "name string")
    found = {r.query: (r.rule, r.severity) for r in derived.symbol_findings(symbols, names).collect()}
    missing, apart = ("symbol-not-found", 3), ("symbol-container-unconfirmed", 2)
    assert found == {"Late.bar": apart, "Foo/lone": apart, "Gone\\bar": apart, "made_up": missing, "Foo.made_up": missing, "::": missing}
    owned = derived.symbol_definitions(symbols, names).where("owned")
    assert sorted((r["query"], r.path, r.line_no) for r in owned.collect()) == [("Foo.bar", "a.py", 4), ("bar", "a.py", 4), ("bar", "b.py", 1), ("lone", "a.py", 1), ("pkg::Foo::bar", "a.py", 4)]
