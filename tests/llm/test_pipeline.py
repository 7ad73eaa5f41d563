import importlib
import sys

import pytest

import corpus_pipeline
from tessera.llm.jaccard_join import shingles
from tessera.llm.nb_svm import NaiveBayesSvm
from tessera.llm.quality_rules import RULES, BASE, Cascade, Figures

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage returns, in order."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        docs = spark.createDataFrame(got.collect(), got.schema).cache()
        out.append(docs)
    return out


def test_columns_stay(spark, steps):
    want = spark.read.parquet(f"{SF}/documents.parquet")
    for s in steps[:-1]:
        assert s.columns == want.columns and [f.dataType for f in s.schema] == [f.dataType for f in want.schema]


def test_rules_stage(spark, steps):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {r.doc_id for r in docs if Cascade((BASE, *RULES)).first_rejection(Figures(r.text)) is None}
    assert {r.doc_id for r in steps[0].collect()} == want


def test_classifier_stage(spark, steps):
    model = NaiveBayesSvm().fit(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in model.scores(steps[0]).collect() if r.score >= 0.5}
    assert {r.doc_id for r in steps[1].collect()} == want
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(want & good) >= 0.98 * len({r.doc_id for r in steps[0].collect()} & good)


def test_near_duplicate_stage(steps):
    sets = {r.doc_id: shingles(r.text) for r in steps[1].collect()}
    near = {a: [b for b in sets if b != a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])] for a in sets}
    kept, seen = set(), set()
    for a in sorted(sets):
        if a not in seen:
            kept.add(a)
            todo = [a]
            while todo:
                for b in near[todo.pop()]:
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            seen.add(a)
    assert {r.doc_id for r in steps[2].collect()} == kept


def test_passages_stage(steps):
    before, after = ({r.doc_id: r for r in s.collect()} for s in steps[2:4])
    assert set(before) == set(after)
    first = {}
    for k in sorted(before):
        w = before[k].text.split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), k)
    for k, r in before.items():
        w = r.text.split()
        gone = {i + j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < k for j in range(13)}
        assert after[k].text.split() == [x for i, x in enumerate(w) if i not in gone]
        assert gone or after[k].text == r.text
        assert after[k].n_chars == len(after[k].text) and (after[k].lang, after[k].source) == (r.lang, r.source)


def test_packing_stage_holds_every_document(steps):
    assert {r.doc_id for r in steps[4].collect()} == {r.doc_id for r in steps[3].collect()}


def test_run_and_odd_rows(spark, tmp_path):
    text = "Plain prose of quite ordinary words that nobody would throw away without a reason at all, really. "
    data = [(None, text, None, None), (1, None, "en", "a"), (2, "", "en", "a"), (3, text + "Three. " * 3, "en", None), (3, text + "Three. " * 3, "en", None), (4, text, None, "b")]
    spark.createDataFrame([(k, t, a, b, 0, {"x": 1}) for k, t, a, b in data], "doc_id bigint, text string, lang string, source string, n_chars bigint, curve map<string,int>").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {None, 3}  # 4 is a near copy of 3


def test_extra_columns_keep_their_values(spark, steps):
    import datetime
    import decimal

    docs = steps[2].limit(5).selectExpr("*", "TIMESTAMP '2024-01-02 03:04:05.123456' AS kept", "CAST(1.25 AS DECIMAL(20,3)) AS carried", "X'00FF' AS c0", "CAST('NaN' AS DOUBLE) AS block")
    out = corpus_pipeline.repeated_passages(spark, docs, SF)
    assert out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    for r in out.collect():
        assert r.kept == datetime.datetime(2024, 1, 2, 3, 4, 5, 123456) and r.carried == decimal.Decimal("1.250") and bytes(r.c0) == b"\x00\xff" and r.block != r.block


def test_entry_without_the_pipeline(monkeypatch):
    for name in ("corpus_pipeline", "tessera.llm.queries"):
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "pipeline" not in entry.queries() and not any(q.startswith("op") and q[2].isdigit() for q in entry.queries())
    sys.modules.pop("__spark_entry__")
