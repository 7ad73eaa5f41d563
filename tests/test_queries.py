import duckdb
import pytest

import __spark_entry__
from tessera.catalog import ORACLE_SQL, QUERIES
from tessera.plans.queries import EXAMPLE_SQL, EXAMPLES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6))
    return repr(value.tolist() if hasattr(value, "tolist") else value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL) + sorted(EXAMPLE_SQL))
def test_query_equals_sql(spark, oracle, name):
    got, want = (QUERIES | EXAMPLES)[name](spark, SF).toPandas(), oracle.execute((ORACLE_SQL | EXAMPLE_SQL)[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_every_query_reads_a_given_table_and_has_sql(spark):
    """Registered are only queries whose plan, or whose own run, reads the tables; what works on literals is an example."""
    assert set(QUERIES) == set(ORACLE_SQL) and set(EXAMPLES) == set(EXAMPLE_SQL) and not set(QUERIES) & set(EXAMPLES)
    for name in sorted(set(QUERIES)):
        if "spark.readStream" not in (QUERIES[name].__doc__ or ""):
            assert any(t in ORACLE_SQL[name] for t in TABLES), name


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1 and set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


def test_line_rules_stay_native_and_read_what_they_need(spark):
    plan = QUERIES["pii_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan and "Python" not in plan and "Pandas" not in plan
    plan = QUERIES["evidence_lines"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_markup_all_reaches_every_rule_of_its_sql(spark):
    """The given pages miss a viewport only; two pages made for it hold the other four."""
    out = QUERIES["markup_all"](spark, SF)
    assert {r.rule for r in out.select("rule").distinct().collect()} == {"ui-viewport-missing", "ui-viewport-zoom-blocked", "ui-img-without-alt", "ui-input-without-label", "ui-clickable-nonsemantic"}
    assert {r.path for r in out.select("path").distinct().collect()} > {"p.html", "q.html"}


def test_sql_states_its_own_literals():
    """No text of the SQL comes from the rule tables: a changed rule must make its query differ."""
    import inspect

    from tessera.plans import oracle

    assert "import" not in inspect.getsource(oracle).replace("from __future__ import annotations", "")
