"""Path tries, interval joins, keyed state, committed sinks and hash trees against plain versions."""

import itertools
import json
import os
import random
import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tessera.operators import changes, intervals, trie
from tessera.plans import tables
from tessera.sources import committed
from tessera.streaming import state

# Paths


def named(targets, modules):
    """Longest run of segments, earliest first; a lone segment by the only module that ends in it."""
    out, known = {}, {m for m in modules if m}
    for t in targets:
        p = [s.strip() for s in re.split(trie.SEPARATORS, t)]
        p = [s for s in p if s]
        runs = [(-(j - i), i, "/".join(p[i:j])) for i in range(len(p)) for j in range(i + 1, len(p) + 1)]
        met = min((r for r in runs if r[2] in known), default=None)
        if met:
            out[t] = met[2]
        elif len(p) == 1:
            last = [m for m in known if m.split("/")[-1] == p[0]]
            if len(last) == 1:
                out[t] = last[0]
    return out


def test_trie_equals_all_runs(spark):
    random.seed(7)
    draw = lambda n, sep: sep.join(random.choice("abcd") for _ in range(n))
    modules = {draw(random.randint(1, 4), "/") for _ in range(25)} | {"x/y/z", "only", "p/q", "r/q", "services/a/utils", ""}
    targets = {draw(random.randint(1, 7), random.choice(["/", ".", "::", "\\"])) for _ in range(200)} | {"z", "q", "only", "", "///", "serde::core", "../services/a/utils/helper", 'use {services::a::utils};', "x.y", "é/ü"}
    t, m = spark.createDataFrame([(x,) for x in targets] * 2, "target string"), spark.createDataFrame([(x,) for x in modules] * 2, "module string")
    got = trie.resolve(t, m).collect()
    assert len(got) == len({r.target for r in got}) and {r.target: r.module for r in got} == named(targets, modules)
    assert trie.resolve(t, m.limit(0)).count() == 0 and trie.resolve(t.limit(0), m).count() == 0


def test_trie_rows_are_linear(spark):
    modules = spark.createDataFrame([("/".join(["a"] * 30),), ("a/b",)], "module string")
    assert trie.trie(modules).count() == 31


# Intervals


def test_intervals_equal_all_pairs(spark):
    random.seed(11)
    span = lambda: (s := random.choice([random.randrange(-2000, 2000), 0, 64]), s + random.choice([0, 1, 7, 63, 64, 5000, random.randrange(300)]))
    left = [(i, *span()) for i in range(150)] + [(900, None, 3), (901, 3, None), (902, 9, 2), (903, -(10**15), 10**15), (904, 5, 5), (904, 5, 5)]
    right = [(i, *span()) for i in range(120)] + [(900, 5, 5), (901, 6, 1), (902, -(10**12), 10**12)]
    l, r = spark.createDataFrame(left, "id int, s bigint, e bigint"), spark.createDataFrame(right, "id int, s bigint, e bigint")
    out = intervals.overlaps(l, r, ("s", "e"), ("s", "e"))
    ok = lambda x: x[1] is not None and x[2] is not None and x[1] <= x[2]
    want = sorted((a[0], b[0]) for a, b in itertools.product(left, right) if ok(a) and ok(b) and a[1] <= b[2] and b[1] <= a[2])
    assert sorted((x.l.id, x.r.id) for x in out.collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.overlaps(l.limit(0), r, ("s", "e"), ("s", "e")).count() == 0


def test_overlaps_join_equal_spans_once(spark, tmp_path, monkeypatch):
    """Ten times the items at the same times are ten times the numbers, from no more rows of the join."""
    at = lambda c: F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval({c})")
    met = []
    whole = intervals.overlaps
    monkeypatch.setattr(intervals, "overlaps", lambda *a: met.append(whole(*a)) or met[-1])
    got = []
    for k in (1, 10):
        orders = spark.range(60).select(F.col("id").alias("o_orderkey"), at("id % 50").alias("o_orderdate"), F.concat(F.lit("p"), F.col("id") % 2).alias("o_orderpriority"))
        items = spark.range(60 * 3 * k).select((F.col("id") % 60).alias("l_orderkey"), at("id % 60 % 50 + (id div 60) % 3 - 1").alias("l_shipdate"))
        orders.write.parquet(f"{tmp_path}/{k}/orders.parquet")
        items.write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        got.append({(r.o_orderpriority, r.month): (r.n, r.seconds) for r in tables.shipping_overlaps(spark, f"{tmp_path}/{k}").collect()})
    assert len(got[0]) == 4 and {g: (10 * n, 10 * t) for g, (n, t) in got[0].items()} == got[1]
    assert met[0].count() == met[1].count() > 0


# Streams

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"


def events(spark, rows):
    """(id, minute, user, type)"""
    return spark.createDataFrame(rows, "event_id bigint, minute double, user_id bigint, event_type string").select("event_id", F.expr("timestampadd(SECOND, CAST(minute * 60 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("ts"), "user_id", "event_type").selectExpr("event_id", "ts", "user_id", "event_type")


def test_sessions_join_late_events_and_expire(spark, tmp_path):
    far = 100_000.0
    one = events(spark, [(1, 0.0, 7, "view"), (2, 40.0, 7, "error"), (3, 10.0, 8, "error"), (4, 5.0, None, "view"), (5, 60.0, 9, "view")])
    two = events(spark, [(6, 20.0, 7, "view"), (7, 400.0, 7, "view"), (8, 400.0, 9, "view")])  # 6 joins 1 and 2
    three = events(spark, [(9, 1.0, 8, "view"), (10, far, -1, "view"), (11, 431.0, 7, "error")])  # 9 is later than the watermark has it
    out = state.replayed([one, two, three], state.session_verdicts, str(tmp_path))
    minute = lambda t: (t - __import__("datetime").datetime(2024, 1, 1)).total_seconds() / 60
    got = sorted((r.user_id, minute(r.started), minute(r.ended), r.n, r.errors, r.verdict) for r in out.collect())
    assert got == [(7, 0, 40, 3, 1, "watch"), (7, 400, 400, 1, 0, "clean"), (7, 431, 431, 1, 1, "failing"), (8, 10, 10, 1, 1, "failing"), (9, 60, 60, 1, 0, "clean"), (9, 400, 400, 1, 0, "clean")]


def test_state_holds_open_sessions_only(spark, tmp_path):
    """After all sessions but the sign of life's are over, nothing else is left in the state."""
    one = events(spark, [(i, float(i), i % 5, "view") for i in range(100)])
    two = events(spark, [(1000, 100_000.0, -1, "view")])
    out = state.replayed([one, two], state.session_verdicts, str(tmp_path))
    assert out.count() == 5
    home = next(tmp_path.glob("stream-*"))
    left = spark.read.format("statestore").option("stateVarName", "open").option("path", f"{home}/checkpoint").load()
    assert {r.key.user_id for r in left.collect()} == {-1}


def test_merging_sessions_any_order():
    random.seed(1)
    for _ in range(200):
        at = [(random.randrange(100),) for _ in range(12)]
        whole = state.merged([(t, t, 1, t % 2) for (t,) in at], 5)
        parts = []
        for (t,) in random.sample(at, len(at)):
            parts = state.merged([*parts, (t, t, 1, t % 2)], 5)
        assert parts == whole and sum(s[2] for s in whole) == 12 and all(b[0] - a[1] > 5 for a, b in zip(whole, whole[1:]))


def test_stream_join_gives_the_outer_side_once_none_can_come(spark, tmp_path):
    one = events(spark, [(1, 0.0, 7, "purchase"), (2, 5.0, 7, "error"), (3, 30.0, 8, "purchase"), (4, 41.0, 8, "error")])
    two = events(spark, [(5, 9.0, 7, "error"), (6, 50.0, 9, "purchase")])
    last = events(spark, [(7, 100_000.0, -1, "purchase"), (8, 100_000.0, -1, "error")])
    work = lambda s: state.followed(s.where("event_type = 'purchase'"), s.where("event_type = 'error'"))
    out = state.replayed([one, two, last], work, str(tmp_path)).where("user_id > 0")
    assert sorted((r.first_id, r.then_id or 0) for r in out.collect()) == [(1, 2), (1, 5), (3, 0), (6, 0)]


# Sinks


def found(spark, n=500):
    return spark.range(n).select(F.concat(F.lit("r"), F.col("id") % 7).alias("rule"), (F.col("id") % 5).cast("int").alias("severity"), F.concat(F.lit('a "b"\n'), F.col("id")).alias("path"), F.col("id").cast("int").alias("line_no"), (F.col("id") % 3).cast("int").alias("cap_ord"))


def test_one_sarif_file_in_order(spark, tmp_path):
    path = f"{tmp_path}/out/x.sarif"
    committed.write_sarif(found(spark), path)
    with open(path) as f:
        doc = json.load(f)
    results = doc["runs"][0]["results"]
    assert doc["version"] == "2.1.0" and len(results) == 500 and os.listdir(f"{tmp_path}/out/.staged") == []
    place = [(-r["rank"], int(re.search(r"\d+$", r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"])[0]) % 3) for r in results]
    assert place == sorted(place)
    assert committed.results_of(spark, path).count() == 500
    with pytest.raises(Exception, match="FileExistsError"):
        committed.write_sarif(found(spark, 3), path)
    committed.write_sarif(found(spark, 0), path, overwrite=True)
    with open(path) as f:
        assert json.load(f)["runs"][0]["results"] == []


def test_one_cyclonedx_file(spark, tmp_path):
    parts = spark.createDataFrame([("b", "1", "pkg:npm/b@1"), ("a", None, "pkg:npm/a")], "name string, version string, purl string")
    committed.write_sbom(parts, f"{tmp_path}/bom.json")
    with open(f"{tmp_path}/bom.json") as f:
        assert [c["name"] for c in json.load(f)["components"]] == ["a", "b"]


def test_failed_task_leaves_nothing(spark, tmp_path):
    bad = found(spark).withColumn("rule", F.when(F.col("line_no") == 499, F.raise_error(F.lit("broken"))).otherwise(F.col("rule")))
    with pytest.raises(Exception, match="broken"):
        committed.write_sarif(bad, f"{tmp_path}/x.sarif")
    with pytest.raises(Exception, match="broken"):
        committed.append_records(bad.select("rule"), f"{tmp_path}/records")
    assert [f for _, _, files in os.walk(tmp_path) for f in files] == []
    with pytest.raises(Exception, match="mounted"):
        committed.write_sarif(found(spark, 3), "s3://bucket/x.sarif")


def test_ids_of_writers_at_a_time_have_no_gaps_or_doubles(spark, tmp_path):
    folder = f"{tmp_path}/records"
    committed.register(spark)
    write = lambda k: committed.append_records(spark.range(37 + k).select(F.concat(F.lit(f"w{k}-"), "id").alias("b")), folder)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(6)))
    got = committed.read_records(spark, folder).collect()
    total = sum(37 + k for k in range(6))
    assert sorted(r.id for r in got) == list(range(total)) and len({r.body for r in got}) == total
    os.makedirs(f"{folder}/data/orphan")
    with open(f"{folder}/data/orphan/part-000000-1", "w") as f:
        f.write('{"i": 0, "body": "never committed"}\n')
    assert committed.read_records(spark, folder).count() == total


# Changes


def changed(a, b):
    return sorted((k, "added" if k not in a else "removed" if k not in b else "changed") for k in set(a) | set(b) if a.get(k) != b.get(k))


@pytest.mark.parametrize("keys", [list(range(3000)), [(i * 2654435761 * 977) % (1 << 63) * (-1) ** i for i in range(3000)], [5, -3]])
def test_hash_tree_finds_what_changed(spark, tmp_path, keys):
    random.seed(2)
    a = {k: str(k) for k in keys}
    b = dict(a)
    for k in random.sample(keys, 2):
        b.pop(k)
    for k in random.sample(sorted(b) or keys, min(2, len(b))):
        b[k] = None
    b[77777] = "new"
    frame = lambda d: spark.createDataFrame([(k, v) for k, v in d.items()] + [(None, "x")], "id bigint, v string")
    before = changes.take(frame(a), "id", f"{tmp_path}/a")
    after = changes.take(frame(b), "id", f"{tmp_path}/b", before.ranges)
    assert sorted((r.key, r.change) for r in changes.compare(spark, before, after).collect()) == changed(a, b)
    same = changes.take(frame(a).orderBy("v"), "id", f"{tmp_path}/c", before.ranges)
    assert changes.compare(spark, before, same).count() == 0


def test_repeated_keys_count_as_one(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (3, "w")], "id bigint, v string")
    b = spark.createDataFrame([(1, "y"), (1, "x"), (2, "z"), (2, "z"), (3, "w")], "id bigint, v string")
    before = changes.take(a, "id", f"{tmp_path}/a")
    after = changes.take(b, "id", f"{tmp_path}/b", before.ranges)
    assert [(r.key, r.change) for r in changes.compare(spark, before, after).collect()] == [(2, "changed")]
    with pytest.raises(ValueError):
        changes.compare(spark, before, changes.take(spark.range(9999).select(F.col("id"), F.lit("").alias("v")), "id", f"{tmp_path}/d"))


def test_little_is_read_where_little_changed(spark, tmp_path):
    """Of 256 slots only those with a change are opened, on every level below them and for the rows."""
    a = spark.range(40_000).select("id", F.lit("v").alias("v"))
    before = changes.take(a, "id", f"{tmp_path}/a")
    after = changes.take(a.where("id <> 12345"), "id", f"{tmp_path}/b", before.ranges)
    out = changes.compare(spark, before, after)
    assert [(r.key, r.change) for r in out.collect()] == [(12345, "removed")]
    slot = f"slot=L{12345 >> before.ranges.slot}"
    scans = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in x]
    assert len(os.listdir(f"{tmp_path}/a/rows")) > 100 and scans
    assert all(slot.removeprefix("slot=L") in x.split("PartitionFilters")[1].split("]")[0] for x in scans)
