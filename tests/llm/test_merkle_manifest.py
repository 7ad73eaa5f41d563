import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm.merkle_manifest import FIELDS, UPPER, Manifest

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, grp string, leaf int"


def digest(*strings):
    return hashlib.sha256("".join(strings).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS])


def tree(digests, fanout):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def siblings(levels, at, fanout):
    for level in levels[:-1]:
        run = at - at % fanout
        yield "".join(level[run:at]), "".join(level[at + 1 : run + fanout])
        at //= fanout


def plain(rows, fanout=8):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]], fanout)
    top, out = tree([trees[g][-1][0] for g in names], fanout), []
    for g in names:
        for at, r in enumerate(groups[g]):
            way = [*siblings(trees[g], at, fanout), *siblings(top, names.index(g), fanout)]
            told = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                told["text"] = r["text"].translate(str.maketrans(UPPER, UPPER.lower()))
            root = leaf(told)
            for left, right in way:
                root = digest(left, root, right)
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], digest(*[s for side in way for s in side]), root, root == top[-1][0]))
    return out


def found(docs, **how):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    out = Manifest(**how).proofs(docs, {"text": F.translate("text", UPPER, UPPER.lower())}, tampered)
    return [tuple(r)[:7] for r in out.collect()]


KEY = lambda r: (r[0] is not None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("how", [{}, {"levels": 1, "bucket": 20}, {"fanout": 3, "levels": 2, "bucket": 1}])
def test_whole_table(spark, how):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain([r.asDict() for r in docs.collect()], how.get("fanout", 8))
    assert sorted(found(docs, **how)) == sorted(want) and {r[6] for r in want} == {True, False}


def test_odd_rows(spark):
    random.seed(3)
    rows = [(random.choice([None, 1, 2, -(2**63), 2**63 - 1, random.randrange(-(2**62), 2**62)]), random.choice(["s", None, ""]), random.choice([None, "", "de", "é"]), random.choice([None, 5]), random.choice([None, "", "Ab", "x" * 9, "ÄB"]), "g", 1) for _ in range(150)]
    rows += [(7, "s", "de", 1, "Same Row", None, None)] * 90 + [(7, "s", "de", 1, f"other {i}", None, None) for i in range(40)] + [(8, "s", "zz", None, "Z" * 300_000, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(plain([r.asDict() for r in df.collect()]), key=KEY)
    for how in ({"levels": 1, "bucket": 4}, {}):
        assert sorted(found(df, **how), key=KEY) == want
    assert found(df.limit(0)) == []


def test_a_lone_row_is_its_own_root(spark):
    (row,) = found(spark.createDataFrame([(1, "s", None, 1, "Text", None, None)], SCHEMA))
    assert row[1] == row[2] == row[3] == row[5] and row[4] == digest() and row[6]


def test_many_groups_and_ranks_without_a_sort_of_all(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("g"), F.col("id") % 700).alias("lang"), F.lit(1).alias("n_chars"), F.lit("T").alias("text"))
    rows = docs.collect()
    assert sorted(found(docs, levels=2, bucket=50)) == sorted(plain([r.asDict() for r in rows]))
    manifest = Manifest(bucket=100)
    ranked = manifest.ranked(manifest.leaves(docs.withColumn("lang", F.lit("one"))))
    assert [(r.doc_id, r.first) for r in ranked.orderBy("doc_id").select("doc_id", F.col("first")).collect()] == [(i, i) for i in range(3000)]
    _, counts, _ = manifest.bucketed(manifest.leaves(docs.withColumn("lang", F.lit("one"))))
    assert counts.agg(F.max("rows")).first()[0] <= 100
