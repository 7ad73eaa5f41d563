import numpy as np
import pytest

from tessera.llm.components import components
from tessera.llm.jaccard_join import JaccardJoin, Verifier, digest_of, forest_of, hashed, least_matches, shingles, signature, survivors, upper_tail


def brute(texts, threshold=0.8):
    """class_id and n_links by all pairs."""
    sets = {k: shingles(t) for k, t in texts.items()}
    near = {k: [j for j, b in sets.items() if j != k and a and b and len(a & b) >= threshold * len(a | b) - 1e-9] for k, a in sets.items()}
    out = {}
    for k in texts:
        seen, todo = {k}, [k]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[k] = (min(seen), len(near[k]))
    return out


def got(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


@pytest.mark.parametrize("block", [1_000_000, 2000])
def test_whole_table_against_brute_force(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute({r.doc_id: r.text for r in docs.collect()})
    assert got(JaccardJoin(block_shingles=block).links(docs)) == want and any(n for _, n in want.values())


def test_odd_rows(spark):
    base = "one two three four five six seven eight nine ten eleven twelve".split()
    texts = {1: None, 2: "", 3: "  \n", 4: "a b", 5: "a  b", 6: "a b c", 7: " ".join(base * 3), 8: " ".join(base * 4), 9: "w" * 200000, 10: " ".join(str(i) for i in range(40000)), 11: " ".join(str(i) for i in range(39000))}
    data = [(k, t, 1, "x") for k, t in texts.items()] + [(None, "a b", 1, "x"), (4, "a b", 1, "x")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, component int, key string")
    assert got(JaccardJoin().links(df)) == brute(texts)
    assert JaccardJoin().links(df.limit(0)).count() == 0


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for k in range(300):
        w = list(base)
        for at in rng.integers(0, 200, rng.integers(0, 6)):
            w[at] = f"x{k}"
        texts[k] = " ".join(w)
    df = spark.createDataFrame([*texts.items()], "doc_id bigint, text string")
    assert got(JaccardJoin(block_shingles=15_000, block=70).links(df)) == brute(texts)


@pytest.mark.parametrize("deal", [1, 2, 3, 5, 7])
def test_repeated_ids_count_as_the_text_of_the_smallest_digest(spark, deal):
    w = [f"w{i}" for i in range(100)]
    rows = [(5, " ".join(w)), (5, " ".join(w[::-1])), (8, " ".join([*w[:-1], "x"])), (9, " ".join(w[::-1][1:])), (5, None)]
    own = min((t for k, t in rows if k == 5 and t), key=lambda t: digest_of(hashed(shingles(t))))
    df = spark.createDataFrame(rows * 2, "doc_id bigint, text string").repartition(deal, "text")
    assert got(JaccardJoin().links(df)) == brute({5: own, 8: rows[2][1], 9: rows[3][1]})


def test_forests_tie_what_pruning_leaves_and_nothing_else():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 256, (3, 128))
    sig = np.array([np.where(rng.random(128) < 0.05, rng.integers(0, 256, 128), base[k % 3]) for k in range(30)], np.uint8)
    for side in (np.zeros(30, bool), np.arange(30) >= 15):
        edges = forest_of(sig, side, least_matches(0.8, 1e-7))
        assert len(edges) == 27 and all(i % 3 == j % 3 for i, j in edges)


def test_products_equal_intersections():
    rng, v = np.random.default_rng(1), Verifier()
    sets = [{str(x).encode() for x in rng.integers(0, 60, 30)} for _ in range(70)]
    for s in sets:
        v.add(s)
    i, j = np.nonzero(np.triu(np.ones((70, 70)), 1))
    assert v.common(i, j).tolist() == [len(sets[a] & sets[b]) for a, b in zip(i, j, strict=True)]


def test_posterior_prunes_only_the_unlikely():
    assert upper_tail(0, 0, 0.8) == pytest.approx(0.2) and upper_tail(128, 128, 0.8) > 0.999999
    needs = dict(least_matches(0.8, 1e-7))
    assert all(upper_tail(m, n, 0.8) >= 1e-7 > upper_tail(m - 1, n, 0.8) for n, m in needs.items())


def test_similar_sets_survive():
    a = [{f"{i} {k}".encode() for i in range(50 - k)} | {f"{i} 0".encode() for i in range(500)} for k in range(5)]
    s = np.array([signature(hashed(x)) for x in a])
    assert sum(len(i) for i, _ in survivors(s, s, True, 0.8, 1e-7)) == 10


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 200)] + [(500, k) for k in range(501, 540)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100} | {k: 500 for k in range(500, 540)}
