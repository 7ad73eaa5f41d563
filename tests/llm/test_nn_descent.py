import numpy as np
import pytest

from tessera.llm.nn_descent import NnDescent, balls, best, linked, sketch, sketches, usable


def brute(data, threshold=0.9):
    """n_links, component_id, kept by all pairs."""
    unit = {}
    for k, v in data:
        unit[k] = usable(v, 64)
    ids = [k for k, u in unit.items() if u is not None]
    x = np.stack([unit[k] for k in ids])
    hit = x @ x.T >= threshold
    np.fill_diagonal(hit, False)
    near = {k: [ids[j] for j in np.flatnonzero(h)] for k, h in zip(ids, hit, strict=True)}
    out = {}
    for k in unit:
        seen, todo = {k}, [k]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[k] = (len(near.get(k, ())), min(seen), min(seen) == k)
    return out


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    op = NnDescent()
    assert got(op.links(df)) == want and op.found_recall == 1.0


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    v = [rng.standard_normal(64).tolist() for _ in range(4)]
    rows = [(9, v[0]), (2, v[0]), (5, [2 * x for x in v[0]]), (1, None), (3, [0.0] * 64), (4, [float("nan"), *v[1][1:]]), (6, [float("inf"), *v[1][1:]]), (7, [None, *v[1][1:]]), (8, v[1]), (8, v[1]), (10, [1.0, 2.0]), (11, [1e-30 * x for x in v[2]]), (12, v[2]), (None, v[0])]
    df = spark.createDataFrame([(k, x, 1, "x") for k, x in rows], "vec_id bigint, embedding array<double>, label int, node string")
    assert got(NnDescent().links(df)) == brute([r for r in rows if r[0] is not None])
    assert NnDescent().links(df.limit(0)).count() == 0
    assert got(NnDescent().links(df.where("vec_id = 3"))) == {3: (0, 3, True)}


def test_dense_group_in_blocks(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(64)
    data = [(k, (base + rng.standard_normal(64) * (0.2 if k < 500 else 2)).tolist()) for k in range(700)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    assert got(NnDescent(block=90, k=6).links(df)) == brute(data)


@pytest.mark.parametrize("block", [40, 4000])
def test_links_between_tight_groups_larger_than_the_lists(spark, block):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(64)
    base /= np.linalg.norm(base)
    data = []
    for g in range(8):  # centres at a cosine of about 0.93, members at more than 0.99
        c = base + 0.27 * np.linalg.qr(np.stack([base, rng.standard_normal(64)]).T)[0][:, 1]
        data += [(100 * g + i, (c + rng.standard_normal(64) * 0.004).tolist()) for i in range(70)]
    data += [(5000 + i, rng.standard_normal(64).tolist()) for i in range(60)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    want = brute(data)
    assert max(n for n, _, _ in want.values()) > 400
    op = NnDescent(k=6, block=block)
    assert got(op.links(df)) == want and op.found_recall == 1.0


def test_links_between_the_ends_of_two_arcs(spark):
    """Dense arcs of 40 degrees, 20 apart: the medoids of their balls are not linked, the ends are."""
    basis = np.linalg.qr(np.random.default_rng(4).standard_normal((64, 2)))[0].T
    at = np.radians(np.concatenate([np.linspace(0, 40, 200), np.linspace(60, 100, 200)]))
    data = [(i, (np.cos(t) * basis[0] + np.sin(t) * basis[1]).tolist()) for i, t in enumerate(at)]
    assert got(NnDescent(k=4, repeats=0, block=150).links(spark.createDataFrame(data, "vec_id bigint, embedding array<double>"))) == brute(data)


def test_balls_cover_all_within_their_radius():
    x = np.stack([usable(v, 8) for v in np.random.default_rng(3).standard_normal((200, 8)).tolist()])
    seen = []
    for ids, units, centre, radius in balls(np.arange(200), x, 0.8):
        assert (np.arccos(np.clip(units @ centre, -1, 1)) <= radius).all()
        seen += ids.tolist()
    assert sorted(seen) == list(range(200))


def test_a_failed_audit_is_reported(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    with pytest.warns(UserWarning, match="audited links"):
        NnDescent(recall=1.1, repeats=0, rounds=1).links(df)


def test_a_recall_below_the_least_is_an_error(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    with pytest.raises(RuntimeError, match="audited links"):
        NnDescent(recall=1.1, least_recall=1.05, repeats=0, rounds=1).links(df)


def test_saturated_lists_grow():
    ids, sims = np.arange(40), np.linspace(1, 0.8, 40).astype(np.float32)
    assert len(best(ids, sims, 4)[0]) == 4 and len(best(ids, sims, 4, 0.95)[0]) == 10 and len(best(ids, sims, 4, 0.85)[0]) == 16


def test_sketches_are_close():
    x = np.stack([usable(v, 64) for v in np.random.default_rng(0).standard_normal((50, 64)).tolist()])
    s = sketches([sketch(v) for v in x])
    assert np.abs(s @ s.T - x @ x.T).max() < 0.02


def test_best_keeps_distinct_ids():
    ids, sims = best(np.array([5, 3, 5, 1]), np.array([0.5, 0.5, 0.5, 0.9], np.float32), 2)
    assert ids.tolist() == [1, 3] and sims[0] == np.float32(0.9)


@pytest.mark.parametrize("same", [True, False])
def test_linked_counts_and_forest(same):
    x = np.array([[1, 0], [1, 0.1], [0, 1], [0.1, 1]], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    counts, edges = linked(np.array([1, 2, 3, 4]), np.array([1, 5, 1, 1]), np.array([False, True, False, True]), x, same, 0.9)
    assert counts.tolist() == [5, 1, 1, 1] and sorted(map(tuple, map(sorted, edges))) == [(1, 2), (3, 4)]
