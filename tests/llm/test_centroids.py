import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.centroids import Centroids, Screen, norms_of

FLOAT = st.integers(-300, 300)


def plain(rows, k, size, rounds):
    """Python integers only: vec_id, cluster, distance, digest of the centroid."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[0] or 0, np.array(r[1], "<i4").tobytes()))[:k]]
    square = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))

    def assigned():
        return [min((square(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        own = assigned()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, own) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = assigned()
    by = {n: sum(d for d, c in own if c == n) for n in range(len(centroids))}
    return [(i, c, d, by[c], sum(by.values()), names[c]) for (i, _), (d, c) in zip(kept, own)]


KEY = lambda r: (r[0] is None, r[0] or 0, *r[1:])


def clusters(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1, b"x") for i, v in rows], "vec_id bigint, embedding array<float>, cluster int, body binary")
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in Centroids(**how).clusters(df).collect()), key=KEY)


@settings(max_examples=200, deadline=None)
@given(vectors=st.lists(st.lists(FLOAT, min_size=6, max_size=6), min_size=1, max_size=30), centroids=st.lists(st.lists(FLOAT, min_size=6, max_size=6), min_size=1, max_size=9), scale=st.sampled_from([1, 1 << 18]))
def test_bounds_never_prune_the_nearest(vectors, centroids, scale):
    v, c = np.array(vectors, np.int32) * scale, np.array(centroids, np.int64) * scale
    screen = Screen(c, 4)
    whole = ((v[:, None, :].astype(object) - c[None, :, :]) ** 2).sum(axis=2)
    assert (screen.bounds(norms_of(v, 4)) <= whole.astype(float)).all()
    best, least = screen.nearest(v, norms_of(v, 4))
    assert least.tolist() == whole.min(axis=1).tolist() and best.tolist() == [r.index(min(r)) for r in whole.tolist()]


def test_bounds_spare_distances(spark):
    draw = np.random.default_rng(5)
    at = draw.normal(size=(40, 64)) * 200 * draw.gamma(1, 1, size=(40, 8)).repeat(8, axis=1)
    v = (at[draw.integers(0, 40, 5000)] + draw.normal(size=(5000, 64)) * 20).astype(np.int32)
    screen = Screen(at.astype(np.int64), 8)
    best, _ = screen.nearest(v, norms_of(v, 8))
    assert screen.measured < 0.2 * 5000 * 40
    assert (best == ((v[:, None, :] - at.astype(np.int64)[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()][:200]
    assert clusters(spark, rows, k=7, rounds=3) == sorted(plain(rows, 7, 64, 3), key=KEY)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0, -1.0]), (2, [0.001, -0.001, 5.0]), (2, [0.001, -0.001, 5.0]), (2, [9.0, 9.0, 9.0]), (None, [1.0, 1.0, 1.0]), (None, None), (3, None), (4, []), (5, [1.0, 2.0]), (6, [1.0, None, 2.0]), (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, [1.0, -inf, 1.0]), (10, [1.0] * 4)]
    rows += [(100 + i, [0.5, 0.5, 0.5]) for i in range(300)] + [(1000 + i, [i % 3 - 1.0, 0.0, i % 2 + 0.25]) for i in range(60)]
    for k in (1, 3, 5, 40):
        assert clusters(spark, rows, k=k, size=3, rounds=4, block=2) == sorted(plain(rows, k, 3, 4), key=KEY)
    assert clusters(spark, rows[5:9], k=3, size=3) == []


def test_components_beyond_a_long_are_an_error(spark):
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException, match="no long"):
        clusters(spark, [(1, [1e9, 0.0, 0.0])], k=1, size=3)
