"""Centroid clustering in exact integers, with bounds from the norms of blocks.

A vector of floats becomes one of integers, floor(scale * x). It is kept with the norms of its segments of `block`
components, worked out once; a round's centroids get theirs too. By Cauchy and Schwarz a segment's squared distance is at
least the squared difference of the two norms, so the sum over segments bounds the squared distance from below. A vector
is first measured against the centroid of least bound; only centroids whose bound doesn't exceed what that gives receive
exact distances. Bounds are rounded towards zero, so ties are never pruned.

A round reads the table of integer vectors, adds up each task's vectors by cluster, and shuffles at most k sums a task;
the k new centroids are all that the driver and the tasks share, whatever the number of vectors. A cluster may hold all
vectors, as sums are formed before the shuffle.

Vectors that are null, of another length, or hold null or non-finite components are left out. Fewer vectors than k make
fewer clusters; no vector, an empty result. Repeated rows count as often as they occur. Of equal distances the smaller
number wins. A null id is carried through and comes last among the first centroids, equal ids by their components.
Extra columns are ignored. Components beyond `MOST` in size, whose distances a long couldn't hold, raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Writer, dropped, only, parts, table, written

#: Largest size of an integer component. Distances of 64 of them stay below 2 ** 63.
MOST = 1 << 27
#: Vectors that are measured at a time.
ROWS = 4096


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, "<i4").tobytes()


def norms_of(vectors: np.ndarray, block: int) -> np.ndarray:
    """Euclidean norms of the segments, as doubles."""
    pad = -vectors.shape[1] % block
    whole = np.pad(vectors.astype(np.float64), ((0, 0), (0, pad)))
    return np.sqrt((whole.reshape(len(whole), whole.shape[1] // block, block) ** 2).sum(axis=2))


def exact(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows, in integers."""
    apart = vectors.astype(np.int64) - centroids
    return np.einsum("ij,ij->i", apart, apart)


class Screen:
    """A round's centroids with the norms of their segments; counts the exact distances that bounds couldn't spare."""

    def __init__(self, centroids: np.ndarray, block: int) -> None:
        self.centroids, self.norms, self.measured = centroids, norms_of(centroids, block), 0

    def bounds(self, norms: np.ndarray) -> np.ndarray:
        """Lower bounds of squared distances, a row for each vector. The rounding of norms and sums is far below what is taken
        off: one part in 10 ** 9 of the squares that go in."""
        squares = (norms**2).sum(axis=1)[:, None] + (self.norms**2).sum(axis=1)[None, :]
        return np.maximum(squares - 2 * (norms @ self.norms.T) - 1e-9 * squares, 0)

    def nearest(self, vectors: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector, the smaller number on ties, and the squared distance."""
        bounds = self.bounds(norms)
        best = bounds.argmin(axis=1)
        least = exact(vectors, self.centroids[best])
        bounds[np.arange(len(best)), best] = np.inf
        row, candidate = np.nonzero(bounds <= least[:, None])
        self.measured += len(best) + len(row)
        for i in range(0, len(row), 16 * ROWS):
            r, c = row[i : i + 16 * ROWS], candidate[i : i + 16 * ROWS]
            found = exact(vectors[r], self.centroids[c])
            # By row, then distance, then number: the first of each row is its best.
            order = np.lexsort((c, found, r))
            first = order[np.concatenate([[True], np.diff(r[order]) > 0])]
            r, c, found = r[first], c[first], found[first]
            better = (found < least[r]) | ((found == least[r]) & (c < best[r]))
            best[r[better]], least[r[better]] = c[better], found[better]
        return best, least


class Centroids:
    """`k` centroids of `size` components, `rounds` replacements; the first ones are the vectors of least digest of `salt` and id."""

    def __init__(self, k: int = 40, size: int = 64, rounds: int = 5, scale: int = 256, block: int = 8, salt: str = "2:") -> None:
        self.k, self.size, self.rounds, self.scale, self.block, self.salt = k, size, rounds, scale, block, salt

    def vectors(self, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """vec_id, the integer components and the norms of the segments, both as bytes."""
        sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
        own = only(df, vec_id=id_col, vector=vector_col)
        kept = own.where((F.size("vector") == self.size) & F.forall("vector", sound)).withColumn("vector", F.transform("vector", lambda x: x.cast("double")))
        size, scale, block = self.size, self.scale, self.block
        schema = pa.schema([("vec_id", pa.int64()), ("body", pa.binary()), ("norms", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    whole = np.floor(scale * b.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, size)
                    if np.abs(whole).max() > MOST:
                        raise ArithmeticError(f"components of a vector exceed {MOST}: their squared distance is no long")
                    vectors = whole.astype(np.int32)
                    norms = norms_of(vectors, block)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packed(v) for v in vectors], pa.binary()), pa.array([n.tobytes() for n in norms], pa.binary())], schema=schema)

        return kept.mapInArrow(run, "vec_id bigint, body binary, norms binary")

    def first(self, vectors: DataFrame) -> np.ndarray:
        """At most k vectors, by the digest of their id, then their components."""
        rank = F.sha2(F.concat(F.lit(self.salt), F.col("vec_id").cast("string")), 256)
        rows = vectors.select(rank.alias("rank"), "vec_id", "body").orderBy(F.asc_nulls_last("rank"), "vec_id", "body").limit(self.k).collect()
        return np.array([np.frombuffer(r.body, "<i4") for r in rows], np.int64).reshape(-1, self.size)

    def measured(self, batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """Slices of the batches with their vectors, nearest centroids and distances."""
        screen = Screen(centroids, self.block)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                vectors = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4").reshape(-1, self.size)
                norms = np.frombuffer(b"".join(b.column(2).to_pylist()), np.float64).reshape(len(vectors), -1)
                yield b, vectors, *screen.nearest(vectors, norms)

    def sums(self, vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
        """cluster, rows and the sums of components, a row for each cluster that has a vector."""
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, rows = np.zeros((len(centroids), size), np.int64), np.zeros(len(centroids), np.int64)
            for _, own, best, _ in self.measured(batches, centroids):
                order = np.argsort(best, kind="stable")
                at = np.flatnonzero(np.diff(best[order], prepend=-1))
                sums[best[order][at]] += np.add.reduceat(own[order].astype(np.int64), at, axis=0)
                rows += np.bincount(best, minlength=len(rows))
            used = np.flatnonzero(rows)
            flat = sums[used].ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, size), pa.int32()), pa.array(np.tile(np.arange(size), len(used)), pa.int32()), pa.array(flat, pa.int64()), pa.array(np.repeat(rows[used], size), pa.int64())], names=["cluster", "component", "total", "rows"])

        partial = vectors.mapInArrow(run, "cluster int, component int, total bigint, rows bigint")
        return partial.groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows"))

    def replaced(self, vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
        """The centroids after a round: floors of exact means, empty ones as they were. At most k * size sums are collected."""
        out = centroids.copy()
        for r in self.sums(vectors, centroids).collect():
            out[r.cluster, r.component] = r.total // r["rows"]
        return out

    def fit(self, vectors: DataFrame) -> np.ndarray:
        centroids = self.first(vectors)
        for _ in range(self.rounds):
            new = self.replaced(vectors, centroids) if len(centroids) else centroids
            if (new == centroids).all():
                break
            centroids = new
        return centroids

    def assign(self, vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
        """vec_id, cluster, distance."""
        schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, _, best, least in self.measured(batches, centroids):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.int32()), pa.array(least, pa.int64())], schema=schema)

        return vectors.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")

    def clusters(self, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
        spark = df.sparkSession
        vectors = written(self.vectors(df, id_col, vector_col).repartition(parts(spark)), "vectors")
        centroids = self.fit(vectors)
        assigned = written(self.assign(vectors, centroids), "assigned")
        dropped(vectors)
        inertia = {r.cluster: r.inertia for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # at most k
        figures = [(c, n, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in inertia.items()]
        return assigned.join(F.broadcast(spark.createDataFrame(figures, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")), "cluster")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Centroids().clusters(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5) -> str:
    """All distances, round by round, in whole numbers."""
    nearest = """SELECT v.vec_id, any_value(v.x) AS x, min(struct_pack(d := list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c := c.c)) AS best
  FROM vectors v CROSS JOIN {0} c GROUP BY v.vec_id, v.row"""
    steps = [
        f"""vectors AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS c, x FROM vectors ORDER BY sha256('2:' || vec_id) LIMIT {k})"""
    ]
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED (
  {nearest.format(f"c{r}")}),
p{r} AS (
  SELECT best.c AS c, i, sum(x[i]) AS total, count(*) AS n FROM a{r} CROSS JOIN range(1, 65) t(i) GROUP BY best.c, i),
m{r} AS (
  SELECT c, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM p{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)""")
    steps.append(f"last AS MATERIALIZED ({nearest.format(f'c{rounds}')})")
    return f"""WITH {", ".join(steps)}
SELECT l.vec_id, l.best.c AS cluster, l.best.d AS distance, CAST(sum(l.best.d) OVER (PARTITION BY l.best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(l.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM last l JOIN c{rounds} c ON c.c = l.best.c"""


OP13_SQL = _sql()
