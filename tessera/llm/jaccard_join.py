"""Similarity join on word n-grams with Bayesian pruning of candidates.

1. Every document's set of five-word shingles gives a 128-bit digest and a MinHash signature. Documents with one digest
   form a class (copies); only the class's smallest id goes on.
2. Bands of the signature put similar representatives into one bucket; buckets of the same members count once. A bucket
   is worked through in pairs of bounded blocks. There signatures (eight bits a value, so that equal ones can only be
   overstated) are compared piece by piece: a pair goes as soon as, under a uniform prior, the probability that it
   reaches the threshold falls below the tolerance. Pairs within one tree of the block's forest are not compared again,
   and only the forest of the pairs that are left is returned: what merely shares a bucket ties nothing together.
3. The forest's components are the candidate clusters. A cluster is compared within one task, or, if it is large, in
   blocks of bounded size, each pair of blocks in a task: full signatures are pruned alike, and what is left is verified
   exactly on the shingles themselves.
4. Tasks return link counts and a spanning forest of the links, whose components are the classes of near duplicates.

With 32 bands of 4 values a pair at the threshold 0.8 shares no bucket with probability below 5e-8, and pruning adds the
tolerance, 1e-7 by default, at each of the two steps.

A text of fewer than five words has one shingle, all its words; a text without words, or null, has none and links with
nothing. Words are `[^\\x20\\x09-\\x0D]+`. Rows with a null id are left out, as nothing could refer to them. Rows that
repeat an id count as one document, that whose shingles have the smallest digest, however the rows are dealt. Equal texts
are always linked; of copies the smallest id stands for all. Very long texts are read whole; one that exceeds a block is
a block of its own cluster's work. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Writer, only, parts, rows, table, written
from tessera.llm.components import components

HASHES, BANDS, STEP = 128, 32, 32


def shingles(text: str | None, n: int = 5) -> set[bytes]:
    w = (text or "").encode("utf-8", "surrogatepass").split()
    if len(w) <= n:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*[w[i:] for i in range(n)], strict=False)))


@lru_cache
def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(1, 1 << 32, HASHES, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, HASHES, np.uint32)


def hashed(found: set[bytes]) -> np.ndarray:
    """64-bit hashes of shingles, alike in every process, sorted."""
    import xxhash

    return np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))


def digest_of(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def signature(h: np.ndarray) -> np.ndarray:
    a, b = permutations()
    low = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        x = low[i : i + 1024][None, :] * a[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(2246822519)
        x += b[:, None]
        np.minimum(out, x.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows_ = sig.reshape(BANDS, -1).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for c in range(rows_.shape[1]):
        key = (key ^ rows_[:, c]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def upper_tail(m: int, n: int, t: float) -> float:
    """P(J >= t) for m of n equal MinHash values and a uniform prior: the tail of Beta(m + 1, n - m + 1)."""
    return sum(np.exp(lgamma(n + 2) - lgamma(k + 1) - lgamma(n + 2 - k) + k * np.log(t) + (n + 1 - k) * np.log1p(-t)) for k in range(m + 1))


@lru_cache
def least_matches(threshold: float, tolerance: float) -> tuple[tuple[int, int], ...]:
    """(values compared, matches needed to go on) for each piece of the signature."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        need = 0
        while need <= n and upper_tail(need, n, threshold) < tolerance:
            need += 1
        out.append((n, need))
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, same: bool, threshold: float, tolerance: float, cells: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of a, j of b) that pruning leaves, a strip of rows at a time; with same, i < j only."""
    needs = least_matches(threshold, tolerance)
    strip = max(1, cells // max(1, len(b)))
    for at in range(0, len(a), strip):
        rows_ = a[at : at + strip]
        n, need = needs[0]
        count = np.zeros((len(rows_), len(b)), np.uint8)
        for k in range(n):
            count += rows_[:, k, None] == b[None, :, k]
        keep = count >= need
        if same:
            keep &= (np.arange(at, at + len(rows_))[:, None]) < np.arange(len(b))[None, :]
        i, j = np.nonzero(keep)
        matches = count[i, j].astype(np.int64)
        for (low, _), (high, need) in zip(needs, needs[1:], strict=False):
            if not len(i):
                break
            for s in range(0, len(i), cells // STEP):
                e = s + cells // STEP
                matches[s:e] += (rows_[i[s:e], low:high] == b[j[s:e], low:high]).sum(axis=1)
            left = matches >= need
            i, j, matches = i[left], j[left], matches[left]
        if len(i):
            yield i + at, j


def forest_of(sig: np.ndarray, side: np.ndarray, needs: tuple[tuple[int, int], ...]) -> list[tuple[int, int]]:
    """Index pairs that tie together what pruning leaves of the pairs of a block (no True in side) or of two blocks."""
    root, edges = np.arange(len(sig)), []
    across = bool(side.any())
    for i in np.flatnonzero(~side).tolist() if across else range(len(sig) - 1):
        left = np.flatnonzero(side & (root != root[i])) if across else i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        count, low = np.zeros(len(left), np.int64), 0
        for high, need in needs:
            if not len(left):
                break
            count += (sig[left, low:high] == sig[i, low:high]).sum(axis=1)
            left, count, low = left[count >= need], count[count >= need], high
        for j in left[np.unique(root[left], return_index=True)[1]].tolist():
            edges.append((i, j))
            root[root == root[j]] = root[i]
    return edges


class Verifier:
    """Exact intersections of shingle sets, which share one numbering."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.sets: list[np.ndarray] = []

    def add(self, found: set[bytes]) -> None:
        n = self.numbers
        self.sets.append(np.sort(np.fromiter((n.setdefault(s, len(n)) for s in found), np.int64, len(found))))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of sets i[k] and j[k]."""
        rows_, cols = np.unique(i), np.unique(j)
        if len(i) > 2000 and len(i) * 8 > len(rows_) * len(cols):
            return self.by_product(rows_, cols)[np.searchsorted(rows_, i), np.searchsorted(cols, j)]
        return np.array([len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)

    def by_product(self, rows_: np.ndarray, cols: np.ndarray, width: int = 2048) -> np.ndarray:
        """All intersections of two groups as products of 0-1 matrices over the shingles that both groups have."""
        left, right = (np.concatenate([self.sets[k] for k in ks]) for ks in (rows_, cols))
        shared = np.intersect1d(np.unique(left), np.unique(right), assume_unique=True)
        out = np.zeros((len(rows_), len(cols)), np.float32)
        if not len(shared):
            return out
        of = []
        for ks, flat in ((rows_, left), (cols, right)):
            owner = np.repeat(np.arange(len(ks)), [len(self.sets[k]) for k in ks])
            at = np.searchsorted(shared, flat)
            ok = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == flat)
            owner, at = owner[ok], at[ok]
            order = np.argsort(at, kind="stable")
            of.append((owner[order], at[order]))
        for s in range(0, len(shared), width):
            m = []
            for ks, (owner, at) in zip((rows_, cols), of, strict=True):
                lo, hi = np.searchsorted(at, [s, s + width])
                x = np.zeros((len(ks), min(width, len(shared) - s)), np.float32)
                x[owner[lo:hi], at[lo:hi] - s] = 1
                m.append(x)
            out += m[0] @ m[1].T
        return out


class Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(p, p)
            x = p
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def compared(group: list[tuple[int, int, bool, bytes, str]], n: int, threshold: float, tolerance: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Linked documents of each id, and forest edges. group: id, members of its class, side, digest, text; side False
    marks block one, True block two; if all are False, the block is compared with itself. Of rows that repeat an id the
    one with the digest counts."""
    verifier, sigs, sizes, ids, weights, sides = Verifier(), [], [], [], [], []
    for doc_id, members, side, digest, t in group:
        found = shingles(t, n)
        h = hashed(found)
        if digest_of(h) != digest or (ids and ids[-1] == doc_id):
            continue
        ids.append(doc_id)
        weights.append(members)
        sides.append(side)
        sigs.append(signature(h))
        sizes.append(len(found))
        verifier.add(found)
    verifier.numbers.clear()
    sig, size, side = np.array(sigs).reshape(-1, HASHES), np.array(sizes), np.array(sides, bool)
    one, two = np.flatnonzero(~side), np.flatnonzero(side)
    links: dict[int, int] = defaultdict(int)
    forest, edges = Forest(), []
    same = not len(two)
    for i, j in survivors(sig[one], sig[one if same else two], same, threshold, tolerance):
        i, j = one[i], (one if same else two)[j]
        both = verifier.common(i, j)
        ok = both * (1 + threshold) >= threshold * (size[i] + size[j]) - 1e-9
        for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
            links[ids[x]] += weights[y]
            links[ids[y]] += weights[x]
            if forest.join(x, y):
                edges.append((ids[x], ids[y]))
    return links, edges


class JaccardJoin:
    def __init__(self, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-7, block_shingles: int = 500_000, block: int = 2000) -> None:
        self.n, self.threshold, self.tolerance, self.block_shingles, self.block = n, threshold, tolerance, block_shingles, block

    def sketched(self, docs: DataFrame) -> DataFrame:
        """doc_id, digest, n_shingles, keys, low (the low bytes of the signature): a row for every document that has words."""
        n = self.n
        schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_shingles", pa.int64()), ("keys", pa.list_(pa.int64())), ("low", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = Writer(schema, 5000)
            for doc_id, text in rows(batches, "doc_id", "text"):
                h = hashed(shingles(text, n))
                if len(h):
                    sig = signature(h)
                    if out.add(doc_id, digest_of(h), len(h), band_keys(sig).tolist(), sig.astype(np.uint8).tobytes()):
                        yield out.take()
            yield out.take()

        return docs.mapInArrow(run, "doc_id bigint, digest binary, n_shingles bigint, keys array<bigint>, low binary")

    def links(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, class_id (smallest id reachable by links), n_links (other documents linked directly), copy_of."""
        named = only(docs, doc_id=id_col, text=text_col).where("doc_id IS NOT NULL")
        sketched = written(self.sketched(named), "sketches")
        names = written(sketched.groupBy("doc_id").agg(F.min(F.struct("digest", "n_shingles")).alias("d")).select("doc_id", "d.digest", "d.n_shingles"), "names")
        copies = written(names.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.first("n_shingles").alias("n_shingles")), "classes")
        # By id and digest: a large class of copies is one row here.
        reps = sketched.join(copies.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"]).dropDuplicates(["doc_id"])
        reps = written(reps.select("doc_id", "keys", "low"), "representatives")
        clusters = written(components(self.ties(reps)), "clusters")
        counted, forest = self.verified(named, clusters, copies)
        linked = components(forest)
        told = copies.join(counted, copies["rep"] == counted["id"], "left").join(linked, copies["rep"] == linked["node"], "left")
        told = told.select("digest", "rep", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"))
        by_doc = names.select("doc_id", "digest").join(told, "digest").select("doc_id", "class_id", "n_links", F.col("rep").alias("copy_of"))
        wordless = named.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select("doc_id").distinct().join(names.select("doc_id"), "doc_id", "left_anti")
        return by_doc.unionByName(wordless.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("doc_id").alias("copy_of")))

    def ties(self, reps: DataFrame) -> DataFrame:
        """(a, b): forests of what pruning leaves of the pairs of each bucket."""
        bands = reps.select("doc_id", F.explode("keys").alias("key"))
        buckets = bands.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("p"), F.bit_xor(F.xxhash64("doc_id", F.lit(7))).alias("q")).where("n > 1")
        buckets = written(buckets.groupBy("least", "n", "p", "q").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / self.block).cast("int").alias("blocks")), "buckets")
        held = bands.join(buckets, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        spread = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keyed = spread.select("key", F.least("block", "other").alias("lower"), F.greatest("block", "other").alias("upper"), (F.col("block") > F.col("other")).alias("side"), "doc_id")
        keyed = keyed.join(reps.select("doc_id", "low"), "doc_id")
        needs = least_matches(self.threshold, self.tolerance)
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, now, group = Writer(schema, 20_000), None, []

            def done() -> None:
                ids, sides, low = zip(*group, strict=True)
                side = np.array(sides)
                if now[1] != now[2] and (side.all() or not side.any()):
                    return
                for i, j in forest_of(np.frombuffer(b"".join(low), np.uint8).reshape(-1, HASHES), side, needs):
                    out.add(ids[i], ids[j])

            for key, lower, upper, *row in rows(batches, "key", "lower", "upper", "doc_id", "side", "low"):
                if (key, lower, upper) != now:
                    if len(group) > 1:
                        done()
                    if len(out.cells[0]) >= out.limit:
                        yield out.take()
                    now, group = (key, lower, upper), []
                group.append(row)
            if len(group) > 1:
                done()
            yield out.take()

        tasks = keyed.repartition(parts(reps.sparkSession), "key", "lower", "upper").sortWithinPartitions("key", "lower", "upper", "doc_id")
        return tasks.mapInArrow(run, "a bigint, b bigint").distinct()

    def verified(self, named: DataFrame, clusters: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(id, n): documents linked to each representative outside its class; (a, b): a forest of the links."""
        sized = clusters.join(copies, clusters["node"] == copies["rep"]).select("node", "component", "members", "n_shingles", "digest")
        whole = sized.groupBy("component").agg(F.ceil(F.sum("n_shingles") / self.block_shingles).cast("int").alias("blocks"))
        placed = sized.join(whole, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        texts = named.join(placed, named["doc_id"] == placed["node"])
        # A task's key is (cluster, lower block, upper block); each document goes to the tasks of its own block's pairs.
        spread = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keyed = spread.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).alias("side"), "doc_id", "members", "digest", "text")
        n, threshold, tolerance = self.n, self.threshold, self.tolerance
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, now, group = Writer(schema, 20_000), None, []

            def done() -> None:
                if len(group) > 1:
                    if now[1] == now[2] or 0 < sum(g[2] for g in group) < len(group):
                        counts, edges = compared(group, n, threshold, tolerance)
                        for x, c in counts.items():
                            out.add(x, None, c)
                        for x, y in edges:
                            out.add(x, y, None)

            for c, low, high, *row in rows(batches, "component", "low", "high", "doc_id", "members", "side", "digest", "text"):
                if (c, low, high) != now:
                    done()
                    if len(out.cells[0]) >= out.limit:
                        yield out.take()
                    now, group = (c, low, high), []
                group.append(row)
            done()
            yield out.take()

        tasks = keyed.repartition(parts(named.sparkSession), "component", "low", "high").sortWithinPartitions("component", "low", "high", "doc_id")
        found = written(tasks.mapInArrow(run, "a bigint, b bigint, n bigint"), "links")
        return found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n")), found.where("b IS NOT NULL").select("a", "b")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin().links(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


#: All pairs that share a shingle, and what the smallest id of a component reaches.
OP9_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END)) AS g FROM t
), n AS (
  SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n AS i ON i.doc_id = x JOIN n AS j ON j.doc_id = y WHERE 18 * c >= 8 * (i.k + j.k)
), linked AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), reached(doc_id, least) AS (
  SELECT doc_id, doc_id FROM t UNION SELECT y, least FROM reached JOIN linked ON x = reached.doc_id AND least < y
), degrees AS (
  SELECT x, count(*) AS n_links FROM linked GROUP BY x
), classes AS (
  SELECT doc_id, min(least) AS class_id FROM reached GROUP BY doc_id
)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM classes LEFT JOIN degrees ON x = doc_id
"""
