"""Near duplicates among embeddings by NN-descent.

1. Equal vectors form a class; its smallest id represents it. Representatives are kept as unit vectors in double
   precision and, for the search, as eight-bit sketches.
2. Each random-hyperplane tree deals the sketches to leaves, which are worked through in pieces of bounded size; the best
   `k` of a piece start the neighbour lists.
3. A round joins neighbours of neighbours: every node gets the sketches of its neighbours and of those that list it, in
   pieces of bounded size, compares pairs of which one is new, and offers each member what beats its list. A list that
   is saturated with links grows to four times its length. Rounds end when few lists change.
4. Edges near the threshold tie clusters together. A cluster is compared exactly, in double precision, in one task or in
   pairs of bounded blocks; tasks return link counts and a spanning forest of the links. So a list that is saturated with
   links loses none of them: its cluster's other links are counted here. Clusters that only links between saturated
   lists tie are found by covering those nodes with balls and comparing the balls that a bound on angles does not part.
5. Recall is audited: `audit` vectors of all, chosen by hash, are compared with every vector. While the links found fall
   short of `recall`, all lists are enlarged, trees added and rounds repeated. What then remains below it is reported in
   a warning; a recall below `least_recall` is an error, never a result.

Null, zero and non-finite vectors, and those of another length than most, link with nothing. Rows with a null id are left
out. Rows that repeat an id count as one, the first by its bytes. Equal similarities are ordered by id. Very long vectors
are compared whole. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Writer, dropped, only, parts, rows, table, written
from tessera.llm.components import components
from tessera.llm.jaccard_join import Forest

PIECE = 256
#: A saturated list grows to so many times its length.
WIDER = 4
LISTS = pa.schema([("node", pa.int64()), ("ids", pa.binary()), ("sims", pa.binary()), ("fresh", pa.binary())])
LISTS_SQL = "node bigint, ids binary, sims binary, fresh binary"


def usable(values: list | None, dims: int) -> np.ndarray | None:
    if values is None or len(values) != dims or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    top = np.abs(x).max() if dims else 0.0
    if not np.isfinite(top) or top == 0.0:
        return None
    x /= top
    return x / np.sqrt(x @ x)


def sketch(x: np.ndarray) -> bytes:
    """Eight-bit sketch of a unit vector, scaled to its largest component, with the scale that makes it a unit vector."""
    q = np.rint(x * (127 / np.abs(x).max())).astype(np.int8)
    return np.float32(1 / np.sqrt((q.astype(np.float64) ** 2).sum())).tobytes() + q.tobytes()


def sketches(found: list[bytes]) -> np.ndarray:
    """Unit float vectors of sketches."""
    raw = np.frombuffer(b"".join(found), np.uint8).reshape(len(found), -1)
    return raw[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


def best(ids: np.ndarray, sims: np.ndarray, k: int, linked_: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """The k most similar of distinct ids, ties by id; up to WIDER * k while they are at least as similar as linked_."""
    order = np.lexsort((ids, -sims))
    ids, sims = ids[order], sims[order]
    _, first = np.unique(ids, return_index=True)
    first.sort()
    k = max(k, min(WIDER * k, int((sims[first] >= linked_).sum())))
    return ids[first[:k]], sims[first[:k]]


def pieces(batches: Iterator[pa.RecordBatch], key: str, columns: tuple[str, ...], size: int) -> Iterator[tuple]:
    """Rows with one key that follow each other, at most size at a time."""
    now, group = None, []
    for k, *row in rows(batches, key, *columns):
        if (k != now or len(group) >= size) and group:
            yield now, group
            group = []
        now = k
        group.append(row)
    if group:
        yield now, group


class NnDescent:
    def __init__(self, threshold: float = 0.9, k: int = 12, trees: int = 8, rounds: int = 6, settled: float = 0.01, margin: float = 0.03, block: int = 4000, audit: int = 200, recall: float = 0.995, repeats: int = 2, least_recall: float = 0.9) -> None:
        self.threshold, self.k, self.trees, self.rounds, self.settled = threshold, k, trees, rounds, settled
        self.margin, self.block, self.audit, self.recall, self.repeats, self.least_recall = margin, block, audit, recall, repeats, least_recall

    def unit_vectors(self, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(vec_id, rep) of every vector, rep null where it links with nothing; (node, members, unit, sketch)."""
        lengths = vectors.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        dims = lengths["n"] if lengths else 0
        schema = pa.schema([("vec_id", pa.int64()), ("unit", pa.binary()), ("exact", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = Writer(schema, 5000)
            for vec_id, values in rows(batches, "vec_id", "embedding"):
                x = usable(values, dims)
                if out.add(vec_id, None if x is None else x.tobytes(), None if x is None else np.array(values, np.float64).tobytes()):
                    yield out.take()
            yield out.take()

        units = vectors.mapInArrow(run, "vec_id bigint, unit binary, exact binary").groupBy("vec_id").agg(F.min(F.struct("exact", "unit")).alias("v")).select("vec_id", "v.exact", "v.unit")
        units = written(units, "units")
        classes = units.where("exact IS NOT NULL").groupBy("exact").agg(F.min("vec_id").alias("node"), F.count("*").alias("members"), F.first("unit").alias("unit"))
        classes = written(classes, "vector-classes")
        named = written(units.join(classes.select("exact", "node"), "exact", "left").select("vec_id", F.col("node").alias("rep")), "vector-names")
        shape = pa.schema([("node", pa.int64()), ("members", pa.int64()), ("unit", pa.binary()), ("sketch", pa.binary())])

        def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = Writer(shape, 5000)
            for node, members, unit in rows(batches, "node", "members", "unit"):
                if out.add(node, members, unit, sketch(np.frombuffer(unit))):
                    yield out.take()
            yield out.take()

        return named, written(classes.mapInArrow(short, "node bigint, members bigint, unit binary, sketch binary"), "sketches")

    def leaves(self, nodes: DataFrame, n: int, trees: range, k: int) -> DataFrame:
        """Lists from trees of random hyperplanes; every leaf is worked through in pieces."""
        bits = max(0, int(np.ceil(np.log2(max(n, 1) / PIECE))))
        dealt = pa.schema([("leaf", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary())])

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes: dict[int, list[np.ndarray]] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                found = b.column(1).to_pylist()
                x = sketches(found)
                dims = x.shape[1]
                if dims not in planes:
                    planes[dims] = [np.random.default_rng(101 + t).standard_normal((dims, bits)).astype(np.float32) for t in trees]
                weights = np.int64(1) << np.arange(bits, dtype=np.int64)
                for t, p in zip(trees, planes[dims], strict=True):
                    leaf = ((x @ p > 0) @ weights if bits else np.zeros(len(x), np.int64)) + (np.int64(t) << 48)
                    yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), b.column(0), b.column(1)], schema=dealt)

        def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = Writer(LISTS, 5000)
            for _, group in pieces(batches, "leaf", ("node", "sketch"), 2 * PIECE):
                if len(group) < 2:
                    continue
                ids, x = np.array([g[0] for g in group], np.int64), sketches([g[1] for g in group])
                sims = x @ x.T
                np.fill_diagonal(sims, -2)
                m = min(k, len(ids) - 1)
                top = np.argpartition(-sims, m - 1, axis=1)[:, :m]
                for i, t in enumerate(top):
                    if out.add(int(ids[i]), ids[t].tobytes(), sims[i, t].tobytes(), b""):
                        yield out.take()
            yield out.take()

        tree = nodes.select("node", "sketch").mapInArrow(deal, "leaf bigint, node bigint, sketch binary")
        spread = tree.repartition(parts(nodes.sparkSession), "leaf").sortWithinPartitions("leaf", F.xxhash64("node"))
        return spread.mapInArrow(lists, LISTS_SQL)

    def merged(self, old: DataFrame | None, offers: DataFrame, k: int) -> DataFrame:
        """Lists after the offers; `fresh` marks what the old list had not."""

        near = self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, now, group = Writer(LISTS, 5000), None, []

            def done() -> bool:
                had = [np.frombuffer(i, np.int64) for i, _, f in group if f is not None]
                ids = np.concatenate([np.frombuffer(i, np.int64) for i, _, _ in group])
                sims = np.concatenate([np.frombuffer(s, np.float32) for _, s, _ in group])
                ids, sims = best(ids, sims, k, near)
                return out.add(now, ids.tobytes(), sims.tobytes(), (~np.isin(ids, had[0]) if had else np.ones(len(ids), bool)).tobytes())

            for node, ids, sims, fresh in rows(batches, "node", "ids", "sims", "fresh"):
                if node != now and group:
                    if done():
                        yield out.take()
                    group = []
                now = node
                group.append((ids, sims, fresh))
                if len(group) > 64:  # folded, so that a node with very many offers stays small
                    own = next((g for g in group if g[2] is not None), None)
                    rest = [g for g in group if g is not own]
                    i, s = best(np.concatenate([np.frombuffer(g[0], np.int64) for g in rest]), np.concatenate([np.frombuffer(g[1], np.float32) for g in rest]), 2 * k, near)
                    group = [*([own] if own else []), (i.tobytes(), s.tobytes(), None)]
            if group:
                done()
            yield out.take()

        bare = offers.select("node", "ids", "sims", F.lit(None).cast("binary").alias("fresh"))
        both = bare if old is None else old.unionByName(bare)
        return written(both.repartition(parts(offers.sparkSession), "node").sortWithinPartitions("node").mapInArrow(run, LISTS_SQL), "lists")

    def offers(self, lists: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
        """Neighbours of neighbours: what each node's neighbourhood offers its members."""
        edge = pa.schema([("at", pa.int64()), ("node", pa.int64()), ("fresh", pa.bool_())])

        def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """(at, node): node is a neighbour of at, or lists it."""
            for b in batches:
                cells: list[list] = [[], [], []]
                for node, ids, fresh in rows(iter([b]), "node", "ids", "fresh"):
                    ids, new = np.frombuffer(ids, np.int64), np.frombuffer(fresh, bool)
                    cells[0] += [ids, np.full(len(ids), node)]
                    cells[1] += [np.full(len(ids), node), ids]
                    cells[2] += [new, new]
                if cells[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(cells, edge, strict=True)], schema=edge)

        lows = lists.select("node", "sims").mapInArrow(low_ends(k, self.threshold), "node bigint, low float")
        facts = nodes.select("node", "sketch").join(lows, "node", "left")
        met = lists.mapInArrow(edges, "at bigint, node bigint, fresh boolean").groupBy("at", "node").agg(F.max("fresh").alias("fresh"))
        sent = met.join(facts, "node").select("at", "node", "fresh", "sketch", F.coalesce("low", F.lit(-1.0)).cast("float").alias("low"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = Writer(LISTS, 5000)
            for at, group in pieces(batches, "at", ("node", "fresh", "sketch", "low"), 64):
                ids = np.array([g[0] for g in group], np.int64)
                new, low, x = np.array([g[1] for g in group]), np.array([g[3] for g in group], np.float32), sketches([g[2] for g in group])
                sims = x @ x.T
                good = (sims > low[:, None]) & (new[:, None] | new[None, :])
                np.fill_diagonal(good, False)
                for i in np.flatnonzero(good.any(axis=1)):
                    j = np.flatnonzero(good[i])
                    if len(j) > k:
                        j = j[np.argpartition(-sims[i, j], k - 1)[:k]]
                    if out.add(int(ids[i]), ids[j].tobytes(), sims[i, j].tobytes(), None):
                        yield out.take()
            yield out.take()

        spread = sent.repartition(parts(lists.sparkSession), "at").sortWithinPartitions("at", F.desc("fresh"), "node")
        return spread.mapInArrow(run, LISTS_SQL)

    def graph(self, nodes: DataFrame, n: int, lists: DataFrame | None, trees: range, k: int) -> DataFrame:
        lists = self.merged(lists, self.leaves(nodes, n, trees, k), k)
        for _ in range(self.rounds):
            before, lists = lists, self.merged(lists, self.offers(lists, nodes, k), k)
            dropped(before)
            changed = lists.agg(F.sum(F.length(F.translate(F.hex("fresh"), "0", "")))).first()[0] or 0
            if changed <= self.settled * n * k:
                break
        return lists

    def tied(self, clusters: DataFrame, lists: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
        """The clusters, those united that a link between nodes of saturated lists ties together.

        A list that is full above threshold - margin may lack links, and a link that both ends' lists lack has two such
        ends. They are covered with balls: a link between two balls is possible only where the angle of their centres is
        at most both radii and the angle of the threshold. Balls of different clusters that this does not part are tied
        if their medoids are linked, or compared exactly."""
        near, threshold = self.threshold - self.margin, self.threshold
        angle = float(np.arccos(np.clip(threshold, -1, 1)))

        def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                last = [float(np.frombuffer(s, np.float32)[-1]) if len(s) >= 4 * k else -2.0 for s in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array([x >= near for x in last], pa.bool_()))], names=["node"])

        ends = lists.select("node", "sims").mapInArrow(full, "node bigint").join(clusters, "node")
        whole = ends.groupBy("component").agg(F.ceil(F.count("*") / self.block).cast("int").alias("blocks"))
        placed = ends.join(whole, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(nodes.select("node", "unit"), "node")
        shape = pa.schema([("ball", pa.int64()), ("component", pa.int64()), ("radius", pa.float64()), ("centre", pa.binary()), ("medoid", pa.binary()), ("units", pa.binary())])

        def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, now, group = Writer(shape, 2000), None, []

            def done() -> bool:
                ready = False
                for ids, units, centre, radius in balls(np.array([g[0] for g in group], np.int64), np.stack([np.frombuffer(g[1]) for g in group]), threshold):
                    m = int(np.argmax(units @ centre))
                    ready = out.add(int(ids[m]), now[0], radius, centre.tobytes(), units[m].tobytes(), units.tobytes(), size=units.nbytes)
                return ready

            for c, block, node, unit in rows(batches, "component", "block", "node", "unit"):
                if (c, block) != now:
                    if group and done():
                        yield out.take()
                    now, group = (c, block), []
                group.append((node, unit))
            if group:
                done()
            yield out.take()

        spread = placed.select("component", "block", "node", "unit").repartition(parts(nodes.sparkSession), "component", "block").sortWithinPartitions("component", "block", "node")
        found = written(spread.mapInArrow(cover, "ball bigint, component bigint, radius double, centre binary, medoid binary, units binary"), "balls")
        told = found.agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).first()
        if told["low"] == told["high"]:
            return clusters
        blocks = int(np.ceil(told["n"] / self.block))
        dealt = found.select("ball", "component", "radius", "centre", "medoid", F.pmod(F.xxhash64("ball"), F.lit(blocks)).cast("int").alias("block")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        keyed = dealt.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).alias("side"), "ball", "component", "radius", "centre", "medoid")
        pair = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("linked", pa.bool_())])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, now, group = Writer(pair, 20_000), None, []

            def done() -> Iterator[pa.RecordBatch]:
                side = np.array([g[0] for g in group])
                ids, comps, radii = (np.array([g[i] for g in group], t) for i, t in ((1, np.int64), (2, np.int64), (3, np.float64)))
                centres, medoids = (np.stack([np.frombuffer(g[i]) for g in group]) for i in (4, 5))
                one, two = (np.arange(len(ids)),) * 2 if now[0] == now[1] else (np.flatnonzero(~side), np.flatnonzero(side))
                trees = Forest()
                for last in (False, True):  # first the medoids that are linked, then what they leave open
                    root = np.array([trees.root(c) for c in comps.tolist()], np.int64)
                    for i in one.tolist():
                        if last:
                            hit = centres[two] @ centres[i] >= np.cos(np.minimum(radii[two] + radii[i] + angle, np.pi)) - 1e-9
                        else:
                            hit = medoids[two] @ medoids[i] >= threshold
                        for j in two[hit & (root[two] != root[i]) & ((two > i) | (now[0] != now[1]))].tolist():
                            if last or trees.join(int(comps[i]), int(comps[j])):
                                if out.add(int(ids[i]), int(ids[j]), int(comps[i]), int(comps[j]), not last):
                                    yield out.take()

            for low, high, *row in rows(batches, "low", "high", "side", "ball", "component", "radius", "centre", "medoid"):
                if (low, high) != now:
                    if group:
                        yield from done()
                    now, group = (low, high), []
                group.append(row)
            if group:
                yield from done()
            yield out.take()

        tasks = keyed.repartition(parts(nodes.sparkSession), "low", "high").sortWithinPartitions("low", "high", "ball")
        met = written(tasks.mapInArrow(meet, "a bigint, b bigint, x bigint, y bigint, linked boolean"), "ball-pairs")
        united = components(met.where("linked"), "x", "y")
        left, right = (united.select(F.col("node").alias(c), F.col("component").alias(f"{c}_root")) for c in "xy")
        open_ = met.where("NOT linked").join(left, "x", "left").join(right, "y", "left").where(F.coalesce("x_root", "x") != F.coalesce("y_root", "y"))
        lines = open_.select("a", "b", "x", "y", F.explode(F.array("a", "b")).alias("ball")).join(found.select("ball", "units"), "ball")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, now, first = Writer(pair, 20_000), None, b""
            for a, b, x, y, units in rows(batches, "a", "b", "x", "y", "units"):
                if (a, b) != now:
                    now, first = (a, b), units
                    continue
                one, two = (np.frombuffer(u).reshape(-1, dims) for u in (first, units))
                if any((one[s : s + 500] @ two.T >= threshold).any() for s in range(0, len(one), 500)) and out.add(a, b, x, y, True):
                    yield out.take()
            yield out.take()

        dims = found.select(F.length("centre").alias("n")).first()["n"] // 8
        pairs = lines.select("a", "b", "x", "y", "units").repartition(parts(nodes.sparkSession), "a", "b").sortWithinPartitions("a", "b")
        more = pairs.mapInArrow(compare, "a bigint, b bigint, x bigint, y bigint, linked boolean")
        united = components(met.where("linked").unionByName(more), "x", "y").select(F.col("node").alias("component"), F.col("component").alias("root"))
        return written(clusters.join(united, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "clusters")

    def exact(self, lists: DataFrame, nodes: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(id, n): vectors linked to each representative outside its class; (a, b): a forest of the links."""
        near = self.threshold - self.margin
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = Writer(schema, 20_000)
            for node, ids, sims in rows(batches, "node", "ids", "sims"):
                for u in np.frombuffer(ids, np.int64)[np.frombuffer(sims, np.float32) >= near].tolist():
                    if out.add(node, u):
                        yield out.take()
            yield out.take()

        clusters = written(components(lists.select("node", "ids", "sims").mapInArrow(ties, "a bigint, b bigint")), "clusters")
        clusters = self.tied(clusters, lists, nodes, k)
        whole = clusters.groupBy("component").agg(F.ceil(F.count("*") / self.block).cast("int").alias("blocks"))
        placed = clusters.join(whole, "component").join(nodes.select("node", "members", "unit"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keyed = spread.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).alias("side"), "node", "members", "unit")
        threshold = self.threshold
        found = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, now, group = Writer(found, 20_000), None, []

            def done() -> None:
                ids, members, sides, units = map(np.array, zip(*[(g[0], g[1], g[2], np.frombuffer(g[3])) for g in group], strict=True))
                if now[1] != now[2] and (sides.all() or not sides.any()):
                    return
                counts, edges = linked(ids, members, sides, units, now[1] == now[2], threshold)
                for i in np.flatnonzero(counts):
                    out.add(int(ids[i]), None, int(counts[i]))
                for x, y in edges:
                    out.add(x, y, None)

            for c, low, high, side, node, members, unit in rows(batches, "component", "low", "high", "side", "node", "members", "unit"):
                if (c, low, high) != now:
                    if group:
                        done()
                    if len(out.cells[0]) >= out.limit:
                        yield out.take()
                    now, group = (c, low, high), []
                group.append((node, members, side, unit))
            if group:
                done()
            yield out.take()

        tasks = keyed.repartition(parts(nodes.sparkSession), "component", "low", "high").sortWithinPartitions("component", "low", "high", "node")
        got = written(tasks.mapInArrow(run, "a bigint, b bigint, n bigint"), "links")
        return got.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n")), got.where("b IS NOT NULL").select("a", "b")

    def audited(self, nodes: DataFrame, counted: DataFrame) -> float:
        """Share of the links of `audit` representatives, the first by hash, that were found. Their number is fixed, so
        they may travel to all tasks; each is compared with every vector."""
        asked = [(r.node, np.frombuffer(r.unit)) for r in nodes.orderBy(F.xxhash64("node")).limit(self.audit).select("node", "unit").collect()]
        if not asked:
            return 1.0
        ids, q, threshold = np.array([a for a, _ in asked], np.int64), np.stack([u for _, u in asked]), self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(ids), np.int64)
            for b in batches:
                if b.num_rows:
                    node, members = b.column(0).to_numpy(), b.column(1).to_numpy()
                    hit = (np.frombuffer(b"".join(b.column(2).to_pylist())).reshape(len(node), -1) @ q.T >= threshold) & (node[:, None] != ids[None, :])
                    total += members @ hit
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "true_n"])

        true = nodes.select("node", "members", "unit").mapInArrow(run, "id bigint, true_n bigint").groupBy("id").agg(F.sum("true_n").alias("true_n"))
        r = true.join(counted, "id", "left").agg(F.sum("true_n").alias("t"), F.sum(F.least(F.coalesce("n", F.lit(0)), F.col("true_n"))).alias("f")).first()
        return r["f"] / r["t"] if r["t"] else 1.0

    def links(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """vec_id, n_links, component_id, kept; the last audit's figure is in `self.found_recall`."""
        named, nodes = self.unit_vectors(only(vectors, vec_id=id_col, embedding=vector_col).where("vec_id IS NOT NULL"))
        n = nodes.count()
        lists, k, trees = None, self.k, range(self.trees)
        for repeat in range(self.repeats + 1):
            lists = self.graph(nodes, n, lists, trees, k)
            counted, forest = self.exact(lists, nodes, k)
            self.found_recall = self.audited(nodes, counted)
            if self.found_recall >= self.recall:
                break
            if repeat == self.repeats:
                if self.found_recall < self.least_recall:
                    raise RuntimeError(f"only {self.found_recall:.4f} of the audited links were found, less than {self.least_recall}")
                warnings.warn(f"{self.found_recall:.4f} of the audited links were found, less than {self.recall}", stacklevel=2)
                break
            k, trees = 2 * k, range(trees.stop, trees.stop + self.trees)
        linked_ = components(forest)
        reps = nodes.select("node", "members").join(counted, nodes["node"] == counted["id"], "left").join(linked_.withColumnRenamed("node", "other"), F.col("node") == F.col("other"), "left")
        reps = reps.select(F.col("node").alias("rep"), F.coalesce("component", "node").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n"))
        out = named.join(reps, "rep", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def low_ends(k: int, threshold: float):
    """The similarity that an offer must beat: the last of a full list, or the threshold where that list may grow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = [(len(s) // 4, float(np.frombuffer(s, np.float32)[-1]) if s else -1.0) for s in b.column(1).to_pylist()]
            low = [-1.0 if n < k else min(last, threshold) if n < WIDER * k else last for n, last in ends]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(low, pa.float32())], names=["node", "low"])

    return run


def balls(ids: np.ndarray, units: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """A cover: ids and units of what is linked to one of them, their mean direction, and the largest angle to it."""
    rest = np.arange(len(ids))
    while len(rest):
        near = units[rest] @ units[rest[0]] >= threshold
        near[0] = True
        own = rest[near]
        centre = units[own].sum(axis=0)
        centre = centre / np.sqrt(centre @ centre) if np.sqrt(centre @ centre) > 1e-9 else units[own[0]]
        yield ids[own], units[own], centre, float(np.arccos(np.clip((units[own] @ centre).min(), -1, 1))) + 1e-6
        rest = rest[~near]


def linked(ids: np.ndarray, members: np.ndarray, sides: np.ndarray, units: np.ndarray, same: bool, threshold: float, strip: int = 1000) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Linked vectors of each row, and forest edges; rows of one block with each other, or of two blocks across."""
    counts, forest, edges = np.zeros(len(ids), np.int64), Forest(), []
    one, two = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(~sides), np.flatnonzero(sides))
    root = np.arange(len(ids))
    for s in range(0, len(one), strip):
        rows_ = one[s : s + strip]
        hit = units[rows_] @ units[two].T >= threshold
        if same:
            hit[np.arange(len(rows_)), rows_] = False
            counts[rows_] += hit @ members
        else:
            counts[rows_] += hit @ members[two]
            counts[two] += members[rows_] @ hit
        for x, h in zip(rows_.tolist(), hit, strict=True):
            reached = two[h]
            # Only one edge to each tree that the row touches.
            for y in reached[np.unique(root[reached], return_index=True)[1]].tolist() if len(reached) else ():
                if forest.join(x, y):
                    edges.append((int(ids[x]), int(ids[y])))
            if len(reached):
                root[np.append(reached, x)] = forest.root(x)
    return counts, edges


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NnDescent().links(table(spark, sf_dir, "embeddings"))


#: All pairs of vectors, and what the smallest id of a component reaches.
OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), usable AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0
), linked AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reached(vec_id, least) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT y, least FROM reached JOIN linked ON x = reached.vec_id AND least < y
), degrees AS (
  SELECT x, count(*) AS n_links FROM linked GROUP BY x
), classes AS (
  SELECT vec_id, min(least) AS component_id FROM reached GROUP BY vec_id
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM classes LEFT JOIN degrees ON x = vec_id
"""
