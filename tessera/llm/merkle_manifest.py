"""Merkle manifest of a dataset: a hash tree for each group of rows and one over the groups, with inclusion proofs.

1. A row becomes a leaf, the digest of its fields. Equal rows become one with a number of copies, so none is hot.
2. Ranks within a group come from histograms of leading digits of the ids, not from a sort: digits are added until no
   bucket holds more than `bucket` rows (past the id's own, digits of the leaf, as rows may repeat an id). The histogram is
   summed up digit by digit, in windows of one digit's buckets. A row's rank is the number of rows in smaller buckets
   and of those before it in its own bucket.
3. The digits of a rank to the base of the fanout are the path of the leaf in a trie: nodes are keyed by leading digits,
   and those with most digits are reduced first. One step takes `levels` digits off, so that all below such a prefix, at
   most fanout ** levels nodes, go through one group.
4. Downwards, the same groups get the way from their prefix to the root and hand on each node's siblings.

Groups are ordered by their name, null first, then by the bytes; ids likewise, null first. Rows that repeat an id are
ordered by their leaf; equal rows stand side by side, each with a proof of its own. Null fields are a sign of their own,
told apart from empty ones. A null id is a leaf like others and is never tampered with. A text may be as long as a row
can. An empty table has an empty result; extra columns are left out of the leaf. A group may hold all the rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import dropped, parts, table, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of a digit of ids, and letters of a digit of leaves: a window of the histograms holds at most 1024 or 4096 buckets.
RADIX_BITS, LETTERS = 10, 3
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WAY = "grp string, idx bigint, lefts array<string>, rights array<string>, subroot string, root string"


def digest_of(*strings: str) -> str:
    return hashlib.sha256("".join(strings).encode()).hexdigest()


def leaf_of(fields: dict[str, Column]) -> Column:
    """Digest of the fields one after the other: `-` for null, else bytes, a colon and the value."""
    shown = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields.values()]
    return F.sha2(F.concat(*shown), 256)


class Manifest:
    """`bucket`: rows that are ordered within a task at most. `levels`: levels of the tree that are worked out in a group."""

    def __init__(self, fanout: int = 8, levels: int = 4, bucket: int = 50_000, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang") -> None:
        self.fanout, self.levels, self.bucket, self.fields, self.id_col, self.group_col = fanout, levels, bucket, fields, id_col, group_col

    def leaves(self, docs: DataFrame, altered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
        """grp, doc_id, leaf, told (the leaf with some fields altered, where asked) and copies."""
        own = {f: docs[f"`{f}`"] for f in self.fields}
        leaf = leaf_of(own)
        told = F.when(where, leaf_of(own | altered)).otherwise(leaf) if altered else leaf
        group = F.coalesce(F.concat(F.lit("="), docs[f"`{self.group_col}`"].cast("string")), F.lit("-"))
        return docs.select(group.alias("grp"), docs[f"`{self.id_col}`"].cast("bigint").alias("doc_id"), leaf.alias("leaf"), told.alias("told")).groupBy("grp", "doc_id", "leaf", "told").agg(F.count("*").alias("copies"))

    # Ranks

    def bucketed(self, leaves: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """The leaves with their bucket, the histogram over all rows, and how many letters of the leaf it needs: leading bits of
        the ids until no bucket is too large, then leading letters of the leaf. `rest` sets null ids, first of all, apart."""
        span = leaves.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
        widest = (span.high - span.low).bit_length() if span.low is not None else 0
        cuts = [(s, 0) for s in range(max(0, widest - RADIX_BITS), 0, -RADIX_BITS)] + [(0, t) for t in range(0, 64, LETTERS)]
        for shift, letters in cuts:
            lowest = F.shiftright(F.lit(-(2**63)).cast("bigint"), shift)
            rest = F.concat(F.when(F.col("doc_id").isNull(), "0").otherwise("1"), F.substring("leaf", 1, letters)) if letters else F.lit("")
            out = leaves.withColumns({"key": F.coalesce(F.shiftright("doc_id", shift), lowest), "rest": rest})
            counts = out.groupBy("grp", "key", "rest").agg(F.sum("copies").alias("rows"), F.count("*").alias("distinct"))
            if (counts.agg(F.max("distinct").alias("most")).first().most or 0) <= self.bucket:
                break
        return out, counts, letters

    def offsets(self, counts: DataFrame, letters: int) -> DataFrame:
        """The rows in smaller buckets of the same group, by sums of digit after digit, top down."""
        tiers = [written(counts.select("grp", "key", "rest", "rows"), "digits")]
        parents: list[tuple[Column, Column]] = []
        while True:
            if letters > 0:
                letters = max(0, letters - LETTERS)
                parent = F.col("key"), F.substring("rest", 1, letters + 1 if letters else 0)
            else:
                span = tiers[-1].agg(F.min("key").alias("low"), F.max("key").alias("high")).first()
                if span.low is None or span.high - span.low < 2**RADIX_BITS:
                    break
                parent = F.shiftright("key", RADIX_BITS), F.lit("")
            parents.append(parent)
            named = tiers[-1].select("grp", parent[0].alias("key"), parent[1].alias("rest"), "rows")
            tiers.append(written(named.groupBy("grp", "key", "rest").agg(F.sum("rows").alias("rows")), "digits"))
        order = Window.orderBy("key", "rest").rowsBetween(Window.unboundedPreceding, -1)
        before = tiers[-1].select("grp", "key", "rest", F.coalesce(F.sum("rows").over(order.partitionBy("grp")), F.lit(0)).alias("before"))
        for tier, (key, rest) in zip(reversed(tiers[:-1]), reversed(parents)):
            kin = tier.withColumns({"high": key, "start": rest})
            kin = kin.withColumn("own", F.coalesce(F.sum("rows").over(order.partitionBy("grp", "high", "start")), F.lit(0)))
            above = before.select("grp", F.col("key").alias("high"), F.col("rest").alias("start"), "before")
            before = kin.join(above, ["grp", "high", "start"]).select("grp", "key", "rest", (F.col("own") + F.col("before")).alias("before"))
        return before

    def ranked(self, leaves: DataFrame) -> DataFrame:
        """grp, doc_id, leaf, told, and the ranks of the copies: `first` and `copies`."""
        rows, counts, letters = self.bucketed(leaves)
        earlier = Window.partitionBy("grp", "key", "rest").orderBy(F.asc_nulls_first("doc_id"), "leaf", "told").rowsBetween(Window.unboundedPreceding, -1)
        within = rows.withColumn("within", F.coalesce(F.sum("copies").over(earlier), F.lit(0)))
        return within.join(self.offsets(counts, letters), ["grp", "key", "rest"]).select("grp", "doc_id", "leaf", "told", "copies", (F.col("before") + F.col("within")).alias("first"))

    # The trie

    def reduced(self, digests: list[str], whole: bool) -> list[list[str]]:
        """The levels below a prefix, from the given nodes up to one node; a group's only prefix ends as soon as one is left."""
        out = [digests]
        while len(out) <= self.levels and not (whole and len(out[-1]) == 1):
            last = out[-1]
            out.append([digest_of(*last[i : i + self.fanout]) for i in range(0, len(last), self.fanout)])
        return out

    def whole(self, prefix: int, n: int) -> bool:
        return prefix == 0 and n < self.fanout**self.levels

    def up(self, nodes: DataFrame) -> DataFrame:
        """grp, idx, digest of the prefixes that are some digits shorter. Nodes: grp, first, copies, digest."""
        schema = pa.schema([("grp", pa.string()), ("idx", pa.int64()), ("digest", pa.string())])

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            grp, prefix = (k.as_py() for k in key)
            digests = self.spread(prefix, rows.select(["first", "copies", "digest"]))
            top = self.reduced([d for d, *_ in digests], self.whole(prefix, len(digests)))[-1]
            return pa.table([[grp], [prefix], top], schema=schema)

        return self.prefixed(nodes).groupBy("grp", "prefix").applyInArrow(run, "grp string, idx bigint, digest string")

    def prefixed(self, nodes: DataFrame) -> DataFrame:
        """Each row under every prefix that some of its copies have."""
        size = self.fanout**self.levels
        return nodes.withColumn("prefix", F.explode(F.sequence(F.expr(f"first div {size}"), F.expr(f"(first + copies - 1) div {size}"))))

    def spread(self, prefix: int, rows: pa.Table) -> list[tuple]:
        """The nodes below a prefix, in order, copies one by one: the columns after `first` and `copies`."""
        size, out = self.fanout**self.levels, []
        for first, copies, *rest in sorted(zip(*[c.to_pylist() for c in rows.columns], strict=True), key=lambda r: r[0]):
            begin, end = max(first, prefix * size), min(first + copies, (prefix + 1) * size)
            out.extend([tuple(rest)] * (end - begin))
        return out

    def siblings(self, levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
        """What stands left and right of a node's ancestors in their runs, level by level."""
        lefts, rights = [], []
        for level in levels[:-1]:
            run = at - at % self.fanout
            lefts.append("".join(level[run:at]))
            rights.append("".join(level[at + 1 : run + self.fanout]))
            at //= self.fanout
        return lefts, rights

    def down(self, nodes: DataFrame, ways: DataFrame) -> DataFrame:
        """The ways of nodes to the root, from those of their prefixes."""
        schema = pa.schema([("grp", pa.string()), ("idx", pa.int64()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])

        def run(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
            grp, prefix = (k.as_py() for k in key)
            (way,) = above.to_pylist()
            digests = [d for d, *_ in self.spread(prefix, rows.select(["first", "copies", "digest"]))]
            levels, out = self.reduced(digests, self.whole(prefix, len(digests))), []
            for at in range(len(digests)):
                lefts, rights = self.siblings(levels, at)
                out.append((grp, prefix * self.fanout**self.levels + at, lefts + way["lefts"], rights + way["rights"], way["subroot"] or levels[-1][0], way["root"]))
            return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        return self.prefixed(nodes).groupBy("grp", "prefix").cogroup(ways.groupBy("grp", "idx")).applyInArrow(run, WAY)

    def climb(self, nodes: DataFrame) -> list[DataFrame]:
        """The nodes, then those of ever shorter prefixes until each group has one."""
        tiers = [nodes]
        while True:
            above = written(self.up(tiers[-1]), "nodes")
            tiers.append(above.select("grp", F.col("idx").alias("first"), F.lit(1).cast("bigint").alias("copies"), "digest"))
            if not above.where("idx > 0").take(1):
                return tiers

    def ordered_groups(self, subroots: DataFrame) -> DataFrame:
        """Subroots numbered by the order of their groups: ranges of names, counted, then the place within a range."""
        n = parts(subroots.sparkSession)
        ranged = written(subroots.repartitionByRange(n, "grp").withColumn("part", F.spark_partition_id()), "groups")
        counts = ranged.groupBy("part").agg(F.count("*").alias("rows"))  # a row for each partition
        before = counts.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        place = F.row_number().over(Window.partitionBy("part").orderBy("grp")) - 1
        return ranged.withColumn("place", place).join(before, "part").select("grp", "digest", (F.col("place") + F.col("before")).alias("first"))

    def proofs(self, docs: DataFrame, altered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
        """For each row doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and the siblings by level."""
        leaves = written(self.leaves(docs, altered, where), "leaves")
        ranked = written(self.ranked(leaves), "ranked")
        tiers = self.climb(ranked.select("grp", "first", "copies", F.col("leaf").alias("digest")))
        groups = written(self.ordered_groups(tiers[-1].select("grp", "digest")), "ordered")
        top = self.climb(groups.select(F.lit("").alias("grp"), "first", F.lit(1).cast("bigint").alias("copies"), "digest"))
        empty = F.array().cast("array<string>")
        ways = top[-1].select("grp", F.lit(0).cast("bigint").alias("idx"), empty.alias("lefts"), empty.alias("rights"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
        for tier in reversed(top[:-1]):
            ways = written(self.down(tier, ways), "ways")
        named = groups.select(F.col("grp").alias("name"), F.col("digest").alias("own"), "first")
        ways = named.join(ways, F.col("first") == F.col("idx")).select(F.col("name").alias("grp"), F.lit(0).cast("bigint").alias("idx"), "lefts", "rights", F.col("own").alias("subroot"), "root")
        for tier in reversed(tiers[1:-1]):
            ways = written(self.down(tier, ways), "ways")
        dropped(leaves)
        return self.folded(ranked, ways)

    def folded(self, ranked: DataFrame, ways: DataFrame) -> DataFrame:
        columns = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, lefts array<string>, rights array<string>"
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_(), *[pa.list_(pa.string())] * 2]
        names = [c.split()[0] for c in columns.split(", ")]

        def run(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
            prefix, (way,) = key[1].as_py(), above.to_pylist()
            nodes = self.spread(prefix, rows.select(["first", "copies", "leaf", "doc_id", "told"]))
            levels, out = self.reduced([n[0] for n in nodes], self.whole(prefix, len(nodes))), []
            for at, (leaf, doc_id, told) in enumerate(nodes):
                lefts, rights = (own + above_ for own, above_ in zip(self.siblings(levels, at), (way["lefts"], way["rights"])))
                root = reduce(lambda d, side: digest_of(side[0], d, side[1]), zip(lefts, rights), told)
                proof = digest_of(*[s for side in zip(lefts, rights) for s in side])
                out.append((doc_id, leaf, way["subroot"], way["root"], proof, root, root == way["root"], lefts, rights))
            return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        return self.prefixed(ranked).groupBy("grp", "prefix").cogroup(ways.groupBy("grp", "idx")).applyInArrow(run, columns)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = {"text": F.translate("text", UPPER, UPPER.lower())}
    return Manifest().proofs(docs, lowered, tampered).drop("lefts", "rights")


def _tree(name: str, leaves: str) -> str:
    """Nodes by group, level and place, from (g, idx, digest, n)."""
    return f"""{name} AS (
  SELECT g, 0 AS level, idx, digest, n FROM {leaves}
  UNION ALL
  SELECT g, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY g, level, idx // 8, n)"""


def _sides(tree: str, nodes: str) -> str:
    """For each of some nodes (g, pos) and each level what stands left and right in its run."""
    return f"""SELECT x.g, x.pos, t.level, coalesce(string_agg(t.digest, '' ORDER BY t.idx) FILTER (WHERE t.idx < x.pos // CAST(pow(8, t.level) AS BIGINT)), '') AS l,
    coalesce(string_agg(t.digest, '' ORDER BY t.idx) FILTER (WHERE t.idx > x.pos // CAST(pow(8, t.level) AS BIGINT)), '') AS r
  FROM {nodes} x JOIN {tree} t ON t.g = x.g AND t.n > 1 AND t.idx // 8 = x.pos // CAST(pow(8, t.level + 1) AS BIGINT) GROUP BY x.g, x.pos, t.level"""


def _field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || {name}, '-')"


#: crc32 by its table of 256 remainders, each from eight shifts; leaves, a recursive tree, and the fold along each leaf's way.
OP12_SQL = f"""WITH RECURSIVE remainders AS (
  SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) r(n))),
told AS (
  SELECT d.*, CASE WHEN xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) % 3 = 0 THEN translate(text, '{UPPER}', '{UPPER.lower()}') ELSE text END AS changed FROM documents d CROSS JOIN remainders),
hashed AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS g, sha256({" || ".join(map(_field, FIELDS))}) AS leaf, sha256({" || ".join(_field("changed" if f == "text" else f) for f in FIELDS)}) AS told FROM told),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM hashed),
first AS (SELECT g, pos AS idx, leaf AS digest, n FROM leaves),
{_tree("tree", "first")},
subroots AS MATERIALIZED (
  SELECT g AS name, digest, '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
groups AS (SELECT g, pos AS idx, digest, n FROM subroots),
{_tree("top", "groups")},
lower AS ({_sides("tree", "leaves")}),
upper AS ({_sides("top", "subroots")}),
ways AS (
  SELECT g, pos, level, l, r FROM lower
  UNION ALL
  SELECT v.g, v.pos, 100 + u.level, u.l, u.r FROM upper u JOIN subroots s ON s.pos = u.pos JOIN leaves v ON v.g = s.name),
listed AS (SELECT g, pos, list(l || '|' || r ORDER BY level) AS sides, string_agg(l || r, '' ORDER BY level) AS proof FROM ways GROUP BY g, pos),
folded AS (
  SELECT v.doc_id, v.leaf, s.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root, sha256(coalesce(w.proof, '')) AS proof_sha256,
    list_reduce(list_prepend(v.told, coalesce(w.sides, [])), lambda d, x: sha256(split_part(x, '|', 1) || d || split_part(x, '|', 2))) AS folded_root
  FROM leaves v JOIN subroots s ON s.name = v.g LEFT JOIN listed w ON w.g = v.g AND w.pos = v.pos)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded"""
