"""Substring dedup over words with prefix-partitioned suffix trees.

Suffixes are split by prefixes of varying length: prefixes are counted, one that more suffixes share than a group may hold
is lengthened by a word, until each group fits in memory. A group's suffixes are sorted, the lengths of their common
prefixes give the nodes of its suffix tree, and the internal nodes of at least L words are the maximal repeats: all that
stands below one starts with the same L words.

Over a cluster, the strings that `repeats` leaves are dealt by the words of their flanks, which all their windows share: the
prefixes that are counted and lengthened are those of the suffixes that start there. The groups that are shuffled are
prefixes of few suffixes taken together by hash, or single long ones; a task holds one at a time, and splits its suffixes
once more by prefixes into trees. Only prefixes that more than an even share of all suffixes start with, and so fewer of
them than there are groups, reach the driver.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged; null and empty texts have none. Words that a 13-word window covers which also
starts in a document of smaller id are removed; windows are judged on the input. Equal ids don't hide one another; rows
without an id neither hide nor are hidden. Very long texts are read whole and are a block of their own. Empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import Writer, rows, table, word_bounds, written
from tessera.llm.repeats import GROUPS, SENT, SENT_SQL, Group, Strings, Words, grouped, repeats, routed, strings_of


def prefix_groups(suffixes: np.ndarray, bound: int) -> Iterator[np.ndarray]:
    """Row numbers of suffixes (n, L), split by prefixes just long enough for groups of at most `bound` rows; small
    neighbouring prefixes of one length are taken together. Equal suffixes stay together, so a group of them may be larger."""
    waiting = [(np.arange(len(suffixes)), 0)]
    while waiting:
        some, depth = waiting.pop()
        if len(some) <= bound or depth == suffixes.shape[1]:
            yield some
            continue
        order = some[np.argsort(suffixes[some, depth], kind="stable")]
        heads = np.flatnonzero(np.append(True, np.diff(suffixes[order, depth].astype(np.int64)) != 0))
        sizes = np.diff(np.append(heads, len(order)))
        at = 0
        while at < len(heads):
            upto, total = at + 1, sizes[at]
            while upto < len(heads) and total + sizes[upto] <= bound:
                total += sizes[upto]
                upto += 1
            part = order[heads[at] : heads[at] + total]
            waiting.append((part, depth + 1 if upto == at + 1 else depth))
            at = upto


class SuffixTree:
    """The suffix tree of sorted suffixes cut at L words, held as their order and common prefix lengths."""

    def __init__(self, suffixes: np.ndarray) -> None:
        width = suffixes.shape[1]
        keys = np.ascontiguousarray(suffixes.astype(">u4")).view(f"S{4 * width}").ravel()
        self.order = np.argsort(keys, kind="stable")
        ordered = suffixes[self.order]
        same = ordered[1:] == ordered[:-1]
        self.common = np.where(same.all(axis=1), width, np.argmin(same, axis=1))

    def deep_nodes(self, depth: int) -> Iterator[tuple[int, int]]:
        """Bounds within `order` of the internal nodes of at least this depth that no other such node holds."""
        deep = np.concatenate([[False], self.common >= depth, [False]])
        edge = np.flatnonzero(deep[1:] != deep[:-1])
        yield from zip(edge[::2].tolist(), (edge[1::2] + 1).tolist(), strict=True)

    def least(self, values: np.ndarray, depth: int) -> np.ndarray:
        """For each suffix the smallest value below its deep node, or its own where it has none."""
        head = np.flatnonzero(np.append(True, self.common < depth))
        low = np.minimum.reduceat(values[self.order], head)
        out = np.empty_like(values)
        out[self.order] = np.repeat(low, np.diff(np.append(head, len(self.order))))
        return out


class TreeMatcher:
    def __init__(self, length: int, bound: int) -> None:
        self.length, self.bound = length, bound

    def __call__(self, strings: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every window of every string, one after the other, the smallest id of a string that holds it; and how many
        windows each string has."""
        number: dict[bytes, int] = {}
        words = [[number.setdefault(w, len(number) + 1) for w in s.split()] for s in strings]
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter((x for w in words for x in w), np.uint32, int(size.sum()))
        n = np.maximum(size - self.length + 1, 0)
        if not n.sum():
            return np.zeros(0, np.int64), n
        begin = np.cumsum(size) - size
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - begin, n)
        suffixes = np.lib.stride_tricks.sliding_window_view(flat, self.length)[at]
        out = np.repeat(ids, n)
        for some in prefix_groups(suffixes, self.bound):
            out[some] = SuffixTree(suffixes[some]).least(out[some], self.length)
        return out, n


def prefixes(s: Strings, some: np.ndarray, depth: int) -> np.ndarray:
    """Hashes of the first `depth` words of the flanks of some strings."""
    texts, flank = s.text, s.flank.tolist()
    found = (b" ".join(texts[i].split(None, flank[i] + depth)[flank[i] : flank[i] + depth]) for i in some.tolist())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(some))


class PrefixGroups:
    """heavy[d] holds the prefixes of d + 1 words that are too frequent for a group."""

    def __init__(self, groups: int, deepest: int, heavy: list[np.ndarray] | None = None) -> None:
        self.groups, self.deepest, self.heavy = groups, deepest, heavy or []

    def light(self, s: Strings) -> tuple[np.ndarray, np.ndarray]:
        """The prefix of each string that is long enough, as far as is known, and which of them the last round found heavy."""
        some = np.arange(len(s.text))
        out = prefixes(s, some, 1)
        for d, heavy in enumerate(self.heavy):
            some = some[np.isin(out[some], heavy)]
            if not len(some) or d + 1 == self.deepest:
                break
            out[some] = prefixes(s, some, d + 2)
        return out, some

    def group_of(self, s: Strings) -> np.ndarray:
        return (self.light(s)[0] % np.uint64(self.groups)).astype(np.int64)

    def counted(self, asks: DataFrame, length: int, bound: int) -> PrefixGroups:
        """Counts prefixes and lengthens heavy ones until none is left."""
        for depth in range(self.deepest):
            now = PrefixGroups(self.groups, self.deepest, list(self.heavy))
            schema = pa.schema([("prefix", pa.int64()), ("n", pa.int64())])

            def run(batches: Iterator[pa.RecordBatch], now: PrefixGroups = now, schema: pa.Schema = schema) -> Iterator[pa.RecordBatch]:
                for (body,) in rows(batches, "body"):
                    s = strings_of(body)
                    found, some = now.light(s)
                    size = np.array([len(s.text[i].split()) - length + 1 for i in some.tolist()], np.int64)
                    keys, of = np.unique(found[some], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(of, size, len(keys)).astype(np.int64))], schema=schema)

            counts = written(asks.where("bucket = 0").mapInArrow(run, "prefix bigint, n bigint").groupBy("prefix").agg(F.sum("n").alias("n")), "prefixes")
            if not depth:
                bound = max(bound, -(-(counts.agg(F.sum("n")).first()[0] or 0) // self.groups))
            heavy = [r.prefix for r in counts.where(F.col("n") > bound).select("prefix").collect()]
            if not heavy:
                break
            self.heavy.append(np.array(heavy, np.int64).view(np.uint64))
        return self


FIELDS = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"


def without(text: bytes, hidden: np.ndarray) -> bytes:
    """The text without its hidden words and the white space after each of them."""
    if not hidden.any():
        return text
    body = np.frombuffer(text, np.uint8)
    start, _ = word_bounds(body)
    change = np.zeros(len(body) + 1, np.int32)
    np.add.at(change, start[hidden], 1)
    np.add.at(change, np.append(start[1:], len(body))[hidden], -1)
    return body[np.cumsum(change)[:-1] == 0].tobytes()


class SubstringDedup:
    """bound: windows of a group, or an even share of all if that is more; block_bytes: text of a block."""

    def __init__(self, length: int = 13, bound: int = 200_000, block_bytes: int = 6_000_000) -> None:
        self.length, self.bound, self.block_bytes = length, bound, block_bytes

    def remove(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: bool = True, carry: list[str] | None = None) -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256 (of the kept words with single spaces between) and, unless left out,
        the text that is kept, white space and all. The columns named in carry follow as c0, c1 and so on."""
        length, bound, kind = self.length, self.bound, Words(self.length)

        def solve(asks: DataFrame, batches: int, n: int) -> DataFrame:
            groups = PrefixGroups(n * GROUPS, kind.gram * kind.reach).counted(asks, length, bound)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out = Writer(SENT, limit_bytes=4 << 20)
                for group, found in grouped(batches):
                    asked = Group([(block, body) for block, _, body in found])
                    texts, least, of = asked.distinct()
                    first, windows = TreeMatcher(length, bound)(texts, least)
                    for block, body in asked.answers(of, windows, first):
                        if out.add(block, 0, group, body, size=len(body)):
                            yield out.take()
                yield out.take()

            return routed(asks, groups.group_of).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, SENT_SQL)

        def finish(doc_id: int | None, text: bytes, hidden: np.ndarray) -> tuple:
            words = text.split()
            removed = int(np.count_nonzero(hidden))
            if removed:
                words = [w for w, gone in zip(words, hidden.tolist(), strict=True) if not gone]
            row = (doc_id, len(hidden), removed, hashlib.sha256(b" ".join(words)).hexdigest())
            return (*row, without(text, hidden).decode("utf-8", "surrogatepass")) if kept else row

        fields = StructType.fromDDL(FIELDS if kept else FIELDS.removesuffix(", kept string"))
        named = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"), *[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(carry or ())])
        return repeats(named, kind, solve, finish, fields, self.block_bytes)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SubstringDedup().remove(table(spark, sf_dir, "documents"), kept=False)


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM starts
), firsts AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS f FROM windows
), hidden AS (
  SELECT DISTINCT doc_id, i + j AS pos FROM firsts, range(0, 13) AS r(j) WHERE f < doc_id
), gone AS (
  SELECT doc_id, list(pos) AS ats, count(*) AS n FROM hidden GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
                   ELSE array_to_string(list_filter(w, lambda x, k: NOT list_contains(ats, k)), ' ') END, '')) AS kept_sha256
FROM t LEFT JOIN gone ON t.doc_id = gone.doc_id
"""
