"""Suffix-array dedup with a logarithmic family of indexes.

Documents come in batches, in order of id. A new batch gets a suffix array: its suffixes of at least L bytes in order of
their first L bytes. It is scanned against every level of the family for matches of L bytes, which come from earlier
batches and so from smaller ids; suffixes that no level has become a new level, and levels of equal size merge, so after b
batches there are at most log2(b) + 1 of them and a suffix is merged as often. Levels are tables in the shared folder.

Over a cluster, suffixes are those of the strings that `repeats` leaves, dealt by the hash of their flanks: a level has a
suffix array for each group, and a task holds one group of a batch and of the levels at a time. Texts are UTF-8 bytes; null
and empty ones have none. Bytes that a 50-byte string covers which also starts in a document of smaller id are removed;
matches are judged on the input, overlaps count, and never cross documents. Equal ids don't hide one another; rows without
an id neither hide nor are hidden. Very long texts are read whole and are a block of their own. Empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import Writer, dropped, only, pack, table, unpack, written
from tessera.llm.repeats import GROUPS, SENT, SENT_SQL, Bytes, Group, Strings, grouped, repeats, routed


class SuffixArray(NamedTuple):
    """Suffixes in order of their first `length` bytes, none twice: where each starts in flat, which consists of pieces
    that begin at `begin`; a piece's id is the smallest that has each of the suffixes that start in it."""

    length: int
    flat: np.ndarray
    begin: np.ndarray
    piece_id: np.ndarray
    at: np.ndarray

    def keys(self) -> np.ndarray:
        return heads(self.flat, self.at, self.length)

    def ids(self) -> np.ndarray:
        return self.piece_id[np.searchsorted(self.begin, self.at, "right") - 1] if len(self.at) else np.zeros(0, np.int64)

    def some(self, chosen: np.ndarray) -> SuffixArray:
        """Only the chosen suffixes, and of the text what they need."""
        at = self.at[chosen]
        change = np.zeros(len(self.flat) + 1, np.int32)
        np.add.at(change, at, 1)
        np.add.at(change, at + self.length, -1)
        needed = np.cumsum(change)[:-1] > 0
        first = needed.copy()
        first[1:] &= ~needed[:-1]
        first[self.begin[needed[self.begin]]] = True
        place = np.cumsum(needed) - 1
        head = np.flatnonzero(first)
        return SuffixArray(self.length, self.flat[needed], place[head], self.piece_id[np.searchsorted(self.begin, head, "right") - 1], place[at])

    def packed(self) -> bytes:
        planes = np.ascontiguousarray(self.at.astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel()
        return pack(self.flat, np.diff(self.begin, prepend=0).astype(np.uint32), self.piece_id, planes, level=3)

    @staticmethod
    def unpacked(length: int, body: bytes) -> SuffixArray:
        flat, begin, ids, planes = unpack(body)
        at = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
        return SuffixArray(length, flat, np.cumsum(begin.astype(np.int64)), ids, at)


def heads(flat: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The first `length` bytes of the suffixes that start at `at`."""
    if not len(at):
        return np.zeros(0, f"S{length}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, length)[at]).view(f"S{length}").ravel()


def order_of(flat: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The order of suffixes by their first `length` bytes: by the first eight, and by all where those are equal."""
    n = min(8, length)
    word = np.zeros((len(at), 8), np.uint8)
    word[:, :n] = np.lib.stride_tricks.sliding_window_view(flat, n)[at]
    word = word.view(">u8").ravel().astype(np.uint64)
    order = np.argsort(word, kind="stable")
    same = word[order[1:]] == word[order[:-1]]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
    if len(tied):
        some = order[tied]
        order[tied] = some[np.argsort(heads(flat, at[some], length), kind="stable")]
    return order


def suffix_array(strings: list[bytes], ids: np.ndarray, length: int) -> tuple[SuffixArray, np.ndarray]:
    """The suffix array of strings with their ids, and the rank there of every suffix, string by string."""
    n = np.maximum(np.fromiter(map(len, strings), np.int64, len(strings)) - length + 1, 0)
    # Strings of small ids come first, so of equal suffixes the first stands in the string of the smallest id.
    by_id = np.argsort(ids, kind="stable")
    flat = np.frombuffer(b"".join([strings[i] for i in by_id.tolist()]), np.uint8)
    size = (n + length - 1)[by_id] if len(n) and n.min() else np.fromiter((len(strings[i]) for i in by_id.tolist()), np.int64, len(strings))
    begin, count = np.cumsum(size) - size, n[by_id]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(count) - count - begin, count)
    if not len(at):
        return SuffixArray(length, flat, begin, ids[by_id], at), at
    order = order_of(flat, at, length)
    keys = heads(flat, at[order], length)
    head = np.append(True, keys[1:] != keys[:-1])
    rank = np.empty(len(at), np.int64)
    rank[order] = np.cumsum(head) - 1
    # From the order of ids back to that of the strings.
    start = np.empty(len(strings), np.int64)
    start[by_id] = np.cumsum(count) - count
    back = np.arange(len(at)) - np.repeat(np.cumsum(n) - n - start, n)
    return SuffixArray(length, flat, begin, ids[by_id], at[order[head]]), rank[back]


def scanned(new: SuffixArray, levels: list[SuffixArray]) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of a new batch the smallest id that has it, here or in a level, and whether no level has it."""
    keys, first = new.keys(), new.ids()
    alone = np.ones(len(keys), bool)
    for level in levels:
        have = level.keys()
        if len(have) and len(keys):
            at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
            hit = have[at] == keys
            first[hit] = np.minimum(first[hit], level.ids()[at[hit]])
            alone &= ~hit
    return first, alone


def merged(arrays: list[SuffixArray]) -> SuffixArray:
    """One suffix array of several that share no suffix."""
    if len(arrays) == 1:
        return arrays[0]
    offset = np.cumsum([0, *[len(a.flat) for a in arrays[:-1]]])
    flat, begin, at = (np.concatenate(c) for c in ([a.flat for a in arrays], [a.begin + o for a, o in zip(arrays, offset, strict=True)], [a.at + o for a, o in zip(arrays, offset, strict=True)]))
    order = order_of(flat, at, arrays[0].length) if len(at) else np.zeros(0, np.int64)
    return SuffixArray(arrays[0].length, flat, begin, np.concatenate([a.piece_id for a in arrays]), at[order])


class IndexFamily:
    """Levels of suffix arrays as tables; each has the number of batches in it and its name, a number below 0."""

    def __init__(self, length: int, partitions: int) -> None:
        self.length, self.partitions = length, partitions
        self.levels: list[tuple[int, int, DataFrame]] = []
        self.batches = 0

    def add(self, strings: DataFrame, keep: bool = True) -> DataFrame:
        """Scans a new batch against the levels, makes it one of them unless keep is off, and merges levels of equal
        size. strings: rows of repeats.SENT, packed strings by group; gives the answers to its blocks."""
        length, name, rows_ = self.length, -1 - self.batches, strings
        size, merging = 1, []
        while keep and len(merging) < len(self.levels) and self.levels[-1 - len(merging)][0] == size:
            merging.append(self.levels[-1 - len(merging)][1])
            size *= 2
        for _, _, level in self.levels:
            rows_ = rows_.unionByName(level)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = Writer(SENT, limit_bytes=4 << 20)
            for group, found in grouped(batches):
                levels = {batch: SuffixArray.unpacked(length, body) for _, batch, body in found if batch < 0}
                asked = Group([(block, body) for block, batch, body in found if batch >= 0])
                texts, least, of = asked.distinct()
                new, rank = suffix_array(texts, least, length)
                first, alone = scanned(new, list(levels.values()))
                for block, body in asked.answers(of, np.array([len(t) - length + 1 for t in texts], np.int64), first[rank]):
                    if out.add(block, 0, group, body, size=len(body)):
                        yield out.take()
                if keep:
                    body = merged([*[levels[m] for m in merging if m in levels], new.some(alone)]).packed()
                    if out.add(group, name, group, body, size=len(body)):
                        yield out.take()
            yield out.take()

        got = written(rows_.repartition(self.partitions, "bucket").sortWithinPartitions("bucket", "batch").mapInArrow(run, SENT_SQL), "suffix-level", by="batch")
        if keep:
            keep_, gone = self.levels[: len(self.levels) - len(merging)], self.levels[len(self.levels) - len(merging) :]
            self.levels = [*keep_, (size, name, got.where(F.col("batch") == name))]
            for _, old, level in gone:
                dropped(level, f"batch={old}")
        self.batches += 1
        return got.where("batch = 0")


FIELDS = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


class SuffixDedup:
    """batches: how many batches of ids the documents are indexed in; block_bytes: text of a block."""

    def __init__(self, length: int = 50, batches: int = 4, block_bytes: int = 6_000_000) -> None:
        self.length, self.batches, self.block_bytes = length, batches, block_bytes

    def remove(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: bool = True) -> DataFrame:
        """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, unless left out, the remaining bytes."""
        length = self.length

        def solve(asks: DataFrame, batches: int, n: int) -> DataFrame:
            groups = np.uint64(n * GROUPS)

            def by_flank(s: Strings) -> np.ndarray:
                return (s.key % groups).astype(np.int64)

            family, answers = IndexFamily(length, n), None
            for b in range(batches):
                got = family.add(routed(asks.where(F.col("batch") == b), by_flank), keep=b + 1 < batches)
                answers = got if answers is None else answers.unionByName(got)
            for _, name, level in family.levels:
                dropped(level, f"batch={name}")
            dropped(asks, "bucket=0")
            return answers

        def finish(doc_id: int | None, text: bytes, hidden: np.ndarray) -> tuple:
            spans = int(np.count_nonzero(np.diff(hidden.astype(np.int8), prepend=0) == 1))
            rest = np.frombuffer(text, np.uint8)[~hidden].tobytes() if spans else text
            return (doc_id, len(text), len(text) - len(rest), spans, hashlib.sha256(rest).hexdigest(), *([rest] if kept else []))

        fields = StructType.fromDDL(FIELDS if kept else FIELDS.removesuffix(", kept binary"))
        return repeats(only(docs, doc_id=id_col, text=text_col), Bytes(length), solve, finish, fields, self.block_bytes, self.batches)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SuffixDedup().remove(table(spark, sf_dir, "documents"), kept=False)


#: Texts as hex digits, two a byte, so that positions are bytes.
OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
  SELECT doc_id, unnest(range(0, len(h) // 2 - 49)) AS i, h FROM t WHERE len(h) >= 100
), windows AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM starts
), firsts AS (
  SELECT s, min(doc_id) AS f FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)
), ends AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM windows w JOIN firsts USING (s) WHERE f < doc_id
), spans AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM ends
), cuts AS (
  SELECT doc_id, span, min(i) AS a, max(i) + 50 AS z FROM spans GROUP BY doc_id, span
), edges AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS past FROM cuts
), gone AS (
  SELECT e.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS z,
         string_agg(substr(h, 2 * past + 1, 2 * (a - past)), '' ORDER BY a) AS kept
  FROM edges e JOIN t ON e.doc_id = t.doc_id GROUP BY e.doc_id
)
SELECT t.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN z IS NULL THEN h ELSE kept || substr(h, 2 * z + 1) END)) AS kept_sha256
FROM t LEFT JOIN gone ON t.doc_id = gone.doc_id
"""
