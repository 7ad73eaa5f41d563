"""Packing along a space-filling curve.

Each document becomes a hashed vector of byte four-grams, which a fixed random matrix projects to few dimensions; the
cells of a Hilbert curve through these dimensions give the order. Documents are dealt to partitions by ranges of
(curve key, id), so that a group of copies with one key spreads over many partitions, sorted within them, and packed one
after the other. A document is cut where a sequence is full. What a partition has left at its end goes into sequences
whose lengths are powers of two, so no position is padded.

Null and empty texts hold the end id alone. A null id is carried through; repeated rows are packed as often as they
occur, in a fixed order by text. An empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Writer, only, parts, rows, table

DIMS, BITS, BUCKETS = 4, 12, 256
PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of integer points (n, dims), each coordinate below 2**bits (Skilling 2004)."""
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    q = np.uint64(1 << (bits - 1))
    one = np.uint64(1)
    while q > one:
        p = q - one
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= one
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > one:
        t = np.where((x[-1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


@lru_cache
def projection(dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((BUCKETS, dims))


def curve_keys(texts: list[str | None], dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """A key for each text: hashed four-gram counts, scaled to unit length, projected, laid on the curve."""
    counts = np.zeros((len(texts), BUCKETS), np.float64)
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) >= 4:
            grams = np.ndarray(len(raw) - 3, "<u4", raw, strides=(1,))
            counts[i] = np.bincount((grams * np.uint32(2654435761)) >> np.uint32(24), minlength=BUCKETS)
    norm = np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12)
    z = (counts / norm) @ projection(dims)
    cells = (1 / (1 + np.exp(-2 * np.clip(z, -15, 15)))) * ((1 << bits) - 1)
    return hilbert(cells.astype(np.int64), bits)


class ChunkIds(dict):
    """The ids, as little-endian 32-bit bytes, of each run of text between ASCII white space.

    The tokenizer drops white space and no token spans it, so a run's ids don't depend on what surrounds it. Runs of
    plain letters, digits and signs are split here and each distinct part goes to the merges alone; all other runs go
    through the whole tokenizer. Holds at most `limit` runs.
    """

    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str, limit: int = 500_000) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit, self.words = Tokenizer.from_file(path), limit, {}
        self.merges = self.tokenizer.model.tokenize
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.bytes_shown = {c: "".join(letter[b] for b in chr(c).encode()) for c in range(128, 256)}

    def word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            got = np.array([t.id for t in self.merges(word.translate(self.bytes_shown))], "<u4").tobytes()
            if len(word) <= 40:
                if len(self.words) >= self.limit:
                    self.words.clear()
                self.words[word] = got
        return got

    def __missing__(self, run: bytes) -> bytes:
        text = run.decode("utf-8", "surrogatepass")
        if self.PLAIN.fullmatch(text) and "<|" not in text:
            ids = b"".join(map(self.word, self.SPLIT.findall(text.lower())))
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(run) <= 40:
            if len(self) >= self.limit:
                self.clear()
            self[run] = ids
        return ids


@lru_cache(maxsize=1)
def chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


def encoded(text: str | None, ids: ChunkIds, end: bytes) -> bytes:
    return b"".join(map(ids.__getitem__, (text or "").encode("utf-8", "surrogatepass").split())) + end


def tail_lengths(n: int) -> list[int]:
    """Powers of two, largest first, that add up to n."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Lays documents end to end into sequences of `size`; yields the pieces of whole sequences."""

    def __init__(self, size: int, first_id: int) -> None:
        self.size, self.next_id, self.waiting, self.filled = size, first_id, [], 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        total, start = len(ids) // 4, 0
        while start < total:
            n = min(total - start, self.size - self.filled)
            self.waiting.append((doc_id, start, n, ids[4 * start : 4 * (start + n)], total))
            start, self.filled = start + n, self.filled + n
            if self.filled == self.size:
                yield from self.flush([self.size])

    def end(self) -> Iterator[tuple]:
        yield from self.flush(tail_lengths(self.filled))

    def flush(self, lengths: list[int]) -> Iterator[tuple]:
        left, offset = iter(lengths), 0
        room = next(left, 0)
        for doc_id, start, n, ids, total in self.waiting:
            at = 0
            while at < n:
                take = min(n - at, room - offset)
                yield doc_id, start + at, take, zlib.crc32(ids[4 * at : 4 * (at + take)]), total, self.next_id, offset
                at, offset = at + take, offset + take
                if offset == room:
                    self.next_id, offset, room = self.next_id + 1, 0, next(left, 0)
        self.waiting, self.filled = [], 0


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path, end = tokenizer or public_tokenizers.path("word_bpe_49k.json"), np.array([end_id], "<u4").tobytes()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(curve_keys(b.column(1).to_pylist()), pa.int64()), b.column(0), b.column(1)], names=["curve", "doc_id", "text"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer, ids, out = Packer(size, (context.partitionId() if context else 0) << 32), chunk_ids(path), Writer(PIECES, 20_000)
        for doc_id, text in rows(batches, "doc_id", "text"):
            for piece in packer.add(doc_id, encoded(text, ids, end)):
                if out.add(*piece):
                    yield out.take()
        for piece in packer.end():
            out.add(*piece)
        yield out.take()

    n = parts(docs.sparkSession)
    by_curve = only(docs, doc_id=id_col, text=text_col).mapInArrow(keyed, "curve bigint, doc_id bigint, text string")
    ordered = by_curve.repartitionByRange(n, "curve", "doc_id").sortWithinPartitions("curve", "doc_id", F.xxhash64("text"))
    return ordered.select("doc_id", "text").mapInArrow(packed, ", ".join(f"{f.name} bigint" for f in PIECES))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
