"""Byte-level BPE by a global shuffle of distinct words.

1. Every map task splits its texts into pre-tokens. Within a block of documents each distinct pre-token gets a number; the
   block's documents are rewritten as those numbers in order of position, frequent ones small, and shuffled once by
   block with the block's list of pre-tokens, cut into buckets by the pre-tokens' hash. Both later steps read this one
   exchange.
2. The lists are shuffled by bucket, so that a pre-token's copies meet, each distinct one is encoded once, and the ids go
   back to the blocks that asked. A pre-token moves once a block however often it occurs, so none is hot.
3. A block's documents are reassembled by position from the ids. Decoding looks each id up in the token-byte table, whose size
   the vocabulary fixes; every task has it.

Null and empty texts have no ids. Null ids of documents are carried through; repeated rows are encoded as often as they
occur. Lone surrogates can't occur in Arrow strings. Empty tables give empty results; extra columns are ignored. Long
texts count by their length against a block's bound, so a very long text is a block of its own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import Writer, only, pack, parts, rows, table, unpack

BLOCK_CHARS = 12_000_000
BLOCK_SQL = "block bigint, bucket int, body binary"
BLOCK = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("body", pa.binary())])


@lru_cache(maxsize=1)
def splitter() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


class Words(dict):
    """Numbers of distinct pre-tokens in order of first use; `lists` keeps the numbers of runs between single spaces.

    In a text whose only white space is single spaces between other characters, and single other white space within such
    a run, a run with the space before it splits on its own: no match of the pattern spans a space that stands before
    anything but white space, except as its first character.
    """

    def __init__(self) -> None:
        super().__init__()
        self.runs: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n

    def of_run(self, run: str) -> tuple[int, ...]:
        got = self.runs.get(run)
        if got is None:
            self.runs[run] = got = tuple(map(self.__getitem__, splitter().findall(run)))
        return got

    def of_text(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if plain(text):
            first, *rest = text.split(" ")
            found = chain(self.of_run(first), chain.from_iterable([self.of_run(" " + r) for r in rest]))
        else:
            found = map(self.__getitem__, splitter().findall(text))
        return np.fromiter(found, np.uint32)


IRREGULAR = regex.compile(r"^\s| \s|\s |\s$")


def plain(text: str) -> bool:
    """No white space at the ends, and none other beside a space."""
    return IRREGULAR.search(text) is None


def planes(codes: np.ndarray) -> list[np.ndarray]:
    """The bytes of numbers, low ones first: three planes, or four where a number needs them; each compresses by itself."""
    return [(codes >> np.uint32(8 * k)).astype(np.uint8) for k in range(3 if not len(codes) or codes.max() < 1 << 24 else 4)]


def from_planes(*parts_: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts_[0]), np.uint32)
    for k, part in enumerate(parts_):
        out |= part.astype(np.uint32) << np.uint32(8 * k)
    return out


def bucket_of(words: list[bytes], n: int) -> np.ndarray:
    import zlib

    return np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words)) % np.uint32(n)


def joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([len(w) for w in words], np.uint32), np.frombuffer(b"".join(words), np.uint8)


def split_up(lengths: np.ndarray, body: np.ndarray) -> list[bytes]:
    raw, ends = body.tobytes(), np.cumsum(lengths, dtype=np.int64).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: the bytes of each id."""
    table_ = ranks(path)
    out = [b""] * (max(table_.values()) + 1)
    for token, i in table_.items():
        out[i] = token
    return out


class ByteBpe:
    def __init__(self, path: str | None = None) -> None:
        self.path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def blocks(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
        """Rows of bucket -1 hold a block's documents, others its pre-tokens of that bucket with their numbers."""
        n = parts(docs.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            context = TaskContext.get()
            base, count = (context.partitionId() if context else 0) << 32, 0
            words, ids, null, found, chars = Words(), [], [], [], 0

            def block() -> pa.RecordBatch:
                out = Writer(BLOCK)
                sizes = np.array([len(f) for f in found], np.uint32)
                flat = np.concatenate([*found, np.zeros(0, np.uint32)])
                by_use = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
                rank = np.empty(len(words), np.uint32)
                rank[by_use] = np.arange(len(words), dtype=np.uint32)
                out.add(base + count, -1, pack(np.array(ids, np.int64), np.array(null, np.uint8), sizes, *planes(rank[flat]), level=3))
                names = list(words)
                raw = [names[i].encode("utf-8", "surrogatepass") for i in by_use.tolist()]
                by = bucket_of(raw, n)
                order = np.argsort(by, kind="stable")
                for some in np.split(order, np.flatnonzero(np.diff(by[order])) + 1):
                    if len(some):
                        out.add(base + count, int(by[some[0]]), pack(np.diff(some, prepend=0).astype(np.uint32), *joined([raw[i] for i in some]), level=3))
                return out.take()

            for doc_id, text in rows(batches, "doc_id", "text"):
                ids.append(doc_id or 0)
                null.append(doc_id is None)
                found.append(words.of_text(text or ""))
                chars += len(text or "")
                if chars >= block_chars or len(ids) >= 50_000:
                    yield block()
                    count += 1
                    words, ids, null, found, chars = Words(), [], [], [], 0
            if ids:
                yield block()

        return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, BLOCK_SQL).repartition(n, "block")

    def word_ids(self, blocks: DataFrame) -> DataFrame:
        """For each block and bucket the ids of its pre-tokens: every distinct pre-token of a bucket is encoded once."""
        path = self.path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode, out = encoding(path)._core_bpe.encode_single_piece, Writer(BLOCK, limit_bytes=4 << 20)
            now, known = None, {}
            for block, bucket, body in rows(batches, "block", "bucket", "body"):
                if bucket != now:
                    now, known = bucket, {}
                numbers, lengths, raw = unpack(body)
                ids = []
                for w in split_up(lengths, raw):
                    got = known.get(w)
                    if got is None:
                        known[w] = got = encode(w)
                    ids.append(got)
                reply = pack(numbers, np.array([len(x) for x in ids], np.uint8 if max(map(len, ids)) < 256 else np.uint32), np.fromiter(chain.from_iterable(ids), np.uint16 if max(map(max, ids), default=0) < 65536 else np.uint32), level=3)
                if out.add(block, bucket, reply, size=len(reply)):
                    yield out.take()
            yield out.take()

        def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pc.greater_equal(b.column(1), 0))

        n = parts(blocks.sparkSession)
        asked = blocks.mapInArrow(lists, BLOCK_SQL).repartition(n, "bucket").sortWithinPartitions("bucket")
        return asked.mapInArrow(run, BLOCK_SQL).repartition(n, "block")

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, ids: bool = True) -> DataFrame:
        """doc_id, n_tokens, ids_sha256, decoded_sha256 and, unless left out, the ids themselves."""
        path, blocks = self.path, self.blocks(docs, id_col, text_col, block_chars)
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *([("ids", pa.list_(pa.int32()))] if ids else [])])

        def run(own: pa.Table, replies: pa.Table) -> pa.Table:
            out, done, table_ = Writer(schema), [], token_bytes(path)
            pieces = [unpack(x) for x in replies.column("body").to_pylist()]
            numbers = np.concatenate([*[np.cumsum(p[0].astype(np.int64)) for p in pieces], np.zeros(0, np.int64)])
            sizes = np.concatenate([*[p[1] for p in pieces], np.zeros(0, np.uint32)]).astype(np.int64)
            values = np.concatenate([*[p[2] for p in pieces], np.zeros(0, np.uint16)]).astype(np.int32)
            first, size = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
            first[numbers], size[numbers] = np.cumsum(sizes) - sizes, sizes
            for bucket, body in zip(own.column("bucket").to_pylist(), own.column("body"), strict=True):
                if bucket >= 0:
                    continue
                doc_ids, null, n_words, *codes = unpack(body.as_py())
                words, at = from_planes(*codes), 0
                for doc_id, is_null, n in zip(doc_ids.tolist(), null.tolist(), n_words.tolist(), strict=True):
                    w = words[at : at + n]
                    at += n
                    got = ragged(values, first[w], size[w]).tolist()
                    text = b"".join([table_[i] for i in got])
                    row = [None if is_null else doc_id, len(got), hashlib.sha256(" ".join(map(str, got)).encode()).hexdigest(), hashlib.sha256(text).hexdigest()]
                    if out.add(*row, *([got] if ids else [])):
                        done.append(out.take())
            return pa.Table.from_batches([*done, out.take()])

        columns = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
        return blocks.groupBy("block").cogroup(self.word_ids(blocks).groupBy("block")).applyInArrow(run, columns)


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices values[start:start + size], one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded bytes: each id is looked up in the token-byte table, whose size the vocabulary fixes."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = token_bytes(path)
        for b in batches:
            found = [None if x is None else b"".join([table_[i] for i in x]) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(encoded[f"`{id_col}`"].alias("doc_id"), encoded[f"`{ids_col}`"].alias("ids")).mapInArrow(run, "doc_id bigint, decoded binary")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ByteBpe().encode(table(spark, sf_dir, "documents"), ids=False)
