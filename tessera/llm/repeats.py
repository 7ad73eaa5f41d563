"""Distribution of the two exact-repeat operators: who compares what with whom.

A window is L consecutive symbols of one document; symbols are bytes or words. What starts in two documents must meet:

1. Documents are gathered in blocks of bounded size and written to the shared folder, each block of one batch of ids.
2. The smallest gram hash of a window, the first one if it stands there twice, is the window's anchor. Either what follows
   the anchor for half a window or what precedes it lies within the window; this is its flank. Neighbouring windows with
   one anchor and one flank are a run. Equal windows have equal flanks, so a run whose flank no other document has repeats
   nowhere: blocks send hashes of their flanks, and get back a bit for each that tells whether others have it. Hashes are
   even, so a bucket of them is of bounded size whatever the texts hold.
3. A block's runs with a shared flank are cut out as strings; equal strings count once, with the smallest and largest id
   that holds them, so a passage costs a block one string however many of its documents hold it.
4. The operator deals the strings to groups by their flanks or by prefixes of them, finds for each window the smallest id
   in which it starts, and answers each block with the windows that start in smaller ids than some asker has.
5. Each block gets its answers and marks its documents.

Ids are bigint. Rows with a null id neither hide nor are hidden. Rows that repeat an id don't hide one another.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm.common import SPACE, Writer, pack, parts, rows, unpack, word_bounds, written

NO_ID = np.iinfo(np.int64).max
#: Buckets or groups for each partition of a shuffle; a task holds one of them at a time.
GROUPS = 8
#: Kinds of rows beside those of groups, which count from 0: a block's documents, and its runs.
STORED, RUNS = -1, -2
C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BYTE_KEYS = np.random.default_rng(3).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = h * C1
    h ^= h >> np.uint64(32)
    h *= C2
    h ^= h >> np.uint64(29)
    return h


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours; len(h) - w + 1 values."""
    out, have = h, 1
    while 2 * have <= w:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    return np.minimum(out[: len(out) - (w - have)], out[w - have :]) if have < w else out


class Bytes:
    """Symbols are bytes."""

    def __init__(self, window: int = 50, gram: int = 8) -> None:
        #: A flank is so many grams from the anchor on, or as many before it and the anchor.
        self.window, self.gram, self.reach = window, gram, max(1, window // (2 * gram))

    def prepared(self, text: str | None) -> bytes:
        return (text or "").encode("utf-8", "surrogatepass")

    def bounds(self, body: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None]:
        return None, None

    def grams(self, body: np.ndarray, start: np.ndarray | None, end: np.ndarray | None, lo: int, hi: int) -> np.ndarray:
        """Hashes of the grams that start at symbols lo..hi-1."""
        raw = np.ascontiguousarray(body[lo : hi + self.gram - 1])
        return mix(np.ndarray(hi - lo, "<u8", raw.data, strides=(1,)))

    def count(self, piece: bytes) -> int:
        return len(piece)


class Words:
    """Symbols are words, whatever white space is between."""

    def __init__(self, window: int = 13, gram: int = 2) -> None:
        self.window, self.gram, self.reach = window, gram, max(1, window // (2 * gram))

    def prepared(self, text: str | None) -> bytes:
        return (text or "").encode("utf-8", "surrogatepass")

    def bounds(self, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return word_bounds(body)

    def hashes(self, body: np.ndarray, start: np.ndarray, end: np.ndarray, portion: int = 150_000) -> np.ndarray:
        """A 64-bit hash of each word, by its bytes and their places in it."""
        out = np.zeros(len(start), np.uint64)
        for at in range(0, len(start), portion):
            s, e = start[at : at + portion], end[at : at + portion]
            base = int(s[0])
            seg = body[base : int(e[-1]) + 1]
            place = np.arange(len(seg), dtype=np.uint64)
            place -= np.repeat((s - base).astype(np.uint64), np.diff(np.append(s, base + len(seg))))
            keyed = BYTE_KEYS[seg] * (place * np.uint64(2) + np.uint64(1)) ^ (BYTE_KEYS[seg] >> np.uint64(17))
            keyed[SPACE[seg]] = 0
            out[at : at + portion] = np.add.reduceat(keyed, s - base)
        return mix(out)

    def grams(self, body: np.ndarray, start: np.ndarray, end: np.ndarray, lo: int, hi: int) -> np.ndarray:
        h = self.hashes(body, start[lo : hi + self.gram - 1], end[lo : hi + self.gram - 1])
        n = hi - lo
        out = np.zeros(n, np.uint64)
        for k in range(self.gram):
            out = (out + h[k : k + n]) * (C2 + np.uint64(2 * k))
        return mix(out)

    def count(self, piece: bytes) -> int:
        return len(piece.split())


Symbols = Bytes | Words


class Block:
    """Documents of a block in one buffer, a space after each."""

    def __init__(self, kind: Symbols, texts: list[bytes]) -> None:
        self.kind = kind
        self.raw = b"".join([t + b" " for t in texts])
        self.body = np.frombuffer(self.raw, np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.doc_start, self.doc_end = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(texts)], (ends - 1).astype(np.int64)
        self.start, self.end = kind.bounds(self.body)
        if self.start is None:
            self.first_symbol, self.last_symbol = self.doc_start, self.doc_end
        else:
            self.first_symbol, self.last_symbol = np.searchsorted(self.start, self.doc_start), np.searchsorted(self.start, self.doc_end)

    def byte_span(self, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte bounds of symbols first..stop-1."""
        return (first, stop) if self.start is None else (self.start[first], self.end[stop - 1])

    def doc_of(self, symbol: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first_symbol, symbol, "right") - 1

    def runs(self, known: np.ndarray, segment: int = 1 << 19) -> Runs:
        """The runs of the documents marked in known, in order."""
        kind, L = self.kind, self.kind.window
        gram, w, total = kind.gram, L - kind.gram + 1, int(self.last_symbol[-1]) if len(self.last_symbol) else 0
        valid = np.zeros(total + 1, bool)
        for s, e in zip(self.first_symbol[known].tolist(), self.last_symbol[known].tolist(), strict=True):
            if e - s >= L:
                valid[s : e - L + 1] = True
        low_bits = np.uint64((1 << 20) - 1)
        out: list[tuple] = []
        for lo in range(0, max(total - L + 1, 0), segment):
            hi = min(lo + segment, total - L + 1)
            p = np.flatnonzero(valid[lo:hi])
            if not len(p):
                continue
            grams = kind.grams(self.body, self.start, self.end, lo, hi + w - 1)
            # The place within the segment breaks ties, so the minimum tells where the anchor is.
            anchor = (sliding_min((grams & ~low_bits) | np.arange(len(grams), dtype=np.uint64), w)[p] & low_bits).astype(np.int64)
            left = anchor - p > L - gram * kind.reach
            new = np.ones(len(p), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (left[1:] != left[:-1]) | (np.diff(p) != 1)
            head = np.flatnonzero(new)
            at, where, before = p[head], anchor[head], left[head]
            key = np.where(before, C1, C2)
            first = where - before * gram * kind.reach
            for k in range(kind.reach + 1):
                more = before | (k < kind.reach)
                key[more] = mix(key[more] + grams[first[more] + gram * k])
            out.append((at + lo, np.diff(np.append(head, len(p))), key, first - at))
        cells = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return Runs(cells[0].astype(np.int64), cells[1].astype(np.int64), cells[2].astype(np.uint64), cells[3].astype(np.int64))

    def strings(self, runs: Runs) -> tuple[list[bytes], np.ndarray]:
        """The distinct strings of the runs in order of first use, and the number of each run's string."""
        a, b = self.byte_span(runs.at, runs.at + runs.size + self.kind.window - 1)
        raw, number = self.raw, {}
        of = np.fromiter((number.setdefault(raw[i:j], len(number)) for i, j in zip(a.tolist(), b.tolist(), strict=True)), np.int64, len(a))
        return list(number), of


class Runs(NamedTuple):
    """First window and number of windows of each run, the hash of its flank, and where in the run the flank starts."""

    at: np.ndarray
    size: np.ndarray
    key: np.ndarray
    flank: np.ndarray

    def some(self, chosen: np.ndarray) -> Runs:
        return Runs(*[c[chosen] for c in self])


SENT = pa.schema([("block", pa.int64()), ("batch", pa.int32()), ("bucket", pa.int32()), ("body", pa.binary())])
SENT_SQL = "block bigint, batch int, bucket int, body binary"


def blocks(docs: DataFrame, kind: Symbols, block_bytes: int, bounds: list[int]) -> DataFrame:
    """docs has doc_id, text and any other columns, which go along as they are. Rows of (block, batch, STORED, body), the
    documents of a body by id; batch b has the ids of at least bounds[b - 1] and less than bounds[b]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        groups: dict[int, list] = defaultdict(list)
        sizes: dict[int, int] = defaultdict(int)
        out = Writer(SENT)

        def done(batch: int) -> None:
            group = sorted(groups.pop(batch), key=lambda g: (g[0] is None, g[0] or 0, g[1]))
            sizes.pop(batch)
            ids, null = np.array([NO_ID if g[0] is None else g[0] for g in group], np.int64), np.array([g[0] is None for g in group], np.uint8)
            texts = np.array([len(g[1]) for g in group], np.int64), np.frombuffer(b"".join([g[1] for g in group]), np.uint8)
            sink = pa.BufferOutputStream()
            if group[0][2] is not None:
                sources = list({id(g[2]): g[2] for g in group}.values())
                begin = dict(zip(map(id, sources), np.cumsum([0, *[x.num_rows for x in sources[:-1]]]).tolist(), strict=True))
                carried = pa.Table.from_batches(sources).take([begin[id(g[2])] + g[3] for g in group]).combine_chunks()
                with pa.ipc.new_stream(sink, carried.schema) as stream:
                    stream.write_table(carried)
            body = pack(ids, null, *texts, np.frombuffer(sink.getvalue(), np.uint8), level=3)
            out.add(number, batch, STORED, body, size=len(body))

        for b in batches:
            carried = b.select(b.schema.names[2:]) if b.num_columns > 2 else None
            for i, (doc_id, text) in enumerate(rows(iter([b]), "doc_id", "text")):
                t = kind.prepared(text)
                batch = bisect_right(bounds, doc_id) if doc_id is not None else 0
                groups[batch].append((doc_id, t, carried, i))
                sizes[batch] += len(t) + 1
                if sizes[batch] >= block_bytes or len(groups[batch]) >= 20_000:
                    done(batch)
                    yield out.take()
                    number += 1
        for batch in sorted(groups):
            done(batch)
            number += 1
            yield out.take()

    return written(docs.mapInArrow(run, SENT_SQL), "repeat-blocks")


def opened(body: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes], pa.Table | None]:
    ids, null, sizes, flat, carried = unpack(body)
    return ids, null.astype(bool), cut(sizes, flat), pa.ipc.open_stream(carried.tobytes()).read_all() if len(carried) else None


def cut(sizes: np.ndarray, flat: np.ndarray) -> list[bytes]:
    raw, ends = flat.tobytes(), np.cumsum(sizes, dtype=np.int64).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def known_runs(kind: Symbols, body: bytes) -> tuple[Block, Runs, np.ndarray, np.ndarray, np.ndarray]:
    """A block, its runs, the distinct flank hashes with the place of each run's among them, and the ids of the runs."""
    ids, null, texts, _ = opened(body)
    b = Block(kind, texts)
    runs = b.runs(~null)
    keys, of = np.unique(runs.key, return_inverse=True)
    return b, runs, keys, of, ids[b.doc_of(runs.at)] if len(runs.at) else np.zeros(0, np.int64)


def bucket_bounds(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The bucket of each of the sorted keys by its upper half, and where each bucket that has some starts and ends."""
    by = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    head = np.flatnonzero(np.append(True, by[1:] != by[:-1])) if len(by) else np.zeros(0, np.int64)
    return by, list(zip(head.tolist(), [*head[1:].tolist(), len(by)], strict=True)) if len(by) else []


def extremes(of: np.ndarray, n: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest id of each of n things; of tells whose an id is."""
    low, high = np.full(n, NO_ID), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, of, ids)
    np.maximum.at(high, of, ids)
    return low, high


def shared(stored: DataFrame, kind: Symbols, n: int) -> DataFrame:
    """(block, batch, bucket, bits): whether others have a flank, for each of a block's in order of its hash."""
    buckets = n * GROUPS

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(SENT)
        for block, batch, body in rows(batches, "block", "batch", "body"):
            _, _, keys, of, ids = known_runs(kind, body)
            low, high = extremes(of, len(keys), ids)
            by, bounds = bucket_bounds(keys, buckets)
            for a, z in bounds:
                if out.add(block, batch, int(by[a]), keys[a:z].astype("<u4").tobytes() + np.packbits(low[a:z] != high[a:z]).tobytes()):
                    yield out.take()
            yield out.take()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, group = Writer(SENT, limit_bytes=4 << 20), None, []

        def done() -> Iterator[pa.RecordBatch]:
            counts = [len(body) * 8 // 33 for _, _, body in group]
            hashes = np.concatenate([np.frombuffer(body, "<u4", k) for (_, _, body), k in zip(group, counts, strict=True)])
            several = np.concatenate([np.unpackbits(np.frombuffer(body, np.uint8)[4 * k :], count=k) for (_, _, body), k in zip(group, counts, strict=True)]).astype(bool)
            order = np.argsort(hashes, kind="stable")
            same = hashes[order[1:]] == hashes[order[:-1]]
            several[order[1:][same]] = True
            several[order[:-1][same]] = True
            for (block, batch, _), bits in zip(group, np.split(several, np.cumsum(counts)[:-1]), strict=True):
                if bits.any() and out.add(block, batch, now, np.packbits(bits).tobytes(), size=len(bits) // 8):
                    yield out.take()
            group.clear()

        for block, batch, bucket, body in rows(batches, "block", "batch", "bucket", "body"):
            if bucket != now and group:
                yield from done()
            now = bucket
            group.append((block, batch, body))
        if group:
            yield from done()
        yield out.take()

    return stored.mapInArrow(ask, SENT_SQL).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, SENT_SQL)


def candidates(stored: DataFrame, kind: Symbols, n: int) -> DataFrame:
    """Of each block a row of its runs with shared flanks, (at, size, string), and a row 0 of the distinct strings of
    those: hashes and places of the flanks, smallest ids, spans to the largest ones, lengths, bytes."""
    buckets = n * GROUPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, got = Writer(SENT), None, []
        for block, batch, bucket, body in rows(batches, "block", "batch", "bucket", "body"):
            if block != now:
                now, got = block, []
            if bucket != STORED:
                got.append((bucket, body))
                continue
            if not got:
                continue
            b, runs, keys, of, ids = known_runs(kind, body)
            by, bounds = bucket_bounds(keys, buckets)
            place, several = {int(by[a]): (a, z) for a, z in bounds}, np.zeros(len(keys), bool)
            for told, bits in got:
                a, z = place[told]
                several[a:z] = np.unpackbits(np.frombuffer(bits, np.uint8), count=z - a).astype(bool)
            chosen = np.flatnonzero(several[of])
            some = runs.some(chosen)
            strings, number = b.strings(some)
            low, high = extremes(number, len(strings), ids[chosen])
            first = np.full(len(strings), len(number))
            np.minimum.at(first, number, np.arange(len(number)))
            out.add(block, batch, RUNS, pack(np.diff(some.at, prepend=0), some.size.astype(np.uint16), number.astype(np.uint32), level=3))
            out.add(block, batch, 0, pack(some.key[first], some.flank[first].astype(np.uint16), low, high - low, np.array([len(x) for x in strings], np.uint32), np.frombuffer(b"".join(strings), np.uint8), level=3))
            yield out.take()
        yield out.take()

    together = stored.unionByName(shared(stored, kind, n)).repartition(n, "block").sortWithinPartitions("block", F.col("bucket") == STORED)
    return written(together.mapInArrow(run, SENT_SQL), "repeat-strings", by="bucket")


class Strings(NamedTuple):
    """Strings of a block with their numbers there."""

    number: np.ndarray
    key: np.ndarray
    flank: np.ndarray
    low: np.ndarray
    span: np.ndarray
    text: list[bytes]

    def packed(self, some: np.ndarray) -> bytes:
        texts = [self.text[i] for i in some.tolist()]
        return pack(np.diff(self.number[some], prepend=0).astype(np.uint32), self.low[some], self.span[some], np.array([len(t) for t in texts], np.uint32), np.frombuffer(b"".join(texts), np.uint8), level=3)


def strings_of(body: bytes) -> Strings:
    key, flank, low, span, sizes, flat = unpack(body)
    return Strings(np.arange(len(key)), key, flank, low, span, cut(sizes, flat))


def routed(asks: DataFrame, group_of: Callable[[Strings], np.ndarray]) -> DataFrame:
    """The strings of each block by the group that group_of gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(SENT)
        for block, batch, body in rows(batches, "block", "batch", "body"):
            s = strings_of(body)
            by = group_of(s)
            order = np.argsort(by, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(by[order])) + 1):
                packed = s.packed(some)
                if out.add(block, batch, int(by[some[0]]), packed, size=len(packed)):
                    yield out.take()
        yield out.take()

    return asks.where(F.col("bucket") == 0).mapInArrow(run, SENT_SQL)


class Group:
    """The strings of a group, from several blocks."""

    def __init__(self, found: list[tuple[int, bytes]]) -> None:
        """found: (block, packed strings)."""
        block, number, low, high, self.text = [], [], [], [], []
        for name, body in found:
            some, lows, span, sizes, flat = unpack(body)
            block.append(np.full(len(some), name))
            number.append(np.cumsum(some.astype(np.int64)))
            low.append(lows)
            high.append(lows + span)
            self.text += cut(sizes, flat)
        self.block, self.number, self.low, self.high = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (block, number, low, high))

    def distinct(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct strings, the smallest id of each, and the place of each string's among them."""
        places: dict[bytes, int] = {}
        of = np.fromiter((places.setdefault(t, len(places)) for t in self.text), np.int64, len(self.text))
        least = np.full(len(places), NO_ID)
        np.minimum.at(least, of, self.low)
        return list(places), least, of

    def answers(self, of: np.ndarray, windows: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """For each block the runs of windows that start in a smaller id than some asker has. windows: how many each
        distinct string has; first: the smallest id of each of them, one string after the other."""
        begin, size = np.cumsum(windows) - windows, windows[of]
        owner = np.repeat(np.arange(len(of)), size)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        ids = first[np.repeat(begin[of], size) + place]
        hidden = np.flatnonzero(ids < self.high[owner])
        if not len(hidden):
            return
        o, p, v = owner[hidden], place[hidden], ids[hidden]
        head = np.flatnonzero(np.append(True, (np.diff(o) != 0) | (np.diff(p) != 1) | (np.diff(v) != 0)))
        last = np.append(head[1:], len(o)) - 1
        o, a, z, v = o[head], p[head].astype(np.uint16), p[last].astype(np.uint16), v[head]
        order = np.lexsort((self.number[o], self.block[o]))
        for part in np.split(order, np.flatnonzero(np.diff(self.block[o][order])) + 1):
            yield int(self.block[o[part[0]]]), pack(self.number[o[part]].astype(np.uint32), a[part], z[part], v[part], level=3)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """(group, [(block, batch, body)]) of rows that come group by group."""
    now, group = None, []
    for block, batch, bucket, body in rows(batches, "block", "batch", "bucket", "body"):
        if bucket != now and group:
            yield now, group
            group = []
        now = bucket
        group.append((block, batch, body))
    if group:
        yield now, group


def hidden_symbols(b: Block, ids: np.ndarray, runs: bytes | None, replies: list[list[np.ndarray]]) -> np.ndarray:
    """A mark for each symbol of the block that a window starting in a smaller id covers."""
    total = int(b.last_symbol[-1]) if len(b.last_symbol) else 0
    change = np.zeros(total + 1, np.int32)
    if replies and runs is not None:
        at, _, of = unpack(runs)
        at = np.cumsum(at)
        number, a, z, first = (np.concatenate(x) for x in zip(*replies, strict=True))
        order = np.argsort(number, kind="stable")
        number, a, z, first = number[order], a[order].astype(np.int64), z[order].astype(np.int64), first[order]
        lo, hi = np.searchsorted(number, of, "left"), np.searchsorted(number, of, "right")
        n = hi - lo
        run = np.repeat(np.arange(len(of)), n)
        item = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        ok = first[item] < ids[b.doc_of(at[run])]
        run, item = run[ok], item[ok]
        np.add.at(change, at[run] + a[item], 1)
        np.add.at(change, at[run] + z[item] + b.kind.window, -1)
    return np.cumsum(change)[:total] > 0


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Ids that part the documents in batches of about like size; fewer where ids repeat."""
    if batches < 2:
        return []
    got = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    return sorted(set(got))


def repeats(docs: DataFrame, kind: Symbols, solve: Callable[[DataFrame, int, int], DataFrame], finish: Callable, fields: StructType, block_bytes: int, batches: int = 1) -> DataFrame:
    """solve(strings of candidates(), batches, partitions) gives the answers, (block, batch, bucket, body) with buckets from
    0; finish(doc_id, text, hidden symbol marks) a document's cells for the columns of fields. docs has doc_id, text and
    perhaps more columns, which follow these."""
    n = parts(docs.sparkSession)
    bounds = batch_bounds(docs, batches)
    stored = blocks(docs, kind, block_bytes, bounds)
    asks = candidates(stored, kind, n)
    answers = solve(asks, len(bounds) + 1, n)
    schema = StructType([*fields, *docs.schema[2:]])
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block come together, its documents last."""
        now, got, runs = None, [], None
        for block, bucket, body in rows(batches, "block", "bucket", "body"):
            if block != now:
                now, got, runs = block, [], None
            if bucket == RUNS:
                runs = body
            elif bucket != STORED:
                got.append(unpack(body))
            else:
                ids, null, texts, carried = opened(body)
                b = Block(kind, texts)
                marks = hidden_symbols(b, ids, runs, got)
                cells = [finish(None if null[i] else int(ids[i]), text, marks[b.first_symbol[i] : b.last_symbol[i]]) for i, text in enumerate(texts)]
                own = [pa.array(c, f.type) for c, f in zip(zip(*cells, strict=True), arrow, strict=True)]
                rest = carried.combine_chunks().to_batches()[0].columns if carried is not None else []
                yield pa.RecordBatch.from_arrays([*own, *rest], names=schema.names)

    together = stored.unionByName(asks.where(F.col("bucket") == RUNS)).unionByName(answers).repartition(n, "block").sortWithinPartitions("block", F.col("bucket") == STORED)
    return together.mapInArrow(run, schema)
