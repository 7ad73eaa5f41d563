"""Encoding and decoding by a merge-type piece vocabulary (sentencepiece's BPE models), with a table over prefixes.

Merging is greedy: of all neighbours whose concatenation is a piece, the best score goes first, then the leftmost. So what
is merged within a span doesn't depend on the rest as long as no merge crosses its ends, and two facts follow. The last
token of the encoding of any prefix is the last token of one pair-compatible chain, hence unique. And a chain of tokens is
the encoding exactly if each two neighbours, merged by themselves, give these two tokens again.

1. An automaton of all pieces yields, for each end in a text, the tokens that end there, long ones first.
2. Of these the one is stored that is compatible with the token stored where it starts; there is exactly one.
3. From the end, the stored tokens are followed backwards, each to the place where it starts.

Two neighbouring characters that are neighbours in no piece are never in one token, so texts are cut there. The equal spans
of some million characters are worked out once, all of them abreast, a character at a time. A character out of the
vocabulary becomes the tokens of its bytes.

Texts are independent of each other: nothing is shuffled, so no key can be hot. A null text counts as empty, and an empty
one has no ids; null document ids are carried through; repeated rows are encoded as often as they occur; there are no ties.
Empty tables give empty results, and extra columns are ignored. A very long text is worked through in pieces that end at
cuts; its ids are held whole, as they are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.byte_bpe import ragged
from tessera.llm.common import Writer, only, rows, table

SPACE_MARK = "▁"
#: Characters that are worked on at a time, and the longest span that is worked out abreast with others.
CHUNK_CHARS, LONGEST = 1_000_000, 64
#: Characters with a column in the automaton's table, the most frequent in pieces; spans with others go one by one.
COLUMNS = 128
#: Slots of the table of pairs; when half full, it is begun anew.
PAIR_SLOTS = 1 << 20


def model_of(path: str) -> tuple[list[str], dict[str, float], list[int], bool]:
    """The pieces by id, the scores of those that text is made of, the ids of bytes, and whether a space mark is put first."""
    from sentencepiece import sentencepiece_model_pb2 as model

    proto = model.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    kind, norm = model.ModelProto.SentencePiece, proto.normalizer_spec
    if proto.trainer_spec.model_type != model.TrainerSpec.BPE or not proto.trainer_spec.byte_fallback:
        raise ValueError("a merge-type model with byte tokens is needed")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces):
        raise ValueError("models that rewrite characters or white space, or have pieces by hand, are not supported")
    names = [p.piece for p in proto.pieces]
    return names, {p.piece: p.score for p in proto.pieces if p.type == kind.NORMAL}, [names.index(f"<0x{b:02X}>") for b in range(256)], norm.add_dummy_prefix


class Vocabulary:
    """Pieces of a merge-type model: scores, byte tokens, and how each piece comes about by merges."""

    def __init__(self, path: str) -> None:
        self.names, self.scores, self.byte_ids, self.mark_first = model_of(path)
        self.lengths = [len(n) for n in self.names]
        self.sizes = np.array(self.lengths, np.int32)
        self.grown: dict[str, list[tuple[float, str, str]] | None] = {}
        tokens = [(n, i) for i, n in enumerate(self.names) if n in self.scores and self.growth(n) is not None]
        self.single = np.full(0x110000, -1, np.int32)
        for n, i in tokens:
            if len(n) == 1:
                self.single[ord(n)] = i
        self.neighbours(tokens)
        self.automaton(tokens)

    def growth(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges that make up a piece: score, then its first and last part before the merge. The last entry is the piece
        itself. None if merging the piece's characters doesn't give the piece; then it never is a token."""
        got = self.grown.get(piece, False)
        if got is False:
            parts, got, scores = list(piece), [], self.scores
            while len(parts) > 1:
                found = [scores.get(a + b, float("-inf")) for a, b in zip(parts, parts[1:])]
                best = found.index(max(found))
                if found[best] == float("-inf"):
                    break
                got.append((found[best], parts[0], parts[-1]))
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            got = [*got, (float("-inf"), piece, piece)] if len(parts) == 1 and piece in scores else None
            self.grown[piece] = got
        return got

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging `left + right` gives these two tokens: no merge across the border comes before their own. Of equal
        scores those within `left` come first, then the one across, then those within `right`."""
        a, b, i, j, scores = self.growth(left), self.growth(right), 0, 0, self.scores
        while True:
            (own, _, end), (other, start, _) = a[i], b[j]
            across = scores.get(end + start)
            if across is not None and across > own and across >= other:
                return False
            if i + 1 == len(a) and j + 1 == len(b):
                return True
            if j + 1 == len(b) or (i + 1 < len(a) and own >= other):
                i += 1
            else:
                j += 1

    def neighbours(self, tokens: list[tuple[str, int]]) -> None:
        """Numbers of the characters of longer pieces, frequent ones first from 1, and which of them are neighbours in a piece."""
        counts: dict[str, int] = {}
        for n, _ in tokens:
            for c in n if len(n) > 1 else "":
                counts[c] = counts.get(c, 0) + 1
        self.number = {c: k for k, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c)), 1)}
        self.numbers = np.zeros(0x110000, np.int16)
        self.numbers[[ord(c) for c in self.number]] = list(self.number.values())
        self.together = np.zeros((len(self.number) + 1,) * 2, bool)
        for n, _ in tokens:
            for a, b in zip(n, n[1:]):
                self.together[self.number[a], self.number[b]] = True

    def automaton(self, tokens: list[tuple[str, int]]) -> None:
        """`moves[state, number]` for numbers up to COLUMNS; `children` and `back`, the state of the longest known suffix, for
        the rest; the tokens that end in a state, long ones first, are `endings[state]`, and
        stand in `ending` from `first[state]` on."""
        self.children: list[dict[str, int]] = [{}]
        own, levels = {}, [[(0, 0, "")]]
        for n, i in tokens:
            state = 0
            for depth, c in enumerate(n, 1):
                to = self.children[state].get(c)
                if to is None:
                    self.children[state][c] = to = len(self.children)
                    self.children.append({})
                    if len(levels) <= depth:
                        levels.append([])
                    levels[depth].append((to, state, c))
                state = to
            own[state] = i
        self.back = [0] * len(self.children)
        self.endings: list[tuple[int, ...]] = [()] * len(self.children)
        self.moves = np.zeros((len(self.children), COLUMNS + 1), np.int32)
        for level in levels:
            for state, parent, c in level:
                self.back[state] = self.step(self.back[parent], c) if parent else 0
                self.endings[state] = (*([own[state]] if state in own else []), *self.endings[self.back[state]])
                row = self.moves[state]
                row[:] = self.moves[self.back[state]]
                for child, to in self.children[state].items():
                    if self.number.get(child, COLUMNS + 1) <= COLUMNS:
                        row[self.number[child]] = to
        sizes = np.array([len(e) for e in self.endings], np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.ending = np.array([i for e in self.endings for i in e], np.int32)

    def step(self, state: int, c: str) -> int:
        while state and c not in self.children[state]:
            state = self.back[state]
        return self.children[state].get(c, 0)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Pairs:
    """Which pairs of tokens are compatible: an open table, filled as pairs are met."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.keys, self.good, self.used = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool), 0

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at, out, rest = self.slot(keys), np.zeros(len(keys), bool), np.arange(len(keys))
        missing = []
        while len(rest):
            found = self.keys[at]
            hit = found == keys[rest]
            out[rest[hit]] = self.good[at[hit]]
            missing.append(rest[found == -1])
            on = ~hit & (found != -1)
            rest, at = rest[on], (at[on] + 1) % PAIR_SLOTS
        new = np.concatenate([*missing, np.zeros(0, np.int64)])
        if len(new):
            distinct, which = np.unique(keys[new], return_inverse=True)
            good = np.array([self.vocab.compatible(self.vocab.names[k >> 32], self.vocab.names[k & 0xFFFFFFFF]) for k in distinct.tolist()], bool)
            out[new] = good[which]
            if self.used + len(distinct) > PAIR_SLOTS // 2:
                self.clear()
            for k, at, fits in zip(distinct.tolist()[: PAIR_SLOTS // 2], self.slot(distinct).tolist(), good.tolist()):
                while self.keys[at] != -1:
                    at = (at + 1) % PAIR_SLOTS
                self.keys[at], self.good[at] = k, fits
                self.used += 1
        return out


class Encoder:
    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.pairs = vocab, Pairs(vocab)
        self.singly: dict[tuple[int, int], bool] = {}

    def of_span(self, span: str) -> list[int]:
        """Ids of one span, a character at a time: `last` holds, for each character, the token that ends the prefix up to it."""
        vocab, last, state, sizes, singly = self.vocab, [], 0, self.vocab.lengths, self.singly
        if len(singly) > PAIR_SLOTS // 8:
            singly.clear()
        for end, c in enumerate(span):
            state = vocab.step(state, c)
            for token in vocab.endings[state]:
                before = end - sizes[token]
                if before < 0:
                    break
                pair = last[before], token
                fits = singly.get(pair)
                if fits is None:
                    singly[pair] = fits = vocab.compatible(vocab.names[pair[0]], vocab.names[token])
                if fits:
                    break
            last.append(token)
        out, at = [], len(span) - 1
        while at >= 0:
            out.append(last[at])
            at -= sizes[last[at]]
        return out[::-1]

    def abreast(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many spans of numbered characters, one after the other, and how many each has."""
        vocab, pairs = self.vocab, self.pairs
        order = np.argsort(-sizes, kind="stable")
        starts, sizes, n = starts[order], sizes[order], len(sizes)
        longest = int(sizes[0]) if n else 0
        last, state = np.zeros((n, longest), np.int32), np.zeros(n, np.int32)
        longer = np.searchsorted(-sizes, -np.arange(longest), side="left")
        for end in range(longest):
            m = int(longer[end])
            state[:m] = vocab.moves[state[:m], codes[starts[:m] + end]]
            rest, at = np.arange(m), vocab.first[state[:m]]
            while len(rest):
                token = vocab.ending[at]
                before = end - vocab.sizes[token]
                fits = before < 0
                inner = np.flatnonzero(~fits)
                fits[inner] = pairs.fit(last[rest[inner], before[inner]], token[inner])
                last[rest[fits], end] = token[fits]
                rest, at = rest[~fits], at[~fits] + 1
        found, count, at, rest = np.zeros((n, longest), np.int32), np.zeros(n, np.int64), sizes - 1, np.arange(n)
        while len(rest):
            token = last[rest, at[rest]]
            found[rest, count[rest]] = token
            count[rest] += 1
            at[rest] -= vocab.sizes[token]
            rest = rest[at[rest] >= 0]
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        count = count[back]
        ends = np.cumsum(count)
        within = np.arange(int(ends[-1]) if n else 0) - np.repeat(ends - count, count)
        return found.ravel()[np.repeat(back * longest + count - 1, count) - within], count

    def of_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of texts that already begin with their space mark; all cuts between them are cuts of the vocabulary too."""
        vocab = self.vocab
        text = "".join(pieces)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        codes = vocab.numbers[points]
        bounds = np.cumsum([0, *map(len, pieces)])
        cut = np.ones(len(points), bool)
        cut[1:] = ~vocab.together[codes[:-1], codes[1:]]
        cut[bounds[:-1][bounds[:-1] < len(points)]] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(starts, append=len(points))
        first, count = np.zeros(len(starts), np.int64), np.ones(len(starts), np.int64)
        values, held = [], 0

        def put(where: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
            nonlocal held
            first[where], count[where] = held + np.cumsum(counts) - counts, counts
            values.append(ids)
            held += len(ids)

        one = sizes == 1
        alone = vocab.single[points[starts]]
        known = np.flatnonzero(one & (alone >= 0))
        put(known, alone[known], np.ones(len(known), np.int64))
        other = np.flatnonzero(one & (alone < 0))
        spelled = [[vocab.byte_ids[b] for b in chr(p).encode()] for p in points[starts[other]].tolist()]
        put(other, np.array([i for s in spelled for i in s], np.int32), np.array([len(s) for s in spelled], np.int64))
        common = np.bitwise_and.reduceat(codes <= COLUMNS, starts) if len(starts) else np.zeros(0, bool)
        single = np.flatnonzero(~one & ~(common & (sizes <= LONGEST)))
        spans: dict[str, list[int]] = {}
        for k in single.tolist():
            span = text[starts[k] : starts[k] + sizes[k]]
            if span not in spans:
                spans[span] = self.of_span(span)
        got = [spans[text[starts[k] : starts[k] + sizes[k]]] for k in single.tolist()]
        put(single, np.array([i for g in got for i in g], np.int32), np.array([len(g) for g in got], np.int64))
        many = np.flatnonzero(~one & common & (sizes <= LONGEST))
        where, which = distinct(codes, starts[many], sizes[many])
        ids, counts = self.abreast(codes, starts[many][where], sizes[many][where])
        firsts = held + np.cumsum(counts) - counts
        first[many], count[many] = firsts[which], counts[which]
        values.append(ids)
        ids = ragged(np.concatenate(values), first, count)
        total = np.concatenate([[0], np.cumsum(count)])
        return np.split(ids, total[np.searchsorted(starts, bounds[1:-1])])


def distinct(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct span, and the number of the one each span equals. Spans are told apart by hashes, and all are
    compared with the one they are taken to equal; should two differ, other factors are drawn."""
    draw = np.random.default_rng(1)
    flat = ragged(codes, starts, sizes)
    ends = np.cumsum(sizes)
    within = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    while True:
        factors = draw.integers(1, 1 << 63, size=LONGEST + 1, dtype=np.uint64) | np.uint64(1)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        product = (flat.astype(np.uint64) + np.uint64(1)) * factors[within]
        keys = np.add.reduceat(product ^ (product >> np.uint64(29)), ends - sizes)
        _, where, which = np.unique(keys, return_index=True, return_inverse=True)
        same = where[which]
        if (sizes[same] == sizes).all() and (ragged(codes, starts[same], sizes) == flat).all():
            return where, which


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path))


CUT = regex.compile(r"(?r)[^ ] ")


def pieces_of(text: str, vocab: Vocabulary, most: int = CHUNK_CHARS) -> Iterator[str]:
    """A text in the vocabulary's writing, in pieces of some size that end before a space that follows another character,
    if the vocabulary has no piece that goes on there."""
    marked = any(SPACE_MARK in n.lstrip(SPACE_MARK) for n in vocab.scores) if len(text) > most else True
    begun = SPACE_MARK if vocab.mark_first and text else ""
    at = 0
    while len(text) - at > most:
        found = None if marked else CUT.search(text, at, at + most)
        if found is None:
            most *= 2
            continue
        yield begun + text[at : found.start() + 1].replace(" ", SPACE_MARK)
        at, begun = found.start() + 1, ""
    yield begun + text[at:].replace(" ", SPACE_MARK)


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


class PieceBpe:
    def __init__(self, path: str | None = None) -> None:
        self.path = path or public_tokenizers.path("piece_bpe_32k.model")

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
        """doc_id and ids, a row for each row of `docs`."""
        path = self.path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, out = encoder(path), Writer(ENCODED)
            pieces, of, chars, begun = [], [], 0, []  # texts of a chunk, the ids of their documents, and of one begun before

            def worked() -> Iterator[pa.RecordBatch]:
                nonlocal pieces, of, chars, begun
                for (doc_id, last), ids in zip(of, own.of_pieces(pieces) if pieces else [], strict=True):
                    begun.append(ids)
                    if last:
                        ids, begun = np.concatenate(begun) if len(begun) > 1 else ids, []
                        if out.add(doc_id, ids, size=ids.nbytes):
                            yield out.take()
                pieces, of, chars = [], [], 0

            for doc_id, text in rows(batches, "doc_id", "text"):
                parts = list(pieces_of(text or "", own.vocab, chunk_chars))
                for k, piece in enumerate(parts, 1):
                    pieces.append(piece)
                    of.append((doc_id, k == len(parts)))
                    chars += len(piece)
                    if chars >= chunk_chars:
                        yield from worked()
            yield from worked()
            yield out.take()

        return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id bigint, ids array<int>")

    def decode(self, encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", digests: bool = False) -> DataFrame:
        """doc_id and the decoded text (null where the ids are); or, of both the ids and the text, lengths and digests."""
        path = self.path
        kinds = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("decoded", pa.string())]
        schema = pa.schema([("doc_id", pa.int64()), *kinds])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spelled, numerals, mark = spellings(path)
            out = Writer(schema)
            for b in batches:
                doc_ids, lists = b.column(0).to_pylist(), b.column(1)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                nulls, ids = lists.is_null().to_pylist(), lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(counts)
                begin = 0
                while begin < len(counts):
                    end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + 200_000, side="right")))
                    some = ids[ends[begin] - counts[begin] : ends[end - 1]]
                    texts = spelled.of(some, counts[begin:end])
                    names = numerals.of(some, counts[begin:end]) if digests else texts
                    at = 0
                    for k, text, name in zip(range(begin, end), texts, names, strict=True):
                        text = text[1:] if mark and text[:1] == b" " and some[at] not in numerals.apart else text
                        at += int(counts[k])
                        if digests:
                            row = [int(counts[k]), hashlib.sha256(name[:-1]).hexdigest(), hashlib.sha256(text).hexdigest()]
                        else:
                            row = [None if nulls[k] else text.decode("utf-8", "replace")]
                        if out.add(doc_ids[k], *row, size=0 if digests else len(text)):
                            yield out.take()
                    begin = end
            yield out.take()

        columns = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "doc_id bigint, decoded string"
        return only(encoded, doc_id=id_col, ids=ids_col).mapInArrow(run, columns)


class Spelling:
    """What each id stands for, as bytes; `apart` are ids whose leading space is not a mark."""

    def __init__(self, strings: list[bytes], apart: list[int]) -> None:
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.body = np.frombuffer(b"".join(strings), np.uint8)
        self.apart = set(apart)

    def of(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each of some lists of ids, which stand one after the other."""
        sizes = self.sizes[ids]
        whole = ragged(self.body, self.first[ids], sizes).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)].tolist()
        return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


@lru_cache(maxsize=2)
def spellings(path: str) -> tuple[Spelling, Spelling, bool]:
    """The bytes of each id, its decimal name with a comma, and whether a leading space mark is the encoder's own."""
    names, scores, byte_ids, mark_first = model_of(path)
    strings = [n.replace(SPACE_MARK, " ").encode() if n in scores else b"" for n in names]
    for b, i in enumerate(byte_ids):
        strings[i] = bytes([b])
    return Spelling(strings, byte_ids), Spelling([b"%d," % i for i in range(len(names))], byte_ids), mark_first


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpe = PieceBpe()
    return bpe.decode(bpe.encode(table(spark, sf_dir, "documents")), digests=True)
