import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.piece_bpe import Encoder, PieceBpe, pieces_of, vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "  a", "a  b   c", "▁", "▁▁ ▁x", "<s> </s> <unk> <0x41>", "a\nb\r\n\tc", "\x00\x01", "日本語 テスト 梦벨ゼ", "é é", "🙂👩‍👩‍👧!!", "n" * 5000, "日" * 3000, "1234 5678a", "﻿x�", "word again " * 20000, "x" * 70 + " " * 40,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return Encoder(vocabulary(PATH))


def digest(text, library):
    ids = library.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from("aehinorst▁  \n\x00.,'é日🙂0")), max_size=8))
def test_ids_equal_the_library(texts, library, own):
    got = own.of_pieces([p for t in texts for p in pieces_of(t, own.vocab)])
    assert [g.tolist() for g in got] == [library.encode(t) for t in texts] if texts else len(got) == 1


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("etahin▁z"), min_size=2, max_size=30))
def test_one_by_one_equals_abreast(text, library, own):
    assert own.of_span("▁" + text) == library.encode(text)


def test_pairs_are_those_that_merging_leaves_apart(library, own):
    """Compatible pairs are told by merging the two together, tokens by merging their own characters."""

    def merged(text):
        parts = list(text)
        while True:
            best = max(((own.vocab.scores.get(a + b, float("-inf")), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=None)
            if best is None or best[0] == float("-inf"):
                return parts
            parts[-best[1] : 2 - best[1]] = ["".join(parts[-best[1] : 2 - best[1]])]

    names = [n for n in own.vocab.names if n in own.vocab.scores and len(n) < 9][::97] + ["▁" * k for k in range(1, 17)]
    assert all((own.vocab.growth(n) is not None) == (merged(n) == [n]) for n in names)
    tokens = [n for n in names if own.vocab.growth(n) is not None]
    assert all(own.vocab.compatible(a, b) == (merged(a + b) == [a, b]) for a in tokens[::3] for b in tokens[::2])


def test_long_texts_go_in_pieces(library, own):
    text = "the cat  sat   on\nthe mat " * 300
    pieces = list(pieces_of(text, own.vocab, 100))
    assert len(pieces) > 50 and "".join(pieces) == "▁" + text.replace(" ", "▁")
    assert [i for g in own.of_pieces(pieces) for i in g.tolist()] == library.encode(text)
    assert len(list(pieces_of("x" * 1000, own.vocab, 100))) == 1


@pytest.mark.parametrize("chunk", [50, 20_000])
def test_whole_table(spark, library, chunk):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bpe = PieceBpe()
    got = bpe.decode(bpe.encode(docs, chunk_chars=chunk), digests=True).collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, *digest(r.text, library)) for r in docs.collect())


def test_odd_rows(spark, library):
    texts = [*enumerate(ODD), (None, "no id"), (3, "a  b"), (3, "a  b")]
    df = spark.createDataFrame([(k, t, 1, [7]) for k, t in texts], "doc_id bigint, text string, ID int, ids array<int>")
    bpe = PieceBpe()
    out = bpe.encode(df)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(key(r) for r in bpe.decode(out, digests=True).collect()) == sorted((k is None, k or 0, *digest(t, library)) for k, t in texts)
    assert sorted(key(r) for r in bpe.decode(out).collect()) == sorted((k is None, k or 0, library.decode(library.encode(t or ""))) for k, t in texts)
    assert bpe.decode(bpe.encode(df.limit(0)), digests=True).count() == 0
    lone = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert sorted(map(tuple, bpe.decode(lone).collect())) == [(1, None), (2, "")]
