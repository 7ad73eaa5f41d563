import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.packing import Packer, chunk_ids, encoded, hilbert, pack, tail_lengths

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "a", "Don't STOP, it's the l'été!!", "ÀÉÎ ß × ÷ ½ µ ª", "İstanbul ΣΑΣ ςσ", "é café", "x y z\x85w\x1cq",
    "<|endoftext|> and a<|startoftext|>b <|end", "日本語 テスト 123٣", "a" * 3000, "'s't're''ve 'LL", "tab\tnew\nline\x0b\x0c\r\n", "\x00\x01 \x7f", "🙂👩‍👩‍👧 ok", "ǅ ſ ﬁ",
]


def reference(texts):
    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def test_ids_equal_the_tokenizer_on_odd_texts():
    got = [np.frombuffer(encoded(x, chunk_ids(PATH), np.array([2], "<u4").tobytes()), "<u4").tolist() for x in ODD]
    assert got == reference(ODD)


def test_hilbert_visits_each_cell_once_in_unit_steps():
    cells = np.stack(np.meshgrid(*[np.arange(4)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert(cells, 2)
    assert sorted(keys) == list(range(64))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("n", [0, 1, 3000, 4095, 4096])
def test_tail(n):
    assert sum(tail_lengths(n)) == n and all(x & (x - 1) == 0 for x in tail_lengths(n))


def check_pieces(pieces, texts):
    """texts: (id, text) rows; every id of every document lies in one piece, offsets are gapless."""
    want = defaultdict(list)
    for (k, _), ids in zip(texts, reference([t for _, t in texts]), strict=True):
        want[k].append(ids)
    spans, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert any(zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 and len(ids) == p.doc_tokens for ids in want[p.doc_id])
        spans[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    for k, docs in want.items():
        assert sorted(i for s, n in spans[k] for i in range(s, s + n)) == sorted(i for ids in docs for i in range(len(ids)))
    for got in sequences.values():
        at = 0
        for offset, n in sorted(got):
            assert offset == at and n > 0
            at += n
        assert at <= 4096 and at & (at - 1) == 0


def test_pack_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_pieces(pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_pack_odd_rows(spark):
    texts = [*enumerate(ODD), (None, "no id"), (3, "a"), (3, "a"), (99, "word " * 9000)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in texts], "doc_id bigint, text string, curve string, sequence_id int")
    check_pieces(pack(df).collect(), texts)
    assert pack(df.limit(0)).count() == 0


def test_neighbours_share_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    by = defaultdict(set)
    for p in pack(docs).collect():
        by[p.sequence_id].add(lang[p.doc_id])
    assert sum(len(v) for v in by.values()) / len(by) < 2


def test_packer_state_is_bounded():
    packer = Packer(8, 0)
    for i in range(100):
        list(packer.add(i, b"\0" * 12))
        assert len(packer.waiting) <= 8
