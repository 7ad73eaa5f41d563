import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm.byte_bpe import ByteBpe, Words, decode, from_planes, plain, planes, splitter

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    None, "", " ", "  a", "a  b", "a \n b", "a\nb c\n\nd", "it's we'll 've", " lead", "trail ", "tab\tb", "x  y", " ", "日本 語123", "<|endoftext|>", "é é", "\x1c a\x1d b", "a b c", "🙂 👩‍👩‍👧!!", "n" * 5000, "1234 5678a",
]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.text(alphabet=st.sampled_from("ab1'sé.!\n\t \x1c  ")))
def test_fast_split_equals_pattern(text):
    words = Words()
    got = words.of_text(text)
    names = list(words)
    assert [names[i] for i in got] == splitter().findall(text)


def test_numbers_beyond_three_bytes():
    for codes in ([], [5, 1 << 16, (1 << 24) - 1], [1 << 24, 3, (1 << 32) - 1]):
        got = planes(np.array(codes, np.uint32))
        assert len(got) == (4 if max(codes, default=0) >= 1 << 24 else 3) and from_planes(*got).tolist() == codes


def test_plain():
    assert plain("a b\nc") and not plain("a  b") and not plain(" a") and not plain("a\n b")


def check(rows, texts, library):
    want = sorted((k is None, k or 0, *digest(t, library)) for k, t in texts)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want


def digest(text, library):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(ByteBpe().encode(docs, block_chars=20_000).collect(), [(r.doc_id, r.text) for r in docs.collect()], library)


def test_odd_rows(spark, library):
    texts = [*enumerate(ODD), (None, "no id"), (3, "a  b"), (3, "a  b"), (99, "word again " * 20000)]
    df = spark.createDataFrame([(k, t, 1, b"x") for k, t in texts], "doc_id bigint, text string, block int, body binary")
    out = ByteBpe().encode(df)
    check(out.collect(), texts, library)
    back = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.decoded)) for r in decode(out).collect())
    assert back == sorted((k is None, k or 0, (t or "").encode()) for k, t in texts)
    assert ByteBpe().encode(df.limit(0)).count() == 0
