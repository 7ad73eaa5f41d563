import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm.prefix_trees import PrefixGroups, SubstringDedup, SuffixTree, prefix_groups
from tessera.llm.repeats import SENT_SQL, Block, Bytes, Group, Strings, Words, sliding_min
from tessera.llm.suffix_index import IndexFamily, SuffixDedup, merged, scanned, suffix_array

ODD = [
    None, "", "  \n", "word", "é" * 40, "ab" * 100, "ab" * 90, "x" * 300, "x" * 200, "The quick brown fox jumps over the lazy dog and runs away from the very angry bear today",
    "So: the quick brown fox jumps over the lazy dog and runs away from the very angry bear today, they say", "so  the quick brown\tfox jumps over the lazy\n dog and runs away from the very angry bear today", "w " * 40,
    "w " * 30, "a b c d e f g h i j k l m n", "z a b c d e f g h i j k l m", "L" * 100000, "日本語テキスト" * 20, "本語テキスト日" * 20,
]


def brute_bytes(texts, n=50):
    raw = [(k, (t or "").encode()) for k, t in texts]
    first = {}
    for k, b in raw:
        if k is not None:
            for i in range(len(b) - n + 1):
                s = b[i : i + n]
                first[s] = min(first.get(s, k), k)
    out = []
    for k, b in raw:
        gone = np.zeros(len(b), bool)
        if k is not None:
            for i in range(len(b) - n + 1):
                if first[b[i : i + n]] < k:
                    gone[i : i + n] = True
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((str(k), len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def brute_words(texts, n=13):
    raw = [(k, (t or "").encode().split()) for k, t in texts]
    first = {}
    for k, w in raw:
        if k is not None:
            for i in range(len(w) - n + 1):
                s = tuple(w[i : i + n])
                first[s] = min(first.get(s, k), k)
    out = []
    for k, w in raw:
        gone = np.zeros(len(w), bool)
        if k is not None:
            for i in range(len(w) - n + 1):
                if first[tuple(w[i : i + n])] < k:
                    gone[i : i + n] = True
        out.append((str(k), len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def as_rows(df, *cols):
    return sorted((str(r.doc_id), *[r[c] for c in cols]) for r in df.collect())


BYTE_COLS, WORD_COLS = ("n_bytes", "n_removed", "n_spans", "kept_sha256"), ("n_words", "n_removed", "kept_sha256")


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert as_rows(SuffixDedup(block_bytes=40_000, batches=5).remove(docs), *BYTE_COLS) == brute_bytes(texts)
    assert as_rows(SubstringDedup(block_bytes=40_000, bound=50).remove(docs), *WORD_COLS) == brute_words(texts)


@pytest.mark.parametrize("block", [100, 6_000_000])
def test_odd_rows(spark, block):
    texts = [(100 - i, t) for i, t in enumerate(ODD)] + [(None, ODD[9]), (None, ODD[9]), (91, ODD[9]), (50, ODD[9]), (-3, "ab" * 60)]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in texts], "doc_id bigint, text string, block int, kept string").repartition(3)
    out = SuffixDedup(block_bytes=block).remove(df)
    assert as_rows(out, *BYTE_COLS) == brute_bytes(texts)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in out.collect())
    words = SubstringDedup(block_bytes=block, bound=3).remove(df)
    assert as_rows(words, *WORD_COLS) == brute_words(texts)
    assert all(hashlib.sha256(b" ".join(r.kept.encode().split())).hexdigest() == r.kept_sha256 for r in words.collect())
    plain = {t for _, t in texts}
    assert all(r.kept in plain or r.n_removed or not r.kept for r in words.collect())
    assert SuffixDedup().remove(df.limit(0)).count() == 0 == SubstringDedup().remove(df.limit(0)).count()


def test_levels_are_logarithmic_and_exact(spark):
    """Batches of one group through a family of tables, each answer against brute force."""
    rng, family, seen, length = np.random.default_rng(0), IndexFamily(5, 2), {}, 5
    for k in range(7):
        texts = list({bytes(rng.integers(97, 100, 12).astype(np.uint8)) for _ in range(30)})
        ids = np.sort(rng.integers(100 * k, 100 * k + 100, len(texts)))
        s = Strings(np.arange(len(texts)), np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint16), ids, np.zeros(len(texts), np.int64), texts)
        rows = [(9, k, g, s.packed(np.flatnonzero(np.arange(len(texts)) % 3 == g))) for g in range(3)]
        hidden = {}
        for r in family.add(spark.createDataFrame(rows, SENT_SQL)).collect():
            from tessera.llm.common import unpack

            for number, a, z, v in zip(*[x.tolist() for x in unpack(r.body)], strict=True):
                hidden |= {(number, p): v for p in range(a, z + 1)}
        for i, t in enumerate(texts):
            for p in range(8):
                key = (i % 3, t[p : p + length])
                least = min([seen.get(key, 10**9), *[ids[j] for j, u in enumerate(texts) if j % 3 == i % 3 and key[1] in u]])
                assert hidden.get((i, p), ids[i]) == least
        for i, t in enumerate(texts):
            for p in range(8):
                seen[i % 3, t[p : p + length]] = min(seen.get((i % 3, t[p : p + length]), 10**9), ids[i])
    assert [n for n, _, _ in family.levels] == [4, 2, 1] and family.batches == 7


def test_suffix_arrays_scan_and_merge():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 99, 20).astype(np.uint8)) for _ in range(20)]
    a, rank = suffix_array(texts[:10], np.arange(10), 9)
    keys = a.keys().tolist()
    assert keys == sorted(set(keys)) and [keys[r] for r in rank] == [t[p : p + 9] for t in texts[:10] for p in range(12)]
    b, _ = suffix_array(texts[10:], np.arange(10, 20), 9)
    first, alone = scanned(b, [a])
    assert all((k in keys) != bool(x) for k, x in zip(b.keys().tolist(), alone, strict=True))
    assert all(f == min(i for i, t in enumerate(texts) if k in t) for k, f in zip(b.keys().tolist(), first, strict=True))
    both = merged([a, b.some(alone)])
    assert both.keys().tolist() == sorted({t[p : p + 9] for t in texts for p in range(12)})
    assert all(f == min(i for i, t in enumerate(texts) if k in t) for k, f in zip(both.keys().tolist(), both.ids(), strict=True))
    again = type(both).unpacked(9, both.packed())
    assert again.keys().tolist() == both.keys().tolist() and again.ids().tolist() == both.ids().tolist()


def test_hot_strings_and_contexts(spark):
    """A passage that a third of the rows hold, and one context with many different surroundings."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 6)))
    passage, context = " ".join(word() for _ in range(30)), " ".join(word() for _ in range(8))
    texts = [(k, " ".join(word() for _ in range(20)) + " " + (passage if k % 3 == 0 else context if k % 3 == 1 else "") + " " + " ".join(word() for _ in range(20))) for k in range(300)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5, "doc_id")
    assert as_rows(SuffixDedup(block_bytes=3000).remove(df), *BYTE_COLS) == brute_bytes(texts)
    assert as_rows(SubstringDedup(block_bytes=3000, bound=20).remove(df), *WORD_COLS) == brute_words(texts)


def test_heavy_prefixes_are_lengthened(spark):
    from tessera.llm.common import pack

    texts = [f"the same {w} start {k}".encode() for k in range(40) for w in ("old", "new")] + [f"rare{k} words come here once".encode() for k in range(9)]
    n = len(texts)
    body = pack(np.zeros(n, np.uint64), np.zeros(n, np.uint16), np.arange(n), np.zeros(n, np.int64), np.array([len(t) for t in texts], np.uint32), np.frombuffer(b"".join(texts), np.uint8))
    g = PrefixGroups(10, 4).counted(spark.createDataFrame([(1, 0, 0, body)], SENT_SQL), 2, 100)
    assert [len(h) for h in g.heavy] == [1, 1, 2, 2]
    s = Strings(np.arange(n), np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), texts)
    by = g.light(s)[0]
    assert len(set(by[:80:2].tolist())) == 1 and by[0] != by[1] and len(set(by[80:].tolist())) == 9


def test_columns_are_carried_as_they_are(spark):
    import datetime
    import decimal

    row = (1, "a b", datetime.datetime(2020, 1, 2, 3, 4, 5, 123456), decimal.Decimal("1.10"), b"\x00\xff", None, {"k": 1}, [None, 2.5])
    df = spark.createDataFrame([row, (None, None, None, None, None, 5, None, None)], "doc_id bigint, text string, ts timestamp, d decimal(9,2), kept binary, c0 int, m map<string,int>, a array<double>")
    out = SubstringDedup().remove(df, carry=df.columns[2:])
    assert {tuple(map(str, r)) for r in out.select("doc_id", *[f"c{i}" for i in range(6)]).collect()} == {tuple(map(str, (r[0], *r[2:]))) for r in df.collect()}
    assert [f.dataType for f in out.schema[5:]] == [f.dataType for f in df.schema[2:]]


def test_prefix_groups_and_deep_nodes():
    rng = np.random.default_rng(0)
    s = rng.integers(1, 3, (500, 6)).astype(np.uint32)
    groups = list(prefix_groups(s, 20))
    assert sorted(np.concatenate(groups).tolist()) == list(range(500))
    assert len({tuple(x) for x in s}) == sum(len({tuple(s[i]) for i in g}) for g in groups)
    tree = SuffixTree(s)
    nodes = {tuple(s[tree.order[a]]): b - a for a, b in tree.deep_nodes(6)}
    rows, n = np.unique(s, axis=0, return_counts=True)
    assert nodes == {tuple(r): c for r, c in zip(rows, n, strict=True) if c > 1}
    least = tree.least(np.arange(500), 6)
    assert all(least[i] == min(j for j in range(500) if (s[j] == s[i]).all()) for i in range(0, 500, 7))


@pytest.mark.parametrize("kind", [Bytes(10), Bytes(20), Words(4, 2), Words(9, 2)])
def test_runs_cover_each_window_once_and_equal_windows_share_a_flank(kind):
    passage = "a bb c dd e f g aa b cc d ee f gg h ii jj k l"
    texts = [kind.prepared(t) for t in [passage, "", "one two", "x x x x x x x x x x x x", "zz " + passage + " yy", passage]]
    b = Block(kind, texts)
    runs = b.runs(np.ones(len(texts), bool))
    n = [max(0, int(e - s) - kind.window + 1) for s, e in zip(b.first_symbol, b.last_symbol, strict=True)]
    assert runs.size.sum() == sum(n)
    key = {}
    for at, size, k, _ in zip(*runs, strict=True):
        for p in range(at, at + size):
            first, stop = b.byte_span(np.array([p]), np.array([p + kind.window]))
            key.setdefault(b.raw[first[0] : stop[0]], set()).add(int(k))
    assert all(len(k) == 1 for k in key.values())
    strings, of = b.strings(runs)
    doc = b.doc_of(runs.at)
    assert (of[doc == 0] == of[doc == 5]).all()
    assert len(b.runs(np.array([False] * 5 + [True])).at) == (doc == 5).sum()


def test_sliding_min():
    h = np.random.default_rng(0).integers(0, 99, 40)
    for w in (1, 2, 3, 7, 8, 40):
        assert sliding_min(h, w).tolist() == [h[i : i + w].min() for i in range(41 - w)]
