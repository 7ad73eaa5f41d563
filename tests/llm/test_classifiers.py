import zlib

import numpy as np
import pytest
import zstandard

from tessera.llm import zstd_toxicity
from tessera.llm.labelled import training_sample
from tessera.llm.nb_svm import Lazy, NaiveBayesSvm, dual_coordinate_descent, features, fit, log_count_ratios, packed, unpacked
from tessera.llm.zstd_toxicity import CompressionToxicity, Model, spread, trained, windows

SF = "/root/testdata/sf0.01"


def held_out(k, modulus, value):
    return zlib.crc32(str(k).encode()) % modulus == value


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_held_out_accuracy(tables):
    docs, labels = tables
    score = {r.doc_id: r.score for r in NaiveBayesSvm().fit(docs, labels).scores(docs).collect()}
    rows = [r for r in labels.collect() if held_out(r.doc_id, 3, 1) and r.doc_id in score]
    assert len(score) == docs.count() and all(0 <= s <= 1 for s in score.values())
    assert np.mean([(score[r.doc_id] >= 0.5) == r.quality for r in rows]) > 0.95


def test_toxicity_held_out_order(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.cache()
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    score = {r.doc_id: r.score for r in CompressionToxicity().fit(docs, labels).scores(docs).collect()}
    rows = [r for r in labels.collect() if held_out(r.doc_id, 4, 2) and r.doc_id in score]
    bad, good = ([score[r.doc_id] for r in rows if r.toxic == t] for t in (1, 0))
    assert np.mean([b > g for b in bad for g in good]) > 0.85
    assert np.mean([b >= 0.3 for b in bad]) > 0.75 and np.mean([g >= 0.3 for g in good]) < 0.03


def test_held_out_labels_are_not_read(spark):
    docs = spark.createDataFrame([(k, "some text here") for k in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)] + [(5, 1, 1), (None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")
    got = training_sample(docs, labels, "quality", 3, 1, {0: 20, 1: 20}).collect()
    assert len(got) <= 40 and not any(held_out(r.doc_id, 3, 1) for r in got) and len({r.doc_id for r in got}) == len(got)


def test_sample_is_chosen_among_the_documents_at_hand(spark):
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(3000)], "doc_id bigint, quality int")
    docs = spark.createDataFrame([(k, None if k % 7 == 0 else "some text") for k in range(2000, 3000)], "doc_id bigint, text string")
    there = [k for k in range(2000, 3000) if k % 7 and not held_out(k, 3, 1)]
    got = training_sample(docs, labels, "quality", 3, 1, {0: 100, 1: 100}).collect()
    assert sum(r.label == 0 for r in got) == 100 and sum(r.label == 1 for r in got) == min(100, sum(k % 10 == 0 for k in there))


def test_prior_is_of_the_documents_at_hand(spark, monkeypatch):
    seen = []
    monkeypatch.setattr("tessera.llm.nb_svm.fit", lambda xs, ys, prior: seen.append(prior) or (None, None))
    labels = spark.createDataFrame([(k, int(k < 100)) for k in range(1000)], "doc_id bigint, quality int")
    docs = spark.createDataFrame([(k, "some text") for k in range(200)], "doc_id bigint, text string")
    NaiveBayesSvm().fit(docs, labels)
    there = [k for k in range(200) if not held_out(k, 3, 1)]
    assert seen == [pytest.approx(np.mean([k < 100 for k in there]))]


@pytest.mark.parametrize("make", [NaiveBayesSvm, CompressionToxicity])
def test_odd_rows(spark, make):
    data = [(1, None), (2, ""), (2, ""), (None, "x"), (3, "word " * 100000), (4, "é!!")]
    docs = spark.createDataFrame([(k, t, 1.0, "l") for k, t in data], "doc_id bigint, text string, score double, label string")
    for rows in ([(3, 1, 1), (4, 0, 0)], [(3, 1, 1)], []):
        labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
        op = make().fit(docs, labels)
        got = op.scores(docs).collect()
        assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
        assert op.scores(docs.limit(0)).count() == 0


def test_features_see_layout():
    assert len(features(None)) == 0 and len(features("ab")) > 0
    assert len(np.intersect1d(features("Good words of prose."), features("Good words of prose."))) == len(features("Good words of prose."))
    assert set(features("aa aa aa aa")) - set(features("aa bb aa bb"))


def test_svm_separates_and_stays_within_the_box():
    rng = np.random.default_rng(0)
    xs = [np.unique(rng.integers(0, 50, 20) + (60 if k % 2 else 0)) for k in range(60)]
    ys = np.array([k % 2 for k in range(60)])
    r = log_count_ratios(xs, ys)
    assert r[70] > 0 > r[10]
    w, b = dual_coordinate_descent(xs, [np.ones(len(x)) for x in xs], ys)
    assert all((w[x].sum() + b > 0) == y for x, y in zip(xs, ys, strict=True))
    model, length = fit(xs, ys, 0.5)
    assert model.margin(xs[1], length) > model.margin(xs[0], length)


def test_descent_reaches_the_dual_optimum():
    """No duality gap, and the value of a plain projected gradient ascent on the same dual."""
    rng = np.random.default_rng(2)
    xs = [np.unique(rng.integers(0, 40, 12)) for _ in range(50)]
    values, ys, cost = [rng.standard_normal(len(x)) for x in xs], rng.integers(0, 2, 50), 0.7
    w, b = dual_coordinate_descent(xs, Lazy(50, lambda i: values[i]), ys, cost, passes=3000)
    dense = np.zeros((50, 41))
    for i, (x, v) in enumerate(zip(xs, values, strict=True)):
        dense[i, x], dense[i, 40] = v, 1.0
    sign, upper = np.where(ys == 1, 1.0, -1.0), cost / (2 * np.array([np.mean(ys == y) for y in ys]))
    full = np.append(w[:40], b)
    primal = full @ full / 2 + upper @ np.maximum(0, 1 - sign * (dense @ full))
    q, alpha = (dense * sign[:, None]) @ (dense * sign[:, None]).T, np.zeros(50)
    for _ in range(200_000):
        alpha = np.clip(alpha + (1 - q @ alpha) / 60, 0, upper)
    assert primal == pytest.approx(alpha.sum() - alpha @ q @ alpha / 2, rel=1e-3)


def test_scores_against_a_plain_model(spark):
    """Held-out scores of a small table, recomputed with sets and dictionaries from the fitted weights."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    op = NaiveBayesSvm().fit(docs, labels)
    m, got = op.model, {r.doc_id: r.score for r in op.scores(docs).collect()}
    for r in docs.limit(60).collect():
        x = set(features(r.text).tolist())
        norm = sum(float(op.length[i]) for i in x) ** 0.5
        z = m.slope * (sum(float(m.weights[i]) for i in x) / norm + m.bias if norm else m.bias) + m.offset
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_packed_features_are_bounded():
    for n in (0, 5, 8191, 8192, 100_000):
        x = np.sort(np.random.default_rng(n).permutation(1 << 18)[:n])
        assert unpacked(packed(x)).tolist() == x.tolist() and len(packed(x)) <= 1 << 15


def test_windows_keep_every_word():
    text = "One two  three\nfour " * 9
    assert b" ".join(windows(text, 12)).split() == text.lower().encode().split() and windows(None, 12) == []


def test_known_text_gains():
    rng = np.random.default_rng(0)
    plain = [bytes(rng.integers(97, 122, 40).astype(np.uint8)) for _ in range(2000)]
    model = Model((trained(plain, 4096), trained(plain[::2], 2048)), b" dreadful insult " * 3)
    assert model.gains("a dreadful insult")[0] >= 4 and model.gains("ordinary calm words").max() <= 2
    assert len(model.gains("")) == 0 and model.score(None) == pytest.approx(0.5)


def test_rare_insults_are_learned_from_large_samples(monkeypatch):
    seen = []
    monkeypatch.setattr(zstd_toxicity, "trained", lambda samples, size: seen.append(samples) or b"")
    texts = [f"calm words {k}" + (" zurgle" if k % 2 and k < 40 else "") for k in range(4500)]
    zstd_toxicity.fit(texts, np.arange(4500) % 2, 0.5)
    assert len(seen) == zstd_toxicity.VIEWS + 1 and b" zurgle " in seen[-1] and b" calm " not in seen[-1]


def test_whole_texts_calibrate(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(zstd_toxicity, "calibrate", lambda model, z, ys, prior: seen.append(z))
    docs = spark.createDataFrame([(k, " ".join(f"calm{(k * 7 + i) % 997} words" for i in range(300)) + (" zurgle" * 9 if k % 2 else "")) for k in range(300)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id bigint, toxic int")
    op = CompressionToxicity(sample_chars=2000, most_windows=5000).fit(docs, labels)
    whole = sorted(tuple(op.model.measures(r.text)) for r in docs.collect())
    assert len(seen[0]) > 10 and all(tuple(z) in whole for z in seen[0])


def test_scores_against_plain_compression(spark):
    """The scores of a fitted model, recomputed window by window with compressors made anew."""
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 8)))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words, 60)) + (" zurgle blagfarp" * 2 if k % 2 else "") for k in range(400)] + [None, "", "zurgle " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)] + [(9999, 1), (7, 0)], "doc_id bigint, toxic int")
    op = CompressionToxicity().fit(docs, labels)
    m, got = op.model, {r.doc_id: r.score for r in op.scores(docs).collect()}
    assert len(m.ordinary) == zstd_toxicity.VIEWS and m.toxic

    def size(dictionary, window):
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=m.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))

    for k in [*range(0, 400, 29), 400, 401, 402]:
        gains, now = [], []
        for w in (texts[k] or "").lower().split():
            now.append(w)
            if sum(len(x) + 1 for x in now) >= m.size:
                gains, now = [*gains, now], []
        gains = [min(size(o, (" " + " ".join(g)).encode()) - size(o + m.toxic, (" " + " ".join(g)).encode()) for o in m.ordinary) for g in [*gains, *([now] if now else [])]]
        z = m.weights[-1] + sum(w * (sum(g >= t for g in gains) / (len(gains) + 5)) ** 0.5 for w, t in zip(m.weights, zstd_toxicity.THRESHOLDS, strict=False))
        z += m.weights[-2] * min(max(max(gains, default=0), 0), 12) / 12
        assert got[k] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
    assert np.mean([got[k] for k in range(1, 400, 2)]) > 0.7 > 0.3 > np.mean([got[k] for k in range(0, 400, 2)])


def test_spread_reaches_the_end():
    text = "".join(chr(97 + i % 26) for i in range(100_000))
    got = spread(text, 4000)
    assert spread("short", 4000) == "short" and len(got) < 4100 and got.endswith(text[-50:]) and got.startswith(text[:50])
