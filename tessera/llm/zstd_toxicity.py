"""Toxicity by compression distance.

Zstandard dictionaries are trained on windows of ordinary documents, `VIEWS` of them on windows of their own, and one on
toxic documents. A toxic document is mostly ordinary text, and a dictionary of all its windows tells little (README), so
the toxic one is trained on the words that toxic training documents use far more often than ordinary ones, each as a
window of its own and as often as it occurs. Every window of a text is compressed with each ordinary dictionary and with
the same one extended by the toxic one; the smallest difference of the lengths is the window's gain, so what one ordinary
dictionary lacks by chance doesn't count. The share of windows whose gain reaches each of a few thresholds, and the largest
gain, enter a logistic curve whose weights are calibrated on whole documents that no dictionary has seen.

At most `per_class` labelled documents a class are used (twice as many ordinary ones), and of a text of more than
`sample_chars` characters pieces spread over all of it, both documented bounds of the fit alone; every document is scored
on its whole text, however long. Null and empty texts have no windows and no gain. Null ids are scored and count as an
empty text for the held-out rows. Repeated rows score alike, and so do equal texts; labelled documents of equal hash are
taken by id. Labels of no document and ids that are labelled both ways are not learned from. Where a class has too few
labelled windows to train a dictionary, every score is the share of label 1. Empty tables give an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Writer, only, rows, table
from tessera.llm.labelled import labelled, remainder, training_sample
from tessera.llm.nb_svm import logistic

EDGE = b".,!?;:|#*%&$\"'()"
THRESHOLDS = (1, 2, 3, 4, 5, 6, 8)
VIEWS = 3


def windows(text: str | None, size: int) -> list[bytes]:
    """Runs of whole words of at least `size` bytes, one after the other, in lower case; the last may be shorter."""
    out: list[bytes] = []
    now: list[bytes] = []
    n = 0
    for w in (text or "").lower().encode("utf-8", "surrogatepass").split():
        now.append(w)
        n += len(w) + 1
        if n >= size:
            out.append(b" " + b" ".join(now))
            now, n = [], 0
    if now:
        out.append(b" " + b" ".join(now))
    return out


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary trained on samples, without its header and tables; empty if there are too few."""
    try:
        whole = zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""
    return whole[min(len(whole) // 4, 300) :]


@lru_cache(maxsize=4 * VIEWS)
def compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


@dataclass
class Model:
    ordinary: tuple[bytes, ...] = ()
    toxic: bytes = b""
    size: int = 30
    level: int = 3
    weights: list[float] = field(default_factory=lambda: [0.0] * (len(THRESHOLDS) + 2))

    def gains(self, text: str | None) -> np.ndarray:
        """What the toxic dictionary saves of each window, by the ordinary one beside which it saves least, or 0 where
        that is nothing: once a window saves nothing, the other ordinary dictionaries aren't asked."""
        if not self.toxic:
            return np.zeros(0)
        found = windows(text, self.size)
        out, left = np.zeros(len(found), np.int64), [(i, w, 1 << 30) for i, w in enumerate(found)]
        for o in self.ordinary:
            plain, both = compressor(o, self.level).compress, compressor(o + self.toxic, self.level).compress
            left = [(i, w, min(g, len(plain(w)) - len(both(w)))) for i, w, g in left]
            left = [x for x in left if x[2] > 0]
        for i, _, g in left:
            out[i] = g
        return out

    def measures(self, text: str | None) -> np.ndarray:
        g = self.gains(text)
        if not len(g):
            return np.array([0.0] * (len(THRESHOLDS) + 1) + [1.0])
        return np.array([*[np.sqrt((g >= k).sum() / (len(g) + 5)) for k in THRESHOLDS], min(max(g.max(), 0), 12) / 12, 1.0])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.measures(text) @ np.array(self.weights), -30, 30))))


def spread(text: str, limit: int, piece: int = 400) -> str:
    """The text, or pieces at even distances over all of it, of about `limit` characters together."""
    if len(text) <= limit:
        return text
    n = max(1, limit // piece)
    return " ".join(text[i * (len(text) - piece) // max(1, n - 1) :][:piece] for i in range(n))


def telling_words(toxic: list[str], ordinary: list[str], ratio: float = 20.0, least: int = 4, significant: float = 10.83) -> set[bytes]:
    """Words that toxic texts hold `ratio` times as often as ordinary ones, counted once a text, in at least `least` of
    them, where the log-likelihood ratio of the two counts is `significant` (one in a thousand by chance)."""
    def count(texts: list[str]) -> Counter:
        out: Counter = Counter()
        for t in texts:
            out.update({w.strip(EDGE) for w in t.lower().encode("utf-8", "surrogatepass").split()})
        return out

    a, b = count(toxic), count(ordinary)
    n, m = max(1, len(toxic)), max(1, len(ordinary))

    def evidence(c: int, d: int) -> float:
        return 2 * (c * np.log(c * (n + m) / ((c + d) * n)) + (d * np.log(d * (n + m) / ((c + d) * m)) if d else 0.0))

    return {w for w, c in a.items() if len(w) >= 3 and c >= least and c / n > ratio * (b[w] + 0.5) / m and evidence(c, b[w]) >= significant}


def fit(texts: list[str], ys: np.ndarray, prior: float, size: int = 30, ordinary_bytes: int = 32768, toxic_bytes: int = 3072, most_windows: int = 100_000) -> tuple[Model, np.ndarray]:
    """Two thirds of the texts train the dictionaries; the model, yet without weights, and the places of the rest, which
    calibrate(). The ordinary dictionaries are trained on `most_windows` windows at most together, taken at random."""
    model = Model(size=size)
    p = min(max(prior, 1e-3), 1 - 1e-3)
    model.weights[-1] = float(np.log(p / (1 - p)))
    inner = np.arange(len(texts)) % 3 != 2
    toxic = list(dict.fromkeys(texts[i] for i in np.flatnonzero(inner & (ys == 1))))
    ordinary = list(dict.fromkeys(texts[i] for i in np.flatnonzero(inner & (ys == 0))))
    telling = telling_words(toxic, ordinary)
    marked = [b" " + w + b" " for t in toxic for w in t.lower().encode("utf-8", "surrogatepass").split() if w.strip(EDGE) in telling]
    common = list(dict.fromkeys(w for t in ordinary for w in windows(t, size)))
    rng = np.random.default_rng(5)
    common = [common[i] for i in rng.permutation(len(common))[:most_windows]]
    model.ordinary, model.toxic = tuple(trained(common[i::VIEWS], ordinary_bytes) for i in range(VIEWS)), trained(marked, toxic_bytes)
    out = np.flatnonzero(~inner)
    if not model.toxic or len(set(ys[out].tolist())) < 2:
        model.toxic = b""
        return model, out[:0]
    return model, out


def calibrate(model: Model, z: np.ndarray, ys: np.ndarray, prior: float) -> None:
    """Weights for the measures z of whole texts."""
    p = min(max(prior, 1e-3), 1 - 1e-3)
    share = ys.mean()
    weigh = np.where(ys == 1, p / share, (1 - p) / (1 - share))
    model.weights = logistic(z, ys, weigh, 0.05).tolist()


class CompressionToxicity:
    """per_class bounds the labelled documents of each class; sample_chars what is read of one to
    train the dictionaries, most_windows the windows of the ordinary ones. Whole texts calibrate."""

    def __init__(self, label: str = "toxic", modulus: int = 4, held_out: int = 2, per_class: int = 2400, sample_chars: int = 20_000, most_windows: int = 100_000) -> None:
        self.label, self.modulus, self.held_out, self.per_class, self.sample_chars = label, modulus, held_out, per_class, sample_chars
        self.most_windows = most_windows
        self.model = Model()

    def fit(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> CompressionToxicity:
        known = labelled(docs, labels, self.label, self.modulus, self.held_out, id_col, text_col)
        sample = training_sample(docs, labels, self.label, self.modulus, self.held_out, {0: 2 * self.per_class, 1: self.per_class}, id_col, text_col, known)
        limit = self.sample_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([spread(t, limit) for t in b.column(2).to_pylist()], pa.string())], names=["doc_id", "label", "text"])

        got = sorted(sample.mapInArrow(run, "doc_id bigint, label int, text string").collect(), key=lambda r: ((r.doc_id * 2654435761) % 4294967291, r.doc_id))
        share = known.agg(F.avg(F.col("label").cast("double"))).first()[0]
        prior = share if share is not None else 0.5
        model, out = fit([r.text for r in got], np.array([r.label for r in got]), prior, most_windows=self.most_windows)
        if len(out):
            rest = {got[i].doc_id for i in out}

            def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    kept = [(k, y, model.measures(t).tolist()) for k, y, t in zip(*[c.to_pylist() for c in b.columns], strict=True) if k in rest]
                    ids, ys, z = zip(*kept, strict=True) if kept else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(z, pa.list_(pa.float64()))], names=["doc_id", "label", "z"])

            measured = sorted(sample.mapInArrow(measure, "doc_id bigint, label int, z array<double>").collect(), key=lambda r: r.doc_id)
            calibrate(model, np.array([r.z for r in measured]), np.array([r.label for r in measured]), prior)
        self.model = model
        return self

    def scores(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        model = self.model
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = Writer(schema, 10_000)
            for doc_id, text in rows(batches, "doc_id", "text"):
                if out.add(doc_id, model.score(text)):
                    yield out.take()
            yield out.take()

        return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id bigint, score double")


def op3_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = CompressionToxicity().fit(docs, table(spark, sf_dir, "labels")).scores(docs)
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
