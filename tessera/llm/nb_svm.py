"""Naive Bayes support vectors: a quality classifier.

A document's features are indicators of hashed n-grams: byte four-grams of the text, and three-grams of word shapes (first
and last character class, whether the word repeats the one before, a length class), which tell layout from language. Each
indicator is scaled by its log-count ratio between the classes, rows are brought to unit length, and a linear hinge-loss
model is fitted to them by dual coordinate descent (Hsieh et al. 2008). A logistic curve over the margins of documents
that were kept out of the fit turns margins into probabilities.

The model is fitted on at most `per_class` labelled documents a class, of which the driver holds 32 KB each at most: their
indicators as a list or, where there are many, as bits. Every document is scored on its whole text, however long. Null
and empty texts have no features and score by the bias alone. Null ids are scored and count as an empty text for the held
out rows. Repeated rows and equal texts score alike; labelled documents of equal hash are taken by id. Labels of no
document and ids that are labelled both ways are not learned from. Where a class has no labelled rows, every score is the
share of the other class. Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Writer, only, rows, table, word_bounds
from tessera.llm.labelled import labelled, remainder, training_sample

BITS = 18
#: Character classes of bytes: other, lower, upper, digit, stop, bracket or quote, sign, part of a longer character.
CLASS = np.zeros(256, np.uint32)
for _k, _s in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"()[]{}'\"", b"!?*#%&$|<>@^~+=/\\_-", bytes(range(128, 256))), 1):
    CLASS[list(_s)] = _k


def mixed(x: np.ndarray) -> np.ndarray:
    return ((x * np.uint32(2654435761)) ^ (x >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(32 - BITS)


def features(text: str | None) -> np.ndarray:
    """The distinct hashed n-grams of a text, sorted."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found = []
    if len(raw) >= 4:
        found.append(mixed(np.ndarray(len(raw) - 3, "<u4", raw, strides=(1,))))
    buf = np.frombuffer(raw, np.uint8)
    start, end = word_bounds(buf)
    if len(start):
        size = (end - start).astype(np.uint32)
        sums = np.concatenate([[0], np.cumsum(buf.astype(np.uint32) * (CLASS[buf] + np.uint32(257)), dtype=np.uint32)]).astype(np.uint32)
        word = (sums[end] - sums[start]) * np.uint32(31) + size + buf[start].astype(np.uint32) * np.uint32(65537)
        again = np.concatenate([[False], word[1:] == word[:-1]]).astype(np.uint32)
        shape = (CLASS[buf[start]] << np.uint32(7)) | (CLASS[buf[np.minimum(start + 1, end - 1)]] << np.uint32(10)) | (CLASS[buf[end - 1]] << np.uint32(4)) | (again << np.uint32(3)) | np.minimum(size >> np.uint32(2), np.uint32(7))
        padded = np.concatenate([np.full(2, 8191, np.uint32), shape])
        found.append(mixed(padded[:-2] * np.uint32(40503) + padded[1:-1] * np.uint32(30011) * np.uint32(257) + padded[2:] * np.uint32(1000003) + np.uint32(77)))
    if not found:
        return np.zeros(0, np.int64)
    seen = np.zeros(1 << BITS, bool)
    for f in found:
        seen[f] = True
    return np.flatnonzero(seen)


def packed(x: np.ndarray) -> bytes:
    """Sorted features as 32-bit numbers, or as bits where those take less room."""
    if 4 * len(x) < 1 << (BITS - 3):
        return x.astype("<u4").tobytes()
    bits = np.zeros(1 << BITS, bool)
    bits[x] = True
    return np.packbits(bits).tobytes()


def unpacked(body: bytes) -> np.ndarray:
    if len(body) < 1 << (BITS - 3):
        return np.frombuffer(body, "<u4").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8)))


class Lazy(Sequence):
    """Items that are made when they are read."""

    def __init__(self, n: int, make: Callable[[int], np.ndarray]) -> None:
        self.n, self.make = n, make

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> np.ndarray:
        if not -self.n <= i < self.n:
            raise IndexError(i)
        return self.make(int(i))


def log_count_ratios(xs: Sequence[np.ndarray], ys: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Of each indicator, between label 1 and label 0, each side's counts scaled to sum to one."""
    counts = np.full((2, 1 << BITS), alpha)
    for x, y in zip(xs, ys, strict=True):
        counts[int(y), x] += 1
    p = counts / counts.sum(axis=1, keepdims=True)
    return np.log(p[1] / p[0])


def dual_coordinate_descent(xs: Sequence[np.ndarray], values: Sequence[np.ndarray], ys: np.ndarray, cost: float = 1.0, passes: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss support vector machine with rows of sparse values; the classes weigh alike."""
    w, bias, sign = np.zeros(1 << BITS), 0.0, np.where(ys == 1, 1.0, -1.0)
    share = np.array([max(1, (ys == k).sum()) for k in (0, 1)]) / max(1, len(ys))
    upper = cost / (2 * share[ys.astype(int)])
    norm = np.array([v @ v + 1.0 for v in values])
    alpha, order = np.zeros(len(xs)), np.random.default_rng(seed)
    for _ in range(passes):
        most = 0.0
        for i in order.permutation(len(xs)):
            x, v = xs[i], values[i]
            g = sign[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), upper[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[x] += step * v
                bias += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-4:
            break
    return w, bias


def logistic(z: np.ndarray, ys: np.ndarray, weights: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression on the columns of z (the caller adds a constant), by Newton's steps."""
    b = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (weights * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(z.shape[1])
        step = np.linalg.solve(h, z.T @ (weights * (ys - p)) - ridge * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return b


@dataclass
class Model:
    """score() gives the probability of label 1."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, x: np.ndarray, length: np.ndarray) -> float:
        n = np.sqrt(length[x].sum()) if len(x) else 0.0
        return float(self.weights[x].sum() / n + self.bias) if n else self.bias

    def score(self, text: str | None, length: np.ndarray) -> float:
        z = self.slope * self.margin(features(text), length) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(xs: Sequence[np.ndarray], ys: np.ndarray, prior: float, cost: float = 1.0) -> tuple[Model, np.ndarray]:
    """The model and the squared scale of each indicator, by which rows are brought to unit length."""
    if len(set(ys.tolist())) < 2:
        p = min(max(float(ys.mean()) if len(ys) else 0.5, 1e-3), 1 - 1e-3)
        return Model(np.zeros(1 << BITS), 0.0, 0.0, float(np.log(p / (1 - p)))), np.ones(1 << BITS, np.float32)
    kept_out = np.arange(len(xs)) % 5 == 4
    inner = [i for i in range(len(xs)) if not kept_out[i]]
    own = Lazy(len(inner), lambda i: xs[inner[i]])
    ratio = log_count_ratios(own, ys[inner])
    length = (ratio**2).astype(np.float32)
    scale = [max(np.sqrt(length[x].sum()), 1e-9) for x in own]
    w, bias = dual_coordinate_descent(own, Lazy(len(inner), lambda i: ratio[own[i]] / scale[i]), ys[inner], cost)
    model = Model(w * ratio, bias, 1.0, 0.0)
    out = np.flatnonzero(kept_out)
    if len(set(ys[out].tolist())) == 2:
        m = np.array([model.margin(xs[i], length) for i in out])
        share = ys[out].mean()
        weigh = np.where(ys[out] == 1, prior / share, (1 - prior) / (1 - share))
        model.slope, model.offset = logistic(np.stack([m, np.ones(len(m))], 1), ys[out], weigh, 1e-2)
    return model, length


class NaiveBayesSvm:
    """per_class bounds the labelled documents of each class that are fitted on."""

    def __init__(self, label: str = "quality", modulus: int = 3, held_out: int = 1, per_class: int = 2500) -> None:
        self.label, self.modulus, self.held_out, self.per_class = label, modulus, held_out, per_class
        self.model: Model | None = None
        self.length: np.ndarray | None = None

    def fit(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> NaiveBayesSvm:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [packed(features(t)) for t in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], names=["doc_id", "label", "x"])

        known = labelled(docs, labels, self.label, self.modulus, self.held_out, id_col, text_col)
        sample = training_sample(docs, labels, self.label, self.modulus, self.held_out, {0: self.per_class, 1: self.per_class}, id_col, text_col, known)
        got = sorted(sample.mapInArrow(run, "doc_id bigint, label int, x binary").collect(), key=lambda r: (hash((r.doc_id * 2654435761) % 4294967291), r.doc_id))
        share = known.agg(F.avg(F.col("label").cast("double"))).first()[0]
        ys = np.array([r.label for r in got])
        self.model, self.length = fit(Lazy(len(got), lambda i: unpacked(got[i].x)), ys, min(max(share or 0.5, 0.01), 0.99))
        return self

    def scores(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        model, length = self.model, self.length
        small = Model(model.weights.astype(np.float32), model.bias, model.slope, model.offset)
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = Writer(schema, 10_000)
            for doc_id, text in rows(batches, "doc_id", "text"):
                if out.add(doc_id, small.score(text, length)):
                    yield out.take()
            yield out.take()

        return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id bigint, score double")

    def filter(self, docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
        """The documents that score at least the threshold, all their columns."""
        model, length = self.model, self.length
        small = Model(model.weights.astype(np.float32), model.bias, model.slope, model.offset)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                yield b.filter(pa.array([small.score(t, length) >= threshold for t in texts], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)


def op4_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    classifier = NaiveBayesSvm().fit(docs, table(spark, sf_dir, "labels"))
    out = classifier.scores(docs)
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
