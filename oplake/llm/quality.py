"""Quality classifier: naive Bayes support vectors.

N-gram indicators are scaled by the log ratio of their class counts; a linear hinge-loss
model over the scaled indicators is fitted by dual coordinate descent and turned into a
probability by a logistic curve fitted on rows left out of the descent.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oplake.llm.common import Words, crc_bucket, mix64, release, word_chunks

#: Indicators are hashed into so many slots.
SLOTS = 1 << 18
#: At most so many labelled rows of each class are used to fit.
SAMPLE_PER_CLASS = 6000

_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1
_PUNCT = np.zeros(256, dtype=np.int64)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
#: An n-gram of shapes is indicated again at each of these shares of the text's words.
SHARES = np.array([0.0, 0.02, 0.1, 0.3])
_U = np.uint64


def _runs(table: np.ndarray, b: np.ndarray, words: Words) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(table[b])])
    return total[words.end] - total[words.start]


def shapes(words: Words) -> np.ndarray:
    """A hash of each word's shape: case, digits, punctuation, last byte's class, length class
    and whether it repeats the word before it."""
    b = words.bytes
    size = words.end - words.start
    upper, digit, punct = (_runs(t, b, words) for t in (_UPPER, _DIGIT, _PUNCT))
    first = _UPPER[b[words.start]] if len(size) else size
    case = np.where(upper == 0, 0, np.where((upper == 1) & (first == 1), 1, np.where(upper + punct + digit >= size, 2, 3)))
    last = b[words.end - 1] if len(size) else np.zeros(0, np.uint8)
    tail = np.where(_PUNCT[last] == 1, last, np.where(_DIGIT[last] == 1, 1, 0)).astype(np.int64)
    same = np.zeros(len(size), dtype=np.int64)
    if len(size) > 1:
        same[1:] = words.hash[1:] == words.hash[:-1]
    code = case + 4 * np.minimum(digit, 2) + 12 * np.minimum(punct, 3) + 48 * tail + 12288 * np.searchsorted([2, 4, 8, 14, 30], size) + 98304 * same
    return mix64(code.astype(_U) + _U(1))


def document_features(words: Words) -> Iterator[np.ndarray]:
    """The distinct indicator slots of each document: word unigrams and bigrams, and shape
    n-grams of one to three words at each share of the text they reach.  A text without words
    has the one indicator of empty texts."""
    w, s = words.hash, shapes(words)
    for a, b in zip(words.first[:-1], words.first[1:]):
        n = int(b - a)
        if n == 0:
            yield np.array([0], dtype=np.int32)
            continue
        h, g = w[a:b], s[a:b]
        grams = [h, h[:-1] * _U(3) + h[1:] * _U(7)]
        for k, gram in enumerate((g, g[:-1] * _U(5) + g[1:] * _U(11), g[:-2] * _U(13) + g[1:-1] * _U(17) + g[2:] * _U(19))):
            kinds, counts = np.unique(gram, return_counts=True)
            for level, share in enumerate(SHARES):
                grams.append(mix64(kinds[counts > share * n] + _U(1000 * (k + 1) + level)))
        distinct = np.unique(h).size / n
        grams.append(mix64(np.array([10_000 + int(distinct * 10), 20_000 + int(np.log2(n) * 2)], dtype=_U)))
        yield np.unique(1 + (np.concatenate(grams) % _U(SLOTS - 1)).astype(np.int32))


@dataclass
class QualityModel:
    weight: np.ndarray  # of each slot, class ratio included
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, words: Words) -> np.ndarray:
        out = []
        for f in document_features(words):
            norm = float(np.sqrt((self.ratio[f] ** 2).sum())) or 1.0
            out.append(self.slope * (float(self.weight[f].sum()) / norm + self.bias) + self.shift)
        return 1.0 / (1.0 + np.exp(-np.clip(np.array(out, dtype=np.float64), -60, 60)))


class Scaled(Sequence):
    """Each row's class ratios at unit length, worked out when asked for: all of them would take as much of
    the driver's memory again as the slots."""

    def __init__(self, rows: list[np.ndarray], ratio: np.ndarray):
        self.rows, self.ratio = rows, ratio
        self.norm = [float(np.sqrt((v * v).sum())) or 1.0 for v in (ratio[f] for f in rows)]

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        return (self.ratio[self.rows[i]] / self.norm[i]).astype(np.float32)


def dual_coordinate_descent(rows: list[np.ndarray], values: Sequence[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int, seed: int, least: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias minimising half the squared norm plus cost-weighted hinge losses; it ends with an
    epoch whose steps are all below ``least``."""
    w, bias, alpha = np.zeros(SLOTS), 0.0, np.zeros(len(rows))
    square = np.array([float((v * v).sum()) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            f, v = rows[i], values[i]
            g = y[i] * (float(w[f] @ v) + bias) - 1.0
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                worst = max(worst, abs(step))
                alpha[i] = new
                w[f] += step * v
                bias += step
        if worst < least:
            break
    return w, bias


def _platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve by Newton steps, targets smoothed."""
    up, down = weight[y > 0].sum(), weight[y < 0].sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -60, 60)))
        g, h = weight * (p - target), np.maximum(weight * p * (1 - p), 1e-12)
        grad = np.array([(g * margin).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * margin**2).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def fit_rows(features: list[np.ndarray], labels: np.ndarray, class_counts: tuple[int, int], seed: int = 5, cost: float = 1.0, epochs: int = 30) -> QualityModel:
    """``class_counts``: labelled rows of class 0 and 1 in all, which set the prior of the probability."""
    y = np.where(labels > 0, 1.0, -1.0)
    prior = (class_counts[1] + 1) / (sum(class_counts) + 2)
    if len(set(y.tolist())) < 2:
        level = float(np.log(prior / (1 - prior)))
        return QualityModel(np.zeros(SLOTS), np.ones(SLOTS), 0.0, 1.0, level)
    up, down = np.ones(SLOTS), np.ones(SLOTS)
    for f, c in zip(features, y):
        (up if c > 0 else down)[f] += 1
    ratio = np.log((up / up.sum()) / (down / down.sum()))
    each = {1.0: len(y) / (2 * (y > 0).sum()), -1.0: len(y) / (2 * (y < 0).sum())}
    costs = np.array([cost * each[c] for c in y])
    held = np.random.default_rng(seed).random(len(y)) < 0.2
    if len({*y[held].tolist()}) < 2 or len({*y[~held].tolist()}) < 2:
        held = np.zeros(len(y), dtype=bool)
    keep = np.flatnonzero(~held)
    use = np.flatnonzero(held) if held.any() else np.arange(len(y))
    train, test = ([features[i] for i in part] for part in (keep, use))
    w, bias = dual_coordinate_descent(train, Scaled(train, ratio), y[keep], costs[keep], epochs, seed)
    margin = np.array([float(w[f] @ v) + bias for f, v in zip(test, Scaled(test, ratio))])
    share = {1.0: prior / max((y[use] > 0).mean(), 1e-9), -1.0: (1 - prior) / max((y[use] < 0).mean(), 1e-9)}
    slope, shift = _platt(margin, y[use], np.array([share[c] for c in y[use]]))
    return QualityModel(w * ratio, ratio, bias, slope, shift)


def labelled_sample(labels: DataFrame, label: str, per_class: int, holdout: tuple[int, int], id_col: str = "doc_id") -> tuple[DataFrame, tuple[int, int]]:
    """At most ``per_class`` training rows of each class by hash order, and the training rows of each
    class in all.  Null ids and labels take no part; an id labelled twice has its smallest label."""
    train = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg((F.min(label) > 0).cast("int").alias("label")).where(crc_bucket(F.col("doc_id"), holdout[0]) != holdout[1])
    counts = {r.label: r.n for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    part = train.where("label = 0").orderBy(order, "doc_id").limit(per_class).unionByName(train.where("label = 1").orderBy(order, "doc_id").limit(per_class))
    return part, (counts.get(0, 0), counts.get(1, 0))


def pack_slots(slots: np.ndarray) -> bytes:
    """Ascending slots as compressed differences, about a third of their bytes."""
    return zlib.compress(np.diff(slots, prepend=0).astype("<i4").tobytes(), 1)


def unpack_slots(data: bytes) -> bytes:
    return np.cumsum(np.frombuffer(zlib.decompress(data), dtype="<i4"), dtype="<i4").tobytes()


def collect_features(docs: DataFrame, sample: DataFrame, extractor, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[np.ndarray], np.ndarray]:
    """Indicator slots and labels of the sampled rows, brought to the driver; the sample is
    bounded, so its ids are broadcast and only its texts are read into features."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, words in word_chunks(batch.column(2), lower=extractor.lower):
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), pa.array([pack_slots(f) for f in extractor.features(words)], pa.binary())], names=["doc_id", "label", "slots"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    sampled, found = rows.mapInArrow(run, f"doc_id {kind}, label int, slots binary").collect(), []
    while sampled:  # each row goes as its features are taken over
        r = sampled.pop()
        found.append((unpack_slots(r.slots), r.label))
    found.sort()
    return [np.frombuffer(f, dtype="<i4") for f, _ in found], np.array([c for _, c in found], dtype=np.int64)


class _Extractor:
    lower = False
    features = staticmethod(document_features)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS, holdout: tuple[int, int] = (5, 0), seed: int = 5) -> QualityModel:
    """A model of label 1 learned from rows whose crc32(id) mod ``holdout[0]`` is not ``holdout[1]``,
    at most ``per_class`` rows of each class.  Without labelled rows of both classes it answers the prior."""
    sample, counts = labelled_sample(labels, label, per_class, holdout)
    features, y = collect_features(docs, sample, _Extractor)
    model = fit_rows(features, y, counts, seed)
    del features
    release(docs.sparkSession)
    return model


def score_documents(docs: DataFrame, model: QualityModel, threshold: float = 0.3, holdout: tuple[int, int] = (5, 0), id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (and the columns of ``keep``).

    The score reads the whole text and nothing else.  Null and empty texts, and texts of white
    space, get the score of the empty-text indicator; an empty table gives no rows; repeated rows
    repeat; a text of any length is read whole; other columns, of any name, are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # fixed size: two tables of SLOTS numbers
    kept = keep or []
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(kept)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.scores(words) for _, _, words in word_chunks(batch.column(1), lower=False)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), *batch.columns[2:]], names=["doc_id", "score", *batch.schema.names[2:]])

    fields = [f"doc_id {source.schema['doc_id'].dataType.simpleString()}", "score double", *(f"__k{i} {source.schema[f'__k{i}'].dataType.simpleString()}" for i in range(len(kept)))]
    done = source.mapInArrow(run, ", ".join(fields))
    return done.select("doc_id", (crc_bucket(F.col("doc_id"), holdout[0]) == holdout[1]).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[F.col(f"__k{i}").alias(c) for i, c in enumerate(kept)])


def keep_documents(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, columns unchanged, whose score reaches ``threshold``; null text is scored as empty;
    repeated rows stay or go together; a score equal to the threshold stays."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.scores(words) for _, _, words in word_chunks(batch.column(at), lower=False)]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
