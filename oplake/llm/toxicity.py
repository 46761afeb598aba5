"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

P(grade >= k) = logistic(w.x - t_k) for ordered thresholds t_1 < t_2 < ... that share one
weight vector; the expected severity is the sum of these probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oplake.llm.common import Words, crc_bucket, release, word_chunks
from oplake.llm.quality import collect_features, labelled_sample

SLOTS = 1 << 20
#: At most so many labelled rows of each class are used to fit.
SAMPLE_PER_CLASS = 6000
#: Features kept: the slots that speak most for the toxic class, by likelihood ratio; none below
#: EVIDENCE (less where under 16 toxic rows are labelled, which give little of it), and none whose rate in the class is not RATE times that outside it.
FEATURES, EVIDENCE, LEAST_EVIDENCE, RATE = 4096, 24.0, 12.0, 12.0
_EDGE = np.zeros(256, dtype=bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _core_hashes(words: Words) -> np.ndarray:
    """Hashes of lower-cased words without the ASCII punctuation at their ends."""
    b, start, end = words.bytes, words.start.copy(), words.end.copy()
    if len(b) and len(start):
        inner = np.where(_EDGE[b], -1, np.arange(len(b)))
        last = np.maximum.accumulate(inner)  # the last byte up to here that is no punctuation
        inner[inner < 0] = len(b)
        first = np.minimum.accumulate(inner[::-1])[::-1]  # the first one from here on
        some = start < end
        start[some] = np.minimum(first[start[some]], end[some])
        end[some] = np.maximum(last[end[some] - 1] + 1, start[some])
    return words.span_hash(start, end)


def document_features(words: Words) -> Iterator[np.ndarray]:
    """The distinct word slots of each document; a text without words has none."""
    slots = (_core_hashes(words) % np.uint64(SLOTS)).astype(np.int32)
    for a, b in zip(words.first[:-1], words.first[1:]):
        yield np.unique(slots[a:b])


class _Extractor:
    lower = True
    features = staticmethod(document_features)


@dataclass
class ToxicityModel:
    slots: np.ndarray  # sorted slots that have a weight
    weights: np.ndarray
    thresholds: np.ndarray

    def predict(self, words: Words) -> np.ndarray:
        """P(grade >= k) of each document, one column per threshold."""
        z = np.zeros(len(words.first) - 1)
        if len(self.slots):
            for i, f in enumerate(document_features(words)):
                at = np.minimum(np.searchsorted(self.slots, f), len(self.slots) - 1)
                z[i] = self.weights[at[self.slots[at] == f]].sum()
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -60, 60)))


def choose_features(features: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots by likelihood-ratio evidence, and the log ratio of their class rates."""
    n1, n0 = int((y > 0).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return np.zeros(0, np.int32), np.zeros(0)
    up = np.bincount(np.concatenate([f for f, c in zip(features, y) if c > 0] + [np.zeros(0, np.int32)]), minlength=SLOTS)
    down = np.bincount(np.concatenate([f for f, c in zip(features, y) if c == 0] + [np.zeros(0, np.int32)]), minlength=SLOTS)
    p = (up + down) / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda k, n: np.where(k > 0, k * np.log(k / (n * p)), 0) + np.where(n - k > 0, (n - k) * np.log((n - k) / (n * (1 - p))), 0)
        evidence = 2 * np.nan_to_num(part(up, n1) + part(down, n0), posinf=0.0, neginf=0.0)
    evidence[(up + 0.5) * (n0 + 1) < RATE * (down + 0.5) * (n1 + 1)] = 0.0
    top = np.argsort(-evidence, kind="stable")[:FEATURES]
    top = np.sort(top[evidence[top] >= min(EVIDENCE, max(LEAST_EVIDENCE, 1.5 * n1))]).astype(np.int32)
    return top, np.log((up[top] + 0.5) / (n1 + 1)) - np.log((down[top] + 0.5) / (n0 + 1))


def grade_labels(features: list[np.ndarray], y: np.ndarray, grades: int = 3) -> np.ndarray:
    """Severity grades 0..``grades``.  Labels beyond 1 are grades already.  Of 0/1 labels the toxic rows
    are graded by how sure a naive Bayes model is of them that was learned from the other half of
    the rows, so that no row's own words, nor weights fitted to them, set its grade."""
    if len(y) and y.max() > 1:
        return y
    half = np.array([zlib.crc32(f.tobytes()) & 1 for f in features])
    sure = np.zeros(len(y))
    for k in (0, 1):
        others = np.flatnonzero(half != k)
        slots, ratio = choose_features([features[i] for i in others], y[others])
        if len(slots):
            for i in np.flatnonzero((half == k) & (y > 0)):
                at = np.minimum(np.searchsorted(slots, features[i]), len(slots) - 1)
                sure[i] = ratio[at[slots[at] == features[i]]].sum()
    edges = np.unique(np.quantile(sure[y > 0], np.arange(1, grades) / grades, method="higher")) if (y > 0).any() else np.zeros(0)
    return np.where(y > 0, 1 + np.searchsorted(edges, sure, side="left"), 0)


def fit_rows(features: list[np.ndarray], y: np.ndarray, class_counts: tuple[int, int], seed: int = 5, epochs: int = 240, rate: float = 0.5, l2: float = 1e-6) -> ToxicityModel:
    """Maximum likelihood by adaptive-rate descent over mini-batches; ``class_counts`` sets the prior."""
    # equal texts count once, or the words of a much-copied text would speak for its class
    first = {(f.tobytes(), int(c)): i for i, (f, c) in reversed(list(enumerate(zip(features, y))))}
    features, y = [features[i] for i in first.values()], y[list(first.values())] if len(y) else y
    slots, ratio = choose_features(features, y)
    prior = (class_counts[1] + 1) / (sum(class_counts) + 2)
    if not len(slots):
        return ToxicityModel(slots, ratio, np.array([np.log((1 - prior) / prior)]))
    grade = grade_labels(features, y)
    levels = int(grade.max())
    rows = []
    for f in features:
        at = np.minimum(np.searchsorted(slots, f), len(slots) - 1)
        rows.append(at[slots[at] == f])
    w, gw = np.clip(ratio, -3, 3) * 0.5, np.full(len(slots), 1e-8)
    t, gt = np.arange(1, levels + 1, dtype=np.float64), np.full(levels, 1e-8)
    rng = np.random.default_rng(seed)
    ks = np.arange(1, levels + 1)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 64):
            part = order[i : i + 64]
            flat = np.concatenate([rows[j] for j in part])
            doc = np.repeat(np.arange(len(part)), [len(rows[j]) for j in part])
            z = np.bincount(doc, weights=w[flat], minlength=len(part))
            # P(g) = s_g - s_(g+1), s_k = P(grade >= k), s_0 = 1, s_(levels+1) = 0
            s = 1 / (1 + np.exp(-np.clip(z[:, None] - t, -30, 30)))
            g = grade[part]
            full = np.concatenate([np.ones((len(part), 1)), s, np.zeros((len(part), 1))], axis=1)
            d = full * (1 - full)
            at = np.arange(len(part))
            p = np.maximum(full[at, g] - full[at, g + 1], 1e-9)
            dz = (d[at, g] - d[at, g + 1]) / p
            lower = (ks[None, :] == g[:, None]) * d[:, 1:-1] / p[:, None]
            upper = (ks[None, :] == g[:, None] + 1) * d[:, 1:-1] / p[:, None]
            dt = (upper - lower).sum(axis=0) / len(part)
            dw = np.bincount(flat, weights=dz[doc], minlength=len(slots)) / len(part) - l2 * w
            gw += dw * dw
            gt += dt * dt
            w += rate * dw / np.sqrt(gw)
            t = np.maximum.accumulate(t + rate * dt / np.sqrt(gt) + np.arange(levels) * 1e-9)
    sampled = (y > 0).mean()
    shift = np.log(sampled / (1 - sampled)) - np.log(prior / (1 - prior))  # the sample holds more toxic rows than the labels
    return ToxicityModel(slots, w, t + shift)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE_PER_CLASS, holdout: tuple[int, int] = (5, 0), seed: int = 5) -> ToxicityModel:
    """A model learned from rows whose crc32(id) mod ``holdout[0]`` is not ``holdout[1]``, at most
    ``per_class`` toxic and as many other rows.  Without labelled rows of both classes it answers the prior."""
    sample, counts = labelled_sample(labels, label, per_class, holdout)
    features, y = collect_features(docs, sample, _Extractor)
    model = fit_rows(features, y, counts, seed)
    del features
    release(docs.sparkSession)
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, holdout: tuple[int, int] = (5, 0), id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, score (P(grade >= 1)), severity (expected grade), grade, toxic.

    ``toxic`` is 1 where the score reaches ``threshold``.  Texts are read whole; null, empty and
    unknown texts have the weight sum 0; an empty table gives no rows; repeated rows repeat and texts of
    equal words tie; null ids count as empty text for ``held_out``; input columns, of any name, are
    ignored but for those in ``keep``, which are added.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights
    kept = keep or []
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(kept)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.predict(words) for _, _, words in word_chunks(batch.column(1))]
            p = np.concatenate(parts) if parts else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p[:, 0]), pa.array(p.sum(axis=1)), pa.array((p >= 0.5).sum(axis=1).astype(np.int32)), *batch.columns[2:]], names=["doc_id", "score", "severity", "grade", *batch.schema.names[2:]])

    fields = [f"doc_id {source.schema['doc_id'].dataType.simpleString()}", "score double", "severity double", "grade int", *(f"__k{i} {source.schema[f'__k{i}'].dataType.simpleString()}" for i in range(len(kept)))]
    done = source.mapInArrow(run, ", ".join(fields))
    return done.select("doc_id", (crc_bucket(F.col("doc_id"), holdout[0]) == holdout[1]).alias("held_out"), "score", "severity", "grade", (F.col("score") >= threshold).cast("int").alias("toxic"), *[F.col(f"__k{i}").alias(c) for i, c in enumerate(kept)])


def keep_documents(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, columns unchanged, whose P(grade >= 1) stays below ``threshold``; null text is scored as
    empty; repeated rows stay or go together; a score equal to the threshold goes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.predict(words)[:, 0] for _, _, words in word_chunks(batch.column(at))]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts) < threshold))

    return docs.mapInArrow(run, docs.schema)
