"""Ordinal quality classifier: cumulative-link regression on graded ratings over hashed text.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score
into grades: P(grade <= k) = sigmoid(threshold_k - w.x). The expected grade and the tail probability
P(grade >= g) rank and select texts. The model is fitted on at most MOST_ROWS labelled rows chosen by
hash, from rows whose crc32(doc_id) mod 5 is not 0.

Features of a text: its words, their endings and shapes (each hashed, weighted by the root of how often),
and hashed steps of its length and of its share of distinct words. Null and empty texts have the steps
alone. Rows that repeat are scored row by row. With fewer than two grades among the labels every text
gets the same score. A null doc_id is scored and has no label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import LOWER, cut, mix, prefix_hash, raw_text, span_hash, text_slices, words_of
from tallyforge.llm.toxicity import labelled_sample

#: Labelled rows that the model is fitted on.
MOST_ROWS = 8_000
BITS = 18
_MASK = np.uint64((1 << BITS) - 1)
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[[*range(0x41, 0x5B)]] = 2
_KIND[[*range(0x30, 0x3A)]] = 3
_KIND[[*b".,;:!?'\"()-"]] = 4


def hashed(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, feature numbers and values (of unit length for each row) of the texts."""
    n = len(offsets) - 1
    starts, ends, doc = words_of(raw, offsets)
    word = span_hash(prefix_hash(LOWER[raw] + np.uint64(1)), starts, ends)
    tail = mix(LOWER[raw[ends - 1]].astype(np.uint64) << np.uint64(8) | LOWER[raw[np.maximum(ends - 2, starts)]] | np.uint64(1 << 40))
    shape = mix(
        (_KIND[raw[starts]].astype(np.uint64) * np.uint64(8) + _KIND[raw[(starts + ends) // 2]]) * np.uint64(8)
        + _KIND[raw[ends - 1]] + (np.minimum(ends - starts, 12).astype(np.uint64) << np.uint64(20)) + np.uint64(1 << 41)
    )
    number = np.concatenate([word, tail, shape]) & _MASK
    key = np.concatenate([doc, doc, doc]).astype(np.uint64) << np.uint64(BITS) | number
    key, times = np.unique(key, return_counts=True)
    value = np.sqrt(times.astype(np.float64))
    owner = (key >> np.uint64(BITS)).astype(np.int64)
    norm = np.sqrt(np.bincount(owner, value**2, n))
    value /= norm[owner]
    words = np.bincount(doc, minlength=n)
    kinds = np.bincount((np.unique(doc.astype(np.uint64) << np.uint64(40) | word >> np.uint64(24)) >> np.uint64(40)).astype(np.int64), minlength=n)
    step = np.stack([np.log2(words + 1).astype(np.uint64) + np.uint64(1 << 42), (10 * kinds // np.maximum(words, 1)).astype(np.uint64) + np.uint64(1 << 43)], axis=1)
    extra = mix(step.ravel()) & _MASK
    owner = np.concatenate([owner, np.repeat(np.arange(n), 2)])
    order = np.argsort(owner, kind="stable")
    number = np.concatenate([key & _MASK, extra])[order].astype(np.int32)
    value = np.concatenate([value, np.full(2 * n, 0.5)])[order]
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), number, value


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class CumulativeLink:
    """thresholds: ascending, one less than the grades; weights: shared by all of them."""

    def __init__(self, grades: int):
        self.grades, self.weights = grades, np.zeros(1 << BITS)
        self.thresholds = np.zeros(grades - 1)

    def fit(self, starts: np.ndarray, number: np.ndarray, value: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.15, decay: float = 1e-5) -> CumulativeLink:
        """Adagrad on the log-likelihood; the thresholds are a first one and positive gaps."""
        share = np.clip(np.cumsum(np.bincount(y, minlength=self.grades))[:-1] / max(len(y), 1), 1e-3, 1 - 1e-3)
        cuts = np.log(share / (1 - share))
        free = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
        seen_w, seen_f, rng = np.full(1 << BITS, 1e-8), np.full(len(free), 1e-8), np.random.default_rng(5)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(y), batch):
                rows = order[a : a + batch]
                size = starts[rows + 1] - starts[rows]
                at = np.repeat(starts[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                who, f, v = np.repeat(np.arange(len(rows)), size), number[at], value[at]
                s = np.bincount(who, self.weights[f] * v, len(rows))
                cut_ = np.concatenate([[-40], free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))]), [40]])
                hi, lo = _sigmoid(cut_[y[rows] + 1] - s), _sigmoid(cut_[y[rows]] - s)
                hi[y[rows] == self.grades - 1], lo[y[rows] == 0] = 1.0, 0.0
                p = np.maximum(hi - lo, 1e-9)
                ds = hi + lo - 1
                touched, slot = np.unique(f, return_inverse=True)
                g = np.bincount(slot, ds[who] * v) / len(rows) - decay * self.weights[touched]
                seen_w[touched] += g * g
                self.weights[touched] += rate * g / np.sqrt(seen_w[touched])
                dcut = np.bincount(y[rows] + 1, hi * (1 - hi) / p, self.grades + 1) - np.bincount(y[rows], lo * (1 - lo) / p, self.grades + 1)
                dcut = dcut[1:-1] / len(rows)
                tail = np.cumsum(dcut[::-1])[::-1]
                df = np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])])
                seen_f += df * df
                free += 0.05 * df / np.sqrt(seen_f)
        self.thresholds = free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])
        self.weights = self.weights.astype(np.float32)
        return self

    def tails(self, starts: np.ndarray, number: np.ndarray, value: np.ndarray) -> np.ndarray:
        """P(grade >= g) for g = 1 .. grades - 1, by row."""
        n = len(starts) - 1
        s = np.bincount(np.repeat(np.arange(n), np.diff(starts)), self.weights[number] * value, n)
        return 1 - _sigmoid(self.thresholds[None, :] - s[:, None])


def grade(quality: Column, toxic: Column) -> Column:
    """Ratings from the two labels: 0 poor, 1 good but toxic, 2 good."""
    return F.when(quality == 0, 0).when(toxic == 1, 1).otherwise(2)


def fit(docs: DataFrame, ratings: DataFrame, grades: int = 3, most_rows: int = MOST_ROWS) -> CumulativeLink:
    """ratings: doc_id, grade (0 .. grades - 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, column=0):
            starts, number, value = hashed(*raw_text(b.column(0)))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column(1), "grade": b.column(2),
                    "f": pa.array([number[a:z].astype("<i4").tobytes() for a, z in zip(starts[:-1], starts[1:], strict=True)], pa.binary()),
                    "v": pa.array([value[a:z].astype("<f4").tobytes() for a, z in zip(starts[:-1], starts[1:], strict=True)], pa.binary()),
                }
            )

    model = CumulativeLink(grades)
    sample = labelled_sample(docs, ratings, "grade", most_rows).select("text", "doc_id", F.col("grade").cast("int").alias("grade"))
    rows = cut(sample.mapInArrow(run, "doc_id long, grade int, f binary, v binary"), "quality-sample").orderBy("doc_id").toArrow()
    y = rows.column("grade").to_numpy()
    if not len(y) or y.min() == y.max():
        return model
    f = [np.frombuffer(x, "<i4") for x in rows.column("f").to_pylist()]
    v = [np.frombuffer(x, "<f4") for x in rows.column("v").to_pylist()]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in f])])
    return model.fit(starts, np.concatenate(f), np.concatenate(v).astype(np.float64), y.astype(np.int64))


def score(docs: DataFrame, model: CumulativeLink, least_grade: int = 1, least_probability: float = 0.5) -> DataFrame:
    """Per row: doc_id, expected_grade, tail_probability (of least_grade or more) and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            tails = model.tails(*hashed(*raw_text(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, least_grade - 1])], names=["doc_id", "expected_grade", "tail_probability"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")
    return rows.withColumn("kept", F.col("tail_probability") >= least_probability)
