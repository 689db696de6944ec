"""Toxicity scores by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: density of a lexicon learned from the training labels (by the log-odds of its words,
also of words undone of obfuscation), how near its hits stand to second-person words, capitals,
punctuation and obfuscation rates, length. Labels are learned only from rows whose crc32(doc_id) mod 5
is not 0, at most MOST_ROWS of them chosen by hash; labels, lang, source and doc_id are never features. The
lexicon is the MOST_LEXICON words that stand out most. Calibration uses margins out of fold: each of FOLDS models
has its own lexicon and trees, learned without the rows that it scores.

Null and empty texts have features of zero and get a score like any other. A null doc_id is not held
out and has no label. Rows that repeat are scored row by row; of several labels of one doc_id the
highest counts. Without labels of both kinds every score is the share of label 1 (0 without labels).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import as_bytes, cut, text_slices
from tallyforge.llm.word_table import WordTable

#: Labelled rows that a model is fitted on.
MOST_ROWS = 20_000
#: Words of a lexicon.
MOST_LEXICON = 400
FOLDS = 5
NAMES = ("lexicon", "hits", "strongest", "distinct", "near_you", "you", "capitals", "shouted", "exclaim", "question", "symbols", "obfuscated", "undone_hits", "log_words", "mean_length")

_SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestra".split())
_UNDO = str.maketrans("013457@$!|", "oieastasil")
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_INNER = re.compile(r"[\W\d_]")


def plain(word: bytes) -> str:
    return _EDGE.sub("", word.decode("utf-8", "replace").lower())


def undone(text: str) -> str:
    """A word without disguises: digits and signs for letters, signs between letters, drawn-out letters."""
    letters = re.sub(r"[\W\d_]+", "", text.translate(_UNDO))
    return re.sub(r"(.)\1{2,}", r"\1", letters)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """doc_id and f, the features of each row as an array in the order of NAMES."""

    def facts(words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), 9), np.float32)
        for i, w in enumerate(words):
            p = plain(w)
            weight = lexicon.get(p, 0.0)
            body = w.decode("utf-8", "replace")
            odd = bool(p) and bool(_INNER.search(p))
            back = lexicon.get(undone(body.lower()), 0.0) if not weight and (odd or not p.isalpha()) else 0.0
            upper = sum(map(str.isupper, body))
            out[i] = (weight, back, p in _SECOND, upper, upper > 1 and body.upper() == body, body.count("!"), body.count("?"), sum(map(body.count, "#*$%&@|")), odd)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(facts)
        for b in text_slices(batches):
            texts = as_bytes(b.column(1))
            codes, n = table.codes(texts)
            ends = np.cumsum(n)
            doc = np.repeat(np.arange(len(n)), n)
            got = table.facts[codes] if len(codes) else np.zeros((0, 9), np.float32)
            total = lambda x, doc=doc, n=n: np.bincount(doc, x, len(n))
            many, weight = np.maximum(n, 1), np.maximum(got[:, 0], got[:, 1])
            hit, you = np.flatnonzero(weight > 0), np.flatnonzero(got[:, 2] > 0)
            near = np.zeros(len(hit))
            if len(you) and len(hit):
                at = np.searchsorted(you, hit)
                for side in (np.clip(at - 1, 0, len(you) - 1), np.clip(at, 0, len(you) - 1)):
                    close = (np.abs(you[side] - hit) <= 5) & (doc[you[side]] == doc[hit])
                    near = np.maximum(near, close)
            strongest = np.zeros(len(n))
            np.maximum.at(strongest, doc[hit], weight[hit])
            kinds = np.unique(doc[hit] * (len(table.facts) + 1) + codes[hit]) // (len(table.facts) + 1) if len(hit) else np.empty(0, np.int64)
            size = np.fromiter(map(len, texts), np.float64, len(texts))
            out = np.stack(
                [
                    total(weight) / many, np.bincount(doc[hit], minlength=len(n)), strongest, np.bincount(kinds, minlength=len(n)), np.bincount(doc[hit], near, len(n)),
                    total(got[:, 2]) / many, total(got[:, 3]) / np.maximum(size, 1), total(got[:, 4]) / many, total(got[:, 5]) / many, total(got[:, 6]) / many,
                    total(got[:, 7]) / many, total(got[:, 8]) / many, total(got[:, 1] > 0), np.log1p(n), size / many,
                ],
                axis=1,
            ).astype(np.float32)
            del ends
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float32()))], names=["doc_id", "f"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, f array<float>")


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words of rows(text, toxic) that stand in clearly more toxic texts than chance gives, with their log-odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bad, known = Counter(), Counter(), {}
        for b in text_slices(batches, column=0):
            for text, toxic in zip(as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                words = set()
                for w in set(text.split()):
                    p = known.get(w)
                    if p is None:
                        p = known[w] = plain(w)
                    words.add(p)
                seen.update(words)
                if toxic:
                    bad.update(words)
            if len(known) > 400_000:
                known.clear()
        names = [w for w in seen if w]
        for a in range(0, len(names), 20_000):
            part = names[a : a + 20_000]
            yield pa.RecordBatch.from_pydict({"word": pa.array(part, pa.string()), "n": pa.array([seen[w] for w in part], pa.int64()), "bad": pa.array([bad[w] for w in part], pa.int64())})

    totals = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    n, bad = totals["n"], totals["bad"] or 0
    if not bad or bad == n:
        return {}
    p = bad / n
    counts = rows.select("text", "toxic").mapInArrow(run, "word string, n long, bad long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    z = (F.col("bad") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    odds = F.log((F.col("bad") + 0.5) / bad) - F.log((F.col("n") - F.col("bad") + 0.5) / (n - bad))
    best = counts.where("bad >= 4").withColumn("z", z).withColumn("odds", odds).where("z >= 5 AND odds >= 1.5").orderBy(F.desc("z"), "word").limit(MOST_LEXICON)
    return {r["word"]: float(r["odds"]) for r in best.collect()}


class BoostedTrees:
    """Logistic gradient boosting with binned features and depth-limited trees."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.1, least: int = 10, bins: int = 64):
        self.rounds, self.depth, self.rate, self.least, self.bins = rounds, depth, rate, least, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._tree(binned, y - p, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            margin += self._value(tree, binned)
        return self

    def _tree(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple[int, int, float]]:
        """Nodes (feature, bin, value) of a full binary tree; feature -1 passes everything left."""
        nodes, at = [], np.zeros(len(g), np.int64)
        for level in range(self.depth + 1):
            for k in range(1 << level):
                rows = np.flatnonzero(at == k)
                gs, hs = g[rows].sum(), h[rows].sum()
                best = (1e-6, -1, 0)
                if level < self.depth and len(rows) >= 2 * self.least:
                    for j in range(x.shape[1]):
                        size = len(self.edges[j]) + 1
                        if size < 2:
                            continue
                        xj = x[rows, j]
                        gl, hl, nl = (np.cumsum(np.bincount(xj, w, size))[:-1] for w in (g[rows], h[rows], None))
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        gain[(nl < self.least) | (len(rows) - nl < self.least)] = -1
                        i = int(gain.argmax())
                        if gain[i] > best[0]:
                            best = (float(gain[i]), j, i)
                nodes.append((best[1], best[2], float(self.rate * gs / (hs + 1))))
            if level < self.depth:
                feature = np.array([n[0] for n in nodes[-(1 << level) :]])[at]
                split = np.array([n[1] for n in nodes[-(1 << level) :]])[at]
                at = 2 * at + ((feature >= 0) & (x[np.arange(len(at)), feature] > split))
        return nodes

    def _value(self, nodes: list[tuple[int, int, float]], x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for level in range(self.depth):
            row = nodes[(1 << level) - 1 : (2 << level) - 1]
            feature, split = np.array([n[0] for n in row])[at], np.array([n[1] for n in row])[at]
            at = 2 * at + ((feature >= 0) & (x[np.arange(len(at)), feature] > split))
        return np.array([n[2] for n in nodes[(1 << self.depth) - 1 :]])[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)
        return self.base + sum((self._value(t, binned) for t in self.trees), np.zeros(len(x)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing function of x that is nearest to y (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for xi, yi in zip(x[order], y[order], strict=True):
        blocks.append([yi, 1, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, n, _, hi = blocks.pop()
            last = blocks[-1]
            last[0], last[1], last[3] = (last[0] * last[1] + m * n) / (last[1] + n), last[1] + n, hi
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    return xs, np.array([v for b in blocks for v in (b[0], b[0])])


class Model:
    def __init__(self, lexicon: dict[str, float], trees: BoostedTrees | None, knots: tuple[np.ndarray, np.ndarray], rate: float):
        self.lexicon, self.trees, self.knots, self.rate = lexicon, trees, knots, rate

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.rate)
        m = self.trees.margin(x)
        raw = 1 / (1 + np.exp(-m))
        # a little of the margin keeps the order of rows within a calibrated step
        return np.clip(0.98 * np.interp(m, *self.knots) + 0.02 * raw, 0, 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, text and label of the training rows, at most about most_rows of them, chosen by hash."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label)).where(~held_out(F.col("doc_id")))
    share = min(1.0, most_rows / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < round(1_000_000 * share))
    return docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text").join(chosen, "doc_id")


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    sample = cut(labelled_sample(docs, labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")), "toxic", most_rows), "toxic-sample")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS))

    def measured(learn: F.Column, keep: F.Column) -> tuple[dict[str, float], np.ndarray, np.ndarray, np.ndarray]:
        """The lexicon of the rows of learn, and features, labels and folds of the rows of keep."""
        lexicon = learn_lexicon(sample.where(learn))
        told = sample.select("doc_id", "toxic").distinct()
        rows = features(sample.where(keep), lexicon).join(told, "doc_id").select("f", "toxic", fold.alias("k")).orderBy("doc_id", "f").collect()
        return lexicon, np.array([r["f"] for r in rows], np.float32), np.array([r["toxic"] for r in rows], np.float64), np.array([r["k"] for r in rows])

    every = F.lit(True)
    lexicon, x, y, k = measured(every, every)
    if not len(y) or y.min() == y.max():
        return Model({}, None, (np.zeros(1), np.zeros(1)), float(y.mean()) if len(y) else 0.0)
    margin, truth = [], []
    for i in range(FOLDS):  # neither words nor trees of a fold's model have seen the rows that calibrate it
        _, fx, fy, fk = measured(fold != i, every)
        if (fk == i).any() and (fk != i).any():
            margin.append(BoostedTrees().fit(fx[fk != i], fy[fk != i]).margin(fx[fk == i]))
            truth.append(fy[fk == i])
    knots = isotonic(np.concatenate(margin), np.concatenate(truth)) if margin else (np.zeros(1), np.full(1, y.mean()))
    return Model(lexicon, BoostedTrees().fit(x, y), knots, float(y.mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, len(NAMES))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = features(docs, model.lexicon).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
