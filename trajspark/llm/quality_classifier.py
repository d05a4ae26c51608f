"""Text quality by naive Bayes support vectors.

Features are indicators of n-grams, hashed into a fixed number of places: words, pairs of words, and one to
three successive word shapes (case, digits, punctuation, repetition). Each indicator is scaled by its
log-count ratio between the classes, the vector is brought to unit length, and a linear hinge-loss model is
fitted by dual coordinate descent. A logistic curve through margins of rows that the model did not see
turns margins into scores.

Bound: the model is fitted on at most ``MAX_ROWS`` labelled rows, those with the smallest seeded hash of
their id. Every document is scored on its whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import bounded, texts_of

BITS = 18
MAX_ROWS = 8000
THRESHOLD = 0.3
MEMO = 200_000
_RUNS = re.compile(rb"(.)\1+", re.S)
_CLASSES = bytes(
    ord("A") if 65 <= b < 91 else ord("a") if 97 <= b < 123 or b >= 128 else ord("9") if 48 <= b < 58 else b for b in range(256)
)


def shape(word: bytes) -> bytes:
    """Upper, lower, digit and punctuation runs of a word."""
    return _RUNS.sub(rb"\1", word.translate(_CLASSES))


class Features:
    """Hashed n-gram indicators of texts; remembers words up to a bound."""

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.words, self.shapes = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)

    def _learn(self, new: list[bytes]) -> None:
        from xxhash import xxh64_intdigest

        n = len(self.index)
        while n + len(new) > len(self.words):
            self.words, self.shapes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.words, self.shapes))
        self.words[n : n + len(new)] = [xxh64_intdigest(w.lower(), 1) for w in new]
        self.shapes[n : n + len(new)] = [xxh64_intdigest(shape(w), 2) for w in new]
        self.index.update(zip(new, range(n, n + len(new)), strict=True))

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Distinct places, ascending; an empty or null text has none."""
        words = (text or b"").split()
        if not words:
            return np.zeros(0, np.int32)
        if len(self.index) > MEMO:
            self._forget()
        new = set(words).difference(self.index)
        if new:
            self._learn(list(new))
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        word, form = self.words[at], self.shapes[at]
        form[1:][at[1:] == at[:-1]] = np.uint64(0x9E3779B97F4A7C15)
        mul = np.uint64(0xBF58476D1CE4E5B9)
        two = form[1:] * mul ^ form[:-1]
        grams = [word, word[1:] * mul ^ word[:-1], form, two, form[2:] * mul * mul ^ two[:-1]]
        salted = [(g + np.uint64(k)) * np.uint64(0x94D049BB133111EB) for k, g in enumerate(grams)]
        places = np.sort((np.concatenate(salted) >> np.uint64(64 - BITS)).astype(np.int32))
        return places[np.concatenate([[True], places[1:] != places[:-1]])]


@dataclass
class Classifier:
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, places: np.ndarray) -> float:
        r = self.ratios[places]
        length = float(np.sqrt((r * r).sum()))
        return float((r * self.weights[places]).sum()) / length + self.bias if length else self.bias

    def score(self, places: np.ndarray) -> float:
        z = min(50.0, max(-50.0, self.slope * self.margin(places) + self.offset))
        return float(1 / (1 + np.exp(-z)))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares of each place in the rows of class 1 and of class 0."""
    counts = [np.bincount(np.concatenate([x for x, y in zip(rows, labels, strict=True) if y == c] + [np.zeros(0, np.int32)]), minlength=1 << BITS) + 1.0 for c in (1, 0)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, cost: np.ndarray, epochs: int = 30, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model: one dual variable at a time, in random order."""
    rng = np.random.default_rng(seed)
    y = np.where(labels > 0, 1.0, -1.0)
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    square = np.array([(v * v).sum() + 1.0 for v in values])  # the bias is a feature of value one
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                worst = max(worst, abs(new - alpha[i]))
                alpha[i] = new
        if worst < 1e-3:
            break
    return w, bias


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps on softened labels."""
    n1, n0 = (labels > 0).sum(), (labels <= 0).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, b = np.c_[margins, np.ones(len(margins))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p) - 1e-6 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 1e-3)), float(b[1])


def train(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0) -> Classifier:
    """A constant score where a class is missing; else margins are calibrated on every fourth row."""
    labels = np.asarray(labels)
    if not len(rows) or labels.min() == labels.max():
        ones = float(labels.sum()) if len(rows) else 0.0
        p = (ones + 1) / (len(rows) + 2)
        return Classifier(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 1.0, float(np.log(p / (1 - p))))

    def fitted(use: np.ndarray) -> Classifier:
        own, y = [rows[i] for i in use], labels[use]
        r = log_count_ratios(own, y)
        values = [r[x] / (np.sqrt((r[x] ** 2).sum()) or 1.0) for x in own]
        share = np.array([(y == 0).mean(), (y == 1).mean()])
        w, bias = dual_coordinate_descent(own, values, y, cost / (2 * share[y]))
        return Classifier(r, w, bias)

    all_rows = np.arange(len(rows))
    fold = np.zeros(len(rows), int)
    for c in (0, 1):  # each class in turn over the folds
        fold[labels == c] = np.arange((labels == c).sum()) % 4
    rest = all_rows[fold != 0]
    model = fitted(all_rows)
    if labels[rest].min() < labels[rest].max():
        other = fitted(rest)
        margins = np.array([other.margin(rows[i]) for i in all_rows[fold == 0]])
        model.slope, model.offset = _logistic(margins, labels[fold == 0])
    return model


def held_out(id_col: str, folds: int = 5) -> F.col:
    """Whether the CRC-32 of the id as text leaves no remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, max_rows: int = MAX_ROWS, seed: int = 7) -> Classifier:
    """Fit on labelled rows outside the held-out fold. Of several labels of an id the lowest counts, of several
    texts the one with the smallest hash. Null ids belong to no label; without usable labels all scores are equal."""
    import pyarrow as pa

    usable = labels.where(~held_out(id_col, folds) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    usable = usable.groupBy("id").agg(F.min("label").alias("label"))
    u, n = F.xxhash64(F.lit(seed), "id"), usable.count()
    if n > 2 * max_rows:  # leaves about twice as many rows to order
        usable = usable.where(F.shiftrightunsigned(u, 1) < int(2**63 * (2 * max_rows / n)))
    usable = usable.orderBy(u, "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # One row for each id: at most max_rows come to the driver.
    rows = texts.join(F.broadcast(usable), "id").groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text")

    def run(batches):
        features = Features()
        for batch in bounded(batches, 1):
            found = [features(x).astype("<i4").tobytes() for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["label", "places"])

    found = rows.mapInArrow(run, "label int, places binary").collect()
    found = sorted((r["places"], r["label"]) for r in found)  # the order of arrival has no effect
    return train([np.frombuffer(p, "<i4") for p, _ in found], np.array([y for _, y in found], int))


def score_documents(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, ``score`` (higher: label 1 likelier) and ``predicted`` of every row, repeats included.

    Null, empty and very long texts are scored like others, whole; ids have no effect, and no other column is read.
    """
    import pyarrow as pa


    def run(batches):
        features = Features()
        for batch in bounded(batches, 1):
            scores = np.array([model.score(features(x)) for x in texts_of(batch)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
