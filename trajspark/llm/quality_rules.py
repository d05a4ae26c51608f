"""Quality rules judged by an isolation forest.

Each document gets rule statistics. An isolation forest, grown on a bounded sample of documents, scores
how few random splits set a document apart; the threshold on the score comes from all labelled documents.

Bounds: the forest sees ``trees * rows_per_tree`` documents, the ones with the smallest seeded hash of
their id. Statistics, scores and the histogram behind the threshold cover all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import bounded, texts_of, written

TREES, ROWS_PER_TREE, DEPTH = 128, 256, 8
#: Share of good labelled documents that may be rejected.
LOSS = 0.003
BINS = 4000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the forest splits on, besides shares of the counts.
SHARES = ["symbols", "dup_lines", "repeats", "capitals", "shouts", "same_as_last"]


def _repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words in 3-word windows found twice or more; words equal to the one before."""
    n = len(words)
    if n < 2:
        return 0, 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
    same = int((ids[1:] == ids[:-1]).sum())
    if n < 4 or len(index) == n:
        return 0, same
    pairs = ids[:-1] * len(index) + ids[1:]
    if len(index) > 1_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(index) + ids[2:]
    order = np.argsort(windows, kind="stable")
    equal = windows[order][1:] == windows[order][:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    in_window = np.zeros(n, bool)
    for k in range(3):
        in_window[k : n - 2 + k] |= again
    return int(in_window.sum()), same


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The counts of ``COUNTS`` and the shares of ``SHARES``; null is an empty text."""
    text = text or b""
    words = text.split()
    n = len(words)
    chars = sum(len(w) for w in words) - (0 if text.isascii() else len(text.translate(None, bytes([*range(128), *range(192, 256)]))))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dups = len(lines) - len(set(lines))
    repeats, same = _repeat_words(words)
    letters = len(text) - len(text.translate(None, _LETTERS))
    capitals = len(text) - len(text.translate(None, _UPPER))
    shares = [
        symbols / max(1, n),
        dups / max(1, len(lines)),
        repeats / max(1, n),
        capitals / max(1, letters),
        text.count(b"!") / max(1, n),
        same / max(1, n - 1),
    ]
    return [n, chars, symbols, dups, repeats], shares


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Too few words, or too many of them in repeated windows. ``counts``: rows of ``COUNTS``."""
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])


@dataclass
class Forest:
    """Trees as complete binary arrays: node k has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    expected: float

    @classmethod
    def grow(
        cls, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, rows_per_tree: int = ROWS_PER_TREE, seed: int = 9
    ) -> Forest:
        """Each split is uniform in its node's box, which begins as the range of all documents.

        So a value that the sample lacks falls into an empty child after few splits.
        """
        rng = np.random.default_rng(seed)
        size = 2 ** (DEPTH + 1) - 1
        feature, split = np.zeros((trees, size), np.int16), np.full((trees, size), np.inf)
        path, usable = np.zeros((trees, size)), np.flatnonzero(high > low)
        for t in range(trees):
            own = rows[rng.permutation(len(rows))[:rows_per_tree]]
            stack = [(0, own, low.copy(), high.copy(), 0)]
            while stack:
                node, x, lo, hi, d = stack.pop()
                if d == DEPTH or len(x) <= 1 or not len(usable):
                    # An infinite split leads down the left side: the last node there has the path.
                    path[t, (node + 1) * 2 ** (DEPTH - d) - 1] = d + expected_path(len(x))
                    continue
                f = rng.choice(usable)
                feature[t, node], split[t, node] = f, rng.uniform(lo[f], hi[f])
                left = x[:, f] <= split[t, node]
                below, above = hi.copy(), lo.copy()
                below[f] = above[f] = split[t, node]
                stack += [(2 * node + 1, x[left], lo, below, d + 1), (2 * node + 2, x[~left], above, hi, d + 1)]
        return cls(feature, split, path, expected_path(min(rows_per_tree, len(rows))) or 1.0)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path over the expected one: near 1 is set apart quickly."""
        total, at_row = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[at_row, feature[node]] > split[node])
            total += path[node]
        return 2.0 ** (-total / len(self.path) / self.expected)


def expected_path(n: int) -> float:
    """Mean path of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the counts and the shares of every row; a null text has no words."""
    import pyarrow as pa


    def run(batches):
        for batch in bounded(batches, 1):
            found = [statistics(x) for x in texts_of(batch)]
            counts = [pa.array([c[k] for c, _ in found], pa.int64()) for k in range(len(COUNTS))]
            shares = [pa.array([s[k] for _, s in found], pa.float64()) for k in range(len(SHARES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, *shares], ["id", *COUNTS, *SHARES])

    kind = docs.schema[id_col].dataType.simpleString()
    columns = [f"id {kind}", *(f"{c} bigint" for c in COUNTS), *(f"{c} double" for c in SHARES)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(columns)).withColumnRenamed("id", id_col)


def _features(shares: np.ndarray) -> np.ndarray:
    return np.sqrt(np.minimum(shares, 1.0))


@dataclass
class QualityModel:
    forest: Forest
    threshold: float

    def keep(self, counts: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which rows fail the base rules, their scores, and which are kept."""
        failed = base_failed(counts)
        scores = self.forest.score(_features(shares))
        return failed, scores, ~failed & (scores <= self.threshold)


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", seed: int = 9, loss: float = LOSS) -> QualityModel:
    """Grow the forest and calibrate its threshold. ``stats`` should be a written table.

    The forest sees at most ``TREES * ROWS_PER_TREE`` documents labelled as good, those with the smallest
    seeded hash; without any, the same number of unlabelled ones. The threshold is the smallest score (in
    steps of 1 / ``BINS``) above which at most ``loss`` of all good labelled documents lie; without labels
    nothing is rejected by score. Labels that are null or belong to no document have no effect.
    """
    good = labels.where("quality = 1").select(id_col).distinct()
    marked = stats.join(good, id_col, "left_semi")
    limits = stats.agg(*[f(c) for c in SHARES for f in (F.min, F.max)]).first()
    low, high = (_features(np.array([limits[2 * k + i] or 0.0 for k in range(len(SHARES))])) for i in (0, 1))

    def sample(rows: DataFrame) -> np.ndarray:
        most, n = TREES * ROWS_PER_TREE, rows.count()
        u = F.xxhash64(F.lit(seed), id_col)
        if n > 2 * most:  # leaves about twice as many rows to order
            rows = rows.where(F.shiftrightunsigned(u, 1) < int(2**63 * min(1.0, 2 * most / n)))
        return _features(rows.orderBy(u, *COUNTS).limit(most).select(*SHARES).toPandas().to_numpy(float))

    rows = sample(marked)
    if not len(rows):
        rows = sample(stats)
    model = QualityModel(Forest.grow(rows.reshape(-1, len(SHARES)), low, high, seed=seed), float("inf"))
    bins = (
        scored(marked, model, id_col)
        .groupBy(F.ceil(F.col("score") * BINS).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("bin"))
        .collect()
    )
    allowed = loss * sum(r["n"] for r in bins)
    for r in bins:
        allowed -= r["n"]
        if allowed < 0:
            model.threshold = r["bin"] / BINS
            break
    return model


def scored(stats: DataFrame, model: QualityModel, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, the counts, ``base_failed``, ``score`` and ``kept`` of every row of ``stats``."""
    import pyarrow as pa

    names = [id_col, *COUNTS, "base_failed", "score", "kept"]

    def run(batches):
        for batch in batches:
            values = [batch.column(k).to_numpy() for k in range(1, 1 + len(COUNTS) + len(SHARES))]
            counts = np.stack(values[: len(COUNTS)], 1).reshape(-1, len(COUNTS))
            failed, scores, kept = model.keep(counts, np.stack(values[len(COUNTS) :], 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + len(COUNTS)], pa.array(failed), pa.array(scores), pa.array(kept)], names)

    kind = stats.schema[id_col].dataType.simpleString()
    columns = [f"`{id_col}` {kind}", *(f"{c} bigint" for c in COUNTS), "base_failed boolean", "score double", "kept boolean"]
    return stats.select(id_col, *COUNTS, *SHARES).mapInArrow(run, ", ".join(columns))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base rules, anomaly score and verdict of every row, repeated ones and those without an id included.

    A null id belongs to no label and is judged like any other; a null or empty text fails the base rules. Very long texts are
    counted whole; an empty table gives no rows.
    """
    stats = written(rule_statistics(docs, id_col, text_col), "rule-statistics")
    return scored(stats, fit(stats, labels, id_col), id_col)


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, which may have any names.

    Statistics are made once, where the text lies, and written next to the row; the verdict reads them there.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"))
    at = docs.columns.index(text_col)
    names = [*COUNTS, *SHARES]
    kinds = [T.LongType()] * len(COUNTS) + [T.DoubleType()] * len(SHARES)
    schema = T.StructType([packed.schema["row"], T.StructField("id", packed.schema["id"].dataType), *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]])

    def run(batches):
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(0).flatten()[at].cast(pa.string())], ["text"])
            found = [statistics(x) for part in bounded([texts], 0) for x in texts_of(part)]
            counts = [pa.array([c[k] for c, _ in found], pa.int64()) for k in range(len(COUNTS))]
            shares = [pa.array([s[k] for _, s in found], pa.float64()) for k in range(len(SHARES))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts, *shares], ["row", "id", *names])

    rows = written(packed.mapInArrow(run, schema), "rule-statistics")
    model = fit(rows.select(F.col("id").alias(id_col), *names), labels, id_col)

    def keep(batches):
        for batch in batches:
            values = [batch.column(1 + k).to_numpy() for k in range(len(names))]
            counts = np.stack(values[: len(COUNTS)], 1).reshape(-1, len(COUNTS))
            _, _, kept = model.keep(counts, np.stack(values[len(COUNTS) :], 1))
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["row"]).filter(pa.array(kept))

    return rows.select("row", *names).mapInArrow(keep, T.StructType([packed.schema["row"]])).select("row.*")
