"""Resampling of documents towards a target distribution, by importance weights over hashed n-grams.

Runs of one and two words fall into buckets; how often the target and the documents fill a bucket makes its
gain, and a document's weight is the mean gain of its runs. Weights with Gumbel noise drawn from a hash of the
id are sampling without replacement in proportion to the weights' exponentials.

In a task, n-grams of a batch are interned in an open-addressed NumPy table: XXH64 keys, linear probing, and
bytes compared before a slot is shared. Slots hold the bucket (so a CRC is made once for each distinct n-gram)
and the count; the slot of each occurrence then gathers gains. What leaves a task in the first pass is one
count for each bucket, in the second one row for each document. No task or driver holds more than a batch and
the buckets.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark.llm.common import bounded, row_hash, small_batches, texts_of, word_chunks, written

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 7, 20, 25
#: Occurrences that a table interns at a time.
OCCURRENCES = 1 << 18
#: Lower-cases A-Z; digits, letters and bytes of other characters stay, all else becomes a space.
_PLAIN = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def intern(grams: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each occurrence in an open-addressed table, and for each slot the occurrence that it holds.

    A slot holds one n-gram: one with the same hash but other bytes goes on to a later slot.
    """
    size = 1 << max(4, (2 * len(grams)).bit_length())
    held, slots = np.full(size, -1), np.empty(len(grams), np.int64)
    found = np.empty(len(grams), object)
    found[:] = grams
    waiting, at = np.arange(len(grams)), (hashes & np.uint64(size - 1)).astype(np.int64)
    while len(waiting):
        free = held[at] < 0
        held[at[free][::-1]] = waiting[free][::-1]  # the first of several takes a slot
        first = held[at]
        same = hashes[first] == hashes[waiting]
        same[same] = (found[first[same]] == found[waiting[same]]).astype(bool)
        slots[waiting[same]] = at[same]
        waiting, at = waiting[~same], (at[~same] + 1) & (size - 1)
    # Slots are numbered anew, without the free ones.
    used = np.flatnonzero(held >= 0)
    number = np.empty(size, np.int64)
    number[used] = np.arange(len(used))
    return number[slots], held[used]


class Table:
    """Interned n-grams of a batch: ``slots`` by occurrence; ``bucket`` and ``count`` by slot."""

    def __init__(self, grams: list[bytes], buckets: int):
        from xxhash import xxh64_intdigest

        self.slots, held = intern(grams, np.fromiter(map(xxh64_intdigest, grams), np.uint64, len(grams)))
        self.bucket = np.fromiter((zlib.crc32(grams[i]) % buckets for i in held.tolist()), np.int64, len(held))
        self.count = np.bincount(self.slots, minlength=len(held))

    def counts(self, buckets: int) -> np.ndarray:
        total = np.zeros(buckets, np.int64)
        np.add.at(total, self.bucket, self.count)
        return total

    def gathered(self, gains: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sums of gains over the occurrences up to each of ``ends`` from the end before."""
        sums = np.concatenate([[0], gains[self.bucket][self.slots].cumsum()])[ends]
        return np.diff(sums, prepend=0)


def _runs(text: bytes | None):
    """Runs of one and two words of a text, and how many words they came from, in bounded lists."""
    last: list[bytes] = []
    for words in word_chunks((text or b"").translate(_PLAIN)):
        joined = last + words
        yield [*words, *map(b" ".join, zip(joined, joined[1:], strict=False))], len(words)
        last = joined[-1:]


def _tables(texts, buckets: int):
    """Tables over texts in order, each with the texts that it covers as (place, words, end of its occurrences)."""
    grams, covered = [], []
    for i, text in enumerate(texts):
        for found, words in _runs(text):
            grams += found
            covered.append((i, words, len(grams)))
            if len(grams) >= OCCURRENCES:
                yield Table(grams, buckets), covered
                grams, covered = [], []
    if covered:
        yield Table(grams, buckets), covered


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of one and two words fall into each bucket, over all rows. Null texts have none."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in bounded(batches, 0):
            for t, _ in _tables(texts_of(batch), buckets):
                total += t.counts(buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    slim = texts.select(F.col(text_col).cast("string").alias("text"))
    out = np.zeros(buckets, np.int64)
    with small_batches(texts.sparkSession):
        for r in slim.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-ratio of a bucket's smoothed share in the target and in the source, rounded down."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = [float(t + 1) * float(s_all + buckets) / (float(s + 1) * float(t_all + buckets)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(name: str, seed: int = SEED) -> int:
    """Thousandths of a Gumbel draw that depends on the seed and the id's text alone, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, key: str | None = None) -> DataFrame:
    """``id``, ``n_words``, ``n_features``, ``weight`` and ``score`` of every row, and ``key``, a text column, if one is named."""
    import pyarrow as pa

    buckets = len(gains)

    def run(batches):
        for batch in bounded(batches, 1):
            words, runs, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for t, covered in _tables(texts_of(batch), buckets):
                at, n, ends = np.array(covered, np.int64).T
                np.add.at(words, at, n)
                np.add.at(runs, at, np.diff(ends, prepend=0))
                np.add.at(total, at, t.gathered(gains, ends))
            weight = total // np.maximum(runs, 1)
            score = weight + np.array([noise(x, seed) for x in batch.column(2).to_pylist()], np.int64)
            columns = [batch.column(0), *map(pa.array, (words, runs, weight, score)), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_features", "weight", "score", *(["key"] if key else [])])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"),
        *([F.col(key).alias("key")] if key else []),
    )
    return rows.mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint{', key string' if key else ''}")


def _ranked(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """``scored`` with the ``rank`` of drawn rows, from 1; null for others.

    Rows are dealt by ranges of (score, id) and sorted there; sizes of the ranges before a row's own make its
    rank. So equal scores, however many, are spread over tasks.
    """
    order = [F.desc("score"), F.asc_nulls_last("id"), "n_features", "weight", *(["key"] if "key" in scored.columns else [])]
    may = scored.where(F.col("n_words") >= least_words)
    placed = may.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = written(placed, "ranges")
    part, nth = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row for each range
    starts, total = [], 0
    for r in sizes:
        starts.append((r.part, total))
        total += r.n
    drawn = percent * total // 100
    if not starts:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    spark = scored.sparkSession
    before = F.broadcast(spark.createDataFrame(starts, "part bigint, before bigint"))
    ranks = placed.withColumn("part", part).join(before, "part").withColumn("rank", F.col("before") + nth + 1)
    ranks = ranks.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranks.select(*rest.columns).union(rest)


def _scored(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_col: str, buckets: int, seed: int, key: str | None = None) -> DataFrame:
    gains = bucket_gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    return written(score_documents(docs, gains, id_col, text_col, seed, key), "importance")


def importance_ranks(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """``id_col``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row.

    Of the rows with at least ``least_words`` words, ``percent`` per cent (rounded down) with the highest scores
    are drawn and ranked from 1, equal scores by id; other ranks are null. Null and empty texts have no words,
    no features and the weight 0; an empty target leaves all to the smoothing. Very long texts pass in pieces of
    1 MB. A row without an id draws its noise from the empty text and follows the others of its score. Repeated
    rows have equal scores and ranks of their own. Empty tables give no rows. No other column is read.
    """
    scored = _scored(docs, target, id_col, text_col, target_col, buckets, seed)
    return _ranked(scored, least_words, percent).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """The drawn documents themselves, with all columns of ``docs`` under any names; ranks as in ``importance_ranks``."""
    key = F.md5(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in (id_col, text_col)]))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), key.alias("key"))
    ranked = _ranked(_scored(slim, target, "id", "text", target_col, buckets, seed, "key"), least_words, percent)
    drawn = ranked.where("rank is not null").groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"), row_hash(docs).alias("whole")).join(drawn, "key")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("whole"))
    return rows.withColumn("nth", nth).where("nth <= copies").select("row.*")
