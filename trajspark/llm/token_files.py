"""Token ids of a corpus as concatenated arrays with Elias-Fano document boundaries.

File format: a Parquet folder of segments, so that Spark's commit protocol, any file system and lost
executors are covered. A segment holds consecutive documents:

    part, seg     position: parts in order of ids, segments in order inside a part
    doc_ids       array<bigint>
    n_ids         number of token ids
    ids           little-endian ids, 2 bytes each if the vocabulary allows, else 4 (``width``)
    low_bits      bits of a boundary that are kept as they are
    low           those bits of all boundaries, packed
    high          the other bits: boundary i sets bit (boundary >> low_bits) + i
    samples       32-bit places of every 256th set bit of ``high``

The boundaries (ends of the documents) of ``n`` documents and ``u`` ids take about 2 + log2(u / n) bits
each. ``select`` finds a boundary from the sample before it and a scan of at most 256 set bits; documents are
read through it.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark.llm import bpe
from trajspark.llm.common import bounded, new_path

END_ID = 0
SEGMENT_IDS = 1 << 20
SAMPLE = 256
SCHEMA = (
    "part int, seg int, doc_ids array<bigint>, n_ids bigint, width int, ids binary, "
    "low_bits int, low binary, high binary, samples binary"
)


@dataclass
class EliasFano:
    """A rising sequence of integers (repeats allowed) in near-minimal space."""

    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        values = np.asarray(values, np.int64)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        lows = (values[:, None] >> np.arange(low_bits) & 1).astype(np.uint8)
        at = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1, np.uint8)
        high[at] = 1
        pack = lambda bits: np.packbits(bits, bitorder="little").tobytes()
        return cls(n, low_bits, pack(lows.ravel()), pack(high), at[::SAMPLE].astype("<u4").tobytes())

    def _lows(self, at: np.ndarray) -> np.ndarray:
        places = at[:, None] * self.low_bits + np.arange(self.low_bits)
        raw = np.frombuffer(self.low, np.uint8)
        return (raw[places >> 3] >> (places & 7) & 1).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """Value number ``i``, from 0."""
        return int(self.select_many(np.array([i]))[0])

    def select_many(self, at: np.ndarray) -> np.ndarray:
        """Values with the ascending numbers ``at``: from the sample before each one, set bits are counted on."""
        if not len(at):
            return np.zeros(0, np.int64)
        if at[0] < 0 or at[-1] >= self.n:
            raise IndexError(at)
        samples, raw = np.frombuffer(self.samples, "<u4"), np.frombuffer(self.high, np.uint8)
        block, out = at // SAMPLE, []
        for own in np.split(at, np.flatnonzero(np.diff(block)) + 1):
            k = int(own[0]) // SAMPLE
            place, after = int(samples[k]), k + 1 < len(samples)
            bits = np.unpackbits(raw[place // 8 : int(samples[k + 1]) // 8 + 1 if after else len(raw)], bitorder="little")
            bits[: place % 8] = 0
            ones = np.flatnonzero(bits)[own - k * SAMPLE] + place // 8 * 8
            out.append((ones - own) << self.low_bits)
        return np.concatenate(out) | self._lows(at)


def write_token_ids(
    docs: DataFrame,
    out: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    end_id: int = END_ID,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Encode every whole text, add ``end_id`` to each and write them in ascending order of ids.

    Texts are encoded where they lie, and only ids are shuffled; a table with fewer splits than there are cores is dealt out
    first. Very long texts are encoded whole, as trees of halves. Null ids come first, repeated ids in the order
    of a hash of their token ids; a null or empty text gives the end id alone. An empty table gives a folder
    without segments.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    path = path or bpe.default_path()
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    bounds = _bounds(rows, n_parts)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)
    names = [field.split()[0] for field in SCHEMA.split(", ")]

    def encode(batches):
        from xxhash import xxh64_intdigest

        c = bpe.codec(path)
        kind = f"<u{_width(c)}"
        for batch in bounded(batches, 1):
            ids = batch.column(0)
            found = [np.append(x, np.uint32(end_id)).astype(kind).tobytes() for x in c.encode_batch(batch.column(1).to_pylist())]
            mixed = np.array([xxh64_intdigest(x) for x in found], np.uint64) >> np.uint64(1)
            parts = _part_of(ids.fill_null(_NULL).to_numpy(), mixed, bounds)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), ids, pa.array(mixed.astype(np.int64)), pa.array(found, pa.binary())], ["part", "id", "mixed", "ids"])

    def write(batches):
        part, seg = TaskContext.get().partitionId(), 0
        width = _width(bpe.codec(path))
        held: list = []

        def segment():
            nonlocal seg
            ends = np.cumsum([len(x) // width for _, x in held])
            bounds = EliasFano.of(ends)
            row = [part, seg, [i for i, _ in held], int(ends[-1]), width, b"".join(x for _, x in held), bounds.low_bits, bounds.low, bounds.high, bounds.samples]
            seg += 1
            held.clear()
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        size = 0
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and size + len(x) > segment_ids * width:
                    yield segment()
                    size = 0
                held.append((i, x))
                size += len(x)
        if held:
            yield segment()

    encoded = rows.mapInArrow(encode, "part int, id bigint, mixed bigint, ids binary")
    dealt = encoded.repartitionById(n_parts, "part").sortWithinPartitions("id", "mixed", "ids").select("id", "ids")
    dealt.mapInArrow(write, SCHEMA).write.parquet(out)


#: Stands for a null id, which comes first, in comparisons.
_NULL = -(2**63)


def _width(c: bpe.Codec) -> int:
    return 2 if c.size <= 1 << 16 else 4


def _bounds(rows: DataFrame, n_parts: int) -> np.ndarray:
    """About equally many ids lie between each two bounds; an id with very many rows is several bounds."""
    shares = [k / n_parts for k in range(1, n_parts)]
    if not shares:
        return np.zeros(0, np.int64)
    found = rows.agg(F.percentile_approx(F.coalesce("id", F.lit(_NULL)), shares, max(10_000, 20 * n_parts)).alias("b")).first()["b"]
    return np.array(found or [], np.int64)


def _part_of(ids: np.ndarray, mixed: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The part of each row, rising with (id, mixed): an id that is several bounds is dealt by the hash."""
    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    return low + (mixed.astype(np.float64) / 2.0**63 * (high - low + 1)).astype(np.int64).clip(0, high - low)


def read_token_ids(spark: SparkSession, out: str) -> DataFrame:
    """Documents of the written files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``."""
    import pyarrow as pa

    segments = spark.read.schema(SCHEMA).parquet(out)
    # One row a segment, then one a part: no window sees documents.
    sizes = segments.select("part", "seg", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("k"))
    parts = parts.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("of_part"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seg")) - F.col("n_ids")
    offsets = sizes.withColumn("of_seg", within).join(parts, "part")
    offsets = offsets.select("part", "seg", (F.col("of_part") + F.col("of_seg")).alias("before"))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n = len(r["doc_ids"])
                ends = EliasFano(n, r["low_bits"], r["low"], r["high"], r["samples"]).select_many(np.arange(n))
                starts = np.concatenate([[0], ends[:-1]])
                ids = np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4")
                sums = [zlib.crc32(ids[b:e].tobytes()) for b, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["part"]] * n, pa.int32()),
                        pa.array([r["seg"]] * n, pa.int32()),
                        pa.array(r["doc_ids"], pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(ends - starts, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    ["part", "seg", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    docs = segments.mapInArrow(run, "part int, seg int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(offsets, ["part", "seg"]).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_file_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the files to the shared folder and read every document back from them."""
    spark = docs.sparkSession
    out = new_path(spark, "token-ids")
    write_token_ids(docs, out, id_col, text_col, path)
    return read_token_ids(spark, out).withColumnRenamed("doc_id", id_col)
