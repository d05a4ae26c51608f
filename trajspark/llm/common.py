"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of texts, that a task works on together. Spark itself bounds the bytes of an Arrow batch.
SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(batches, at: int, most: int = SLICE_BYTES) -> Iterator:
    """Slices of Arrow batches with at most ``SLICE_ROWS`` rows and ``most`` bytes of the texts in column ``at``,
    or one row. Empty batches are left out."""
    import pyarrow.compute as pc

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        ends, begin = np.cumsum(lengths), 0
        while begin < len(ends):
            before = int(ends[begin - 1]) if begin else 0
            end = min(int(np.searchsorted(ends, before + most, "right")), begin + SLICE_ROWS)
            end = max(end, begin + 1)
            yield batch.slice(begin, end - begin)
            begin = end


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in one process, a temporary folder is made once.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``SLICE_BYTES`` at most for the jobs inside; the session's own bound is put back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(SLICE_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write once to the shared folder and read back, so that later uses do not compute it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_hash(df: DataFrame, *seeds):
    """A 64-bit hash of all columns; equal rows have equal hashes. Maps are hashed as JSON."""
    plain = [F.to_json(F.struct(c)) if "map<" in t else F.col(c) for c, t in ((f"`{n}`", t) for n, t in df.dtypes)]
    return F.xxhash64(*map(F.lit, seeds), *plain)


def row_digest(df: DataFrame, seed: int):
    """MD5 (hex) of the seed and all columns as text, null as ``\\N``, joined by U+001F; nested columns as JSON."""
    nested = ("map<", "array<", "struct<")
    texts = [F.to_json(F.struct(c)) if t.startswith(nested) else F.col(c).cast("string") for c, t in ((f"`{n}`", t) for n, t in df.dtypes)]
    return F.md5(F.concat_ws("\u001f", F.lit(str(seed)), *[F.coalesce(t, F.lit("\\N")) for t in texts]))


def ascii_lower(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_chunks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order, in lists made from about ``size`` bytes each."""
    if len(text) <= size:
        yield text.split()
        return
    begin, end = 0, len(text)
    while begin < end:
        to = SPACE.search(text, min(begin + size, end))
        stop = to.start() if to else end
        yield text[begin:stop].split()
        begin = stop


def texts_of(batch, name: str = "text") -> list[bytes | None]:
    """UTF-8 texts of an Arrow batch."""
    import pyarrow as pa

    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()
