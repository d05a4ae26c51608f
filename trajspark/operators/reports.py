"""Counts about a run: scan, drops, splits, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.operators.validate import REASONS, fate
from trajspark.spec import DTYPES, TrajectorySpec


def _scan_columns() -> list:
    counts = [F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in REASONS]
    return [F.count(F.lit(1)).alias("n_total"), *counts, F.min("min_dt").alias("min_forward_dt"), F.max("max_dt").alias("max_forward_dt")]


def scan_report(classified: DataFrame) -> DataFrame:
    """Per file: trajectories by reason, and the range of steps in time over all that passed the time rules."""
    return classified.groupBy("file_id").agg(*_scan_columns())


def scan_overall(classified: DataFrame) -> DataFrame:
    """The same per file and, with a null file, over all, in one pass."""
    return classified.rollup("file_id").agg(*_scan_columns())


def drop_counts() -> list[Column]:
    """Aggregates over rows with ``reason`` and ``fate``: what was read, why trajectories were dropped, and what is left."""
    is_valid = F.col("reason") == "valid"

    def count(*fates: str):
        return F.count_if(is_valid & F.col("fate").isin(*fates))

    valid = F.count_if(is_valid)
    dropped = count("unused", "nonfinite", "below_threshold", "nonfinite_global")
    return [
        F.count(F.lit(1)).alias("n_total"),
        (valid - dropped).alias("n_valid"),
        (F.count(F.lit(1)) - valid + dropped).alias("n_dropped"),
        (F.count_if(F.col("reason") == "nan_time") + count("nonfinite", "nonfinite_global")).alias("n_nan"),
        count("below_threshold").alias("n_below_threshold"),
        count("unused").alias("n_unused"),
    ]


def drop_report(classified: DataFrame, spec: TrajectorySpec) -> DataFrame:
    """One row with ``drop_counts``, in one pass."""
    fated = classified.select("reason", F.when(F.col("reason") == "valid", fate(spec)).alias("fate"))
    return fated.agg(*drop_counts())


def size_estimate(kept: DataFrame, spec: TrajectorySpec) -> DataFrame:
    """Bytes of the time grid and of all stored values."""
    width = 4 if DTYPES[spec.value_dtype] == "float" else 8
    return kept.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(spec.time)).alias("t")).select(
        "n", "t", (8 * F.col("t") + F.col("n") * F.col("t") * F.lit(len(spec.species) * width)).alias("bytes")
    )
