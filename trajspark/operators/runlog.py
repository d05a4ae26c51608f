"""Histories of training runs: the last record of each epoch, the best so far, clean curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.scalars import NAN, is_finite, safe_float


def last_per_epoch(log: DataFrame) -> DataFrame:
    """Of several records of a run's epoch the last by ``seq``."""
    rest = [c for c in log.columns if c not in ("run_id", "epoch")]
    return log.groupBy("run_id", "epoch").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("run_id", "epoch", "r.*")


def best_so_far(log: DataFrame, value: str = "val_loss", epochs: int = 1000) -> DataFrame:
    """Adds ``best`` up to each epoch and whether the epoch is better than infinity and all before it; NaN is never better.

    Windows see ``epochs`` epochs of a run; the minima of the ranges before them are carried on.
    """
    x = F.when(F.isnan(value), F.lit(None)).otherwise(F.col(value))
    rows = log.withColumn("_range", F.floor(F.col("epoch") / epochs))
    ranges = rows.groupBy("run_id", "_range").agg(F.min(x).alias("_least"))
    earlier = F.min("_least").over(Window.partitionBy("run_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    joined = rows.join(ranges.select("run_id", "_range", earlier.alias("_earlier")), ["run_id", "_range"])
    w = Window.partitionBy("run_id", "_range").orderBy("epoch")
    before = F.least("_earlier", F.min(x).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    best = F.least("_earlier", F.min(x).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    better = F.coalesce(x < F.coalesce(before, F.lit(float("inf"))), F.lit(False))
    return joined.withColumns({"best": best, "improved": better}).select(*log.columns, "best", "improved")


def curve(log: DataFrame, train: str = "train_loss", val: str = "val_loss") -> DataFrame:
    """Epochs from 1 with a finite positive training loss; a validation loss that is not is NaN."""
    t, v = safe_float(F.col(train).cast("string")), safe_float(F.col(val).cast("string"))
    return log.where(is_finite(t) & (t > 0)).select("run_id", (F.col("epoch") + 1).alias("epoch"), t.alias(train), F.when(is_finite(v) & (v > 0), v).otherwise(F.lit(NAN)).alias(val))


def require_curve(log: DataFrame) -> DataFrame:
    out = curve(log)
    if out.isEmpty():
        raise ValueError("the log has no epoch with a usable training loss")
    return out
