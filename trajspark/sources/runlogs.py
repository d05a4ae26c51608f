"""Metrics logs as nested JSON lines, with the place of each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PART = "struct<loss: double, phys: double, z: double, mult_err_proxy: double>"
SCHEMA = f"epoch long, lr double, train {_PART}, val {_PART}, best_val_loss double"
#: The folder that holds a log is its run.
RUN = r"([^/]+)/[^/]+$"


def read_lines(spark: SparkSession, path: str, run: str = RUN) -> DataFrame:
    """All lines of text files: ``run_id``, ``file``, ``seq``, ``value``.

    ``run`` is a pattern whose group finds the run in a file's path. ``seq`` counts a run's lines from 1, its files in the
    order of their paths, blank lines included. Files are read in splits; inside a split lines are in order,
    and the lines of the splits and files before it are added. So numbers depend neither on splits nor on tasks. The
    files are read twice.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("at"), "value"
    )
    rows = rows.withColumn("run_id", F.regexp_extract("file", run, 1))
    splits = rows.groupBy("run_id", "file", "begin").agg(F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(Window.partitionBy("run_id").orderBy("file", "begin")) - F.col("k")  # a row for each split of a run
    splits = splits.select("run_id", "file", "begin", before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("run_id", "file", "begin").orderBy("at"))  # the lines of one split
    numbered = rows.withColumn("nth", nth).join(splits, ["run_id", "file", "begin"])
    return numbered.select("run_id", "file", (F.col("before") + F.col("nth")).alias("seq"), "value")


def read_metrics(spark: SparkSession, path: str, run: str = RUN) -> DataFrame:
    """All records of all runs, with ``run_id`` and ``seq``; blank lines are skipped. A line that is no such object or lacks its epoch is an error."""
    lines = read_lines(spark, path, run).where(F.col("value").rlike(r"\S"))
    where = F.concat(F.col("file"), F.lit(", line "), F.col("seq").cast("string"))

    def or_error(ok, value, kind: str, text: str):
        return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(text), where)).cast(kind))

    text = or_error(F.col("value").rlike(r"^\s*\{"), F.col("value"), "string", "not an object: ")
    parsed = lines.withColumn("r", F.from_json(text, SCHEMA, {"mode": "FAILFAST", "allowNonNumericNumbers": "true"}))
    epoch = or_error(F.col("r.epoch").isNotNull(), F.col("r.epoch"), "long", "no epoch: ")
    rows = parsed.select("run_id", "seq", epoch.alias("epoch"), "r.lr", "r.train", "r.val", "r.best_val_loss")
    if rows.isEmpty():
        raise ValueError(f"no metrics in {path}")
    return rows
