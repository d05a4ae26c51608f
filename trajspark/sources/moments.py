"""Training statistics that are kept up to date as files come, change and go.

A store holds partial moments by file, with the file's length and change time, in a folder for each set of settings. An
update reads the files that are new or changed and nothing else; those of files that are gone are left out. Each update
is a version of its own, complete once Spark has marked it so.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.functions.hashing import split_name
from trajspark.operators import stats, validate
from trajspark.sources import outputs
from trajspark.sources.trajectories import read_trajectories
from trajspark.spec import TrajectorySpec

_SAME = ["path", "length", "modified"]
SCHEMA = f"{outputs.FILES}, key string, n long, mean double, m2 double, min double, max double"


def folder_of(store: str, spec: TrajectorySpec) -> str:
    """Where a store has the moments for these settings; others would keep other rows."""
    text = json.dumps(outputs.settings_of(spec), sort_keys=True)
    return f"{store}/{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions."""
    names = outputs.names_in(spark, folder)
    return sorted(int(n.removeprefix("v")) for n in names if n.startswith("v") and outputs.exists(spark, f"{folder}/{n}/_SUCCESS"))


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """The partials of the latest version; of none, an empty table. A file without training rows has one row without a key."""
    found = _versions(spark, folder)
    return spark.read.schema(SCHEMA).parquet(f"{folder}/v{found[-1]}") if found else spark.createDataFrame([], SCHEMA)


def fresh_files(spark: SparkSession, folder: str, inputs: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The files there are, and the paths of those that the store does not know as they are now."""
    files = outputs.listed(spark, inputs)
    fresh = files.join(read_store(spark, folder), _SAME, "left_anti").select("path").orderBy("path").collect()  # names of files that changed
    return files, [r["path"] for r in fresh]


def partials_of(spark: SparkSession, paths: list[str], spec: TrajectorySpec) -> DataFrame:
    """Moments of the training rows by file (``path``) and species; only ``paths`` are read."""
    raw = read_trajectories(spark, paths, spec).select("*", F.col("_metadata.file_path").alias("path"))
    valid = validate.checked_lengths(validate.classify(raw, spec).where("reason = 'valid'"), spec)
    kept = validate.with_fate(valid, spec).where("fate = 'kept'")
    train = kept.where(split_name(spec.seed, spec.val_fraction, spec.test_fraction) == "train")
    return stats.partial_statistics(train, spec, "path")


def update(spark: SparkSession, store: str, inputs: Sequence[str], spec: TrajectorySpec) -> DataFrame:
    """Bring the store to the files below ``inputs`` and return the statistics over all of them, by ``key``."""
    folder = folder_of(store, spec)
    files, fresh = fresh_files(spark, folder, inputs)
    before = read_store(spark, folder)
    stay = before.join(files, _SAME, "left_semi")
    gone = before.select(*_SAME).join(files, _SAME, "left_anti")
    if fresh or not gone.isEmpty():
        if fresh:
            new = files.join(before, _SAME, "left_anti").join(partials_of(spark, fresh, spec), "path", "left")
            stay = stay.unionByName(new)
        last = _versions(spark, folder)
        version = last[-1] + 1 if last else 1
        if outputs.exists(spark, f"{folder}/v{version}"):  # of an update that did not end
            outputs.removed(spark, f"{folder}/v{version}")
        stay.select("path", "length", "modified", "key", "n", "mean", "m2", "min", "max").write.parquet(f"{folder}/v{version}")
    return stats.merge_statistics(read_store(spark, folder).where("n > 0"))
