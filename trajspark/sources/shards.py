"""Shards of prepared trajectories: Parquet by split, an index, and NPZ files for exchange."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.functions.hashing import trajectory_hash
from trajspark.operators.numbering import with_row_numbers
from trajspark.operators.validate import increasing
from trajspark.sources.trajectories import KEY
from trajspark.spec import DTYPES, TrajectorySpec


def dense(traj: DataFrame, spec: TrajectorySpec) -> DataFrame:
    """``y`` as ``[T][S]`` and ``g`` as ``[G]`` in storage types, next to time, key and split."""
    v, t = DTYPES[spec.value_dtype], DTYPES[spec.time_dtype]
    steps = F.transform(F.arrays_zip(*spec.species), lambda p: F.array(*[p[s] for s in spec.species]))
    y = (steps if len(spec.species) > 1 else F.transform(spec.species[0], lambda x: F.array(x))).cast(f"array<array<{v}>>")
    g = F.array(*[F.col(x) for x in spec.globals]).cast(f"array<{v}>")
    time = F.col(spec.time).cast(f"array<{t}>")
    ok = increasing(time.cast("array<double>"))
    time = F.when(ok, time).otherwise(F.raise_error(F.lit("stored times do not increase")).cast(f"array<{t}>"))
    return traj.select(*KEY, *(c for c in ("split", "shard") if c in traj.columns), y.alias("y"), g.alias("g"), time.alias(spec.time))


def numbered(kept: DataFrame, spec: TrajectorySpec) -> DataFrame:
    """Adds ``shard``: blocks of ``trajectories_per_shard`` in each split, in the order of the trajectories' hashes."""
    rows = with_row_numbers(kept, trajectory_hash(spec.seed, "order"), KEY, "__n", within=["split"])
    return rows.withColumn("shard", F.expr(f"__n div {spec.trajectories_per_shard}")).drop("__n")


def shard_index(sharded: DataFrame) -> DataFrame:
    return sharded.groupBy("split", "shard").agg(F.count(F.lit(1)).alias("n_trajectories"))


def shard_name(split: str, shard: int) -> str:
    return f"shard_{split}_{shard:05d}"


def write_shards(kept: DataFrame, path: str, spec: TrajectorySpec, overwrite: bool = False) -> None:
    """Parquet with one file for each block of ``numbered``, in folders by split and shard.

    A block has at most ``trajectories_per_shard`` rows, so no split is one task's work. An existing folder is an
    error unless ``overwrite`` is given; so is a table without rows.
    """
    if kept.isEmpty():
        raise ValueError("no trajectory to write")
    rows = dense(numbered(kept, spec), spec).repartition("split", "shard").sortWithinPartitions("split", "shard", trajectory_hash(spec.seed, "order"), *KEY)
    rows.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("split", "shard").parquet(path)


def read_shards(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """All shards as one table, or those of one split."""
    rows = spark.read.parquet(path).withColumns({"split": F.col("split").cast("string"), "shard": F.col("shard").cast("long")})
    return rows if split is None else rows.where(F.col("split") == split)


def file_index(spark: SparkSession, path: str) -> DataFrame:
    """``split``, ``shard``, ``name`` and number of trajectories of each shard that was written."""
    name = F.format_string("shard_%s_%05d", "split", "shard").alias("name")
    return shard_index(read_shards(spark, path)).select("split", "shard", name, "n_trajectories")


def require_shards(shards: DataFrame, spec: TrajectorySpec) -> None:
    """All rows must have one time grid and the configured numbers of species and globals."""
    s = F.transform("y", lambda row: F.size(row))
    row = shards.agg(F.min(spec.time).alias("a"), F.max(spec.time).alias("b"), F.min(F.array_min(s)).alias("s1"), F.max(F.array_max(s)).alias("s2"), F.min(F.size("g")).alias("g1"), F.max(F.size("g")).alias("g2")).first()
    if row["a"] is None:
        raise ValueError("no shard")
    if row["a"] != row["b"]:
        raise ValueError("shards have different time grids")
    if (row["s1"], row["s2"]) != (len(spec.species),) * 2 or (row["g1"], row["g2"]) != (len(spec.globals),) * 2:
        raise ValueError(f"shards have {row['s2']} species and {row['g2']} globals")


NPZ_SCHEMA = "file string, row int, y array<array<double>>, g array<double>, time array<double>"


def read_npz(spark: SparkSession, path: str, y: str = "y_mat", g: str = "globals", time: str = "t_vec") -> DataFrame:
    """One row a trajectory from ``.npz`` files with ``[N, T, S]``, ``[N, G]`` and ``[T]``; files are read by tasks."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with np.load(io.BytesIO(content)) as f:
                    values, extra, grid = f[y], f[g], f[time].astype(float).reshape(-1)
                if values.ndim != 3:
                    raise ValueError(f"{name}: {y} has {values.ndim} dimensions")
                for k in range(0, len(values), 256):
                    n = len(values[k : k + 256])
                    yield pd.DataFrame({"file": name.rsplit("/", 1)[-1], "row": np.arange(k, k + n), "y": [[list(r) for r in m] for m in values[k : k + n].astype(float)], "g": list(extra[k : k + n].astype(float)), "time": [grid] * n})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)
    return files.select("path", "content").mapInPandas(run, NPZ_SCHEMA)


def npz_blobs(sharded: DataFrame, spec: TrajectorySpec) -> DataFrame:
    """``split``, ``shard``, ``name``, ``content``: each shard as the bytes of an ``.npz`` file.

    A shard holds at most ``trajectories_per_shard`` rows, so a group is bounded.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(KEY)
        out = io.BytesIO()
        np.savez(out, y_mat=np.array([[list(r) for r in m] for m in pdf["y"]], np.float32), globals=np.array(list(pdf["g"]), np.float32), t_vec=np.array(pdf[spec.time].iloc[0]))
        split, shard = pdf["split"].iloc[0], int(pdf["shard"].iloc[0])
        return pd.DataFrame({"split": [split], "shard": [shard], "name": [f"{shard_name(split, shard)}.npz"], "content": [out.getvalue()]})

    return dense(sharded, spec).groupBy("split", "shard").applyInPandas(one, "split string, shard long, name string, content binary")
