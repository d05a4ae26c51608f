"""Trajectories as packed rows (one each), as steps (one for each point) and in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.spec import TrajectorySpec

KEY = ["file_id", "group_id"]


def read_trajectories(spark: SparkSession, paths: str | list[str], spec: TrajectorySpec) -> DataFrame:
    """Packed trajectories from Parquet; a missing variable reads as null, which the scan reports."""
    return spark.read.schema(spec.schema).parquet(*([paths] if isinstance(paths, str) else paths))


def flat_column(x: Column) -> Column:
    """A variable kept as ``[T][1]`` as ``[T]``."""
    return F.transform(x, lambda row: F.when(F.size(row) == 1, row[0]).otherwise(F.raise_error(F.lit("a variable must have one value a step")).cast("double")))


def pack(points: DataFrame, spec: TrajectorySpec, order_by: str) -> DataFrame:
    """One row a trajectory from one row a point: the one big shuffle, by trajectory."""
    variables = [spec.time, *spec.species]
    held = F.sort_array(F.collect_list(F.struct(F.col(order_by).alias("o"), F.struct(*variables).alias("v")))).alias("points")
    firsts = F.struct(*[F.first(g).alias(g) for g in spec.globals], F.lit(0)).alias("firsts")
    packed = points.groupBy(*KEY).agg(held, firsts)
    return packed.select(*KEY, *[F.col("points")["v"][v].alias(v) for v in variables], *[F.col("firsts")[g].alias(g) for g in spec.globals])


def unpack(traj: DataFrame, spec: TrajectorySpec) -> DataFrame:
    """One row a point, with its ``step``."""
    zipped = F.posexplode(F.arrays_zip(spec.time, *spec.species)).alias("step", "__p")
    columns = [F.col("__p")[v].alias(v) for v in (spec.time, *spec.species)]
    return traj.select(*KEY, *spec.globals, zipped).select(*KEY, "step", *columns, *spec.globals)


def long_form(steps: DataFrame, spec: TrajectorySpec) -> DataFrame:
    """One row a point and species: ``species``, ``value``."""
    return steps.unpivot([*KEY, "step", spec.time], list(spec.species), "species", "value")
