"""The order of an epoch over written shards, without a shuffle of the data.

Shards follow each other in a keyed order, and so do the units of a shard (each trajectory's pairs). The place of a unit
is computed from its number, and a reader of some places opens the shards that hold them and no other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark.functions.hashing import trajectory_hash
from trajspark.functions.permutation import permuted
from trajspark.sources.shards import read_shards
from trajspark.sources.trajectories import KEY
from trajspark.spec import TrajectorySpec


def shard_order(index: DataFrame, spec: TrajectorySpec, epoch: int, per: int = 1) -> DataFrame:
    """``split``, ``shard``, ``n`` (units) and ``begin`` (the first place) of each shard of an index, by split.

    ``index`` is a shard index, a row for each shard; ``per`` is the number of units of a trajectory.
    """
    whole = Window.partitionBy("split")
    rows = index.select("split", "shard", (F.col("n_trajectories") * per).alias("n"), F.count(F.lit(1)).over(whole).alias("k"))
    turn = permuted(F.col("shard"), F.col("k"), spec.seed, f"shards:{epoch}")
    return rows.withColumn("turn", turn).select("split", "shard", "n", (F.sum("n").over(whole.orderBy("turn")) - F.col("n")).alias("begin"))


def with_places(sharded: DataFrame, order: DataFrame, spec: TrajectorySpec, epoch: int, per: int = 1) -> DataFrame:
    """A row for each unit of the shards, with ``unit`` (0 to ``per`` - 1) and its ``place`` in the epoch of its split.

    Windows see one shard, in which rows are numbered by the trajectories' hashes; ``order`` has a row for each shard.
    """
    w = Window.partitionBy("split", "shard").orderBy(trajectory_hash(spec.seed, "order"), *KEY)
    rows = sharded.withColumn("_row", F.row_number().over(w) - 1).join(F.broadcast(order), ["split", "shard"])
    rows = rows.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    place = F.col("begin") + permuted(F.col("_row") * per + F.col("unit"), F.col("n"), spec.seed, f"units:{epoch}")
    return rows.withColumn("place", place).drop("_row", "begin", "n")


def read_places(spark: SparkSession, path: str, index: DataFrame, spec: TrajectorySpec, split: str, epoch: int, begin: int, end: int, per: int = 1) -> DataFrame:
    """The units at the places from ``begin`` to before ``end``, from the shards that hold them."""
    order = shard_order(index, spec, epoch, per).where(F.col("split") == split)
    held = [r["shard"] for r in order.where((F.col("begin") < end) & (F.col("begin") + F.col("n") > begin)).select("shard").collect()]  # shards of the range
    rows = read_shards(spark, path, split).where(F.col("shard").isin(held))
    return with_places(rows, order, spec, epoch, per).where(F.col("place").between(begin, end - 1))
