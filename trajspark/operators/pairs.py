"""Anchor and target pairs of a trajectory. Only indices are exploded; arrays are looked up and left behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.hashing import unit_hash
from trajspark.sources.trajectories import KEY
from trajspark.spec import TrajectorySpec


def _steps(spec: TrajectorySpec) -> Column:
    most = F.size(spec.time) - 1
    return most if spec.max_steps is None else F.least(F.lit(spec.max_steps), most)


def _at(spec: TrajectorySpec, i: Column) -> Column:
    return F.array(*[F.get(s, i) for s in spec.species])


def _pair_columns(spec: TrajectorySpec) -> list[Column]:
    i, j = F.col("i"), F.col("j")
    return [
        *[F.col(k) for k in KEY],
        i,
        j,
        (F.get(spec.time, j) - F.get(spec.time, i)).alias("dt"),
        _at(spec, i).alias("y_i"),
        _at(spec, j).alias("y_j"),
        F.array(*[F.col(g) for g in spec.globals]).cast("array<double>").alias("g"),
    ]


def all_pairs(traj: DataFrame, spec: TrajectorySpec) -> DataFrame:
    """Every anchor ``i`` with every target ``j`` of ``min_steps`` to ``max_steps`` later; no shuffle.

    Anchors are those from which the longest step still ends inside the trajectory.
    """
    most = _steps(spec)
    rows = traj.where(most >= spec.min_steps).withColumn("i", F.explode(F.sequence(F.lit(0), F.size(spec.time) - 1 - most)))
    rows = rows.withColumn("j", F.explode(F.transform(F.sequence(F.lit(spec.min_steps), most), lambda d: d + F.col("i"))))
    return rows.select(*_pair_columns(spec))


def sample_pairs(traj: DataFrame, spec: TrajectorySpec, draws: int = 4, targets: int = 2, epoch: int = 0, first_anchor: bool = False) -> DataFrame:
    """``draws`` anchors a trajectory with ``targets`` targets each, drawn with replacement.

    Each draw is a function of seed, trajectory, epoch and number, so it does not depend on partitions.
    """
    most = _steps(spec)
    base = F.concat_ws(":", "file_id", "group_id", F.lit(str(epoch)), F.col("draw"))
    rows = traj.where(most >= spec.min_steps).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    n_anchors = F.size(spec.time) - most
    u = unit_hash(spec.seed, F.concat(base, F.lit(":anchor")))
    anchor = F.lit(0) if first_anchor else F.least(n_anchors - 1, F.floor(u * n_anchors).cast("int"))
    rows = rows.withColumn("i", anchor).withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(targets - 1))))
    v = unit_hash(spec.seed, F.concat(base, F.lit(":"), F.col("target")))
    offset = F.least(most, spec.min_steps + F.floor(v * (most - spec.min_steps + 1)).cast("int"))
    rows = rows.withColumn("j", F.col("i") + offset)
    return rows.select("draw", "target", *_pair_columns(spec))


def shuffled(pairs: DataFrame, seed: int, partitions: int) -> DataFrame:
    """A repeatable random order for a trainer: the one shuffle of pairing."""
    order = F.xxhash64(F.lit(seed), "file_id", "group_id", "draw", "target")
    return pairs.repartition(partitions, order).sortWithinPartitions(order)


def query_indices(n_points: Column, count: int) -> Column:
    """Evenly spread step numbers from 1 to the last, rounded half to even; repeats stay."""
    q = F.greatest(F.lit(1), F.least(F.lit(count), n_points - 1))
    step = F.when(q > 1, (n_points - 2).cast("double") / (q - 1)).otherwise(F.lit(0.0))
    inner = F.transform(F.sequence(F.lit(0), q - 1), lambda k: F.rint(F.lit(1.0) + k * step).cast("int"))
    return F.when(q > 1, F.concat(F.slice(inner, F.lit(1), q - 1), F.array(n_points - 1))).otherwise(F.array(F.lit(1)))


def query_points(traj: DataFrame, spec: TrajectorySpec, count: int) -> DataFrame:
    """Pairs from the first point to each query index."""
    rows = traj.where(F.size(spec.time) >= 2).withColumn("i", F.lit(0))
    rows = rows.select("*", F.posexplode(query_indices(F.size(spec.time), count)).alias("q", "j"))
    return rows.select("q", *_pair_columns(spec))
