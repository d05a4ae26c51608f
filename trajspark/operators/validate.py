"""Rules that decide which trajectories are used. ``*_report`` is lazy, ``require_*`` runs a job and raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.hashing import trajectory_hash
from trajspark.functions.scalars import differences, is_finite
from trajspark.spec import DTYPES, TrajectorySpec

TIME_REASONS = ["missing_time", "nan_time", "nonpositive_dt"]
REASONS = [*TIME_REASONS, "missing_species", "missing_globals", "valid"]
SPLITS = ["train", "validation", "test"]


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def drop_first_step(traj: DataFrame, spec: TrajectorySpec) -> DataFrame:
    """All arrays without their first value; empty ones stay empty."""
    return traj.withColumns({v: F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))) for v in (spec.time, *spec.species)})


def increasing(time: Column) -> Column:
    """Whether every value is above the one before it."""
    return ~F.exists(differences(time), lambda d: d <= 0)


def classify(traj: DataFrame, spec: TrajectorySpec) -> DataFrame:
    """Adds ``reason`` (the first rule that fails, or ``valid``), ``min_dt`` and ``max_dt``."""
    if spec.skip_first_step:
        traj = drop_first_step(traj, spec)
    time = F.col(spec.time)
    reason = (
        F.when(time.isNull(), "missing_time")
        .when((F.size(time) < 2) | F.exists(time, lambda t: F.coalesce(~is_finite(t), F.lit(True))), "nan_time")
        .when(~increasing(time), "nonpositive_dt")
        .when(_any([F.col(s).isNull() for s in spec.species]), "missing_species")
        .when(_any([F.col(g).isNull() for g in spec.globals]), "missing_globals")
        .otherwise("valid")
    )
    passed = ~F.col("reason").isin(TIME_REASONS)
    return traj.withColumn("reason", reason).withColumns(
        {"min_dt": F.when(passed, F.array_min(differences(time))), "max_dt": F.when(passed, F.array_max(differences(time)))}
    )


def checked_lengths(traj: DataFrame, spec: TrajectorySpec) -> DataFrame:
    """A species with another number of values than there are times is an error."""
    bad = _any([F.size(s) != F.size(spec.time) for s in spec.species])
    message = F.concat(F.lit("species of another length than time in "), F.concat_ws(":", "file_id", "group_id"))
    return traj.withColumn(spec.time, F.when(bad, F.raise_error(message).cast("array<double>")).otherwise(F.col(spec.time)))


def length_report(traj: DataFrame, spec: TrajectorySpec) -> DataFrame:
    """Per species: trajectories where it has another number of values than there are times."""
    bad = [F.struct(F.lit(s).alias("species"), F.count_if(F.size(s) != F.size(spec.time)).alias("n_bad")) for s in spec.species]
    return traj.agg(F.array(*bad).alias("x")).select(F.inline("x"))


def log_time_report(traj: DataFrame, spec: TrajectorySpec) -> DataFrame:
    """Trajectories, and those with a time that a log method cannot take."""
    return traj.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_min(spec.time) <= 0).alias("n_not_positive"))


def fate(spec: TrajectorySpec) -> Column:
    """``unused``, ``nonfinite``, ``below_threshold``, ``nonfinite_global`` or ``kept``: the first that holds, in this order."""
    finite = reduce(lambda a, b: a & b, [F.forall(s, lambda v: F.coalesce(is_finite(v), F.lit(False))) for s in spec.species])
    least = [F.array_min(s) for s in spec.species]
    least = F.least(*least) if len(least) > 1 else least[0]
    out = F.when(F.lit(spec.use_fraction < 1) & (trajectory_hash(spec.seed, "use") >= spec.use_fraction), "unused").when(~finite, "nonfinite")
    if spec.min_value_threshold > 0:
        out = out.when(least < spec.min_value_threshold, "below_threshold")
    return out.when(_any([~is_finite(F.col(g)) for g in spec.globals]), "nonfinite_global").otherwise("kept")


def with_fate(valid: DataFrame, spec: TrajectorySpec) -> DataFrame:
    """Adds ``fate`` to valid trajectories."""
    return valid.withColumn("fate", fate(spec))


def grid_census(valid: DataFrame, spec: TrajectorySpec) -> DataFrame:
    """How many trajectories have each time grid."""
    return valid.groupBy(F.col(spec.time).alias("grid")).agg(F.count(F.lit(1)).alias("n"))


def canonical_grid(valid: DataFrame, spec: TrajectorySpec) -> list[float]:
    """The time grid that all valid trajectories share; another, or none at all, is an error."""
    row = valid.agg(F.min(spec.time).alias("a"), F.max(spec.time).alias("b")).first()
    return require_one_grid(row["a"], row["b"], spec)


def require_one_grid(least: list | None, most: list | None, spec: TrajectorySpec) -> list[float]:
    """The grid, where the smallest and the largest of all grids are the same."""
    if least is None or most is None:
        raise ValueError("no valid trajectory to take the time grid from")
    if list(least) != list(most):
        raise ValueError("valid trajectories have different time grids")
    grid = [float(t) for t in least]
    if spec.method(spec.time).startswith("log-") and min(grid) <= 0:
        raise ValueError("a log method for time needs times above zero")
    return grid


def require_increasing_after_cast(traj: DataFrame, spec: TrajectorySpec) -> None:
    """Storing times with fewer digits must not merge points."""
    stored = F.col(spec.time).cast(f"array<{DTYPES[spec.time_dtype]}>").cast("array<double>")
    n = traj.where(~increasing(stored)).count()
    if n:
        raise ValueError(f"{n} trajectories have equal times as {spec.time_dtype}")


def split_counts(kept: DataFrame) -> DataFrame:
    """Trajectories in each of the three splits, empty ones as zero."""
    names = kept.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    return names.join(kept.groupBy("split").agg(F.count(F.lit(1)).alias("k")), "split", "left").select("split", F.coalesce("k", F.lit(0)).alias("n"))


def require_splits(kept: DataFrame) -> dict[str, int]:
    counts = {r["split"]: r["n"] for r in split_counts(kept).collect()}
    if min(counts.values()) == 0:
        raise ValueError(f"a split is empty: {counts}")
    return counts


def positive_report(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, how many values a log method would reject."""
    counts = [F.struct(F.lit(k).alias("key"), F.count_if((F.col(k) <= 0) | ~is_finite(F.col(k))).alias("n_bad")) for k in keys]
    return steps.agg(F.array(*counts).alias("x")).select(F.inline("x"))


def require_positive(steps: DataFrame, keys: list[str]) -> None:
    bad = {r["key"]: r["n_bad"] for r in positive_report(steps, keys).collect() if r["n_bad"]}
    if bad:
        raise ValueError(f"values that are not finite and positive: {bad}")


def dt_norm_report(pairs: DataFrame, column: str = "dt_norm") -> DataFrame:
    """Range of normalized gaps, and how many are outside [0, 1] or not finite."""
    x = F.col(column)
    bad = ~(is_finite(x) & (x >= 0) & (x <= 1))
    return pairs.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.count_if(bad).alias("n_bad"))


def require_dt_norm(pairs: DataFrame, column: str = "dt_norm") -> None:
    row = dt_norm_report(pairs, column).first()
    if row["n_bad"]:
        x = F.col(column)
        some = [r[0] for r in pairs.where(~(is_finite(x) & (x >= 0) & (x <= 1))).select(column).limit(5).collect()]
        raise ValueError(f"{row['n_bad']} normalized gaps outside [0, 1]: min {row['min']}, max {row['max']}, such as {some}")


def evaluation_mask(truth: Column, prediction: Column, floor: float = 1e-15) -> Column:
    """Points that count in an error: both finite and the truth above the floor."""
    return is_finite(truth) & is_finite(prediction) & (truth > floor)


def in_window(time: Column, low: float = 1e-3, high: float = 1e8) -> Column:
    return time.between(low, high)
