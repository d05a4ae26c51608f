"""Statistics of the training split, the manifest made from them, and what follows from it.

A manifest is a small DataFrame ``key, method, stat, value``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.scalars import differences, strict_log10
from trajspark.spec import DTYPES, TrajectorySpec
from trajspark.sources.trajectories import unpack


def _entries(key: str, x: Column, spec: TrajectorySpec, with_log: bool) -> list[Column]:
    """One (key, method, stat, value) for each statistic that the method, or weighting, needs."""
    method, out = spec.method(key), []

    def add(stat: str, value: Column) -> None:
        out.append(F.struct(F.lit(key).alias("key"), F.lit(method).alias("method"), F.lit(stat).alias("stat"), value.alias("value")))

    if method == "standard":
        add("mean", F.avg(x))
        add("std", F.greatest(F.stddev_pop(x), F.lit(spec.min_std)))
    if method == "min-max":
        add("min", F.min(x))
        add("max", F.max(x))
    if method.startswith("log-") or with_log:
        y = strict_log10(x, key)
        add("log_mean", F.avg(y))
        add("log_std", F.greatest(F.stddev_pop(y), F.lit(spec.min_std)))
        add("log_min", F.min(y))
        add("log_max", F.max(y))
    return out


def fit_manifest(train: DataFrame, spec: TrajectorySpec, weighted: bool = False) -> DataFrame:
    """Statistics of the training rows alone, before any rounding for storage.

    A species counts each of its values, a global once a trajectory, time the shared grid once. With
    ``weighted``, species have log statistics whatever their method. A value that a log method cannot take
    is an error. Partial aggregates merge like parallel moments; nothing but them is shuffled.
    """
    points = unpack(train.drop(*spec.globals), TrajectorySpec(spec.species, time=spec.time))
    found = [points.agg(F.array(*[e for s in spec.species for e in _entries(s, F.col(s), spec, weighted)]).alias("x"))]
    if spec.globals:
        found.append(train.agg(F.array(*[e for g in spec.globals for e in _entries(g, F.col(g), spec, False)]).alias("x")))
    grid = train.agg(F.min(spec.time).alias("grid")).select(F.explode("grid").alias("t"))
    found.append(grid.agg(F.array(*_entries(spec.time, F.col("t"), spec, False)).alias("x")))
    rows = [f.select(F.inline("x")) for f in found]
    return reduce(DataFrame.union, rows)


def partial_statistics(train: DataFrame, spec: TrajectorySpec, by: str = "file_id") -> DataFrame:
    """Per file (or another column) and species: ``n, mean, m2, min, max``, so that new files are added without reading old ones."""
    values = F.explode(F.arrays_zip(*spec.species)).alias("p")
    points = train.select(by, values).select(by, *[F.col("p")[s].alias(s) for s in spec.species]).unpivot([by], list(spec.species), "key", "x")
    return points.groupBy(by, "key").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("m2"), F.min("x").alias("min"), F.max("x").alias("max")
    )


def merge_statistics(partials: DataFrame) -> DataFrame:
    """Partials of disjoint rows as those of their union, by ``key``; ``std`` added."""
    means = partials.groupBy("key").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all_mean"))
    joined = partials.join(F.broadcast(means), "key")  # one row a variable
    merged = joined.groupBy("key").agg(
        F.sum("n").alias("n"),
        F.first("all_mean").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("all_mean"), 2)).alias("m2"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )
    return merged.withColumn("std", F.sqrt(F.col("m2") / F.col("n")))


def dt_spec(grid: DataFrame, spec: TrajectorySpec) -> DataFrame:
    """Bounds of log10 of the time gap over all allowed steps, from a one-row DataFrame with the time grid.

    The grid is rounded as it will be stored, so that gaps of stored times stay inside the bounds.
    """
    t = F.col(spec.time).cast(f"array<{DTYPES[spec.time_dtype]}>").cast("array<double>")
    rows = grid.select(t.alias("t")).withColumn("n", F.size("t"))
    least = F.greatest(F.lit(1), F.least(F.lit(spec.min_steps), F.col("n") - 1))
    most = F.col("n") - 1 if spec.max_steps is None else F.least(F.lit(spec.max_steps), F.col("n") - 1)
    rows = rows.withColumn("k_min", least).withColumn("k_max", F.greatest(F.col("k_min"), most))

    def gaps(k: str) -> Column:
        m = F.col("n") - F.col(k)
        return F.zip_with(F.slice("t", F.col(k) + 1, m), F.slice("t", F.lit(1), m), lambda a, b: a - b)

    ok = F.forall(differences(F.col("t")), lambda d: d > 0) & (F.col("n") >= 2)
    rows = rows.withColumn("t", F.when(ok, F.col("t")).otherwise(F.raise_error(F.lit("the stored time grid does not increase")).cast("array<double>")))
    rows = rows.select(
        F.array_min(gaps("k_min")).alias("least"), F.array_max(gaps("k_max")).alias("most"), F.array_min(differences(F.col("t"))).alias("k1_min"), F.array_max(differences(F.col("t"))).alias("k1_max")
    )
    high = F.when(F.col("most") > F.col("least"), F.log10("most")).otherwise(F.raise_error(F.lit("all time gaps are equal")).cast("double"))
    return rows.select(F.log10("least").alias("log_min"), high.alias("log_max"), "k1_min", "k1_max")


def species_weights(manifest: DataFrame, spec: TrajectorySpec, power: float = 1.0, low: float = 0.0, high: float = float("inf")) -> DataFrame:
    """Loss weights by each species' log range, of mean one; one outside the bounds is an error."""
    ranges = (
        manifest.where(F.col("key").isin(list(spec.species)))
        .groupBy("key")
        .agg((F.max(F.when(F.col("stat") == "log_max", F.col("value"))) - F.max(F.when(F.col("stat") == "log_min", F.col("value")))).alias("r"))
    )
    powered = F.when(F.col("r") > 0, F.pow("r", F.lit(power))).otherwise(F.raise_error(F.lit("no log range above zero")).cast("double"))
    raw = ranges.select("key", powered.alias("w"))
    mean = raw.agg(F.avg("w").alias("mean"))
    w = F.col("w") / F.col("mean")
    inside = F.when((w >= low) & (w <= high), w).otherwise(F.raise_error(F.lit("a species weight is out of bounds")).cast("double"))
    return raw.crossJoin(F.broadcast(mean)).select("key", inside.alias("weight"))  # one row


def representative_values(manifest: DataFrame) -> DataFrame:
    """A typical physical value of each key: its mean, or the middle of its range."""

    def stat(name: str) -> Column:
        return F.max(F.when(F.col("stat") == name, F.col("value")))

    found = manifest.groupBy("key", "method").agg(*[stat(s).alias(s) for s in ("mean", "min", "max", "log_mean", "log_min", "log_max")])
    value = (
        F.when(F.col("method") == "standard", F.col("mean"))
        .when(F.col("method") == "min-max", 0.5 * (F.col("min") + F.col("max")))
        .when(F.col("method") == "log-standard", F.pow(F.lit(10.0), F.col("log_mean")))
        .when(F.col("method") == "log-min-max", F.pow(F.lit(10.0), 0.5 * (F.col("log_min") + F.col("log_max"))))
    )
    return found.select("key", "method", value.alias("value"))
