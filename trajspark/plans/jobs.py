"""The three workloads from end to end: prepare trajectories, make training pairs, evaluate predictions."""

from __future__ import annotations

import json

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trajspark.functions.hashing import split_name
from trajspark.operators import evaluate, pairs, reports, score, stats, validate
from trajspark.operators.normalize import Manifest
from trajspark.operators.schema_diff import resolved_names
from trajspark.sources import outputs, shards
from trajspark.sources.scratch import written
from trajspark.sources.trajectories import KEY
from trajspark.spec import TrajectorySpec


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    return Manifest.from_json(outputs.read_text(spark, path))


def _build(traj: DataFrame, spec: TrajectorySpec, out: str) -> None:
    """One pass over the raw rows writes ``kept``; what else must be known of them is observed on the way."""
    spark = traj.sparkSession
    classified = validate.with_fate(validate.classify(traj, spec), spec)
    seen, valid = Observation(), F.col("reason") == "valid"
    grids = [F.to_json(f(F.when(valid, F.col(spec.time)))).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))]
    observed = classified.observe(seen, *grids, *reports.drop_counts())
    fated = validate.checked_lengths(observed.where(valid), spec)
    kept = fated.where("fate = 'kept'").drop("fate", "reason", "min_dt", "max_dt")
    kept = kept.withColumn("split", split_name(spec.seed, spec.val_fraction, spec.test_fraction))
    kept.write.mode("errorifexists").partitionBy("split").parquet(f"{out}/kept")
    found = dict(seen.get)
    grid = validate.require_one_grid(*(json.loads(x) if x else None for x in (found.pop("low", None), found.pop("high", None))), spec)
    kept = spark.read.parquet(f"{out}/kept")
    counts = validate.require_splits(kept)
    validate.require_increasing_after_cast(kept.limit(1), spec)  # all rows have the same grid
    grid_row = spark.createDataFrame([(grid,)], f"`{spec.time}` array<double>")
    dt = stats.dt_spec(grid_row, spec)
    manifest = Manifest.collect(stats.fit_manifest(kept.where("split = 'train'"), spec), dt, {"n_steps": len(grid), "seed": spec.seed})
    shards.write_shards(kept, f"{out}/shards", spec)
    index = shards.file_index(spark, f"{out}/shards").orderBy("split", "shard").collect()  # a row a shard
    report = {
        "splits": counts,
        "drops": found,
        "size": reports.size_estimate(kept, spec).first().asDict(),
        "shards": [r.asDict() for r in index],
        "M_per_sample": len(grid),
        "n_input_species": len(spec.species),
        "n_globals": len(spec.globals),
    }
    outputs.write_text(spark, f"{out}/manifest", manifest.to_json(spec))
    outputs.write_text(spark, f"{out}/report", json.dumps(report, indent=2))


def prepare(traj: DataFrame, spec: TrajectorySpec, out: str, reuse: bool = False, overwrite: bool = False, inputs: Sequence[str] | None = None) -> dict:
    """Validate, filter, split, profile and write. Returns the report that is also written, with the ``outcome``.

    ``out`` gets ``kept`` (trajectories that pass, in full precision, by split), ``shards``, ``manifest``
    and ``report``. Wrong grids, empty splits and values that a log method cannot take are errors before any shard
    is written. Raw rows are read once. An existing ``out`` is an error, unless it may be overwritten, or used again and was made
    with the same settings from the same files: ``inputs``, or the files that ``traj`` reads.
    """
    spark = traj.sparkSession
    files = traj.inputFiles() if inputs is None else inputs
    outcome = outputs.produced(spark, out, outputs.settings_of(spec), files, lambda: _build(traj, spec, out), reuse, overwrite)
    return {**json.loads(outputs.read_text(spark, f"{out}/report")), "outcome": outcome}


def open_prepared(spark: SparkSession, out: str, species: Sequence[str], globals_: Sequence[str] = (), time: str | None = None) -> tuple[TrajectorySpec, DataFrame, Manifest]:
    """The settings, kept trajectories and manifest of a finished ``prepare``.

    Names that are given must be those of the result, in its order; globals and time may be left blank.
    """
    spec = TrajectorySpec.from_settings(outputs.made_with(spark, out))
    resolved_names(spark, species, globals_, time, {"species": spec.species, "globals": spec.globals, "time": spec.time})
    return spec, spark.read.parquet(f"{out}/kept"), read_manifest(spark, f"{out}/manifest")


def make_pairs(kept: DataFrame, spec: TrajectorySpec, manifest: Manifest, draws: int = 4, targets: int = 2, epoch: int = 0) -> DataFrame:
    """Normalized training pairs of one split: ``y_i``, ``y_j``, ``g`` and ``dt_norm`` in double precision."""

    def of(column: str, keys: tuple[str, ...]):
        return F.array(*[manifest.normalize(F.get(column, F.lit(k)), key) for k, key in enumerate(keys)]).cast("array<double>")

    rows = pairs.sample_pairs(kept, spec, draws, targets, epoch)
    return rows.select(
        *KEY, "draw", "target", "i", "j", of("y_i", spec.species).alias("y_i"), of("y_j", spec.species).alias("y_j"), of("g", spec.globals).alias("g"), manifest.normalize_dt(F.col("dt")).alias("dt_norm")
    )


def evaluation(kept: DataFrame, spec: TrajectorySpec, predict: score.Predict, queries: int = 10, k: int = 4, accuracy: int | None = None) -> dict[str, DataFrame]:
    """Score query points of the test split, once, and report: ``summary``, ``relative``, ``peaks`` and the ``worst``.

    Percentiles are exact; ``accuracy`` makes them approximate, within ``1 / accuracy`` of their ranks.
    """
    test = kept.where("split = 'test'")
    points = written(evaluate.error_points(score.score(pairs.query_points(test, spec, queries), predict), spec), "scored-points")
    peaks = evaluate.peak_errors(points)
    return {
        "summary": evaluate.error_summary(points, accuracy=accuracy),
        "relative": evaluate.relative_error(points),
        "peaks": evaluate.peak_distribution(peaks, accuracy),
        "worst": evaluate.worst(peaks, k),
    }
