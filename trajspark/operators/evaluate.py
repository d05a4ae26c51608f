"""Errors of predictions: points in long form, summaries, and the worst trajectories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.hashing import trajectory_hash, unit_hash
from trajspark.functions.scalars import floored_log10, is_finite, multiplicative_error
from trajspark.operators.normalize import Manifest
from trajspark.operators.numbering import with_row_numbers
from trajspark.operators.quantiles import exact_quantiles
from trajspark.operators.validate import evaluation_mask
from trajspark.sources.scratch import written
from trajspark.sources.trajectories import KEY
from trajspark.spec import TrajectorySpec

PAIR = [*KEY, "i", "j"]


def aligned(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions and truth that lie in two tables, joined by trajectory and steps."""
    return predictions.join(truth, PAIR)


def alignment_report(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """How many rows of either table have no partner in the other."""
    alone = predictions.join(truth, PAIR, "left_anti").select(F.lit("prediction").alias("side"))
    alone = alone.union(truth.join(predictions, PAIR, "left_anti").select(F.lit("truth").alias("side")))
    return alone.groupBy("side").agg(F.count(F.lit(1)).alias("n_alone"))


def _quantiles(rows: DataFrame, values: dict[str, Column], quantiles: Sequence[float], accuracy: int | None, by: Sequence[str] = ()) -> DataFrame:
    """An array for each of ``values``: exact by selection, or within ``1 / accuracy`` of the ranks in one pass."""
    if accuracy is None:
        return exact_quantiles(rows, values, quantiles, by)
    many = F.array(*[F.lit(float(q)) for q in quantiles])
    return rows.groupBy(*by).agg(*[F.percentile_approx(v, many, accuracy).alias(n) for n, v in values.items()])


def error_points(scored: DataFrame, spec: TrajectorySpec, species: Sequence[str] = ()) -> DataFrame:
    """One row a pair and species: ``y_true``, ``y_pred``; of all species or of those with the given labels."""
    labels = [s.removesuffix("_evolution") for s in spec.species]
    wanted = [k for k, name in enumerate(labels) if not species or name in species]
    if not wanted:
        raise ValueError(f"none of {list(species)} is a species")
    points = F.array(*[F.struct(F.lit(labels[k]).alias("species"), F.get("y_j", F.lit(k)).alias("y_true"), F.get("y_pred", F.lit(k)).alias("y_pred")) for k in wanted])
    return scored.select(*PAIR, "dt", F.inline(points))


def error_summary(points: DataFrame, bucket_floor: float = 1e-10, log_floor: float = 5e-20, percent_eps: float = 1e-20, quantiles: Sequence[float] = (0.5, 0.9, 0.95, 0.99, 0.999), accuracy: int | None = None) -> DataFrame:
    """Errors over all finite points and over those with a truth above ``bucket_floor``.

    Percentiles are exact with linear interpolation, by selection over the errors, which are written once;
    ``accuracy`` makes them approximate.
    """
    t, p = F.col("y_true"), F.col("y_pred")
    finite = points.where(is_finite(t) & is_finite(p))
    percent = 100 * F.abs(p - t) / (F.abs(t) + F.lit(percent_eps))
    log_err = floored_log10(p, log_floor) - floored_log10(t, log_floor)
    buckets = F.array(F.lit("all"), F.when(t > bucket_floor, "large"))
    rows = finite.select((p - t).alias("e"), percent.alias("pct"), log_err.alias("l"), F.explode(buckets).alias("bucket")).where("bucket is not null")
    rows = written(rows, "errors")
    out = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("pct").alias("mean_percent"),
        F.avg(F.abs("e")).alias("mae"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        F.avg(F.abs("l")).alias("log_mae"),
        F.sqrt(F.avg(F.col("l") * F.col("l"))).alias("log_rmse"),
        F.avg("l").alias("log_bias"),
        F.max("pct").alias("max_percent"),
    )
    names = [f"p{q * 100:g}".replace(".", "_") for q in quantiles]
    found = _quantiles(rows, {"__q": F.col("pct")}, quantiles, accuracy, ["bucket"])
    return out.join(found, "bucket").select(*out.columns, *[F.get("__q", F.lit(k)).alias(n) for k, n in enumerate(names)])


def relative_error(points: DataFrame, eps: float = 1e-12) -> DataFrame:
    e = F.abs(F.col("y_pred") - F.col("y_true")) / (F.abs("y_true") + F.lit(eps))
    return points.groupBy("species").agg(F.avg(e).alias("mean_relative"), F.max(e).alias("max_relative"))


def loss_components(scored_z: DataFrame, spec: TrajectorySpec, manifest: Manifest, weights: dict[str, float] | None = None, lambda_phys: float = 1.0, lambda_z: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """The training loss over normalized truth ``z_true`` and prediction ``z_pred``, its parts and the error proxy.

    All are means over pairs and species; without rows they are null.
    """
    parts = []
    for k, s in enumerate(spec.species):
        a, b = F.get("z_pred", F.lit(k)), F.get("z_true", F.lit(k))
        log = F.abs(manifest.z_to_log10(a, s) - manifest.z_to_log10(b, s))
        w = F.lit(1.0 if weights is None else weights[s])
        parts.append(F.struct(log.alias("log"), (w * log).alias("wlog"), ((a - b) * (a - b)).alias("z")))
    rows = scored_z.select(*by, F.inline(F.array(*parts)))
    means = rows.groupBy(*by).agg(F.avg("log").alias("mean_abs_log10"), F.avg("wlog").alias("__w"), F.avg("z").alias("__z"))
    phys, z = F.lit(lambda_phys) * F.col("__w"), F.lit(lambda_z) * F.col("__z")
    return means.select(*by, (phys + z).alias("total"), phys.alias("phys"), z.alias("z"), "mean_abs_log10", multiplicative_error(F.col("mean_abs_log10")).alias("mult_err_proxy"))


def weighted_means(batches: DataFrame, metrics: Sequence[str], weight: str) -> DataFrame:
    """Means over batches of different sizes."""
    return batches.agg(*[(F.sum(F.col(m) * F.col(weight)) / F.sum(weight)).alias(m) for m in metrics])


def count_breakdown(scored: DataFrame, spec: TrajectorySpec, accuracy: int | None = None) -> DataFrame:
    """Trajectories, targets, distinct and repeated targets a trajectory, and finite points."""
    finite = F.aggregate(F.zip_with("y_j", "y_pred", lambda a, b: (is_finite(a) & is_finite(b)).cast("int")), F.lit(0), lambda acc, x: acc + x)
    per = scored.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("k"), F.count_distinct("j").alias("d"), F.sum(F.size("y_j")).alias("raw"), F.sum(finite).alias("fin")
    )
    per = written(per, "targets")
    medians = _quantiles(per, {"mk": F.col("k").cast("double"), "md": F.col("d").cast("double")}, [0.5], accuracy)
    counts = per.agg(
        F.count(F.lit(1)).alias("n_trajectories"),
        F.min("k").alias("min_targets"),
        F.max("k").alias("max_targets"),
        F.sum(F.col("k") - F.col("d")).alias("n_repeated"),
        F.sum("k").alias("n_pairs"),
        F.sum("raw").alias("n_points"),
        F.sum("fin").alias("n_finite"),
    )
    both = counts.crossJoin(F.broadcast(medians))  # one row each
    medians_of = {n: F.get(c, F.lit(0)).alias(n) for n, c in (("median_targets", "mk"), ("median_distinct", "md"))}
    names = ["n_trajectories", "median_targets", "min_targets", "max_targets", "median_distinct", "n_repeated", "n_pairs", "n_points", "n_finite"]
    return both.select(*[medians_of.get(n, F.col(n)) for n in names])


def peak_errors(points: DataFrame, floor: float = 1e-35, significant: float = 1e-15) -> DataFrame:
    """Each trajectory's largest absolute log10 error over points that matter; 0 where none does."""
    err = F.abs(floored_log10(F.col("y_pred"), floor) - floored_log10(F.col("y_true"), floor))
    matters = evaluation_mask(F.col("y_true"), F.col("y_pred"), significant)
    return points.groupBy(*KEY).agg(F.coalesce(F.max(F.when(matters, err)), F.lit(0.0)).alias("peak"))


def worst(peaks: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` largest peaks with their rank; equal ones by trajectory. No full sort."""
    order = [F.desc("peak"), *KEY]
    top = peaks.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows


def peak_distribution(peaks: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Median, high percentiles and the maximum of all peaks."""
    q = _quantiles(peaks, {"q": F.col("peak")}, (0.5, 0.9, 0.99, 1.0), accuracy)
    return q.select(*[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("p50", "p90", "p99", "max"))])


def sampled_trajectories(traj: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` trajectories by hash: a repeatable sample without replacement."""
    return traj.orderBy(trajectory_hash(seed, "sample"), *KEY).limit(n)


def quadrant_picks(traj: DataFrame, pressure: str, temperature: str, seed: int, accuracy: int | None = None) -> DataFrame:
    """One trajectory for each quadrant around the medians of log pressure and temperature.

    The one with the smallest hash; for an empty quadrant the one with the smallest hash of all.
    """
    spark, u = traj.sparkSession, trajectory_hash(seed, "pick")
    logp, t = F.log10(pressure), F.col(temperature)
    medians = _quantiles(traj, {"mp": logp, "mt": t}, [0.5], accuracy).select(*[F.get(n, F.lit(0)).alias(n) for n in ("mp", "mt")])
    marked = traj.select(*KEY, u.alias("u"), logp.alias("lp"), t.alias("tt")).crossJoin(F.broadcast(medians))  # one row
    name = F.concat(F.when(F.col("lp") < F.col("mp"), "low").otherwise("high"), F.lit("_"), F.when(F.col("tt") < F.col("mt"), "low").otherwise("high"))
    first = F.min_by(F.struct(*KEY), F.struct("u", *KEY)).alias("own")
    picks = marked.groupBy(name.alias("quadrant")).agg(first, F.min(F.struct("u", *KEY)).alias("key"))
    every = picks.agg(F.min_by("own", "key").alias("any"))
    names = spark.createDataFrame([(f"{a}_{b}",) for a in ("low", "high") for b in ("low", "high")], "quadrant string")
    rows = names.join(picks, "quadrant", "left").crossJoin(F.broadcast(every))  # four rows and one
    chosen = F.coalesce("own", "any")
    return rows.select("quadrant", *[chosen[k].alias(k) for k in KEY])


def species_by_peak(long: DataFrame, time: str, low: float = 1e-3, high: float = 1e8) -> DataFrame:
    """Species in order of their largest value inside a window of time."""
    return long.where(F.col(time).between(low, high)).groupBy("species").agg(F.max("value").alias("peak")).orderBy(F.desc("peak"), "species")


def strided_sample(points: DataFrame, valid: Column, keys: Sequence[str], most: int, seed: int) -> DataFrame:
    """At most ``most`` valid points: every so many of them in the order of a hash of their keys. Valid points are computed and written once."""
    rows = written(points.where(valid), "points")
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("p"), *[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)])
    ties = [f"k{n}" for n in range(len(keys))]
    stride = max(1, -(-rows.count() // most))
    numbered = with_row_numbers(packed, unit_hash(seed, F.concat_ws(":", *ties)), ties, "n")
    return numbered.where((F.col("n") % stride == 0) & (F.col("n") < stride * most)).select("p.*")


def bottom_sample(points: DataFrame, valid: Column, keys: Sequence[str], most: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """The ``most`` valid points with the smallest hashes of their keys, of all or of each group: a uniform sample in one pass.

    A task hands on ``most`` rows (of a group) at most, whatever it reads, and samples merge by the same rule.
    """
    rows = points.where(valid).select(F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("p"), unit_hash(seed, F.concat_ws(":", *keys)).alias("u"))
    order = ["u", *[F.col("p")[k] for k in keys]]
    if not by:
        return rows.orderBy(*order).limit(most).select("p.*")
    rank = F.row_number().over(Window.partitionBy(*[F.col("p")[c] for c in by]).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("p.*")
