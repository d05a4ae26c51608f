"""Queries by name over the given tables; the SQL that gives the same rows is in ``oracles``.

Floating-point results are rounded, since engines differ in the last bits of logarithms and sums.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark.functions import names, scalars, transforms
from trajspark.functions.hashing import derived_seed_column, trajectory_hash
from trajspark.operators import chemistry, evaluate, pairs, reports, runlog, schema_diff as diff, score, segments, sketches, stats, validate
from trajspark.operators.normalize import normalized, quantized
from trajspark.plans import fixtures as fx, jobs
from trajspark.plans.oracles import ORACLES
from trajspark.sources import bucketed, epochs, moments, outputs, runlogs, shards
from trajspark.sources.scratch import scratch_path, written
from trajspark.sources.trajectories import KEY, long_form, read_trajectories, unpack

QUERIES: dict = {}
V, O4 = fx.V_SPEC, fx.O4_SPEC


def query(f):
    QUERIES[f.__name__] = f
    return f


def _r(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# -- prepare --------------------------------------------------------------------------------------


@query
def norm_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return _r(fx.v_manifest(spark, sf), 9, "value")


@query
def scan_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.scan_report(validate.classify(fx.o(spark, sf), fx.O_SPEC))


@query
def scan_overall(spark: SparkSession, sf: str) -> DataFrame:
    return reports.scan_overall(validate.classify(fx.o(spark, sf), fx.O_SPEC))


@query
def scan_skip_first(spark: SparkSession, sf: str) -> DataFrame:
    spec = type(fx.O_SPEC)(**{**fx.O_SPEC.__dict__, "skip_first_step": True})
    return reports.scan_report(validate.classify(fx.o(spark, sf), spec))


@query
def packed_points(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.o(spark, sf).where("t is not null")
    total = F.aggregate("l_extendedprice", F.lit(0.0), lambda a, x: a + x)
    return rows.select(*KEY, F.size("t").cast("long").alias("n"), F.get("t", F.lit(0)).alias("first_t"), F.element_at("l_quantity", -1).alias("last_quantity"), F.round(total, 2).alias("total_price"))


@query
def forward_dt(spark: SparkSession, sf: str) -> DataFrame:
    dt = F.lead("t").over(Window.partitionBy(*KEY).orderBy("t")) - F.col("t")
    rows = fx.e_points(spark, sf).withColumn("dt", dt)
    return _r(rows.groupBy(*KEY).agg(F.count("dt").alias("n"), F.min("dt").alias("min_dt"), F.max("dt").alias("max_dt"), F.avg("dt").alias("mean_dt")), 3, "min_dt", "max_dt", "mean_dt")


@query
def grid_census(spark: SparkSession, sf: str) -> DataFrame:
    valid = validate.classify(fx.o(spark, sf), fx.O_SPEC).where("reason = 'valid'")
    return validate.grid_census(valid, fx.O_SPEC).select(F.concat_ws(",", F.transform("grid", lambda x: x.cast("int").cast("string"))).alias("grid"), "n")


@query
def dt_spec(spark: SparkSession, sf: str) -> DataFrame:
    return _r(stats.dt_spec(fx.v(spark, sf).agg(F.min("time").alias("time")), V), 10, "log_min", "log_max")


@query
def dt_norm_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = pairs.all_pairs(fx.v_kept(spark, sf), V).select("i", "j", "dt").groupBy("i", "j", "dt").agg(F.count(F.lit(1)).alias("n"))
    manifest = fx.v_collected(spark, sf)
    z = manifest.normalize_dt(F.col("dt"))
    return rows.select("i", "j", "dt", "n", F.round(z, 10).alias("dt_norm"), F.round(manifest.denormalize_dt(z), 6).alias("dt_back"))


@query
def dt_norm_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = pairs.all_pairs(fx.v_kept(spark, sf), V).withColumn("dt_norm", fx.v_collected(spark, sf).normalize_dt(F.col("dt")))
    return validate.dt_norm_report(rows)


@query
def split_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return fx.v_kept(spark, sf).select(*KEY, "split", F.round(trajectory_hash(V.seed, "split"), 12).alias("u"), derived_seed_column(V.seed, F.col("group_id")).alias("seed"))


@query
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return validate.split_counts(fx.v_kept(spark, sf))


@query
def split_counts_orders(spark: SparkSession, sf: str) -> DataFrame:
    return validate.split_counts(fx.kept(fx.o4(spark, sf), O4))


def _drops(traj: DataFrame, spec) -> DataFrame:
    return reports.drop_report(validate.classify(traj, spec), spec)


@query
def drop_report(spark: SparkSession, sf: str) -> DataFrame:
    return _drops(fx.v(spark, sf), V)


@query
def drop_report_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Of all orders, whatever their defects."""
    return _drops(fx.o(spark, sf), O4)


@query
def scan_defects(spark: SparkSession, sf: str) -> DataFrame:
    return reports.scan_report(validate.classify(fx.d(spark, sf), V))


@query
def drop_report_defects(spark: SparkSession, sf: str) -> DataFrame:
    return _drops(fx.d(spark, sf), V)


@query
def fates(spark: SparkSession, sf: str) -> DataFrame:
    valid = validate.classify(fx.d(spark, sf), V).where("reason = 'valid'")
    return validate.with_fate(valid, V).groupBy("fate").agg(F.count(F.lit(1)).alias("n"))


@query
def length_report(spark: SparkSession, sf: str) -> DataFrame:
    return validate.length_report(fx.d(spark, sf), V)


@query
def log_time_report(spark: SparkSession, sf: str) -> DataFrame:
    """With and without the first step, whose time is zero."""
    rows = fx.d(spark, sf)
    found = [validate.log_time_report(x, V).select(F.lit(name).alias("steps"), "*") for name, x in (("all", rows), ("later", validate.drop_first_step(rows, V)))]
    return found[0].union(found[1])


@query
def trajectories_read(spark: SparkSession, sf: str) -> DataFrame:
    """Written and read back; a file without one of the variables reads as if each of its rows lacked it."""
    path, rows = scratch_path(spark, "trajectories"), fx.d(spark, sf)
    rows.where("P < 6").write.parquet(f"{path}/a")
    rows.where("not P < 6").drop("HCN_evolution").write.parquet(f"{path}/b")
    return reports.scan_report(validate.classify(read_trajectories(spark, [f"{path}/a", f"{path}/b"], V), V))


@query
def size_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return reports.size_estimate(fx.v_kept(spark, sf), V)


def _o4_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Numbering reads its rows twice: for the counts of buckets and for the rows."""
    return shards.numbered(written(fx.kept(fx.o4(spark, sf), O4), "kept"), O4)


@query
def shard_index(spark: SparkSession, sf: str) -> DataFrame:
    return shards.shard_index(_o4_numbered(spark, sf))


@query
def shard_members(spark: SparkSession, sf: str) -> DataFrame:
    return _o4_numbered(spark, sf).select(*KEY, "split", "shard")


def _written_shards(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "shards")
    shards.write_shards(written(fx.kept(fx.o4(spark, sf), O4), "kept"), path, O4)
    return path


@query
def shard_files(spark: SparkSession, sf: str) -> DataFrame:
    """Names and sizes of the shards as they are on disk."""
    return shards.file_index(spark, _written_shards(spark, sf))


@query
def shards_read(spark: SparkSession, sf: str) -> DataFrame:
    """All shards written, read as one table: members, and a value of the first and the last step."""
    rows = shards.read_shards(spark, _written_shards(spark, sf))
    first, last = F.get(F.get("y", F.lit(0)), F.lit(0)), F.get(F.get("y", F.lit(3)), F.lit(0))
    return rows.select(*KEY, "split", "shard", first.cast("double").alias("first_quantity"), last.cast("double").alias("last_quantity"))


@query
def write_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Shards found after a first write, one that is refused because the folder exists, and one that may replace it."""
    path, kept, found = scratch_path(spark, "policy"), fx.v_kept(spark, sf), []
    for step, rows, overwrite in (("first", kept, False), ("refused", kept.where("split = 'test'"), False), ("replaced", kept.where("split = 'test'"), True)):
        try:
            shards.write_shards(rows, path, V, overwrite=overwrite)
        except AnalysisException:
            if step != "refused":
                raise
        n = shards.read_shards(spark, path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
        n.select(F.lit(step).alias("step"), "split", "n").write.parquet(f"{path}-counts/{step}")
        found.append(f"{path}-counts/{step}")
    return spark.read.parquet(*found)


@query
def dense_shards(spark: SparkSession, sf: str) -> DataFrame:
    rows = shards.dense(fx.v_kept(spark, sf), V)
    return rows.select(*KEY, F.size("y").cast("long").alias("n_steps"), F.round(F.get(F.get("y", F.lit(3)), F.lit(2)).cast("double"), 7).alias("y_3_2"), F.get("g", F.lit(1)).cast("double").alias("g_1"))


@query
def quantization(spark: SparkSession, sf: str) -> DataFrame:
    rows = quantized(fx.v_kept(spark, sf), "float", "double", V)
    exact, kept = fx.v_kept(spark, sf).select(*KEY, "CH4_evolution"), rows.select(*KEY, F.col("CH4_evolution").alias("q"))
    gap = F.zip_with("CH4_evolution", "q", lambda a, b: F.abs(a - b.cast("double")))
    return exact.join(kept, KEY).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.array_max(gap)), 9).alias("largest_gap"))


@query
def partial_stats_merge(spark: SparkSession, sf: str) -> DataFrame:
    train = fx.v_kept(spark, sf).where("split = 'train'")
    merged = stats.merge_statistics(stats.partial_statistics(train, V))
    return _r(merged, 9, "mean", "m2", "min", "max", "std")


@query
def positive_report(spark: SparkSession, sf: str) -> DataFrame:
    return validate.positive_report(unpack(fx.o(spark, sf).where("t is not null"), fx.O_SPEC), list(fx.O_SPEC.species))


# -- normalize and pair ---------------------------------------------------------------------------


@query
def normalize_species(spark: SparkSession, sf: str) -> DataFrame:
    rows = normalized(fx.v_kept(spark, sf), V, fx.v_collected(spark, sf))
    return _r(long_form(unpack(rows, V), V), 8, "value").select(*KEY, "step", "species", "value")


@query
def denormalize_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    manifest = fx.v_collected(spark, sf)
    steps = unpack(fx.v_kept(spark, sf), V)
    close = [
        F.struct(F.lit(k).alias("key"), F.count_if(F.abs(manifest.denormalize(manifest.normalize(F.col(k), k), k) - F.col(k)) <= 1e-9 * F.abs(k)).alias("n_close"), F.count(k).alias("n"))
        for k in (*V.species, *V.globals)
    ]
    return steps.agg(F.array(*close).alias("x")).select(F.inline("x"))


@query
def normalize_globals(spark: SparkSession, sf: str) -> DataFrame:
    rows = normalized(fx.v_kept(spark, sf), V, fx.v_collected(spark, sf))
    return _r(rows.select(*KEY, "P", "T"), 8, "P", "T").select(*KEY, F.col("P").alias("p_norm"), F.col("T").alias("t_norm"))


@query
def normalize_by_join(spark: SparkSession, sf: str) -> DataFrame:
    manifest = fx.v_manifest(spark, sf).groupBy("key", "method").agg(F.map_from_entries(F.collect_list(F.struct("stat", "value"))).alias("s"))
    rows = long_form(unpack(fx.v_kept(spark, sf), V), V).join(F.broadcast(manifest), F.col("species") == F.col("key"))  # a row a variable
    log = F.log10("value")
    z = (
        F.when(F.col("method") == "standard", (F.col("value") - F.col("s")["mean"]) / F.col("s")["std"])
        .when(F.col("method") == "min-max", (F.col("value") - F.col("s")["min"]) / (F.col("s")["max"] - F.col("s")["min"]))
        .when(F.col("method") == "log-standard", (log - F.col("s")["log_mean"]) / F.col("s")["log_std"])
        .otherwise((log - F.col("s")["log_min"]) / (F.col("s")["log_max"] - F.col("s")["log_min"]))
    )
    out = rows.groupBy("species", "step").agg(F.count(F.lit(1)).alias("n"), F.avg(z).alias("mean_z"), F.min(z).alias("min_z"), F.max(z).alias("max_z"))
    return _r(out, 8, "mean_z", "min_z", "max_z")


@query
def z_to_log10(spark: SparkSession, sf: str) -> DataFrame:
    manifest = fx.v_collected(spark, sf)
    steps = unpack(fx.v_kept(spark, sf), V)
    both = []
    for s in V.species:
        log = manifest.z_to_log10(manifest.normalize(F.col(s), s), s)
        both.append(F.struct(F.lit(s).alias("species"), log.alias("log10_value"), F.abs(manifest.log10_to_z(log, s) - manifest.normalize(F.col(s), s)).alias("gap")))
    rows = steps.select(F.inline(F.array(*both)))
    out = rows.groupBy("species").agg(F.count(F.lit(1)).alias("n"), F.avg("log10_value").alias("mean_log10"), F.count_if(F.col("gap") < 1e-9).alias("n_inverse"))
    return _r(out, 8, "mean_log10")


@query
def head_residual_log(spark: SparkSession, sf: str) -> DataFrame:
    rows, manifest = fx.r_normalized(spark, sf)
    out = []
    for k, s in enumerate(V.species):
        moved = manifest.z_to_log10(F.get("z_true", F.lit(k)), s) + F.lit(0.05)
        out.append(F.struct(F.lit(s).alias("species"), manifest.log10_to_z(moved, s).alias("z")))
    return _r(rows.select(F.inline(F.array(*out))).groupBy("species").agg(F.avg("z").alias("mean_z"), F.min("z").alias("min_z"), F.max("z").alias("max_z")), 8, "mean_z", "min_z", "max_z")


@query
def head_residual(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = fx.r_normalized(spark, sf)
    moved = transforms.residual_head(F.col("z_true"), F.transform("z_pred", lambda z: 0.1 * z))
    return rows.select(F.posexplode(moved).alias("k", "z")).groupBy("k").agg(F.round(F.avg("z"), 8).alias("mean_z"), F.count(F.lit(1)).alias("n"))


@query
def head_simplex(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = fx.r_normalized(spark, sf)
    logs = transforms.log10_softmax(F.col("z_pred"))
    return rows.select(F.posexplode(logs).alias("k", "l")).groupBy("k").agg(F.round(F.avg("l"), 8).alias("mean_log10"), F.round(F.avg(F.pow(F.lit(10.0), F.col("l"))), 8).alias("mean_share"))


@query
def species_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _r(stats.species_weights(fx.v_manifest(spark, sf, weighted=True), V, power=0.5), 9, "weight")


@query
def representative_values(spark: SparkSession, sf: str) -> DataFrame:
    return _r(stats.representative_values(fx.v_manifest(spark, sf)), 8, "value")


@query
def pairs_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = pairs.all_pairs(fx.v_kept(spark, sf), V)
    return rows.select(*KEY, "i", "j", "dt", F.round(F.get("y_i", F.lit(0)), 8).alias("ch4_i"), F.round(F.get("y_j", F.lit(3)), 8).alias("hcn_j"), F.get("g", F.lit(0)).alias("p"))


@query
def pairs_sampled(spark: SparkSession, sf: str) -> DataFrame:
    rows = pairs.sample_pairs(fx.v_kept(spark, sf), V, draws=4, targets=2, epoch=3)
    return rows.select(*KEY, "draw", "target", "i", "j", "dt", F.round(F.get("y_j", F.lit(1)), 8).alias("co_j"))


@query
def query_points(spark: SparkSession, sf: str) -> DataFrame:
    rows = pairs.query_points(fx.v_kept(spark, sf), V, 6)
    return rows.select(*KEY, "q", "j", "dt")


# -- score and evaluate ---------------------------------------------------------------------------


@query
def score_persistence(spark: SparkSession, sf: str) -> DataFrame:
    scored = score.score(pairs.all_pairs(fx.v_kept(spark, sf).where("split = 'test'"), V), score.persistence)
    out = evaluate.error_points(scored, V).groupBy("species", "i", "j").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae"))
    return _r(out, 9, "mae")


@query
def alignment(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.r(spark, sf)
    return evaluate.alignment_report(rows.where("i < 6").select(*evaluate.PAIR, "y_pred"), rows.where("j > 2").select(*evaluate.PAIR, "y_j"))


@query
def error_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.error_summary(evaluate.error_points(fx.r(spark, sf), V), bucket_floor=0.5)
    return _r(out, 7, *[c for c in out.columns if c not in ("bucket", "n")])


@query
def error_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    points = evaluate.error_points(fx.r(spark, sf), V, ["CO", "HCN"])
    out = evaluate.error_summary(points, bucket_floor=0.1, quantiles=(0.25, 0.5, 0.75))
    return _r(out.select("bucket", "n", "p25", "p50", "p75"), 7, "p25", "p50", "p75")


@query
def relative_error(spark: SparkSession, sf: str) -> DataFrame:
    return _r(evaluate.relative_error(evaluate.error_points(fx.r(spark, sf), V)), 7, "mean_relative", "max_relative")


@query
def loss_components(spark: SparkSession, sf: str) -> DataFrame:
    rows, manifest = fx.r_normalized(spark, sf)
    weights = {r["key"]: r["weight"] for r in stats.species_weights(fx.v_manifest(spark, sf, weighted=True), V).collect()}
    out = evaluate.loss_components(rows, V, manifest, weights)
    return _r(out, 8, *out.columns)


@query
def loss_by_step(spark: SparkSession, sf: str) -> DataFrame:
    rows, manifest = fx.r_normalized(spark, sf)
    out = evaluate.loss_components(rows.withColumn("steps", F.col("j") - F.col("i")), V, manifest, by=["steps"])
    return _r(out.select("steps", "total", "mult_err_proxy"), 8, "total", "mult_err_proxy")


@query
def epoch_means(spark: SparkSession, sf: str) -> DataFrame:
    rows, manifest = fx.r_normalized(spark, sf)
    batches = evaluate.loss_components(rows, V, manifest, by=["file_id"]).join(rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("w")), "file_id")
    return _r(evaluate.weighted_means(batches, ["total", "z"], "w"), 8, "total", "z")


@query
def trajectory_peak_error(spark: SparkSession, sf: str) -> DataFrame:
    return _r(evaluate.peak_errors(evaluate.error_points(fx.r(spark, sf), V)), 8, "peak")


@query
def worst_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    return _r(evaluate.worst(evaluate.peak_errors(evaluate.error_points(fx.r(spark, sf), V))), 8, "peak")


@query
def peak_error_distribution(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.peak_distribution(evaluate.peak_errors(evaluate.error_points(fx.r(spark, sf), V)))
    return _r(out, 8, *out.columns)


@query
def sampled_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.sampled_trajectories(fx.v_kept(spark, sf).select(*KEY), 84, V.seed)


@query
def quadrant_picks(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.quadrant_picks(fx.v_kept(spark, sf), "P", "T", V.seed)


@query
def species_peak_order(spark: SparkSession, sf: str) -> DataFrame:
    long = long_form(unpack(fx.v_kept(spark, sf), V), V).withColumn("species", names.label(F.col("species")))
    return _r(evaluate.species_by_peak(long, "time", high=4096.0), 8, "peak")


@query
def count_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.count_breakdown(fx.r(spark, sf), V)


@query
def strided_sample(spark: SparkSession, sf: str) -> DataFrame:
    points = evaluate.error_points(fx.r(spark, sf), V).withColumns({"i": F.col("i").cast("string"), "j": F.col("j").cast("string")})
    return evaluate.strided_sample(points, F.col("y_true") > 0.2, [*KEY, "i", "j", "species"], 500, V.seed).select(*KEY, "i", "j", "species")


@query
def bottom_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Sixty points of each species, by hash."""
    points = evaluate.error_points(fx.r(spark, sf), V).withColumns({"i": F.col("i").cast("string"), "j": F.col("j").cast("string")})
    found = evaluate.bottom_sample(points, F.col("y_true") > 0.2, [*KEY, "i", "j", "species"], 60, V.seed, ["species"])
    return found.select(*KEY, "i", "j", "species")


@query
def alignment_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of some pairs joined with truth of some, both in bucketed tables; no exchange."""
    rows = fx.r(spark, sf)
    name = f"t{uuid.uuid4().hex}"
    predictions = bucketed.write_bucketed(rows.where("i < 6").select(*evaluate.PAIR, "y_pred"), f"{name}_predictions", evaluate.PAIR, 8)
    truth = bucketed.write_bucketed(rows.where("j > 2").select(*evaluate.PAIR, "y_j"), f"{name}_truth", evaluate.PAIR, 8)
    both = evaluate.aligned(predictions.hint("merge"), truth)
    return _r(both.select(*evaluate.PAIR, F.get("y_j", F.lit(0)).alias("truth"), F.get("y_pred", F.lit(0)).alias("prediction")), 8, "truth", "prediction")


@query
def distinct_grids(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct time grids and part lists of orders by file and over all: exact numbers, and whether the sketches' are within three errors."""
    rows = fx.o(spark, sf).select("file_id", "t", "l_extendedprice")
    values = {"grids": F.col("t"), "prices": F.col("l_extendedprice")}
    found = written(sketches.distinct_sketches(rows, values), "sketches")
    every = sketches.merged(found, list(values)).withColumn("file_id", F.lit(None).cast("string"))
    near = sketches.estimates(found.unionByName(every), list(values))
    exact = rows.rollup("file_id").agg(*[F.count_distinct(v).alias(f"n_{n}") for n, v in values.items()])
    both = exact.join(near, exact["file_id"].eqNullSafe(near["file_id"]))
    close = [(F.abs(F.col(n) - F.col(f"n_{n}")) <= 3 * sketches.ERROR * F.col(f"n_{n}") + 1).alias(f"{n}_close") for n in values]
    return both.select(exact["file_id"], *[f"n_{n}" for n in values], *close)


# -- the order of an epoch --------------------------------------------------------------------------

#: Few trajectories in a shard, so that small tables have several.
_EPOCH = type(V)(**{**V.__dict__, "trajectories_per_shard": 40})


def _epoch_shards(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    path = scratch_path(spark, "epoch")
    shards.write_shards(fx.v_kept(spark, sf), path, _EPOCH)
    return path, shards.file_index(spark, path)


@query
def epoch_places(spark: SparkSession, sf: str) -> DataFrame:
    """The place of every pair of every split in the order of epoch 3, eight pairs a trajectory."""
    path, index = _epoch_shards(spark, sf)
    order = epochs.shard_order(index, _EPOCH, 3, 8)
    return epochs.with_places(shards.read_shards(spark, path), order, _EPOCH, 3, 8).select(*KEY, "split", "unit", "place")


@query
def places_read(spark: SparkSession, sf: str) -> DataFrame:
    """A stretch of the training split's epoch 4, read from its shards."""
    path, index = _epoch_shards(spark, sf)
    return epochs.read_places(spark, path, index, _EPOCH, "train", 4, 700, 1100, 8).select(*KEY, "shard", "unit", "place")


# -- trajectories of any length ---------------------------------------------------------------------


@query
def window_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of a user's events within two days, from segments of three."""
    found = segments.window_pairs(fx.e_points(spark, sf), "t", 2 * 86400.0, 3 * 86400.0)
    return found.select("group_id", F.col("i.t").alias("t_i"), F.col("j.t").alias("t_j"), F.col("i.value").alias("value_i"), F.col("j.value").alias("value_j"))


def _event_steps(spark: SparkSession, sf: str) -> DataFrame:
    return segments.with_steps(fx.e_points(spark, sf), "t", 7 * 86400.0)


@query
def ragged_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of all orders' lines, one or two steps apart, whatever the number of lines."""
    spec = type(V)(**{**fx.O_SPEC.__dict__, "max_steps": 2})
    lines, orders = fx.o_lines(spark, sf)
    steps = segments.with_steps(lines, "t", 3.0, fx.O_TIES, orders).drop(*fx.O_TIES)
    found = segments.step_pairs(steps, spec, length=3)
    columns = [F.col(f"{side}.{c}").alias(f"{n}_{side}") for side in "ij" for c, n in (("step", "step"), ("l_quantity", "quantity"))]
    return found.select("file_id", F.col("group_id").cast("string").alias("group_id"), *columns, "dt")


@query
def ragged_dt_spec(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds over grids that all differ, some with fewer steps than the most that are allowed."""
    spec = type(V)(**{**fx.E_SPEC.__dict__, "min_steps": 2, "max_steps": 60})
    return _r(segments.ragged_dt_spec(_event_steps(spark, sf), spec, length=16), 9, "log_min", "log_max", "k1_min", "k1_max")


# -- results that are used again --------------------------------------------------------------------


@query
def reuse_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of a second run: outcome and trajectories found after each step."""
    base = scratch_path(spark, "reuse")
    source, out, rows = f"{base}/in", f"{base}/out", fx.v(spark, sf)
    rows.where("P <= 8").write.parquet(source)
    changed = type(V)(**{**V.__dict__, "min_value_threshold": 2e-3})
    found = []

    def step(name: str, spec=V, **how) -> None:
        try:
            outcome = jobs.prepare(read_trajectories(spark, source, spec), spec, out, **how)["outcome"]
        except outputs.DoesNotFit as e:
            outcome = e.why
        except FileExistsError:
            outcome = "exists"
        splits = spark.read.parquet(f"{out}/kept").groupBy().agg(F.count(F.lit(1)).alias("n"))
        splits.select(F.lit(name).alias("step"), F.lit(outcome).alias("outcome"), "n").write.parquet(f"{base}/found/{name}")
        found.append(f"{base}/found/{name}")

    step("first")
    step("again")
    step("reuse", reuse=True)
    step("other setting", changed, reuse=True)
    rows.where("P > 8").write.mode("append").parquet(source)
    step("more input", reuse=True)
    step("overwrite", overwrite=True)
    step("other setting overwritten", changed, overwrite=True)
    outputs.removed(spark, f"{out}/commit")
    step("half", changed, reuse=True)
    return spark.read.parquet(*found)


@query
def prepared_globals(spark: SparkSession, sf: str) -> DataFrame:
    """A prepared folder opened with the species' names alone, and its globals normalized by its manifest."""
    out = scratch_path(spark, "prepared")
    jobs.prepare(fx.v(spark, sf), V, out)
    spec, kept, manifest = jobs.open_prepared(spark, out, V.species)
    return normalized(kept, spec, manifest).select(*KEY, F.round("P", 8).alias("p_norm"), F.round("T", 8).alias("t_norm"))


@query
def stored_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Training statistics after files came, changed and went; each update reads what changed and nothing else."""
    base, rows, found = scratch_path(spark, "moments"), fx.v(spark, sf), []
    parts = {n: f"{base}/in/{n}" for n in ("low", "middle", "high")}
    for n, where in (("low", "P <= 4"), ("middle", "P > 4 AND P <= 7"), ("high", "P > 7")):
        rows.where(where).write.parquet(parts[n])

    def step(name: str, *inputs: str) -> None:
        merged = moments.update(spark, f"{base}/store", [parts[n] for n in inputs], V)
        merged.select(F.lit(name).alias("step"), "key", "n", "mean", "min", "max", "std").write.parquet(f"{base}/found/{name}")
        found.append(f"{base}/found/{name}")

    step("first", "low", "middle")
    step("same", "low", "middle")
    step("added", "low", "middle", "high")
    rows.where("P = 5").write.mode("overwrite").parquet(parts["middle"])
    step("changed", "low", "middle", "high")
    step("removed", "middle", "high")
    return _r(spark.read.parquet(*found), 9, "mean", "min", "max", "std")


# -- chemistry ------------------------------------------------------------------------------------


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "documents").select(F.explode(F.split("text", r"[\s]+")).alias("species")).distinct()


@query
def element_composition(spark: SparkSession, sf: str) -> DataFrame:
    rows = chemistry.element_composition(_words(spark, sf))
    return rows.groupBy("element").agg(F.count(F.lit(1)).alias("n_names"), F.sum("n_atoms").alias("n_atoms"))


@query
def solar_reference(spark: SparkSession, sf: str) -> DataFrame:
    rows = chemistry.solar_references(chemistry.element_composition(_words(spark, sf)))
    return rows.select(F.round("c_to_o", 9).alias("c_to_o"), F.round("m_to_h", 12).alias("m_to_h"), F.concat_ws(",", "elements").alias("elements"), F.concat_ws(",", "missing").alias("missing"))


@query
def global_scale(spark: SparkSession, sf: str) -> DataFrame:
    rows = chemistry.global_scales(_words(spark, sf), "species")
    kinds = ["is_metallicity", "metallicity_scale", "is_c_to_o", "c_to_o_scale"]
    return rows.groupBy(*kinds).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("canonical").alias("n_canonical"))


def _atoms(spark: SparkSession) -> dict[str, list[float]]:
    return chemistry.coefficients(spark, V.species)


@query
def species_ratios(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.r(spark, sf)
    co, mh = chemistry.element_ratios(F.col("y_j"), _atoms(spark))
    return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(co), 8).alias("c_to_o"), F.round(F.avg(mh), 8).alias("m_to_h"), F.round(F.max(scalars.safe_log10(co)), 8).alias("max_log_c_to_o"))


@query
def chemistry_report(spark: SparkSession, sf: str) -> DataFrame:
    c, o = (10.0 ** (names.SOLAR[e] - 12.0) for e in ("C", "O"))
    metals = sum(10.0 ** (names.SOLAR[e] - 12.0) for e in ("C", "O", "N"))
    scale = "linear_ratio_like"
    rows = chemistry.chemistry_quantities(written(fx.r(spark, sf), "scored"), _atoms(spark), c / o, metals, metallicity=(F.get("g", F.lit(0)), scale), c_to_o=(F.get("g", F.lit(1)), "linear_ratio"))
    return _r(chemistry.chemistry_report(rows), 6, "mean", "std", "min", "max")


# -- names and run logs ---------------------------------------------------------------------------


@query
def schema_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Names here are event types, listed by how often even and odd users have them."""
    rows = fx.table(spark, sf, "events").groupBy((F.col("user_id") % 2).alias("side"), F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    listed = rows.withColumn("position", F.row_number().over(Window.partitionBy("side").orderBy(F.desc("n"), "name")))
    return diff.schema_diff(listed.where("side = 0"), listed.where("side = 1"))


@query
def name_sets(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "events")
    users = rows.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("all"))
    known = rows.where("user_id % 5 = 0").agg(F.collect_set("event_type").alias("known"))
    both = users.crossJoin(F.broadcast(known))  # one row
    return both.select("user_id", F.concat_ws(",", diff.ordered_union("all", F.array().cast("array<string>"))).alias("union"), F.concat_ws(",", diff.unknown_names("all", "known")).alias("unknown"))


@query
def metrics_log_read(spark: SparkSession, sf: str) -> DataFrame:
    """The logs of all runs as nested JSON lines, some without validation, in several files each, read back: the last line of each epoch."""
    path, log = scratch_path(spark, "metrics"), fx.run_log(spark, sf)
    part = F.struct(F.col("val_loss").alias("loss"))
    nested = log.select("run_id", "seq", F.struct("epoch", F.struct(F.col("train_loss").alias("loss")).alias("train"), F.when(F.col("seq") % 3 != 0, part).alias("val")).alias("r"))
    lines = nested.repartitionByRange(16, "run_id", "seq").sortWithinPartitions("run_id", "seq")
    lines.select("run_id", F.to_json("r").alias("value")).write.partitionBy("run_id").text(path)
    rows = runlogs.read_metrics(spark, path, run=r"run_id=([^/]+)/")
    return runlog.last_per_epoch(rows.select("run_id", "epoch", "seq", F.col("train.loss").alias("train_loss"), F.col("val.loss").alias("val_loss")))


@query
def metrics_last_per_epoch(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.last_per_epoch(fx.run_log(spark, sf))


@query
def metrics_best_so_far(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.best_so_far(runlog.last_per_epoch(fx.run_log(spark, sf)))


@query
def metrics_curve(spark: SparkSession, sf: str) -> DataFrame:
    out = runlog.curve(runlog.last_per_epoch(fx.run_log(spark, sf)))
    return out.withColumn("val_loss", F.when(~F.isnan("val_loss"), F.col("val_loss")))


@query
def probe_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs drawn near typical values, ten for each trajectory of the training split."""
    typical = {r["key"]: r["value"] for r in stats.representative_values(fx.v_manifest(spark, sf)).collect()}
    dt = stats.dt_spec(fx.v(spark, sf).agg(F.min("time").alias("time")), V).first()
    n = 10 * fx.v_kept(spark, sf).where("split = 'train'").count()
    rows = score.probe_inputs(spark, n, V, typical, (10.0 ** dt["log_min"], 10.0 ** dt["log_max"]))
    y = [F.round(F.get("y_i", F.lit(k)), 8).alias(f"y{k}") for k in range(4)]
    return rows.select("id", *y, F.round("dt", 6).alias("dt"), F.round(F.get("g", F.lit(0)), 8).alias("p"), F.round(F.get("g", F.lit(1)), 6).alias("t"))


