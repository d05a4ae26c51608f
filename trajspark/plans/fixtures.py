"""Trajectories from the given tables, in the shapes that the operators work on.

``V``: 16 points on a shared grid, from ``embeddings``. ``O``: ragged and defective ones, from ``orders`` and
``lineitem``. ``O4``: those of ``O`` that have points, at four places of each, on the grid 1 to 4. ``E``: irregular series, from
``events``. ``D``: those of ``V`` with defects of every kind. ``R``: predictions on the test split of ``V``. ``L``: a run log, from ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.functions.hashing import split_name
from trajspark.operators import pairs, stats, validate
from trajspark.operators.normalize import Manifest
from trajspark.sources.trajectories import pack
from trajspark.spec import TrajectorySpec

V_SPEC = TrajectorySpec(
    species=("CH4_evolution", "CO_evolution", "H2O_evolution", "HCN_evolution"),
    globals=("P", "T"),
    methods={"HCN_evolution": "standard", "CO_evolution": "min-max", "H2O_evolution": "log-min-max", "P": "log-min-max", "T": "standard", "time": "min-max"},
    min_value_threshold=1e-3,
    max_steps=8,
)
O_SPEC = TrajectorySpec(species=("l_quantity", "l_extendedprice", "l_discount", "l_tax"), globals=("o_totalprice", "c_acctbal"), time="t", default_method="standard", min_value_threshold=1e-3)
O4_SPEC = TrajectorySpec(**{**O_SPEC.__dict__, "use_fraction": 0.8, "trajectories_per_shard": 100})
#: The order of an order's lines with equal numbers.
O_TIES = ("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
E_SPEC = TrajectorySpec(species=("value",), time="t", default_method="standard")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")

    def series(n: int):
        return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.abs(F.get("embedding", 4 * k + n).cast("double")))

    time = F.array(F.lit(0.0), *[F.lit(2.0 ** (k - 1)) for k in range(1, 16)])
    return rows.select(
        F.concat(F.lit("label_"), "label").alias("file_id"),
        F.col("vec_id").cast("string").alias("group_id"),
        time.alias("time"),
        *[series(n).alias(s) for n, s in enumerate(V_SPEC.species)],
        (F.lit(1.0) + F.col("label")).alias("P"),
        (F.lit(300.0) + (F.col("vec_id") * 37) % 2701).alias("T"),
    )


def d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``V`` where some trajectories lack a time, species or global, and some have values that are not finite."""
    n = F.col("group_id").cast("bigint")

    def at(column: str, place: int, value: str):
        return F.transform(column, lambda x, k: F.when(k == place, F.lit(float(value))).otherwise(x))

    def when(divisor: int, rest: int, column: str, changed):
        return F.when(n % divisor == rest, changed).otherwise(F.col(column)).alias(column)

    changed = {
        "CO_evolution": when(11, 3, "CO_evolution", at("CO_evolution", 5, "nan")),
        "HCN_evolution": when(13, 5, "HCN_evolution", at("HCN_evolution", 2, "inf")),
        "H2O_evolution": when(17, 7, "H2O_evolution", F.lit(None)),
        "T": when(19, 4, "T", F.lit(None)),
        "P": when(23, 9, "P", F.lit(float("inf"))),
        "time": F.when(n % 31 == 8, F.lit(None)).when(n % 29 == 6, at("time", 3, "nan")).when(n % 37 == 2, at("time", 3, "1")).otherwise(F.col("time")).alias("time"),
        "CH4_evolution": when(7, 2, "CH4_evolution", F.slice("CH4_evolution", 1, 15)),
    }
    rows = v(spark, sf_dir)
    return rows.select(*[changed.get(c, F.col(c)) for c in rows.columns])


def kept(traj: DataFrame, spec: TrajectorySpec) -> DataFrame:
    """Trajectories that pass every rule, with their split."""
    valid = validate.classify(traj, spec).where("reason = 'valid'").drop("reason", "min_dt", "max_dt")
    rows = validate.with_fate(validate.checked_lengths(valid, spec), spec).where("fate = 'kept'").drop("fate")
    return rows.withColumn("split", split_name(spec.seed, spec.val_fraction, spec.test_fraction))


def v_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(v(spark, sf_dir), V_SPEC)


def v_manifest(spark: SparkSession, sf_dir: str, weighted: bool = False) -> DataFrame:
    return stats.fit_manifest(v_kept(spark, sf_dir).where("split = 'train'"), V_SPEC, weighted)


def v_collected(spark: SparkSession, sf_dir: str) -> Manifest:
    grid = v(spark, sf_dir).agg(F.min("time").alias("time"))
    return Manifest.collect(v_manifest(spark, sf_dir), stats.dt_spec(grid, V_SPEC))


def o_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("double").alias("t"), *[F.col(s).cast("double").alias(s) for s in O_SPEC.species],
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").alias("seq"),
    )
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.select(
        F.col("o_orderpriority").alias("file_id"), F.col("o_orderkey").cast("string").alias("group_id"), "o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), F.col("c_acctbal").cast("double").alias("c_acctbal")
    )
    return orders.join(lines, F.col("o_orderkey") == F.col("o"), "left").drop("o_orderkey", "o")


def o_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The points of ``O`` before their join, by the order's number: lines with ``O_TIES``, and the key of each order."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").cast("double").alias("t"), F.col("l_quantity").cast("double").alias("l_quantity"), *O_TIES
    )
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return lines, orders.select(F.col("o_orderpriority").alias("file_id"), F.col("o_orderkey").alias("group_id"))


def o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without lines have no arrays at all."""
    packed = pack(o_points(spark, sf_dir), O_SPEC, "seq")
    empty = F.forall("t", lambda x: x.isNull())
    return packed.withColumns({c: F.when(~empty, F.col(c)) for c in ("t", *O_SPEC.species)})


def o4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders that have lines, at four evenly spaced places of their lines."""
    last = F.size("t") - 1
    places = F.array(F.lit(0), F.floor(last / 3).cast("int"), F.floor(2 * last / 3).cast("int"), last)

    def at_places(s: str):
        return F.transform(places, lambda k: F.get(s, k))

    rows = o(spark, sf_dir).where("t is not null")
    return rows.withColumns({s: at_places(s) for s in O4_SPEC.species}).withColumn("t", F.array(*[F.lit(float(k)) for k in (1, 2, 3, 4)]))


def e_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(F.lit("events").alias("file_id"), F.col("user_id").cast("string").alias("group_id"), (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e6).alias("t"), F.col("value").cast("double").alias("value"))


def e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(e_points(spark, sf_dir), E_SPEC, "t")


def r(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the test split, with a prediction in closed form."""
    test = v_kept(spark, sf_dir).where("split = 'test'")
    manifest = v_collected(spark, sf_dir)
    rows = pairs.all_pairs(test, V_SPEC).withColumn("dt_norm", manifest.normalize_dt(F.col("dt")))
    return rows.withColumn("y_pred", F.transform("y_i", lambda y: y * (1 + 0.1 * F.col("dt_norm"))))


def r_normalized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Manifest]:
    manifest = v_collected(spark, sf_dir)

    def z(column: str):
        return F.array(*[manifest.normalize(F.get(column, F.lit(k)), s) for k, s in enumerate(V_SPEC.species)])

    return r(spark, sf_dir).withColumns({"z_true": z("y_j"), "z_pred": z("y_pred")}), manifest


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    value = F.col("value").cast("double")
    return rows.select(F.col("event_type").alias("run_id"), F.col("user_id").alias("epoch"), F.col("event_id").alias("seq"), value.alias("val_loss"), (value - 5.0).alias("train_loss"))


