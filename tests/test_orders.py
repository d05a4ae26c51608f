"""Keyed orders, bucketed joins, samples in one pass, sketches."""

import pytest
from pyspark.sql import functions as F

from trajspark.functions.permutation import permuted, unpermuted
from trajspark.operators import evaluate, sketches
from trajspark.plans import registry
from trajspark.sources import bucketed, epochs, shards
from trajspark.sources.scratch import scratch_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 99_991])
def test_permutation_is_one_to_one_and_goes_back(spark, n):
    rows = spark.range(n).withColumn("p", permuted(F.col("id"), n, 42, "a")).withColumn("q", permuted(F.col("id"), n, 42, "b"))
    rows = rows.withColumn("back", unpermuted(F.col("p"), F.lit(n), 42, "a")).toPandas()
    assert sorted(rows.p) == sorted(rows.q) == list(range(n)) and (rows.back == rows.id).all()
    if n > 100:
        assert (rows.p == rows.id).mean() < 0.05 and (rows.p == rows.q).mean() < 0.05
        assert abs(rows.p.corr(rows.id)) < 0.1 and abs((rows.p.diff().dropna() > 0).mean() - 0.5) < 0.05


def test_a_reader_opens_its_shards_alone(spark):
    path, index = registry._epoch_shards(spark, SF)
    whole = epochs.with_places(shards.read_shards(spark, path, "train"), epochs.shard_order(index, registry._EPOCH, 1, 8), registry._EPOCH, 1, 8)
    some = epochs.read_places(spark, path, index, registry._EPOCH, "train", 1, 100, 300, 8)
    assert sorted(r.place for r in whole.select("place").collect()) == list(range(268 * 8))
    assert sorted(r.place for r in some.collect()) == list(range(100, 300))
    assert some.select("shard").distinct().count() <= 2
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "shard" in plan.split("PartitionFilters")[1].split("]")[0]
    other = epochs.with_places(shards.read_shards(spark, path, "train"), epochs.shard_order(index, registry._EPOCH, 2, 8), registry._EPOCH, 2, 8)
    key = ["group_id", "unit"]
    assert whole.join(other.withColumnRenamed("place", "q"), key).where("place = q").count() < 50


def test_bucketed_tables_join_without_exchange(spark):
    rows = spark.range(2000).selectExpr("'f' AS file_id", "cast(id % 50 AS string) AS group_id", "cast(id AS int) AS i", "cast(id + 1 AS int) AS j", "id * 0.5 AS v")
    name = scratch_path(spark, "b").rsplit("/", 1)[1].replace("-", "_")
    a = bucketed.write_bucketed(rows, f"{name}_a", evaluate.PAIR, 4)
    b = bucketed.write_bucketed(rows.where("i % 2 = 0").withColumnRenamed("v", "w"), f"{name}_b", evaluate.PAIR, 4)
    both = evaluate.aligned(a.hint("merge"), b)
    assert both.count() == 1000
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    report = evaluate.alignment_report(a.hint("merge"), b.hint("merge"))
    assert [tuple(r) for r in report.collect()] == [("prediction", 1000)]


def test_samples_hand_on_few_rows(spark):
    rows = spark.range(5000).selectExpr("cast(id AS string) AS k", "id % 3 AS g")
    one = evaluate.bottom_sample(rows, F.lit(True), ["k"], 10, 1)
    each = evaluate.bottom_sample(rows, F.col("g") < 2, ["k"], 10, 1, ["g"])
    assert one.count() == 10 and each.groupBy("g").count().orderBy("g").collect() == [(0, 10), (1, 10)]
    assert "TakeOrderedAndProject" in one._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in each._jdf.queryExecution().executedPlan().toString()
    parts = [evaluate.bottom_sample(rows.where(f"k % 2 = {m}"), F.lit(True), ["k"], 10, 1) for m in (0, 1)]
    assert evaluate.bottom_sample(parts[0].union(parts[1]), F.lit(True), ["k"], 10, 1).collect() == one.collect()


def test_sketches_merge_over_files(spark):
    rows = spark.range(60_000).selectExpr("cast(id % 5 AS string) AS file_id", "array(id % 20000, 1) AS grid", "cast(null AS string) AS none")
    found = sketches.distinct_sketches(rows, {"grid": F.col("grid"), "none": F.col("none")})
    assert all(abs(r.grid - 4000) < 4000 * 3 * sketches.ERROR and r.none == 0 for r in sketches.estimates(found, ["grid", "none"]).collect())
    every = sketches.estimates(sketches.merged(found, ["grid"]), ["grid"]).first()
    assert abs(every.grid - 20_000) < 20_000 * 3 * sketches.ERROR
