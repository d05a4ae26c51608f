"""Steps and pairs with few shuffles: points that get their file from a second table, and packed segments."""

import re

import pytest
from pyspark.sql import functions as F

from trajspark.operators import pairs, segments as seg
from trajspark.plans import registry
from trajspark.sources.trajectories import pack
from trajspark.spec import TrajectorySpec

SF = "/root/testdata/sf0.001"


def plain(df):
    return sorted(map(tuple, df.collect()))


def test_lines_are_read_whole_once(spark):
    plan = registry.QUERIES["ragged_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in re.findall(r"ReadSchema: struct<([^\n]*)", plan) if "l_orderkey" in x]
    assert len(lines) == 2 and sum("l_partkey" in x for x in lines) == 1


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(g, float(t), k, f"{g}:{t}:{k}") for g in range(40) for t in range(g % 7) for k in range((g + t) % 3 + 1)]
    df = spark.createDataFrame([*rows, (3, None, 0, "no time"), (None, 1.0, 0, "no group")], "group_id long, t double, tie int, range string")
    return df.repartition(5)


def test_files_give_the_rows_of_a_join(spark, lines):
    """One group is in no file, one in two, one without a name, one twice in a file."""
    named = [(f"f{g % 3}", g) for g in range(39)] + [("f9", 5), (None, 6), ("f1", 4)]
    files = spark.createDataFrame(named, "file_id string, group_id long")
    joined = files.where("file_id is not null").join(lines, "group_id")
    got = seg.with_steps(lines, "t", 2.5, ["tie"], files)
    want = seg.with_steps(joined, "t", 2.5, ["tie"]).select(got.columns)
    assert got.columns == ["file_id", *lines.columns, "step"]
    assert plain(got) == plain(want) and got.count() == joined.where("t is not null").count()
    each = got.groupBy("file_id", "group_id").agg(F.sort_array(F.collect_list("step")).alias("s"))
    assert all(r.s == list(range(len(r.s))) for r in each.collect())


def test_times_without_end(spark):
    df = spark.createDataFrame([("f", "a", t) for t in (float("inf"), 2.0, float("-inf"), -1e300, 1e300)], "file_id string, group_id string, t double")
    got = seg.with_steps(df, "t", 1.0).orderBy("step").collect()
    assert [r.t for r in got] == [float("-inf"), -1e300, 2.0, 1e300, float("inf")] and [r.step for r in got] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("least, most", [(1, 1), (1, 4), (3, 4), (4, 4)])
@pytest.mark.parametrize("length", [2, 4, 5, 9, 64])
def test_packed_segments_and_joins_give_the_same_pairs(spark, least, most, length):
    spec = TrajectorySpec(species=("x",), time="t", min_steps=least, max_steps=most, default_method="standard")
    sizes = spark.range(1, 23).selectExpr("'f' AS file_id", "cast(id AS string) AS group_id", "explode(sequence(0, id - 1)) AS n")
    points = sizes.selectExpr("file_id", "group_id", "n * n * 0.5D AS t", "cast(n AS double) AS x", "map('m', n) AS m")
    want = plain(pairs.all_pairs(pack(points, spec, "t"), spec).select("group_id", "i", "j", "dt", F.col("y_i")[0], F.col("y_j")[0]))
    got = seg.step_pairs(seg.with_steps(points, "t", 7.0), spec, length)
    assert plain(got.select("group_id", "i.step", "j.step", "dt", "i.x", "j.x")) == want and want
    assert got.where("i.m['m'] <> i.step OR j.m['m'] <> j.step").count() == 0


def test_pairs_are_packed_without_lengths(spark, lines):
    spec = TrajectorySpec(species=("tie",), time="t", max_steps=4, default_method="standard")
    steps = lines.select(F.lit("f").alias("file_id"), "group_id", "t", "tie", F.col("group_id").alias("step"))

    def scans(length):
        return seg.step_pairs(steps, spec, length)._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD")

    assert scans(4) == 1 and scans(3) == 3
