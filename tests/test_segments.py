"""Segments against whole trajectories, for any cut."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.operators import pairs, segments as seg, stats
from trajspark.sources.trajectories import pack
from trajspark.spec import TrajectorySpec

SPEC = TrajectorySpec(species=("x",), time="t", min_steps=2, max_steps=5, default_method="standard")


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k, n in enumerate((1, 2, 3, 5, 6, 7, 40, 111)):
        t = np.cumsum(rng.choice([0.25, 0.5, 1.0, 9.0], n)) - 20
        rows += [("f", str(k), float(a), float(i), "own") for i, a in enumerate(t)]
    rows += [("f", "none", None, 0.0, "own")]
    df = spark.createDataFrame(rows, "file_id string, group_id string, t double, x double, segment string")
    return df.repartition(6)


def plain(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("width", [0.3, 4.0, 1e9])
def test_steps(spark, points, width):
    got = seg.with_steps(points, "t", width)
    assert got.columns == [*points.columns, "step"]
    assert all(r.step == r.x for r in got.collect()) and got.count() == points.count() - 1


@pytest.mark.parametrize("width", [0.4, 2.0, 7.5, 1e6])
def test_window_pairs(points, width):
    rows = [r for r in points.collect() if r.t is not None]
    want = sorted((a.group_id, a.x, b.x) for a, b in itertools.product(rows, rows) if a.group_id == b.group_id and 0 < b.t - a.t <= 2)
    got = seg.window_pairs(points, "t", 2.0, width)
    assert plain(got.select("group_id", "i.x", "j.x")) == want and want


@pytest.mark.parametrize("length", [1, 3, 4096])
@pytest.mark.parametrize("most", [5, 3, None])
def test_step_pairs_are_those_of_packed_rows(spark, points, length, most):
    spec = TrajectorySpec(**{**SPEC.__dict__, "max_steps": most})
    packed = pack(points.where("t is not null"), spec, "t")
    want = plain(pairs.all_pairs(packed, spec).select("group_id", "i", "j", "dt", F.col("y_i")[0], F.col("y_j")[0]))
    got = seg.step_pairs(seg.with_steps(points, "t", 5.0), spec, length)
    assert plain(got.select("group_id", "i.step", "j.step", "dt", "i.x", "j.x")) == want and want


@pytest.mark.parametrize("length", [1, 7, 4096])
@pytest.mark.parametrize("most", [5, None])
def test_gap_bounds(spark, points, length, most):
    spec = TrajectorySpec(**{**SPEC.__dict__, "max_steps": most})
    packed = pack(points.where("t is not null"), spec, "t").where(F.size("t") > 1)
    each = [stats.dt_spec(packed.where(f"group_id = '{k}'").select("t"), TrajectorySpec(**{**spec.__dict__, "min_steps": 1})).first() for k in range(3, 8)]
    low = [stats.dt_spec(packed.where(f"group_id = '{k}'").select("t"), spec).first().log_min for k in range(3, 8)]
    got = seg.ragged_dt_spec(seg.with_steps(points, "t", 5.0).where("group_id >= '3'"), spec, length).first()
    assert got.log_min == min(low) and got.log_max == max(r.log_max for r in each)
    assert got.k1_min == min(r.k1_min for r in each) and got.k1_max == max(r.k1_max for r in each)


def test_equal_times_are_an_error(spark):
    df = spark.createDataFrame([("f", "a", t, k) for k, t in enumerate((0.0, 1.0, 1.0, 4.0))], "file_id string, group_id string, t double, step long")
    with pytest.raises(Exception, match="does not increase"):
        seg.ragged_dt_spec(df, SPEC).collect()


def test_no_task_sees_a_whole_trajectory(points):
    plan = seg.with_gaps(seg.with_steps(points, "t", 5.0), "t", [1, 3], 8)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "segment" in plan and plan.count("Window") == 3
