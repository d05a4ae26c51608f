"""Selection against NumPy's quantiles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.operators import quantiles as q

QS = (0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0)


def wanted(values):
    return [float(x) for x in np.quantile(np.array(values, float), QS)]


@pytest.mark.parametrize("small", [True, False])
def test_groups_and_columns_side_by_side(spark, monkeypatch, small):
    monkeypatch.setattr(q, "MAX_BROADCAST", 10**6 if small else 0)
    rng = np.random.default_rng(0)
    groups = {
        "wide": rng.standard_normal(500) * 10.0 ** rng.integers(-300, 300, 500),
        "ties": rng.integers(-3, 3, 400).astype(float),
        "near": 1.0 + rng.integers(0, 2000, 300) * 2.0**-52,
        "one": np.array([-7.5]),
        None: -rng.random(77),
    }
    rows = [(g, float(x), int(10 * x) if abs(x) < 1e9 else None) for g, v in groups.items() for x in v] + [("ties", None, None), ("none", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, name long").repartition(7)
    got = {r.g: r for r in q.exact_quantiles(df, {"x": F.col("x"), "key": F.col("name")}, QS, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert np.allclose(got[g].x, wanted(v), rtol=1e-15, atol=0)
        assert np.allclose(got[g].key, wanted([int(10 * x) for x in v if abs(x) < 1e9]), rtol=1e-15, atol=0)


def test_special_values_and_none_at_all(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, -0.0, math.inf, -math.inf, math.nan, None, 5e-324, -5e-324)], "x double")
    got = q.exact_quantiles(df, {"x": F.col("x")}, [k / 6 for k in range(7)]).first().x
    assert got[:6] == [-math.inf, -5e-324, 0.0, 0.0, 5e-324, math.inf] and math.isnan(got[6])
    assert q.exact_quantiles(df.where("false"), {"x": F.col("x")}, [0.5]).collect() == [(None,)]
    assert q.exact_quantiles(df.where("false"), {"x": F.col("x")}, [0.5], ["x"]).collect() == []


def test_no_buffer_grows_with_values(spark):
    df = spark.range(1000).withColumn("x", F.rand(1))
    plan = q.exact_quantiles(df, {"x": F.col("x")}, [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_set" not in plan and "ObjectHashAggregate" in plan  # of the ranks alone
