"""Rules and round trips of the trajectory library against plain Python."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.functions import hashing, names, scalars, transforms
from trajspark.operators import chemistry, evaluate, normalize, pairs, reports, runlog, schema_diff, score, stats, validate
from trajspark.plans import fixtures as fx
from trajspark.plans import jobs
from trajspark.sources import runlogs, shards, trajectories
from trajspark.spec import TrajectorySpec

SF = "/root/testdata/sf0.001"
SPEC = TrajectorySpec(species=("A", "B"), globals=("P",), default_method="standard", min_value_threshold=0.5, max_steps=3)
GRID = [0.0, 1.0, 3.0, 7.0]


def rows(spark, data, spec=SPEC):
    return spark.createDataFrame([(f"f{k % 2}", str(k), *r) for k, r in enumerate(data)], spec.schema)


DEFECTS = [
    ("missing_time", (None, [1.0], [1.0], 1.0)), ("nan_time", ([], [], [], 1.0)), ("nan_time", ([1.0], [1.0], [1.0], 1.0)), ("nan_time", ([0.0, math.nan], [1.0, 1.0], [1.0, 1.0], 1.0)),
    ("nan_time", ([0.0, math.inf], [1.0, 1.0], [1.0, 1.0], None)), ("nonpositive_dt", ([0.0, 1.0, 1.0], [1.0] * 3, None, 1.0)), ("nonpositive_dt", ([2.0, 1.0], [1.0] * 2, [1.0] * 2, 1.0)),
    ("missing_species", ([0.0, 2.0], [1.0] * 2, None, None)), ("missing_globals", ([0.0, 5.0], [1.0] * 2, [1.0] * 2, None)), ("valid", ([0.0, 1.0], [1.0] * 2, [1.0] * 2, 1.0)),
]


def test_first_failing_rule_wins(spark):
    got = {r.group_id: r for r in validate.classify(rows(spark, [d for _, d in DEFECTS]), SPEC).collect()}
    assert [got[str(k)].reason for k in range(len(DEFECTS))] == [reason for reason, _ in DEFECTS]
    # Steps in time count for all that passed the time rules, also those dropped later.
    report = reports.scan_overall(validate.classify(rows(spark, [d for _, d in DEFECTS]), SPEC)).where("file_id is null").first()
    assert (report.n_total, report.n_valid, report.min_forward_dt, report.max_forward_dt) == (10, 1, 1.0, 5.0)
    assert report.n_total == sum(report[f"n_{r}"] for r in validate.REASONS)


def test_dropping_the_first_step(spark):
    spec = TrajectorySpec(**{**SPEC.__dict__, "skip_first_step": True})
    got = validate.classify(rows(spark, [([], [], [], 1.0), ([0.0, 0.0, 1.0], [9.0, 1.0, 2.0], [9.0, 1.0, 2.0], 1.0), ([0.0, 1.0], [1.0] * 2, [1.0] * 2, 1.0)]), spec).orderBy("group_id").collect()
    assert [r.reason for r in got] == ["nan_time", "valid", "nan_time"] and got[1].A == [1.0, 2.0] and got[1].time == [0.0, 1.0]


def test_order_of_value_filters(spark):
    data = [(GRID, [1.0, math.nan, 1.0, 0.1], [1.0] * 4, math.inf), (GRID, [1.0, 1.0, 1.0, 0.1], [1.0] * 4, math.inf), (GRID, [0.5] * 4, [1.0] * 4, math.nan), (GRID, [0.5] * 4, [1.0] * 4, 2.0), (GRID, [1.0] * 4, [math.inf] * 4, 2.0)]
    got = {r.group_id: r.fate for r in validate.with_fate(rows(spark, data), SPEC).collect()}
    assert got == {"0": "nonfinite", "1": "below_threshold", "2": "nonfinite_global", "3": "kept", "4": "nonfinite"}
    classified = validate.classify(rows(spark, data), SPEC)
    drop = reports.drop_report(classified, SPEC).first()
    assert (drop.n_total, drop.n_valid, drop.n_dropped, drop.n_nan, drop.n_below_threshold) == (5, 1, 4, 3, 1)


def test_hard_errors(spark):
    ok = (GRID, [1.0] * 4, [2.0] * 4, 1.0)
    with pytest.raises(ValueError, match="different time grids"):
        validate.canonical_grid(rows(spark, [ok, ([0.0, 1.0, 3.0, 7.5], [1.0] * 4, [1.0] * 4, 1.0)]), SPEC)
    with pytest.raises(ValueError, match="no valid"):
        validate.canonical_grid(rows(spark, []), SPEC)
    with pytest.raises(ValueError, match="above zero"):
        validate.canonical_grid(rows(spark, [ok]), TrajectorySpec(**{**SPEC.__dict__, "methods": {"time": "log-min-max"}}))
    with pytest.raises(Exception, match="another length"):
        validate.checked_lengths(rows(spark, [(GRID, [1.0] * 3, [2.0] * 4, 1.0)]), SPEC).collect()
    with pytest.raises(ValueError, match="a split is empty"):
        validate.require_splits(rows(spark, [ok]).withColumn("split", F.lit("train")))
    with pytest.raises(ValueError, match="outside"):
        validate.require_dt_norm(spark.createDataFrame([(0.0,), (1.0,), (1.0000001,)], "dt_norm double"))
    validate.require_dt_norm(spark.createDataFrame([(0.0,), (1.0,)], "dt_norm double"))
    with pytest.raises(ValueError, match="not finite and positive"):
        validate.require_positive(spark.createDataFrame([(1.0,), (-0.0,)], "x double"), ["x"])
    with pytest.raises(ValueError, match="equal times"):
        spec = TrajectorySpec(**{**SPEC.__dict__, "time_dtype": "float32"})
        validate.require_increasing_after_cast(rows(spark, [([1e8, 1e8 + 1], [1.0] * 2, [1.0] * 2, 1.0)]), spec)
    with pytest.raises(Exception, match="not finite and positive"):
        spec = TrajectorySpec(**{**SPEC.__dict__, "methods": {"A": "log-standard"}})
        stats.fit_manifest(rows(spark, [(GRID, [1.0, 0.0, 1.0, 1.0], [1.0] * 4, 1.0)]), spec).collect()


@pytest.mark.parametrize(
    "change",
    [{"species": ()}, {"species": ("A", "a")}, {"globals": ("TIME",)}, {"val_fraction": 0}, {"val_fraction": 0.95}, {"use_fraction": 0}, {"min_steps": 0}, {"max_steps": 0}, {"default_method": "z"}, {"methods": {"Z": "standard"}}, {"dt_method": "standard"}, {"value_dtype": "int8"}, {"min_std": 0}],
)
def test_wrong_settings(change):
    with pytest.raises(ValueError):
        TrajectorySpec(**{**SPEC.__dict__, **change})


def test_hashes_as_in_python(spark):
    keys = [f"file {k}:group é{k}" for k in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = df.select("k", hashing.unit_hash(7, F.col("k")).alias("u"), hashing.derived_seed_column(7, F.col("k")).alias("s")).collect()
    for r in got:
        digest = hashlib.sha256(f"7:{r.k}".encode()).digest()
        assert r.u == int.from_bytes(digest[:8], "big") / 2**64 and r.s == hashing.derived_seed(7, r.k)


def test_split_does_not_depend_on_anything_else(spark):
    kept = fx.v_kept(spark, SF)
    a = {tuple(r) for r in kept.select("file_id", "group_id", "split").collect()}
    half = TrajectorySpec(**{**fx.V_SPEC.__dict__, "use_fraction": 0.5})
    b = {tuple(r) for r in fx.kept(fx.v(spark, SF).repartition(5), half).select("file_id", "group_id", "split").collect()}
    assert b < a and 0.3 < len(b) / len(a) < 0.7 and len({x[:2] for x in a}) == len(a)


def test_statistics_merge_and_properties(spark):
    train = fx.v_kept(spark, SF).where("split = 'train'")
    direct = {r.key: r for r in stats.partial_statistics(train.withColumn("file_id", F.lit("x")), fx.V_SPEC).collect()}
    for r in stats.merge_statistics(stats.partial_statistics(train, fx.V_SPEC)).collect():
        d = direct[r.key]
        assert r.n == d.n and (r["min"], r["max"]) == (d["min"], d["max"]) and np.allclose([r["mean"], r.m2], [d["mean"], d.m2], rtol=1e-12)
    manifest = fx.v_collected(spark, SF)
    z = trajectories.unpack(normalize.normalized(train, fx.V_SPEC, manifest), fx.V_SPEC)
    m = z.agg(F.avg("CH4_evolution"), F.stddev_pop("HCN_evolution"), F.min("CO_evolution"), F.max("CO_evolution"), F.min("H2O_evolution"), F.max("H2O_evolution"), F.min("P"), F.max("P")).first()
    assert np.allclose(list(m), [0, 1, 0, 1, 0, 1, 0, 1], atol=1e-9)
    back = normalize.denormalized(normalize.normalized(train, fx.V_SPEC, manifest), fx.V_SPEC, manifest)
    gap = back.select("group_id", F.col("H2O_evolution").alias("b")).join(train.select("group_id", "H2O_evolution"), "group_id")
    assert gap.select(F.max(F.aggregate(F.zip_with("b", "H2O_evolution", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda m, x: F.greatest(m, x)))).first()[0] < 1e-12


def test_only_training_rows_count(spark):
    kept = fx.v_kept(spark, SF)
    changed = kept.withColumn("HCN_evolution", F.when(F.col("split") != "train", F.transform("HCN_evolution", lambda x: x * 9)).otherwise(F.col("HCN_evolution")))
    a, b = (sorted(map(str, stats.fit_manifest(k.where("split = 'train'"), fx.V_SPEC).collect())) for k in (kept, changed))
    assert a == b


def test_constant_values_get_the_least_deviation(spark):
    found = stats.fit_manifest(rows(spark, [(GRID, [2.0] * 4, [1.0, 2.0, 3.0, 4.0], 5.0)]), SPEC)
    got = {(r.key, r.stat): r.value for r in found.collect()}
    assert got["A", "std"] == SPEC.min_std and got["P", "std"] == SPEC.min_std and math.isclose(got["B", "std"], math.sqrt(1.25))


def test_gaps_at_the_bounds_are_exactly_zero_and_one(spark):
    traj = rows(spark, [(GRID, [1.0] * 4, [2.0] * 4, 1.0)])
    spec = TrajectorySpec(**{**SPEC.__dict__, "max_steps": None})
    m = normalize.Manifest({}, {}, stats.dt_spec(traj.select("time"), spec).first().asDict())
    z = pairs.all_pairs(traj, SPEC).select(m.normalize_dt(F.col("dt")).alias("z"))
    assert m.dt["k1_min"] == 1.0 and m.dt["k1_max"] == 4.0
    low, high = z.agg(F.min("z"), F.max("z")).first()
    assert (low, high) == (0.0, 1.0)
    with pytest.raises(Exception, match="outside"):
        spark.createDataFrame([(1.1,)], "z double").select(m.denormalize_dt(F.col("z"))).collect()
    with pytest.raises(Exception, match="equal"):
        stats.dt_spec(spark.createDataFrame([([0.0, 1.0],)], "time array<double>"), SPEC).collect()


def test_query_indices_as_numpy(spark):
    cases = [(m, q) for m in range(2, 40) for q in (1, 2, 3, 5, 7, 10, 60)]
    df = spark.createDataFrame(cases, "m int, q int")
    for q in (1, 2, 3, 5, 7, 10, 60):
        for r in df.where(F.col("q") == q).select("m", pairs.query_indices(F.col("m"), q).alias("x")).collect():
            n = max(1, min(q, r.m - 1))
            assert r.x == np.linspace(1, r.m - 1, n).round().astype(int).tolist(), (r.m, q)


def test_sampled_pairs(spark):
    kept = fx.v_kept(spark, SF)
    a = pairs.sample_pairs(kept, fx.V_SPEC, 4, 2, epoch=1)
    b = pairs.sample_pairs(kept.repartition(7), fx.V_SPEC, 4, 2, epoch=1)
    got = sorted(map(str, a.collect()))
    assert got == sorted(map(str, b.collect())) and len(got) == 8 * kept.count()
    r = a.agg(F.min("i"), F.max("i"), F.min(F.col("j") - F.col("i")), F.max(F.col("j") - F.col("i"))).first()
    assert tuple(r) == (0, 7, 1, 8)
    assert sorted(map(str, pairs.sample_pairs(kept, fx.V_SPEC, 4, 2, epoch=2).collect())) != got
    assert pairs.sample_pairs(kept, fx.V_SPEC, first_anchor=True).where("i <> 0").isEmpty()
    assert pairs.shuffled(a, 1, 3).count() == len(got)


def test_formulas(spark):
    want = {
        "CH4_evolution": {"C": 1, "H": 4}, "CO2_evolution": {"C": 1, "O": 2}, "H": {"H": 1}, "OH": {"O": 1, "H": 1}, "NaCl": {"Na": 1, "Cl": 1}, "Ca(OH)2": {"Ca": 1, "O": 1, "H": 2},
        "H3O+": {"H": 3, "O": 1}, "C2H5OH": {"C": 2, "H": 6, "O": 1}, "e-": None, "x2": None, "C0": None, "": None, "He_evolution": {"He": 1}, "C H 4": {"C": 1, "H": 4}, "H2x": None,
    }
    df = spark.createDataFrame([(k,) for k in want], "s string")
    assert {r.s: r.f for r in df.select("s", names.formula(F.col("s")).alias("f")).collect()} == want


def test_scales_and_aliases(spark):
    df = spark.createDataFrame([("P", 0), ("T", 1), ("metallicity", 2), ("[M/H]", 3), ("log10_metallicity", 4), ("C/O", 5), ("log C/O", 6), ("CTO", 7), (None, 8)], "name string, position int")
    got = {r.name: (r.metallicity_scale, r.c_to_o_scale) for r in chemistry.global_scales(df).collect()}
    assert got["metallicity"][0] == "linear_ratio_like" and got["[M/H]"][0] == got["log10_metallicity"][0] == "log10_dex_like"
    assert got["C/O"][1] == got["CTO"][1] == "linear_ratio" and got["log C/O"][1] == "log10_ratio" and got[None] == ("unknown", "unknown")
    assert chemistry.find_alias(df, names.METALLICITY).first().name == "metallicity" and chemistry.find_alias(df, names.C_TO_O).first().name == "C/O"


def test_solar_references_and_missing_ones(spark):
    def of(*species):
        return chemistry.solar_references(chemistry.element_composition(spark.createDataFrame([(s,) for s in species], "species string"))).first()

    a = of("CH4", "CO", "H2O", "HCN", "He")
    assert a.elements == ["C", "N", "O"] and math.isclose(a.m_to_h, sum(10 ** (names.SOLAR[e] - 12) for e in "CNO")) and a.missing == []
    assert of("CH4", "XeO").missing == ["Xe"]
    with pytest.raises(ValueError, match="Xe"):
        chemistry.coefficients(spark, ["CH4", "CO", "XeO"])
    with pytest.raises(ValueError, match="has O"):
        chemistry.coefficients(spark, ["CH4"])


def test_safe_functions(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (-1.0, 2.0), (math.nan, 1.0), (1.0, math.inf), (0.0, 1.0)], "n double, d double")
    got = [r[0] for r in df.select(scalars.safe_ratio(F.col("n"), F.col("d"))).collect()]
    assert got[0] == 0.5 and got[5] == 0.0 and all(math.isnan(x) for x in got[1:5])
    logs = [r[0] for r in df.select(scalars.safe_log10(F.col("n"))).collect()]
    assert logs[0] == 0.0 and all(math.isnan(x) for x in logs[2:4]) and math.isnan(logs[5])
    text = spark.createDataFrame([("1.5",), ("x",), ("inf",), (None,), ("NaN",)], "t string")
    assert [r[0] if r[0] == r[0] else None for r in text.select(scalars.safe_float(F.col("t"))).collect()] == [1.5, None, None, None, None]


def test_heads_and_inverses(spark):
    df = spark.createDataFrame([([1.0, 700.0, -3.0],), ([0.0, 0.0, 0.0],)], "x array<double>")
    for r in df.select("x", transforms.log10_softmax(F.col("x")).alias("l")).collect():
        x = np.array(r.x)
        assert np.allclose(r.l, (x - x.max() - np.log(np.exp(x - x.max()).sum())) / np.log(10))
    stat = {"mean": 1.0, "std": 0.5, "min": 0.2, "max": 4.0, "log_mean": -1.0, "log_std": 0.3, "log_min": -3.0, "log_max": 1.0}
    v = spark.createDataFrame([(0.3,), (1.0,), (3.9,)], "v double")
    for method in ("standard", "min-max", "log-standard", "log-min-max"):
        z = transforms.normalize_value(F.col("v"), "k", method, stat)
        log = transforms.z_to_log10(z, "k", method, stat)
        for r in v.select("v", z.alias("z"), transforms.denormalize_value(z, "k", method, stat).alias("b"), log.alias("l"), transforms.log10_to_z(log, "k", method, stat).alias("z2")).collect():
            assert math.isclose(r.b, r.v, rel_tol=1e-12) and math.isclose(r.l, math.log10(r.v), abs_tol=1e-12) and math.isclose(r.z, r.z2, rel_tol=1e-9, abs_tol=1e-12)
    for bad in ({"mean": 1.0}, {"mean": 1.0, "std": 0.0}):
        with pytest.raises(ValueError):
            transforms.normalize_value(F.col("v"), "k", "standard", bad)
    with pytest.raises(ValueError):
        transforms.normalize_value(F.col("v"), "k", "min-max", {"min": 1.0, "max": 1.0})


def test_errors_and_peaks(spark):
    points = spark.createDataFrame([("f", "a", 0, 1, "X", 1.0, 1.1), ("f", "a", 0, 2, "X", 1.0, 10.0), ("f", "a", 0, 3, "X", math.nan, 1.0), ("f", "b", 0, 1, "X", 1e-20, 1.0), ("f", "c", 0, 1, "X", 1.0, 10.0)], "file_id string, group_id string, i int, j int, species string, y_true double, y_pred double")
    s = {r.bucket: r for r in evaluate.error_summary(points).collect()}
    assert s["all"].n == 4 and s["large"].n == 3 and math.isclose(s["large"].max_percent, 900.0)
    approx = {r.bucket: r for r in evaluate.error_summary(points, accuracy=1000).collect()}
    assert approx["large"].p50 in (s["large"].p50, 10.000000000000009, 900.0)
    peaks = evaluate.peak_errors(points)
    assert {r.group_id: round(r.peak, 9) for r in peaks.collect()} == {"a": 1.0, "b": 0.0, "c": 1.0}
    assert [(r["rank"], r.group_id) for r in evaluate.worst(peaks, 2).orderBy("rank").collect()] == [(1, "a"), (2, "c")]
    with pytest.raises(ValueError):
        evaluate.error_points(fx.r(spark, SF), fx.V_SPEC, ["none"])


def test_scoring_with_networks(spark):
    rng, spec, manifest = np.random.default_rng(3), fx.V_SPEC, fx.v_collected(spark, SF)
    test = pairs.all_pairs(fx.v_kept(spark, SF).where("split = 'test'"), spec)
    dense = lambda *n: score.Dense([rng.normal(0, 0.2, (b, a)) for a, b in zip(n, n[1:], strict=False)], [rng.normal(0, 0.1, b) for b in n[1:]], "tanh", [None if a == b else rng.normal(0, 0.1, (b, a)) for a, b in zip(n, n[1:-1], strict=False)])
    for model in (score.NormalizedModel(manifest, spec, dense(7, 16, 16, 4), residual=True), score.NormalizedModel(manifest, spec, dense(6, 8, 3), dense(4, 8, 3), dense(3, 8, 4))):
        got = score.score(test, model, chunk=100).collect()
        y, g = np.array([r.y_i for r in got]), np.array([r.g for r in got])
        assert np.allclose(model(y, np.array([r.dt for r in got]), g), [r.y_pred for r in got])
    assert all(r.y_pred == r.y_i for r in score.score(test, score.persistence).take(50))
    with pytest.raises(Exception, match="returned"):
        score.score(test, lambda y, dt, g: y[:, :2]).collect()
    with pytest.raises(ValueError, match="outside"):
        model(y[:1], np.array([1e9]), g[:1])


def test_shards_and_npz(spark, tmp_path):
    kept, spec = fx.v_kept(spark, SF), TrajectorySpec(**{**fx.V_SPEC.__dict__, "trajectories_per_shard": 50})
    numbered = shards.numbered(kept, spec)
    sizes = {(r.split, r["shard"]): r.n_trajectories for r in shards.shard_index(numbered).collect()}
    assert sum(sizes.values()) == kept.count() and max(sizes.values()) == 50 and sizes["train", 0] == 50
    shards.write_shards(kept, str(tmp_path / "s"), spec)
    with pytest.raises(Exception, match="(?i)exist"):
        shards.write_shards(kept, str(tmp_path / "s"), spec)
    with pytest.raises(ValueError, match="no trajectory"):
        shards.write_shards(kept.limit(0), str(tmp_path / "e"), spec)
    back = shards.read_shards(spark, str(tmp_path / "s"))
    shards.require_shards(back, spec)
    with pytest.raises(ValueError, match="species"):
        shards.require_shards(back, TrajectorySpec(species=("A",), globals=("P", "T")))
    index = shards.file_index(spark, str(tmp_path / "s")).collect()
    assert {(r.split, r["shard"]): r.n_trajectories for r in index} == sizes and {r.name for r in index} == {shards.shard_name(*k) for k in sizes}
    files = {(p.parent.parent.name, p.parent.name) for p in (tmp_path / "s").rglob("*.parquet")}
    assert len(list((tmp_path / "s").rglob("*.parquet"))) == len(files) == len(sizes)
    (tmp_path / "npz").mkdir()
    for r in shards.npz_blobs(numbered, spec).collect():
        (tmp_path / "npz" / r.name).write_bytes(r.content)
    npz = shards.read_npz(spark, str(tmp_path / "npz"))
    assert npz.count() == kept.count()
    a = sorted(round(r.y[3][2], 6) for r in npz.collect())
    assert a == sorted(round(float(np.float32(r.H2O_evolution[3])), 6) for r in kept.collect())


def test_workloads(spark, tmp_path):
    out = str(tmp_path / "run")
    report = jobs.prepare(fx.v(spark, SF), fx.V_SPEC, out)
    assert report["splits"] == {"train": 268, "validation": 29, "test": 29} and report["drops"]["n_below_threshold"] == 174
    with pytest.raises(Exception, match="(?i)exist"):
        jobs.prepare(fx.v(spark, SF), fx.V_SPEC, out)
    manifest, kept = jobs.read_manifest(spark, f"{out}/manifest"), spark.read.parquet(f"{out}/kept")
    assert list(json.loads(manifest.to_json(fx.V_SPEC))["per_key_stats"]) == fx.V_SPEC.keys
    made = jobs.make_pairs(kept.where("split = 'train'"), fx.V_SPEC, manifest)
    validate.require_dt_norm(made)
    assert made.count() == 268 * 8
    found = jobs.evaluation(kept, fx.V_SPEC, score.persistence)
    assert {r.bucket for r in found["summary"].collect()} == {"all", "large"} and found["worst"].count() == 4 and found["relative"].count() == 4


def test_run_log(spark, tmp_path):
    lines = [{"epoch": 0, "lr": 1e-3, "train": {"loss": 2.0}, "val": None}, {"epoch": 1, "lr": 1e-3, "train": {"loss": 1.0}, "val": {"loss": 3.0}}, {"epoch": 1, "lr": 1e-3, "train": {"loss": 0.5}, "val": {"loss": 2.0}}]
    (tmp_path / "m.jsonl").write_text("\n\n".join(json.dumps(x) for x in lines) + '\n{"epoch": 2, "train": {"loss": NaN}, "val": {"loss": 1.0}}\n')
    log = runlogs.read_metrics(spark, str(tmp_path / "m.jsonl"))
    flat = log.select(F.lit("r").alias("run_id"), "epoch", F.monotonically_increasing_id().alias("seq"), F.col("train.loss").alias("train_loss"), F.col("val.loss").alias("val_loss"))
    last = runlog.last_per_epoch(flat)
    assert {r.epoch: r.train_loss for r in last.where("epoch < 2").collect()} == {0: 2.0, 1: 0.5}
    assert [(r.epoch, r.best, r.improved) for r in runlog.best_so_far(last).orderBy("epoch").collect()] == [(0, None, False), (1, 2.0, True), (2, 1.0, True)]
    assert [(r.epoch, r.val_loss == r.val_loss) for r in runlog.curve(last).orderBy("epoch").collect()] == [(1, False), (2, True)]
    with pytest.raises(ValueError):
        runlog.require_curve(last.where("epoch = 2"))
    for bad in ('{"epoch": }', '{"lr": 1.0}', ""):
        (tmp_path / "bad.jsonl").write_text(bad + "\n")
        with pytest.raises(Exception):
            runlogs.read_metrics(spark, str(tmp_path / "bad.jsonl")).collect()


def test_schema_diff(spark):
    schema_diff.require_same_schema(spark, ["a", "b"], ["a", "b"])
    with pytest.raises(ValueError, match="1: b is c; 2: c is b; 3: d is None"):
        schema_diff.require_same_schema(spark, ["a", "b", "c", "d"], ["a", "c", "b"])


def test_blank_names_come_from_the_artifact(spark):
    artifact = {"species": ["a", "b"], "globals": ["P"], "time": "t"}
    assert schema_diff.resolved_names(spark, ["a", "b"], [], None, artifact) == artifact == schema_diff.resolved_names(spark, ["a", "b"], ["P"], "t", artifact)
    for bad in ((["b", "a"], [], None), ([], [], None), (["a", "b"], ["Q"], None), (["a", "b"], [], "x")):
        with pytest.raises(ValueError):
            schema_diff.resolved_names(spark, *bad, artifact)
    with pytest.raises(ValueError, match="no time"):
        schema_diff.resolved_names(spark, ["a"], [], None, {"species": ["a"], "globals": []})


def test_counts_of_atoms_that_are_too_long(spark):
    rows = spark.createDataFrame([("H99999999999",), ("H2O" + "9" * 30,), ("C2H5OH",)], "species string")
    got = {r.species: r.m for r in rows.select("species", names.formula(F.col("species")).alias("m")).collect()}
    assert got == {"H99999999999": {"H": 99999999999}, "H2O" + "9" * 30: None, "C2H5OH": {"C": 2, "H": 6, "O": 1}}


def test_infinity_is_no_improvement(spark):
    log = spark.createDataFrame([("r", 0, float("inf")), ("r", 1, float("nan")), ("r", 2, 5.0), ("r", 3, 5.0)], "run_id string, epoch int, val_loss double")
    for epochs in (1, 2, 1000):
        assert [r.improved for r in runlog.best_so_far(log, epochs=epochs).orderBy("epoch").collect()] == [False, False, True, False]


def test_points_to_trajectories_and_back(spark):
    packed = fx.v(spark, SF)
    again = trajectories.pack(trajectories.unpack(packed, fx.V_SPEC), fx.V_SPEC, "step")
    assert sorted(map(str, again.select(*packed.columns).collect())) == sorted(map(str, packed.collect()))
    flat = spark.createDataFrame([([[1.0], [2.0]],)], "x array<array<double>>")
    assert flat.select(trajectories.flat_column(F.col("x"))).first()[0] == [1.0, 2.0]
    with pytest.raises(Exception, match="one value"):
        spark.createDataFrame([([[1.0, 3.0]],)], "x array<array<double>>").select(trajectories.flat_column(F.col("x"))).collect()
