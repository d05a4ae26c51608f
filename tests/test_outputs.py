"""Logs with line numbers, results that are used again, statistics kept up to date, one pass over raw rows."""

import json
import os

import pytest
from pyspark.sql import functions as F

from trajspark.operators import runlog, stats
from trajspark.plans import fixtures as fx, jobs
from trajspark.sources import moments, outputs, runlogs
from trajspark.sources.trajectories import read_trajectories

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("split", ["128m", "700"])
def test_lines_are_numbered_over_files_and_splits(spark, tmp_path, split):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        want = {}
        for run in ("a", "b c"):
            (tmp_path / run).mkdir()
            lines = [json.dumps({"epoch": k % 40, "lr": float(k), "train": {"loss": 1.0}, "val": None}) if k % 7 else "  " for k in range(150)]
            for n in range(3):
                (tmp_path / run / f"{n}.jsonl").write_text("\n".join(lines[50 * n : 50 * n + 50]) + "\n")
            want |= {(run.replace(" ", "%20"), k % 40): k for k in range(150) if k % 7}
        log = runlogs.read_metrics(spark, f"{tmp_path}/*/*.jsonl")
        assert all(r.seq == r.lr + 1 for r in log.collect())
        got = runlog.last_per_epoch(log.select("run_id", "epoch", "seq", "lr"))
        assert {(r.run_id, r.epoch): r.lr for r in got.collect()} == want
        if split == "700":
            assert spark.read.text(f"{tmp_path}/*/*.jsonl").rdd.getNumPartitions() > 10
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_wrong_lines_are_named(spark, tmp_path):
    for bad, what in (("[1]", "not an object"), ('{"lr": 1.0}', "no epoch"), ('{"epoch": }', ""), ("", "no metrics")):
        (tmp_path / "m.jsonl").write_text(f"\n{bad}\n")
        with pytest.raises(Exception, match=what or None):
            runlogs.read_metrics(spark, str(tmp_path / "m.jsonl")).collect()
        if "n" in what[:2]:
            with pytest.raises(Exception, match="line 2|no metrics"):
                runlogs.read_metrics(spark, str(tmp_path / "m.jsonl")).collect()


def test_result_is_used_again_only_where_it_fits(spark, tmp_path):
    source, out, made = tmp_path / "in", str(tmp_path / "out"), []
    source.mkdir()
    (source / "a").write_text("one")

    def build():
        made.append(1)
        outputs.write_text(spark, f"{out}/data", str(len(made)))

    def run(settings=None, **how):
        return outputs.produced(spark, out, settings or {"seed": 1}, [str(source)], build, **how)

    assert run() == "made" and run(reuse=True) == "reused" and len(made) == 1
    with pytest.raises(FileExistsError):
        run()
    with pytest.raises(outputs.DoesNotFit, match="seed"):
        run({"seed": 2}, reuse=True)
    (source / "b").write_text("two")
    with pytest.raises(outputs.DoesNotFit, match="added .*/b"):
        run(reuse=True)
    assert run(overwrite=True) == "replaced" and run(reuse=True) == "reused"
    os.utime(source / "a", (1, 1))
    with pytest.raises(outputs.DoesNotFit, match="changed .*/a"):
        run(reuse=True)
    outputs.removed(spark, f"{out}/commit")
    with pytest.raises(outputs.DoesNotFit, match="not finished"):
        run(reuse=True)
    with pytest.raises(outputs.DoesNotFit, match="not finished"):
        run()
    assert len(made) == 2


def test_raw_rows_are_read_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    traj = fx.v(spark, SF)
    report = jobs.prepare(traj.mapInArrow(counted, traj.schema), fx.V_SPEC, str(tmp_path / "out"), inputs=[])
    assert read.value == traj.count() == report["drops"]["n_total"]
    wrong = traj.withColumn("time", F.transform("time", lambda t: t + F.col("T")))
    with pytest.raises(ValueError, match="different time grids"):
        jobs.prepare(wrong, fx.V_SPEC, str(tmp_path / "wrong"))
    assert not (tmp_path / "wrong" / "shards").exists() and not (tmp_path / "wrong" / "commit").exists()


def test_update_reads_changed_files_alone(spark, tmp_path):
    rows, store = fx.v(spark, SF), str(tmp_path / "store")
    for k in (1, 2, 3):
        rows.where(F.col("P") % 3 == k - 1).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    paths = [str(tmp_path / f"in{k}") for k in (1, 2, 3)]
    moments.update(spark, store, paths[:2], fx.V_SPEC)
    folder = moments.folder_of(store, fx.V_SPEC)
    assert moments.fresh_files(spark, folder, paths[:2])[1] == []
    other = moments.folder_of(store, type(fx.V_SPEC)(**{**fx.V_SPEC.__dict__, "seed": 1}))
    assert len(moments.fresh_files(spark, other, paths[:2])[1]) == 2
    fresh = moments.fresh_files(spark, folder, paths)[1]
    assert len(fresh) == 1 and "/in3/" in fresh[0]
    assert all("/in3/" in f for f in moments.partials_of(spark, fresh, fx.V_SPEC).inputFiles())
    merged = {r.key: r for r in moments.update(spark, store, paths, fx.V_SPEC).collect()}
    again = stats.merge_statistics(stats.partial_statistics(fx.kept(read_trajectories(spark, paths, fx.V_SPEC), fx.V_SPEC).where("split = 'train'"), fx.V_SPEC))
    for r in again.collect():
        assert merged[r.key].n == r.n and merged[r.key].mean == pytest.approx(r["mean"]) and merged[r.key].std == pytest.approx(r["std"])
    versions = moments._versions(spark, folder)
    moments.update(spark, store, paths, fx.V_SPEC)
    assert moments._versions(spark, folder) == versions == [1, 2]
    rows.where("P > 1000").write.parquet(str(tmp_path / "empty"))
    moments.update(spark, store, [*paths, str(tmp_path / "empty")], fx.V_SPEC)
    assert moments.fresh_files(spark, folder, [*paths, str(tmp_path / "empty")])[1] == []


def test_prepared_folder_is_opened_with_blank_names(spark, tmp_path):
    out, v = str(tmp_path / "out"), fx.V_SPEC
    with pytest.raises(outputs.DoesNotFit, match="not finished"):
        jobs.open_prepared(spark, out, v.species)
    jobs.prepare(fx.v(spark, SF), v, out)
    spec, kept, manifest = jobs.open_prepared(spark, out, v.species)
    assert spec == v and kept.count() == 326 and set(manifest.methods) == set(v.keys)
    assert jobs.open_prepared(spark, out, v.species, v.globals, v.time)[0] == v
    for wrong in ((v.species[::-1],), (v.species, ("T", "P")), (v.species, (), "t"), ((),)):
        with pytest.raises(ValueError):
            jobs.open_prepared(spark, out, *wrong)


@pytest.mark.parametrize(
    ("change", "what"),
    [
        ({"auto_resume": True}, "unknown settings: .*auto_resume"), ({"target_species": ["a"]}, "unknown settings"), ({"species": []}, "at least one species"), ({"species": ["P"]}, "names must differ"),
        ({"val_fraction": 0.0}, "above 0"), ({"val_fraction": 0.6, "test_fraction": 0.4}, "training split"), ({"use_fraction": 0.0}, "use_fraction"), ({"use_fraction": 1.5}, "use_fraction"),
        ({"min_steps": 0}, "min_steps"), ({"min_steps": 9}, "max_steps"), ({"min_std": 0.0}, "min_std"), ({"epsilon": -1.0}, "epsilon"), ({"trajectories_per_shard": 0}, "trajectories_per_shard"),
        ({"dt_method": "standard"}, "log-min-max"), ({"value_dtype": "bf16"}, "dtypes"), ({"time_dtype": "int8"}, "dtypes"), ({"default_method": "none"}, "unknown methods"), ({"methods": {"x": "standard"}}, "unknown names"),
    ],
)
def test_wrong_settings_fail_at_once(change, what):
    good = outputs.settings_of(fx.V_SPEC)
    assert type(fx.V_SPEC).from_settings(good) == fx.V_SPEC
    with pytest.raises(ValueError, match=what):
        type(fx.V_SPEC).from_settings(good | change | ({"methods": {}} if "species" in change else {}))
