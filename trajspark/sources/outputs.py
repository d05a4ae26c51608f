"""Written results that say what they were made from, so that they are used again only where they fit.

A result is a folder. Beside its tables it gets ``inputs`` (path, length and change time of every input file) and, last of
all, ``commit`` with the settings and a digest of the inputs. A folder without ``commit`` was not finished.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.spec import TrajectorySpec

FILES = "path string, length long, modified timestamp"
#: Differences that an error names.
NAMED = 5


class DoesNotFit(ValueError):
    """A result that was made from other inputs or settings, or was not finished. ``why`` says which."""

    def __init__(self, why: str, text: str):
        super().__init__(text)
        self.why = why


def _fs(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_empty(spark: SparkSession, path: str) -> bool:
    """Whether there is no such folder, or nothing in it."""
    return not names_in(spark, path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none where there is no such folder."""
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def removed(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file, through Spark so that any file system will do."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").option("lineSep", "\n").text(path)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def listed(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path``, ``length`` and ``modified`` of all files below ``paths``; their content is not read."""
    if not paths:
        return spark.createDataFrame([], FILES)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    m = "_metadata.file_"
    return files.select(F.col(f"{m}path").alias("path"), F.col(f"{m}size").alias("length"), F.col(f"{m}modification_time").alias("modified"))


def settings_of(spec: TrajectorySpec, **more) -> dict:
    """Settings as JSON has them."""
    return json.loads(json.dumps(dataclasses.asdict(spec) | more))


def _digest(files: DataFrame) -> dict:
    mixed = F.xxhash64("path", "length", F.unix_micros("modified"))
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.coalesce(F.bit_xor(mixed), F.lit(0)).alias("hash")).first().asDict()


def commit(spark: SparkSession, out: str, settings: dict, files: DataFrame) -> None:
    files.write.parquet(f"{out}/inputs")
    stored = spark.read.parquet(f"{out}/inputs")
    write_text(spark, f"{out}/commit", json.dumps({"settings": settings, "inputs": _digest(stored)}, sort_keys=True))


def made_with(spark: SparkSession, out: str) -> dict:
    """The settings of a finished result."""
    if not exists(spark, f"{out}/commit/_SUCCESS"):
        raise DoesNotFit("unfinished", f"{out} was not finished")
    return json.loads(read_text(spark, f"{out}/commit"))["settings"]


def changed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """``path`` and ``change``: ``added``, ``removed`` or ``changed``."""
    a, b = (df.select("path", F.struct("length", "modified").alias(n)) for df, n in ((before, "a"), (now, "b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def state(spark: SparkSession, out: str, settings: dict, files: DataFrame) -> tuple[str, list[str]]:
    """``absent``, ``unfinished``, ``setting``, ``input`` or ``fits``, and what differs."""
    if is_empty(spark, out):
        return "absent", []
    if not exists(spark, f"{out}/commit/_SUCCESS"):
        return "unfinished", []
    made = json.loads(read_text(spark, f"{out}/commit"))
    keys = sorted({*made["settings"], *settings})
    if other := [k for k in keys if made["settings"].get(k) != settings.get(k)]:
        return "setting", other
    if made["inputs"] != _digest(files):
        some = changed_files(spark.read.parquet(f"{out}/inputs"), files).orderBy("path").limit(NAMED).collect()
        return "input", [f"{r['change']} {r['path']}" for r in some]
    return "fits", []


def produced(
    spark: SparkSession, out: str, settings: dict, inputs: Sequence[str], build: Callable[[], None], reuse: bool = False, overwrite: bool = False
) -> str:
    """See that ``out`` holds the result of ``build`` for these settings and inputs; returns ``made``, ``reused`` or ``replaced``.

    An existing result is used again only on request (``reuse``) and where it fits; ``overwrite`` replaces it, whatever it
    is. Else it is an error that names the difference. Without known inputs a result never counts as fitting.
    """
    files = listed(spark, inputs)
    found, what = state(spark, out, settings, files)
    if found != "absent":
        if overwrite:
            removed(spark, out)
        elif found == "fits" and not reuse:
            raise FileExistsError(f"{out} exists: ask for its reuse, or to overwrite it")
        elif found == "fits" and inputs:
            return "reused"
        else:
            why = {"unfinished": "was not finished", "setting": "was made with other settings", "input": "was made from other inputs", "fits": "was made from inputs that are not known"}[found]
            raise DoesNotFit(found, f"{out} {why}{': ' if what else ''}{', '.join(what)}")
    build()
    commit(spark, out, settings, files)
    return "made" if found == "absent" else "replaced"
