"""Differences between the names that are configured and those that a table or artifact has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def schema_diff(configured: DataFrame, found: DataFrame, name_col: str = "name", position_col: str = "position") -> DataFrame:
    """By position: both names and whether they agree. A missing or further name is null on one side."""
    a = configured.select(F.col(position_col).alias("position"), F.col(name_col).alias("configured"))
    b = found.select(F.col(position_col).alias("position"), F.col(name_col).alias("found"))
    return a.join(b, "position", "full").select("position", "configured", "found", F.coalesce(F.col("configured") == F.col("found"), F.lit(False)).alias("same"))


def listed(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "position int, name string")


def require_same_schema(spark: SparkSession, configured: Sequence[str], found: Sequence[str]) -> None:
    rows = schema_diff(listed(spark, configured), listed(spark, found)).where("not same").orderBy("position").collect()
    if rows:
        raise ValueError("; ".join(f"{r['position']}: {r['configured']} is {r['found']}" for r in rows))


def resolved_names(spark: SparkSession, species: Sequence[str], globals_: Sequence[str], time: str | None, artifact: dict) -> dict:
    """Names as configured, with blank globals and a blank time taken from ``artifact``, which has ``species``,
    ``globals`` and ``time``. Species must be given; a name that differs from the artifact's is an error."""
    lacking = [k for k in ("species", "globals", "time") if artifact.get(k) is None or k != "globals" and not artifact[k]]
    if lacking:
        raise ValueError(f"the artifact has no {', '.join(lacking)}")
    if not species:
        raise ValueError("species must be given")
    require_same_schema(spark, species, artifact["species"])
    if globals_:
        require_same_schema(spark, globals_, artifact["globals"])
    if time and time != artifact["time"]:
        raise ValueError(f"time is {time}, the artifact has {artifact['time']}")
    return {"species": list(species), "globals": list(globals_ or artifact["globals"]), "time": time or artifact["time"]}


def ordered_union(*lists):
    """Array columns as one, each value once, in order of first occurrence."""
    return F.array_distinct(F.concat(*lists))


def unknown_names(given, known):
    """Values of one array column that another lacks, sorted."""
    return F.array_sort(F.array_except(given, known))
