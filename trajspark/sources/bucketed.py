"""Tables that are written once in the order of their joins, which then need no exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from trajspark.sources.scratch import scratch_path


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """``df`` as a table of ``buckets`` buckets by ``keys``, sorted in each.

    Tables with equal keys and numbers of buckets join where they lie. Joins must be on all the keys. A bucket should fit in a
    task: choose their number by the size of the larger table. The table's files are at ``path`` (else a scratch folder).
    """
    spark = df.sparkSession
    dealt = df.repartition(buckets, *keys)  # one file for each bucket
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path or scratch_path(spark, name)).mode("errorifexists").saveAsTable(name)
    return spark.table(name)
