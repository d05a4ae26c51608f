"""Row numbers in the order of a uniform hash, over a whole table or within large groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket, about, in a table without groups.
BUCKET_ROWS = 50_000


def with_row_numbers(df: DataFrame, u: Column, ties: Sequence[str], name: str, within: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Adds numbers from 0 in the order of ``u`` (evenly spread over [0, 1]), then ``ties``.

    Windows see one narrow bucket of ``u`` in one group each; the rows of the buckets before it are added.
    So no task sorts a whole table or a hot group. There are as many buckets as the number of rows calls for, unless
    ``buckets`` says how many; results are the same. ``df`` is read three times: a table that is costly to compute should be
    written first. Its columns may have any names.
    """
    buckets = buckets or max(16, df.count() // BUCKET_ROWS)
    keys = [f"w{k}" for k in range(len(within))]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("p"), u.alias("u"), *[F.col(f"`{c}`").alias(k) for c, k in zip(within, keys, strict=True)])
    rows = rows.withColumn("b", F.least(F.lit(buckets - 1), F.floor(F.col("u") * buckets).cast("int")))
    counts = rows.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(Window.partitionBy(*keys).orderBy("b")) - F.col("k")
    offsets = counts.select(*keys, "b", before.alias("before"))  # at most ``buckets`` rows a group
    order = Window.partitionBy(*keys, "b").orderBy("u", *[F.col("p")[c] for c in ties])
    numbered = rows.withColumn("in", F.row_number().over(order) - 1).join(offsets, [*keys, "b"])
    return numbered.select("p.*", (F.col("before") + F.col("in")).alias(name))
