"""Shards that each match the mixture of sources, by proportional stratified interleaving.

Rows are shuffled inside their source by a seeded hash and ranked; row ``r`` of ``n`` has the fractional
rank ``(r - 1/2) / n``. Sorted by fractional rank, every stretch of the order holds each source in
proportion, and cutting the order into equal counts gives the shards.

Ranks come without a window over a whole source or the whole table: the hash and the fractional rank are
both uniform, so rows are ranked inside narrow buckets of them and the bucket's offset is added. Offsets of
the first come from counts; those of the second follow from the sources' sizes by arithmetic alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark.llm.common import row_digest

#: Rows of a bucket, about: of the hash in each source, and of the fractional rank over all.
BUCKET_ROWS = 20_000


def _bits(rows: int) -> int:
    return max(4, (rows // BUCKET_ROWS).bit_length())


def shard_documents(
    docs: DataFrame, n_shards: int = 8, seed: int = 20, stratum_col: str = "source", bucket_bits: int | None = None
) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    Shards differ by one row at most, and in each a source's rows by about one from its share. The shuffle is by
    a seeded hash of the whole row, so it depends on the rows and the seed only, repeated and null ids are dealt
    like others, and rows computed anew get their old places; rows that are equal in all columns are placed one by
    one and cannot be told apart. Null strata are one stratum of their own. An empty table gives no rows. Columns
    named ``shard`` or ``slot`` are replaced; all other names are free. The number of buckets
    (2 to the power of ``bucket_bits``, by default by the number of rows) has no effect on the result.
    """
    kept = docs.drop("shard", "slot")
    bits = bucket_bits if bucket_bits is not None else _bits(docs.count())
    buckets = 1 << bits
    rows = kept.select(
        F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"),
        F.coalesce(F.concat(F.lit("s"), F.col(stratum_col).cast("string")), F.lit("n")).alias("s"),
        row_digest(kept, seed).alias("h2"),
    )
    rows = rows.withColumn("h", F.conv(F.substring("h2", 1, 15), 16, 10).cast("bigint")).withColumn("b", F.shiftright("h", 60 - bits))
    counts = rows.groupBy("s", "b").agg(F.count(F.lit(1)).alias("k"))
    of_source = Window.partitionBy("s")
    offsets = counts.select(
        "s",
        "b",
        F.sum("k").over(of_source).alias("n"),
        (F.sum("k").over(of_source.orderBy("b")) - F.col("k")).alias("before"),
    )
    in_bucket = Window.partitionBy("s", "b").orderBy("h", "h2")

    def ranked(of: DataFrame) -> DataFrame:
        r = of.join(offsets, ["s", "b"]).withColumn("r", F.col("before") + F.row_number().over(in_bucket))
        return r.withColumn("c", F.expr(f"((2 * r - 1) * {buckets}) div (2 * n)")).drop("b", "before", "h", "h2")

    # Rows before each bucket of fractional ranks, added up in two levels, so that no task sees all buckets.
    sizes = ranked(rows.drop("row")).groupBy("c").agg(F.count(F.lit(1)).alias("k")).withColumn("high", F.shiftright("c", bits // 2))
    highs = sizes.groupBy("high").agg(F.sum("k").alias("of_high"))
    everything = Window.partitionBy(F.lit(0))  # a row for each of at most 2**11 or so
    highs = highs.select("high", (F.sum("of_high").over(everything.orderBy("high")) - F.col("of_high")).alias("below"), F.sum("of_high").over(everything).alias("total"))
    within = F.sum("k").over(Window.partitionBy("high").orderBy("c")) - F.col("k")
    starts = sizes.withColumn("within", within).join(F.broadcast(highs), "high").select("c", (F.col("below") + F.col("within")).alias("start"), "total")
    along = Window.partitionBy("c").orderBy((2 * F.col("r") - 1).cast("double") / F.col("n"), "s", "r")
    placed = ranked(rows).join(starts, "c").withColumn("g", F.col("start") + F.row_number().over(along) - 1)
    placed = placed.withColumn("shard", F.expr(f"(g * {n_shards}) div total").cast("int"))
    first = F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")
    return placed.select("row.*", "shard", (F.col("g") - first).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in the order of their slots; several tasks may share a shard."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
