"""Exact quantiles by distributed selection: no task and no aggregate holds the values of a group.

The bits of a double, with those of negative ones turned round, are integers in the order of the values. A pass counts
how many values share the next ``BITS`` bits and keeps, for every wanted rank, the prefix that it falls under. After
64 bits the prefix is the value. All groups, columns and quantiles go side by side, and a group has at most
``2 ** BITS`` counts for each prefix in a pass, whatever the number of its values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.functions.scalars import NAN
from trajspark.sources.scratch import written

#: Bits of a pass; 64 is a multiple.
BITS = 16
#: Most groups whose prefixes are broadcast to the next pass (some hundred bytes for each wanted rank); more are joined by a shuffle.
MAX_BROADCAST = 10_000
_TURNED = 0x7FFF_FFFF_FFFF_FFFF


@F.pandas_udf(T.LongType())
def ordered_bits(x: pd.Series) -> pd.Series:
    """An integer in the order of doubles, where -0.0 is 0.0 and NaN is above infinity."""
    v = x.to_numpy(np.float64) + 0.0
    bits = np.where(np.isnan(v), np.nan, v).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ _TURNED, bits))


@F.pandas_udf(T.DoubleType())
def value_of_bits(bits: pd.Series) -> pd.Series:
    b = bits.to_numpy(np.int64)
    return pd.Series(np.where(b < 0, b ^ _TURNED, b).view(np.float64))


def _narrowed(keys: DataFrame, state: DataFrame, shift: int, small: bool) -> DataFrame:
    """Prefixes that are ``BITS`` longer, for the ranks that fall under them."""
    longer = F.shiftright("key", shift) if shift else F.col("key")
    first = shift + BITS == 64
    rows = keys.select("g", "name", longer.alias("bucket"), *([] if first else [F.shiftright("key", shift + BITS).alias("prefix")]))
    hits = rows.join(F.broadcast(state) if small else state, ["g", "name"] if first else ["g", "name", "prefix"])
    whole = ["g", "name", "n", "prefix", "below", "ranks"]
    counts = hits.groupBy(*whole, "bucket").agg(F.count(F.lit(1)).alias("c"))
    up_to = F.col("below") + F.sum("c").over(Window.partitionBy(*whole).orderBy("bucket"))
    placed = counts.withColumn("end", up_to).withColumn("start", F.col("end") - F.col("c"))
    inside = F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("end")))
    return placed.select("g", "name", "n", F.col("bucket").alias("prefix"), F.col("start").alias("below"), inside.alias("ranks")).where(F.size("ranks") > 0)


def exact_quantiles(rows: DataFrame, values: dict[str, Column], quantiles: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """For each of ``values`` an array with its ``quantiles``, by group or, without ``by``, in one row.

    Ranks between two values are interpolated linearly. Nulls are left out; where nothing else is, the array is null.
    Integers beyond 2**53 are doubles first. ``rows`` are read once; their 64-bit keys are written for the passes.
    """
    points = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("x")) for n, v in values.items()])
    group = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    long = rows.select(group.alias("g"), F.inline(points)).where("x is not null")
    keys = written(long.select("g", "name", ordered_bits("x").alias("key")), "quantile-keys")
    sizes = keys.groupBy("g", "name").agg(F.count(F.lit(1)).alias("n"))
    few = sizes.limit(MAX_BROADCAST + 1).collect()
    small = len(few) <= MAX_BROADCAST
    sizes = rows.sparkSession.createDataFrame(few, sizes.schema) if small else written(sizes, "quantile-sizes")
    wanted = F.array(*[F.lit(float(q)) for q in quantiles])
    place = lambda q: q * (F.col("n") - 1).cast("double")
    ranks = F.array_distinct(F.flatten(F.transform(wanted, lambda q: F.array(F.floor(place(q)), F.ceil(place(q))))))
    state = sizes.select("g", "name", "n", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), ranks.alias("ranks"))
    state = reduce(lambda s, shift: _narrowed(keys, s, shift, small), range(64 - BITS, -1, -BITS), state)
    found = state.select("g", "name", "n", F.explode("ranks").alias("rank"), F.coalesce(value_of_bits("prefix"), F.lit(NAN)).alias("x"))  # pandas hands NaN on as null
    # At most two ranks for each quantile.
    at = found.groupBy("g", "name", "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))

    def between(q: Column) -> Column:
        low, high = F.element_at("at", F.floor(place(q))), F.element_at("at", F.ceil(place(q)))
        share = place(q) - F.floor(place(q))
        return F.when(low == high, low).otherwise((1 - share) * low + share * high)

    each = at.select("g", "name", F.transform(wanted, between).alias("x"))
    names = [F.max(F.when(F.col("name") == n, F.col("x"))).alias(n) for n in values]
    if not by:
        return each.agg(*names)
    return each.groupBy("g").agg(*names).select(*[F.col("g")[c].alias(c) for c in by], *list(values))
