"""Steps, pairs and time gaps of trajectories of any length, with grids that may differ, without packing them.

Points stay rows. A trajectory is cut into segments by steps or by ranges of time, and the points near a segment's
end are copied into the segments that they reach (the halo). Joins and windows see one segment each, so no
task holds a whole trajectory, and results do not depend on the cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.sources.trajectories import KEY
from trajspark.spec import DTYPES, TrajectorySpec

#: Steps of a segment.
LENGTH = 4096


def _inner(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """All columns but the key as one struct, so that their names are free."""
    return df.select(*key, F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in key]).alias("p"))


def with_steps(points: DataFrame, time: str, width: float, ties: Sequence[str] = (), files: DataFrame | None = None) -> DataFrame:
    """Adds ``step`` from 0 in the order of ``time``, then ``ties``.

    A window sees the points of ``width`` in time; the counts of the ranges before it are added. Points without
    a time have no place and are left out. ``points`` are read twice; the counts need key and time alone.

    ``files`` (the key alone, a row for each trajectory) gives points that have ``group_id`` alone their ``file_id``, with the
    rows of a join. It is joined with the counts, so the points are shuffled once, for their steps.
    """
    key = KEY if files is None else ["group_id"]
    # Ranges end where there is still one before them; the order in a range is that of time, however wide it is.
    place = F.greatest(F.floor(F.col("p")[time] / F.lit(float(width))), F.lit(-(2**62)))
    rows = _inner(points.where(F.col(time).isNotNull()), key).withColumn("range", place)
    counts = rows.groupBy(*key, "range").agg(F.count(F.lit(1)).alias("k"))
    if files is not None:
        counts = counts.join(files.where("file_id is not null").select(*KEY), key)
    earlier = Window.partitionBy(*KEY).orderBy("range").rangeBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*KEY, "range", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("before"))
    order = [F.col("p")[c] for c in (time, *ties)]
    nth = F.row_number().over(Window.partitionBy(*KEY, "range").orderBy(*order)) - 1
    joined = rows.join(counts, [*key, "range"]).withColumn("nth", nth)
    columns = points.columns if files is None else ["file_id", *points.columns]
    return joined.select(*[F.col(c) if c in KEY else F.col("p")[c].alias(c) for c in columns], (F.col("before") + F.col("nth")).alias("step"))


def with_halo(rows: DataFrame, own: Column, last: Column) -> DataFrame:
    """Each row in its own ``segment`` and, as ``halo``, in those after it up to ``last``."""
    return rows.withColumn("segment", F.explode(F.sequence(own, last))).withColumn("halo", F.col("segment") > own)


def window_pairs(points: DataFrame, time: str, window: float, width: float | None = None) -> DataFrame:
    """All pairs of a trajectory's points where the second is later by at most ``window``: key, ``i`` and ``j`` (structs), ``dt``.

    A pair belongs to the segment of its second point, into which the first one's halo reaches. ``width`` is that of
    a segment in time, ``window`` unless given.
    """
    width = float(width or window)
    rows = _inner(points.where(F.col(time).isNotNull()))
    t = F.col("p")[time]
    firsts = with_halo(rows, F.floor(t / width), F.floor((t + window) / width)).select(*KEY, "segment", F.col("p").alias("i"))
    seconds = rows.select(*KEY, F.floor(t / width).alias("segment"), F.col("p").alias("j"))
    dt = F.col("j")[time] - F.col("i")[time]
    inside = (F.col("j")[time] > F.col("i")[time]) & (F.col("j")[time] <= F.col("i")[time] + window)
    return firsts.join(seconds, [*KEY, "segment"]).where(inside).select(*KEY, "i", "j", dt.alias("dt"))


def _lengths(steps: DataFrame) -> DataFrame:
    return steps.groupBy(*KEY).agg((F.max("step") + 1).alias("n"))


def _packed_pairs(rows: DataFrame, spec: TrajectorySpec, length: int) -> DataFrame:
    """Pairs from arrays: each segment's points with the ``max_steps`` after them. No lengths are needed."""
    at = F.col("p")["step"]
    first, own = (F.floor((at - k) / length) for k in (spec.max_steps, 0))
    seen = rows.withColumn("segment", F.explode(F.sequence(F.greatest(first, F.lit(0)), own)))
    by_step = F.array_sort(F.collect_list("p"), lambda a, b: F.signum(a["step"] - b["step"]).cast("int"))
    packed = seen.groupBy(*KEY, "segment").agg(by_step.alias("p"))
    # The first segment alone holds the whole of a trajectory that ends before its longest step.
    end = F.size("p") - 1
    most = F.when(F.col("segment") == 0, F.least(F.lit(spec.max_steps), end)).otherwise(F.lit(spec.max_steps))
    packed = packed.withColumn("most", most).where(F.col("most").between(spec.min_steps, end))
    anchors = packed.withColumn("a", F.explode(F.sequence(F.lit(0), F.least(F.lit(length - 1), end - F.col("most")))))
    pairs = anchors.withColumn("k", F.explode(F.sequence(F.lit(spec.min_steps), F.col("most"))))
    return pairs.select(*KEY, F.get("p", F.col("a")).alias("i"), F.get("p", F.col("a") + F.col("k")).alias("j"))


def step_pairs(steps: DataFrame, spec: TrajectorySpec, length: int = LENGTH) -> DataFrame:
    """Every anchor with every target ``min_steps`` to ``max_steps`` later, as ``all_pairs`` has them of packed rows.

    ``steps`` come from ``with_steps``. Returns key, ``i`` and ``j`` (structs with ``step``) and ``dt``. Anchors are those from
    which the longest step still ends inside the trajectory; without ``max_steps`` that is the first point alone.

    With ``max_steps`` of at most ``length``, points are shuffled once and a row holds at most twice ``length`` of them. Beyond, anchors are
    joined with their targets, and a row holds one pair.
    """
    rows = _inner(steps)
    at = F.col("p")["step"]
    if spec.max_steps is None:
        firsts = rows.where(at == 0).select(*KEY, F.col("p").alias("i"))
        pairs = firsts.join(rows.where(at >= spec.min_steps).withColumnRenamed("p", "j"), KEY)
    elif spec.max_steps <= length:
        pairs = _packed_pairs(rows, spec, length)
    else:
        lengths = _lengths(steps).where(F.col("n") > spec.min_steps)
        last = F.col("n") - 1 - F.least(F.lit(spec.max_steps), F.col("n") - 1)
        anchors = rows.join(lengths, KEY).where(at <= last)
        own, reach = (F.floor((at + k) / length) for k in (0, spec.max_steps))
        firsts = with_halo(anchors, own, reach).select(*KEY, "segment", F.col("p").alias("i"))
        seconds = rows.select(*KEY, own.alias("segment"), F.col("p").alias("j"))
        k = F.col("j")["step"] - F.col("i")["step"]
        pairs = firsts.join(seconds, [*KEY, "segment"]).where(k.between(spec.min_steps, spec.max_steps))
    return pairs.select(*KEY, "i", "j", (F.col("j")[spec.time] - F.col("i")[spec.time]).alias("dt"))


def with_gaps(steps: DataFrame, time: str, ks: Sequence[int], length: int = LENGTH) -> DataFrame:
    """Adds ``dt_k`` for each of ``ks``: the time since the point ``k`` steps before, null where there is none."""
    rows = _inner(steps)
    at = F.col("p")["step"]
    seen = with_halo(rows, F.floor(at / length), F.floor((at + max(ks)) / length))
    w = Window.partitionBy(*KEY, "segment").orderBy(at)
    gaps = {f"dt_{k}": F.col("p")[time] - F.lag(F.col("p")[time], k).over(w) for k in ks}
    own = seen.withColumns(gaps).where(~F.col("halo"))
    return own.select(*[F.col(c) if c in KEY else F.col("p")[c].alias(c) for c in steps.columns], *gaps)


def ragged_dt_spec(steps: DataFrame, spec: TrajectorySpec, length: int = LENGTH) -> DataFrame:
    """Bounds of log10 of the time gap over all allowed steps of all trajectories, as ``dt_spec`` has them of one shared grid.

    Steps are bounded by each trajectory's own length; those of fewer than two points have no gap and no say. Times
    are rounded as they will be stored. A grid that does not increase is an error, and so are gaps that are all equal.
    """
    stored = steps.select(*KEY, "step", F.col(spec.time).cast(DTYPES[spec.time_dtype]).cast("double").alias("t"))
    ks = sorted({1, spec.min_steps, spec.max_steps or 1})
    inner = with_gaps(stored, "t", ks, length).agg(
        *[f(f"dt_{k}").alias(f"{f.__name__}_{k}") for k in ks for f in (F.min, F.max)],
    )
    ends = stored.groupBy(*KEY).agg(F.max("step").alias("m"), (F.max("t") - F.min("t")).alias("whole")).where("m > 0")
    # Of a trajectory that is too short for k steps, or has no bound on them, the one gap from end to end.
    short = F.col("m") <= spec.min_steps
    long = F.lit(True) if spec.max_steps is None else F.col("m") <= spec.max_steps
    ends = ends.agg(F.min(F.when(short, F.col("whole"))).alias("short"), F.max(F.when(long, F.col("whole"))).alias("long"))
    both = inner.crossJoin(F.broadcast(ends))  # one row each
    least = F.least(f"min_{spec.min_steps}", "short")
    most = F.col("long") if spec.max_steps is None else F.greatest(f"max_{spec.max_steps}", "long")
    rows = both.select(least.alias("least"), most.alias("most"), F.col("min_1").alias("k1_min"), F.col("max_1").alias("k1_max"))
    wrong = lambda text: F.raise_error(F.lit(text)).cast("double")
    low = F.when(F.col("k1_min") > 0, F.log10("least")).otherwise(wrong("a stored time grid does not increase"))
    high = F.when(F.col("most") > F.col("least"), F.log10("most")).otherwise(wrong("all time gaps are equal"))
    return rows.select(low.alias("log_min"), high.alias("log_max"), "k1_min", "k1_max")
