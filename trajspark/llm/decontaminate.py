"""Benchmark decontamination with DataFrame functions only.

The benchmark's windows of normalised words are hashed; where their number is within a bound the hash set
is broadcast, else the same join is a shuffle of hashes alone. Documents are split into words, and pieces of a
few windows each are hashed side by side: words, then pairs, fours and eights of them, of which a window's hash
is composed. So all lengths of windows are probed in one scan, the cost grows with the text's length alone, and
only hits leave the scan. Hits are verified word by word against the benchmark's windows. Results are made once
for each distinct text that has hits.

Very long texts are cut into pieces like any other. Null and empty texts, and those without words, have no
windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.llm.common import ascii_lower, written

WINDOW = 10
#: Words of a stretch of a text, and windows of each length that begin in a piece of it.
STRETCH, PIECE = 2000, 20
#: Most distinct window hashes (8 bytes each) that are broadcast.
MAX_BROADCAST = 2_000_000
# Written out one by one: classes of single characters are matched by a table, classes of ranges one after another.
_NOT_WORD = "[" + "".join(f"\\x{i:02X}" for i in range(128) if not chr(i).isalnum()) + "]+"
_STEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text, A-Z included and not lower-cased; null has none."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), _NOT_WORD), "")


def _window_hashes(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """``rows`` without ``words``, once for each window: its first word ``pos``, its ``len``, its hash ``h``, and ``near``, in which it
    begins at ``at``. The hash is of words in lower case; windows that differ in case beyond A-Z may share one.
    """
    longest, keys = max(lengths), [c for c in rows.columns if c != "words"]
    # Stretches bound what a row carries; within one, all is one generated loop over its array.
    begins = F.sequence(F.lit(0), F.size("words") - 1, F.lit(STRETCH))
    stretches = F.transform(begins, lambda i: F.slice("words", i + 1, STRETCH + longest - 1))
    none = F.array().cast("array<array<string>>")
    rows = rows.select(*keys, F.posexplode(F.when(F.size("words") > 0, stretches).otherwise(none)).alias("stretch", "near"))
    rows = rows.select(*keys, "stretch", "near", F.explode(F.sequence(F.lit(0), F.least(F.size("near"), F.lit(STRETCH)) - 1, F.lit(PIECE))).alias("p"))
    span = PIECE + longest - 1
    # h<k>_<j>: hash of 2**k words from word j on. Each level is a projection of its own, so that it is computed once.
    rows = rows.withColumns({f"h0_{j}": F.xxhash64(F.lower(F.get("near", F.col("p") + j))) for j in range(span)})
    level = 1
    while 2**level <= longest:
        half = 2 ** (level - 1)
        rows = rows.withColumns({f"h{level}_{j}": F.xxhash64(f"h{level - 1}_{j}", f"h{level - 1}_{j + half}") for j in range(span - 2**level + 1)})
        level += 1

    def hashed(length: int, j: int) -> Column:
        parts, at = [F.lit(length)], j
        for k in reversed(range(level)):
            if length >> k & 1:
                parts.append(F.col(f"h{k}_{at}"))
                at += 2**k
        return F.when(F.size("near") >= F.col("p") + (j + length), F.xxhash64(*parts))

    hashes = F.array(*[hashed(n, j) for n in lengths for j in range(PIECE)])
    rows = rows.select(*keys, "stretch", "near", "p", F.posexplode(hashes).alias("k", "h")).where("h is not null")
    at = F.col("p") + F.col("k") % PIECE
    length = F.element_at(F.array(*map(F.lit, lengths)), F.expr(f"k div {PIECE}").cast("int") + 1)
    return rows.select(*keys, (F.col("stretch") * STRETCH + at).alias("pos"), length.alias("len"), "h", "near", at.alias("at"))


def _joined(words: str, at, length) -> Column:
    """Words as one text, with A-Z lower-cased."""
    return ascii_lower(F.array_join(F.slice(words, at + 1, length), " "))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``item``, ``len``, ``h``, ``win``: all windows; an item of fewer words is one window, of none has none."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
    items = items.withColumn("own", F.least(F.size("words"), F.lit(window)))
    wins = _window_hashes(items, list(range(1, window + 1))).where("len = own")
    return wins.select("item", "len", "h", _joined("near", F.col("at"), F.col("len")).alias("win"))


def _hits(texts: DataFrame, hashes: DataFrame, lengths: list[int], few: bool) -> DataFrame:
    """``text_sha``, ``pos``, ``len``, ``win`` of the windows whose hashes are known."""
    scanned = _window_hashes(texts, lengths)
    win = _joined("near", F.col("at"), F.col("len")).alias("win")
    if few:
        return scanned.join(F.broadcast(hashes), "h").select("text_sha", "pos", "len", win).distinct()
    places = scanned.select("text_sha", "pos", "len", "h").join(hashes.hint("merge"), "h").select("text_sha", "pos", "len").distinct()
    places = places.groupBy("text_sha").agg(F.collect_list(F.struct("pos", "len")).alias("places"))
    # The words come back once for each distinct text with hits.
    found = texts.join(places, "text_sha").dropDuplicates(["text_sha"])
    each = F.transform("places", lambda p: F.struct(p["pos"].alias("pos"), p["len"].alias("len"), _joined("words", p["pos"], p["len"]).alias("win")))
    return found.select("text_sha", F.inline(each))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    window: int = WINDOW,
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """One row for each distinct text with hits: ``text_sha``, ``n_hit``, ``items`` (sorted), ``spans``.

    ``spans`` are merged word ranges (``b``, ``e``), end not included. Items without an id count towards
    hits, but have no name in ``items``. Tables without words or matches give no rows.
    """
    windows = written(benchmark_windows(benchmark, item_col, window=window), "windows")
    by_len = windows.groupBy("len").agg(F.count_distinct("h").alias("n")).collect()
    if not by_len:
        return docs.sparkSession.createDataFrame(
            [], "text_sha string, n_hit bigint, items array<string>, spans array<struct<b: int, e: int>>"
        )
    texts = docs.select(F.sha2(F.col(text_col).cast("string"), 256).alias("text_sha"), words_of(F.col(text_col)).alias("words"))
    few = sum(r["n"] for r in by_len) <= max_broadcast
    # Written, so that texts are read once, and no condition on the hits' words is tried on all windows.
    hits = written(_hits(texts, windows.select("h").distinct(), sorted(r["len"] for r in by_len), few), "hits")
    sure = hits.join(windows.select("item", "win"), "win").select("text_sha", "pos", (F.col("pos") + F.col("len")).alias("end"), "item")
    items = sure.groupBy("text_sha").agg(F.array_sort(F.collect_set("item")).alias("items"))
    # Ranges in order of their beginnings: a range goes on with the ones before it or begins anew.
    along = Window.partitionBy("text_sha").orderBy("pos", "end")
    ranges = sure.select("text_sha", "pos", "end").distinct()
    ranges = ranges.withColumn("reached", F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)))
    ranges = ranges.withColumn("range", F.count_if(F.expr("reached is null or pos > reached")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = ranges.groupBy("text_sha", "range").agg(F.min("pos").alias("b"), F.max("end").alias("e"))
    spans = ranges.groupBy("text_sha").agg(F.sum(F.col("e") - F.col("b")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("b", "e"))).alias("spans"))
    return spans.join(items, "text_sha").select("text_sha", "n_hit", "items", "spans")


def contamination_report(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW
) -> DataFrame:
    """Per row of ``docs``: its id, ``n_words``, ``n_hit``, ``items`` (sorted ids as strings), ``contaminated``."""
    # Written, both sides of the join are read and dealt anew, so Spark can split a text with very many copies.
    found = written(contamination(docs, benchmark, text_col, item_col, window), "contamination")
    rows = docs.select(
        F.col(id_col),
        F.sha2(F.col(text_col).cast("string"), 256).alias("text_sha"),
        F.size(words_of(F.col(text_col))).cast("long").alias("n_words"),
    )
    return rows.join(found.drop("spans"), "text_sha", "left").select(
        id_col,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    window: int = WINDOW,
    remove: str = "documents",
) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with the hit words cut out.

    Cutting takes each hit word with the characters before it that are in no word. Null texts stay. Columns may
    have any names.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    found = written(contamination(docs, benchmark, text_col, item_col, window), "contamination")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.sha2(F.col(text_col).cast("string"), 256).alias("text_sha"))
    if remove == "documents":
        return keyed.join(found, "text_sha", "left_anti").select("row.*")
    joined = keyed.join(found.select("text_sha", "spans"), "text_sha", "left")
    text, steps = F.col("row")[text_col], F.col("steps")
    # Read several times below, so that it stays a projection of its own and is computed once.
    joined = joined.withColumn("steps", F.when(F.col("spans").isNotNull(), F.regexp_extract_all(text, F.lit(f"({_STEP})"), F.lit(1))))
    # What is kept lies between the end of a span and the beginning of the next one.
    ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda x: x["e"]))
    begins = F.concat(F.transform("spans", lambda x: x["b"]), F.array(F.size(steps)))
    kept = F.transform(F.arrays_zip(ends.alias("e"), begins.alias("b")), lambda g: F.array_join(F.slice(steps, g["e"] + 1, g["b"] - g["e"]), ""))
    rest = F.substring(text, F.length(F.array_join(steps, "")) + 1, F.length(text))
    cut = F.when(F.col("spans").isNull(), text).otherwise(F.concat(F.array_join(kept, ""), rest))
    return joined.select(*[(cut if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
