"""SimHash fingerprints and exact near-duplicate groups by tiled comparison.

Distinct fingerprints are laid into tiles by the population counts of their four 16-bit quarters. Two
fingerprints within ``radius`` bits differ by at most ``radius`` in the sum of the four differences of
counts, so a tile is compared only with the tiles inside that distance; all other tile pairs are skipped
without loss. Inside a pair of tiles every pair is compared exactly: numpy exclusive-or and bit counts
over blocks. Blocks emit a spanning set of their links, not all pairs, and components join them.

Texts are hashed where they lie; only (id, fingerprint) rows are shuffled, and equal fingerprints are one
node before any comparison, so a group of copies of any size costs one fingerprint.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark.llm.common import bounded, cut, row_hash, texts_of, word_chunks, written
from trajspark.llm.components import connected_components

SEED = 42
#: Parts of a fingerprint whose population counts make a tile. More parts skip more tile pairs, and put each
#: fingerprint into more tiles: 65 with four parts, 417 with eight (radius 3).
PARTS, MORE_PARTS = 4, 8
#: Distinct fingerprints above which more parts cost less: then pairs outweigh the rows that meet them.
MANY = 40_000_000
#: Most rows of a tile that one task holds; a tile with more is split. Rows of a compared block on each side.
TILE_ROWS, BLOCK = 16_384, 1024
#: Most tiles whose splits are broadcast (16 bytes each).
MAX_BROADCAST = 1_000_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    at = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(0, 2048, 256)
    return (np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """The 64-bit SimHash of the lower-cased (A-Z) text's word shingles, repeats included.

    Fewer than ``size`` words make one shingle; no words, or null, give 0.
    """
    from xxhash import xxh64_intdigest

    total, n, tail = np.zeros(64, np.int64), 0, []
    for chunk in word_chunks((text or b"").lower()):
        words = tail + chunk
        count = max(0, len(words) - size + 1)
        if count:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
            total += _counts(np.fromiter(map(xxh64_intdigest, shingles, itertools.repeat(SEED)), np.uint64, count))
            n += count
        tail = words[max(0, len(words) - size + 1) :]
    if not n and tail:
        total += _counts(np.array([xxh64_intdigest(b" ".join(tail), SEED)], np.uint64))
        n = 1
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0]) if n else 0


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, key: str | None = None) -> DataFrame:
    """``id`` and ``fp`` (the fingerprint's bits as a signed long) of every row; between them ``key``, a text column, if one is named."""
    import pyarrow as pa

    def run(batches):
        for batch in bounded(batches, 1):
            fps = np.array([fingerprint(x, size) for x in texts_of(batch)], np.uint64).view(np.int64)
            keys = [batch.column(2)] if key else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *keys, pa.array(fps, pa.int64())], ["id", *(["key"] if key else []), "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *([F.col(key).alias("key")] if key else []))
    return rows.mapInArrow(run, f"id {kind}, {'key string, ' if key else ''}fp bigint")


def _steps(radius: int, parts: int) -> list[int]:
    """Differences of tile keys within the radius: zero, and one of each pair of opposites."""
    ball = [()]
    for _ in range(parts):
        ball = [(*d, x) for d in ball for x in range(-radius, radius + 1) if sum(map(abs, d)) + abs(x) <= radius]
    keys = [sum(x << (6 * i) for i, x in enumerate(d)) for d in ball]
    return sorted(k for k in keys if k >= 0)


def _block_links(home: np.ndarray, guest: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links between two blocks: each linked item with the least item of its group."""
    near = np.bitwise_count(home[:, None] ^ guest[None, :]) <= radius
    i, j = np.nonzero(np.triu(near, 1) if same else near)
    if not len(i):
        return home[:0], home[:0]
    items, at = np.unique(np.concatenate([home[i], guest[j]]), return_inverse=True)
    left, right = at[: len(i)], at[len(i) :]
    root = np.arange(len(items))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(items)))
    return items[moved], items[root[moved]]


def fingerprint_links(distinct_fps: DataFrame, radius: int = 3, parts: int = PARTS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links ``a``, ``b`` that join all fingerprints (column ``fp``, distinct) reachable within ``radius`` bits.

    A tile with more than ``tile_rows`` rows is split by a hash: each split holds its own rows and meets the
    rows of the splits before it and of the other tiles.
    """
    import pyarrow as pa

    width = 64 // parts
    mask = F.lit((1 << width) - 1)
    small = [F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(mask)).cast("long") for i in range(parts)]
    key = sum((p * F.lit(1 << (6 * i)) for i, p in enumerate(small)), F.lit(0).cast("long"))
    steps = F.explode(F.array(*[F.lit(s).cast("long") for s in _steps(radius, parts)]))
    keyed = distinct_fps.select("fp", key.alias("own"))
    sizes = cut(keyed.groupBy("own").agg(F.count(F.lit(1)).alias("n"))).select("own", F.ceil(F.col("n") / tile_rows).cast("int").alias("splits"))
    sizes = F.broadcast(sizes) if sizes.count() <= MAX_BROADCAST else sizes
    of_row = F.pmod(F.xxhash64("fp"), F.col("splits").cast("long")).cast("int")
    own = keyed.join(sizes, "own").select("fp", "own", of_row.alias("split"))
    # Tiles without rows of their own need no guests.
    met = own.select("fp", "own", "split", steps.alias("step")).select("fp", (F.col("own") + F.col("step")).alias("tile"), F.col("step") != 0, "split")
    met = met.toDF("fp", "tile", "other", "split").join(sizes.withColumnRenamed("own", "tile"), "tile")
    last = F.when(F.col("other"), F.col("splits") - 1).otherwise(F.col("split"))
    tiles = met.select("tile", F.explode(F.sequence(F.lit(0), last)).alias("part"), "fp", "other", "split")
    tiles = tiles.select("tile", "part", (F.col("other") | (F.col("part") != F.col("split"))).alias("guest"), "fp")
    tiles = tiles.repartition("tile", "part").sortWithinPartitions("tile", "part", "guest", "fp")

    def run(batches):
        """The rows of a tile's split come first and stay; its guests are compared as they pass."""
        tile, home = None, []

        def compare(rows: np.ndarray, same: bool):
            for k in range(0, len(rows), BLOCK):
                part = rows[k : k + BLOCK]
                for h in home:
                    yield _block_links(h, part, radius, False)
                if same:
                    yield _block_links(part, part, radius, True)
                    home.append(part)

        for batch in batches:
            tiles_, parts_, guests = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            fps = batch.column(3).to_numpy().view(np.uint64)
            edges = np.flatnonzero((np.diff(tiles_) != 0) | (np.diff(parts_) != 0) | (np.diff(guests.astype(np.int8)) != 0)) + 1
            found = []
            for begin, end in itertools.pairwise([0, *edges.tolist(), len(tiles_)]):
                if begin == end:
                    continue
                if (tiles_[begin], parts_[begin]) != tile:
                    tile, home = (tiles_[begin], parts_[begin]), []
                if guests[begin] and not home:
                    continue
                found += [x for x in compare(fps[begin:end], not guests[begin]) if len(x[0])]
            a, b = (np.concatenate([x[k] for x in found] or [fps[:0]]).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return tiles.mapInArrow(run, "a bigint, b bigint")


def _grouped(fps: DataFrame, radius: int, parts: int | None) -> tuple[DataFrame, DataFrame]:
    """``fp``, ``least`` (smallest id) of all distinct fingerprints; ``node``, ``root`` of the linked ones."""
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("least")))
    parts = parts or (PARTS if nodes.count() <= MANY else MORE_PARTS)
    return nodes, connected_components(fingerprint_links(nodes.select("fp"), radius, parts))


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3, parts: int | None = None
) -> DataFrame:
    """Fingerprint and near-duplicate group of every row.

    Returns ``id_col``, ``fingerprint`` (16 lowercase hex digits) and ``component_id``: the smallest id
    reachable over links of at most ``radius`` differing bits, itself included. Null and empty texts have
    fingerprint zero and are linked like any other. A row without an id keeps its links, but is never a
    group's name; a group with no id at all has a null name. Repeated rows give repeated results. Very long texts are
    hashed whole, in pieces of 1 MB. ``parts``, by default by the number of distinct fingerprints, has no effect on the result.
    """
    fps = written(with_fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes, roots = _grouped(fps, radius, parts)
    linked = roots.join(nodes, roots["node"] == nodes["fp"])
    names = linked.groupBy("root").agg(F.min("least").alias("name"))
    linked = linked.join(names, "root").select(F.col("node").alias("fp"), "name")
    nodes = nodes.join(linked, "fp", "left").select("fp", F.coalesce("name", "least").alias("component_id"))
    # Written, both sides of the last join are read and dealt anew, so Spark can split a hot fingerprint.
    return fps.join(written(nodes, "groups"), "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def simhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3, parts: int | None = None
) -> DataFrame:
    """One row of every near-duplicate group, with the columns of ``docs``, which may have any names.

    It is the one with the smallest id, rows without an id last; of several the one with the smallest hash of its
    text, then of the row. So every group keeps exactly one row, whatever ids repeat or lack.
    """
    text = F.col(text_col).cast("string")
    # Tells rows with another id or text apart, and is null for none, so that one shuffle serves join and window.
    key = F.md5(F.concat_ws("\u001f", F.coalesce(F.col(id_col).cast("string"), F.lit("\\N")), F.coalesce(text, F.lit("\\N"))))
    keyed = docs.select(F.col(id_col).alias("id"), key.alias("key"), text.alias("text"))
    fps = written(with_fingerprints(keyed, "id", "text", size, key="key"), "fingerprints")
    nodes, roots = _grouped(fps, radius, parts)
    labels = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key", "fp")
    firsts = fps.groupBy("fp").agg(F.min(order).alias("first")).join(labels, "fp").groupBy("root").agg(F.min("first").alias("first"))
    keep = written(firsts.select("first.key").distinct(), "survivors")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"), row_hash(docs).alias("whole"))
    first = Window.partitionBy("key").orderBy("whole")
    return rows.join(keep, "key").withColumn("nth", F.row_number().over(first)).where("nth = 1").select("row.*")
