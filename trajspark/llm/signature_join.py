"""Exact Jaccard join of documents' word shingles by signature trees.

1. Texts are hashed where they lie. Equal sets are one class, named by a hash of the set, and so any number of
   copies is one class. A class has a signature: its size and a bitmap of its hashed shingles.
2. Classes that link share a shingle among their rarest: of ``n`` shingles the first ``n - ceil(t * n) + 1`` in
   an order by frequency (from a sketch of fixed size over all rows) and hash. Each such shingle makes a group,
   so passages that many documents have in common make none unless a document has nothing rarer. A member stays in
   a group only if what either side has left from there on, in that order, is enough for a link with another member.
3. The classes of a group become a tree, whose nodes hold the OR of the bitmaps and the range of sizes below. A
   traversal of the tree against itself leaves out node pairs whose greatest possible overlap is too small.
   What remains are candidates. In a first round a candidate is taken for a link at once and pairs that
   are joined already are left out, so a group of copies yields as many candidates as members, not as pairs.
4. Candidates are decided on the whole sets, and components follow from the links.
5. In a second round, groups that had a wrong candidate or are in several parts are traversed again, now
   leaving out only pairs that real links have joined. So no link between different components is missed. Members with
   a possible partner form clusters. A large cluster gets their whole sets: candidates are decided where they are found, and
   it yields fewer rows than members. A small one yields its pairs, at most ``SMALL / 2`` for each member.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import bounded, small_batches, texts_of, word_chunks, written
from trajspark.llm.components import connected_components

SIZE, PERCENT = 4, 85
#: Cells of the frequency sketch (8 bytes each in every task), children of a node, most members of a part of a group.
CELLS, FANOUT, PART = 1 << 18, 16, 4096
#: Node pairs that are opened together.
OPENED = 16
#: Bits of a bitmap for each shingle, and most bits of a bitmap; beyond, it only leaves out less.
BITS_EACH, MOST_BITS = 4, 1 << 17
#: Most hashes that are broadcast to find the signatures of members and the texts of candidates (8 bytes each); more are
#: joined by a shuffle.
MAX_BROADCAST = 1_000_000
#: Most members of a cluster whose pairs leave undecided; larger ones get the whole sets.
SMALL = 64
#: Most bytes of whole sets that a group holds in the second round, smaller sets first. Pairs with a set beyond are not decided
#: there but on the whole sets afterwards.
HELD = 64 << 20
#: Most sets that a task remembers, so that it sends copies once.
SEEN = 500_000


# -- sets and signatures -----------------------------------------------------------------------------


def shingle_set(text: bytes | None, size: int = SIZE) -> np.ndarray:
    """Sorted XXH64 hashes of the distinct word shingles of the lower-cased (A-Z) text.

    Fewer than ``size`` words make one shingle; no words, or null, none.
    """
    from xxhash import xxh64_intdigest

    found, tail = [], []
    for chunk in word_chunks((text or b"").lower()):
        words = tail + chunk
        if len(words) >= size:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
            found.append(np.unique(np.fromiter(map(xxh64_intdigest, shingles), np.uint64, len(words) - size + 1)))
        tail = words[max(0, len(words) - size + 1) :]
    if not found and tail:
        found.append(np.array([xxh64_intdigest(b" ".join(tail))], np.uint64))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found or [np.empty(0, np.uint64)]))


def _name(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(hashes.tobytes())).view(np.int64))


def bitmap(hashes: np.ndarray) -> bytes:
    """Bits at the hashes modulo a power of two, so that a longer bitmap folds onto a shorter one."""
    bits = min(MOST_BITS, 64 << max(0, (BITS_EACH * len(hashes) - 1) >> 6).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def frequency_sketch(texts: DataFrame, text_col: str = "text", size: int = SIZE, cells: int = CELLS) -> np.ndarray:
    """How many sets have a shingle that falls in each cell, over all rows. A task sends its cells in pieces."""
    import pyarrow as pa

    step = min(cells, 1 << 12)
    names = ["piece", "counts"]

    def count(batches):
        total = np.zeros(cells, np.int64)
        for batch in bounded(batches, 0):
            hashes = np.concatenate([shingle_set(text, size) for text in texts_of(batch)])
            total += np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
        kind = np.min_scalar_type(int(total.max(initial=0)))
        for i in range(0, cells, step):
            if total[i : i + step].any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([kind.char.encode() + total[i : i + step].astype(kind).tobytes()])], names)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(raw, raw[:1].decode(), offset=1).astype(np.int64)
        for i, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()])], names)

    slim = texts.select(F.col(text_col).cast("string").alias("text"))
    out = np.zeros(cells, np.int64)
    with small_batches(texts.sparkSession):
        for r in slim.mapInArrow(count, "piece int, counts binary").repartition("piece").mapInArrow(add, "piece int, counts binary").collect():
            out[r.piece : r.piece + step] = np.frombuffer(r.counts, np.int64)
    return out


def rarest(hashes: np.ndarray, sketch: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shingles of which linked sets share one at least; none where no other set can link."""
    n = len(hashes)
    if 100 * n < percent * (n + 1):
        return hashes[:0]
    order = sketch[(hashes & np.uint64(len(sketch) - 1)).astype(np.int64)].argsort(kind="stable")  # ties by hash
    return hashes[order[: n + (-percent * n // 100) + 1]]


def signatures(docs: DataFrame, sketch: np.ndarray, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """``id``, ``text_key``, ``set`` (null for an empty one) and ``n`` of every row; ``rarest`` and ``bits`` where a task
    meets a set for the first time."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        seen: set[int] = set()
        for batch in bounded(batches, 2):
            sets, ns, firsts, bits = [], [], [], []
            for text in texts_of(batch):
                h = shingle_set(text, size)
                name = _name(h) if len(h) else None
                new = name is not None and name not in seen
                if new:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                sets.append(name)
                ns.append(len(h))
                firsts.append(rarest(h, shared.value, percent).view(np.int64) if new else None)
                bits.append(bitmap(h) if new else None)
            columns = [batch.column(0), batch.column(1), pa.array(sets, pa.int64()), pa.array(ns, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_key", "set", "n", "rarest", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(run, f"id {kind}, text_key bigint, `set` bigint, n bigint, rarest array<bigint>, bits binary")


# -- groups ------------------------------------------------------------------------------------------


def _with_partner(n: np.ndarray, left: np.ndarray, percent: int) -> np.ndarray:
    """Which members could link with another, if this were their first shingle in common and all that is left agreed.

    A set may be as large as the shingles left allow, so of the members small enough for one, the other that allows
    most decides.
    """
    most = ((100 + percent) * left - percent * n) // percent  # how large a partner may be
    order = n.argsort(kind="stable")
    best = np.maximum.accumulate(most[order])
    second = np.maximum.accumulate(np.minimum(np.append(-1, best[:-1]), most[order]))
    at = np.searchsorted(n[order], most, "right") - 1
    others = np.where((n <= most) & (best[at] == most), second[at], best[at])  # without the member itself
    return (at >= 0) & (others >= n)


def groups(tokens: DataFrame, percent: int = PERCENT, part: int = PART) -> DataFrame:
    """Members of every group of two or more: ``gid``, ``token``, ``many`` (whether the group has several parts), ``members``.

    ``tokens`` has the columns ``token``, ``set``, ``n`` (the set's size) and ``left`` (its shingles from this one on, in order
    of rarity). Rows of a token pass in order and leave in parts of at most ``part`` members; later parts have the
    first member of all as well. Groups with equal members have equal ids.
    """
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    names = ["gid", "token", "many", "members"]

    def packed(found: list) -> Iterator:
        for k in range(0, len(found), 1024):
            token, many, members = zip(*found[k : k + 1024], strict=True)
            gids = [xxh64_intdigest(m.tobytes() + (np.int64(t).tobytes() if s else b"")) for t, s, m in zip(token, many, members, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(gids, np.uint64).view(np.int64)), pa.array(token, pa.int64()), pa.array(many), pa.array(members, pa.list_(pa.int64()))], names
            )

    def run(batches):
        held = [np.empty(0, np.int64)] * 4
        pivot = None  # of the group whose parts are leaving

        def parted(rows: list[np.ndarray], last: bool) -> tuple[list, list[np.ndarray]]:
            """Parts of a group that can leave, and the rows that stay."""
            nonlocal pivot
            out, (token, members, n, left) = [], rows
            if last and pivot is None:
                members = members[_with_partner(n, left, percent)]
                if len(members) < 2:
                    return out, rows
            at = 0
            while len(members) - at > part or last and at < len(members):
                head = members[at : at + part]
                at += part
                if pivot is None:
                    pivot = head[0]
                    out.append((int(token[0]), not last or at < len(members), head))
                else:
                    out.append((int(token[0]), True, np.append(pivot, head)))
            if last:
                pivot = None
            return out, [x[at:] for x in rows]

        for batch in batches:
            rows = [np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate(held)]
            if not len(rows[0]):
                continue
            new = np.append(True, (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0))
            rows = [x[new] for x in rows]
            starts = np.flatnonzero(np.append(True, np.diff(rows[0]) != 0))
            ends, found = np.append(starts[1:], len(rows[0])), []
            for k in np.flatnonzero(ends - starts > 1) if pivot is None else range(len(starts)):
                if k < len(starts) - 1 and (k == 0 or ends[k] - starts[k] > 1):
                    found += parted([x[starts[k] : ends[k]] for x in rows], True)[0]
            more, held = parted([x[starts[-1] :] for x in rows], False)
            yield from packed(found + more)
        if len(held[0]):
            yield from packed(parted(held, True)[0])

    dealt = tokens.select("token", "set", "n", "left").repartition("token").sortWithinPartitions("token", "set")
    return dealt.mapInArrow(run, "gid bigint, token bigint, many boolean, members array<bigint>")


# -- trees -------------------------------------------------------------------------------------------


class Tree:
    """Signatures of a group in the order of size. Level 0 has the members, each level above a node for ``FANOUT`` below."""

    def __init__(self, sizes: np.ndarray, bits: list[bytes], labels: np.ndarray, sets: list[np.ndarray | None] | None = None):
        words = min(map(len, bits)) // 8
        rows = np.array([np.bitwise_or.reduce(np.frombuffer(b, np.uint64).reshape(-1, words), axis=0) for b in bits])
        slack = sizes - np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
        self.labels = labels
        #: Whole sets by which pairs are decided; None for one that is not held.
        self.sets = sets
        #: For each level the smallest and largest size, the bitmaps, and how many shingles at most share a bit with another.
        self.levels = [(sizes, sizes, rows, slack)]
        while len(self.levels[-1][0]) > 1:
            low, high, rows, slack = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.bitwise_or.reduceat(rows, at, axis=0), np.maximum.reduceat(slack, at)))
        self.relabel()

    def relabel(self) -> None:
        """Smallest and largest label below each node."""
        self.ranges = [(self.labels, self.labels)]
        for level in self.levels[1:]:
            at = np.arange(0, len(self.ranges[-1][0]), FANOUT)
            low, high = self.ranges[-1]
            self.ranges.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which node pairs may hold a link between members with different labels."""
        low, high, rows, slack = self.levels[level]
        least, most = self.ranges[level]
        keep = (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i]) & ((least[i] != most[j]) | (least[j] != most[i]))
        k = np.flatnonzero(keep)
        i, j = i[k], j[k]
        common = np.bitwise_count(rows[i] & rows[j]).sum(axis=1, dtype=np.int64)
        overlap = np.minimum(np.minimum(high[i], high[j]), common + np.minimum(slack[i], slack[j]))
        keep[k] = (100 + percent) * overlap >= percent * (low[i] + low[j])
        return keep

    def children(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of nodes one level below, each once."""
        a, b = (x.ravel() for x in np.meshgrid(np.arange(FANOUT), np.arange(FANOUT), indexing="ij"))
        x, y = (i[:, None] * FANOUT + a).ravel(), (j[:, None] * FANOUT + b).ravel()
        n = len(self.levels[level - 1][0])
        keep = (x < n) & (y < n) & ((x < y) if level == 1 else (x <= y))
        return x[keep], y[keep]

    def pairs(self, percent: int, spanning: bool) -> Iterator[tuple[int, int]]:
        """Members that may link. ``spanning``: a pair that is found counts as joined from then on."""
        for i, j in self._leaves(percent):
            if not spanning:
                yield from zip(i.tolist(), j.tolist(), strict=True)
            else:
                changed = len(i)
                while len(i):
                    yield int(i[0]), int(j[0])
                    self.labels[self.labels == self.labels[j[0]]] = self.labels[i[0]]
                    apart = self.labels[i] != self.labels[j]
                    i, j = i[apart], j[apart]
                if changed and len(self.levels) > 2:
                    self.relabel()

    def links(self, percent: int) -> Iterator[tuple[int, int, bool]]:
        """Members that link by their whole sets, and those that may link where a set is not held; the last value tells which.

        A link counts as joined from then on, an undecided pair does not.
        """
        for i, j in self._leaves(percent):
            changed = False
            for k in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else ():
                for found in self._decided(int(i[k[0]]), j[k], percent):
                    changed |= found[2]
                    yield found
            if changed and len(self.levels) > 2:
                self.relabel()

    def _decided(self, i: int, others: np.ndarray, percent: int) -> Iterator[tuple[int, int, bool]]:
        """Links of one member with others that have another label, and undecided pairs."""
        others, own, sizes = others[self.labels[others] != self.labels[i]], self.sets[i], self.levels[0][0]
        held = [j for j in others.tolist() if own is not None and self.sets[j] is not None]
        yield from ((i, j, False) for j in others.tolist() if own is None or self.sets[j] is None)
        if held:
            flat = np.concatenate([self.sets[j] for j in held])
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            common = np.add.reduceat(hit, np.cumsum([0, *(len(self.sets[j]) for j in held[:-1])]), dtype=np.int64)
            for j in np.array(held)[(100 + percent) * common >= percent * (sizes[i] + sizes[held])].tolist():
                if self.labels[j] != self.labels[i]:
                    self.labels[self.labels == self.labels[j]] = self.labels[i]
                    yield i, j, True

    def _leaves(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Members that may link and have different labels when they are reached."""
        top = len(self.levels) - 1
        todo = [(top, np.array([0]), np.array([0]))] if top else []
        while todo:
            level, i, j = todo.pop()
            keep = self.possible(level, i, j, percent)
            i, j = i[keep], j[keep]
            if level:
                for k in range(0, len(i), OPENED):
                    todo.append((level - 1, *self.children(level, i[k : k + OPENED], j[k : k + OPENED])))
            else:
                yield i, j


def _runs(sizes: np.ndarray, labels: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """Places of a group in the order of size; sizes with a gap that no link crosses are in runs, and trees, of their own."""
    order = np.lexsort((labels, sizes))
    s = sizes[order]
    yield from (run for run in np.split(order, np.flatnonzero(100 * s[:-1] < percent * s[1:]) + 1) if len(run) > 1)


def group_pairs(sizes: np.ndarray, bits: list[bytes], labels: np.ndarray, percent: int = PERCENT, spanning: bool = False) -> Iterator[tuple[int, int]]:
    """Pairs of places in a group whose sets may link."""
    for run in _runs(sizes, labels, percent):
        for i, j in Tree(sizes[run], [bits[k] for k in run], labels[run]).pairs(percent, spanning):
            yield int(run[i]), int(run[j])


def group_links(
    sizes: np.ndarray, bits: list[bytes], labels: np.ndarray, sets: list[np.ndarray | None], percent: int = PERCENT
) -> Iterator[tuple[int, int, bool]]:
    """Pairs of places in a group that link, fewer than members, and pairs that may link where a set is None (not held)."""
    for run in _runs(sizes, labels, percent):
        for i, j, linked in Tree(sizes[run], [bits[k] for k in run], labels[run], [sets[k] for k in run]).links(percent):
            yield int(run[i]), int(run[j]), linked


def group_clusters(sizes: np.ndarray, bits: list[bytes], labels: np.ndarray, percent: int = PERCENT) -> list[np.ndarray]:
    """Places in a group that are joined by pairs that may link with another label; others are left out."""
    cluster = np.arange(len(sizes))
    for run in _runs(sizes, labels, percent):
        for i, j in Tree(sizes[run], [bits[k] for k in run], labels[run])._leaves(percent):
            i, j = run[i], run[j]
            while len(i := i[apart := cluster[i] != cluster[j]]):
                j = j[apart]
                cluster[cluster == cluster[j[0]]] = cluster[i[0]]
    order = cluster.argsort(kind="stable")
    return [x for x in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1) if len(x) > 1]


def open_members(members: DataFrame, percent: int) -> DataFrame:
    """``gid``, ``set``, ``label``, ``large`` of the members of each cluster in a group; ``members`` as for ``candidates``.

    Clusters with equal members, of whatever groups, have equal ids and leave once.
    """
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    def run(batches):
        gid, held = None, []

        def packed():
            sets, n, bits, label = zip(*held, strict=True)
            sets, label = np.array(sets), np.array(label)
            for own in group_clusters(np.array(n), list(bits), label, percent) if len(held) > 1 else ():
                own = own[sets[own].argsort()]
                name = np.uint64(xxh64_intdigest(sets[own].tobytes())).view(np.int64)
                columns = [np.full(len(own), name), sets[own], label[own], np.full(len(own), len(own) > SMALL)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["gid", "set", "label", "large"])

        for batch in batches:
            for g, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if g != gid:
                    if held:
                        yield from packed()
                    gid, held = g, []
                if not held or held[-1][0] != row[0]:
                    held.append(row)
        if held:
            yield from packed()

    dealt = members.select("gid", "set", "n", "bits", "label").repartition("gid").sortWithinPartitions("gid", "set")
    return dealt.mapInArrow(run, "gid bigint, `set` bigint, label bigint, large boolean").dropDuplicates(["gid", "set"])


def candidates(members: DataFrame, percent: int) -> DataFrame:
    """``gid``, ``a``, ``b`` (a < b) of the pairs that the trees leave; ``members`` has ``gid``, ``set``, ``n``, ``bits``, ``label``."""
    import pyarrow as pa

    def run(batches):
        gid, held = None, []

        def pairs():
            sets, n, bits, label = zip(*held, strict=True)
            if len(held) > 1:
                for i, j in group_pairs(np.array(n), list(bits), np.array(label), percent, spanning=True):
                    yield gid, min(sets[i], sets[j]), max(sets[i], sets[j])

        def packed(found):
            for k in range(0, len(found), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found[k : k + 65536], strict=True)], ["gid", "a", "b"])

        for batch in batches:
            found = []
            for g, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if g != gid:
                    if held:
                        found += pairs()
                    gid, held = g, []
                if not held or held[-1][0] != row[0]:
                    held.append(row)
            yield from packed(found)
        if held:
            for part in iter(lambda it=pairs(): list(itertools.islice(it, 65536)), []):
                yield from packed(part)

    dealt = members.select("gid", "set", "n", "bits", "label").repartition("gid").sortWithinPartitions("gid", "set")
    return dealt.mapInArrow(run, "gid bigint, a bigint, b bigint")


def links_of(members: DataFrame, percent: int, most: int = HELD) -> DataFrame:
    """``a``, ``b`` (a < b), ``linked`` of links that join each group's labels, and of undecided pairs (not linked).

    ``members`` has ``gid``, ``set``, ``n``, ``bits``, ``label``, ``hashes`` (the whole set, or null). A group holds at most ``most``
    bytes of whole sets.
    """
    import pyarrow as pa

    def run(batches):
        gid, held, room = None, [], most

        def pairs():
            names, n, bits, label, sets = zip(*held, strict=True)
            if len(held) > 1:
                for i, j, linked in group_links(np.array(n), list(bits), np.array(label), list(sets), percent):
                    yield min(names[i], names[j]), max(names[i], names[j]), linked

        def packed():
            for part in iter(lambda it=pairs(): list(itertools.islice(it, 65536)), []):
                a, b, linked = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked)], ["a", "b", "linked"])

        for batch in batches:
            flat, ends, there = batch.column(5).values.to_numpy(), batch.column(5).offsets.to_numpy(), batch.column(5).is_valid().to_pylist()
            for k, (g, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)):
                if g != gid:
                    if held:
                        yield from packed()
                    gid, held, room = g, [], most
                if not held or held[-1][0] != row[0]:
                    size = 8 * row[1] if there[k] else 0
                    held.append((*row, flat[ends[k] : ends[k + 1]].view(np.uint64).copy() if there[k] and size <= room else None))
                    room -= min(size, room)
        if held:
            yield from packed()

    dealt = members.select("gid", "set", "n", "bits", "label", "hashes").repartition("gid").sortWithinPartitions("gid", "n", "set")
    return dealt.mapInArrow(run, "a bigint, b bigint, linked boolean")


# -- the join ----------------------------------------------------------------------------------------


def _sets_of(docs: DataFrame, text_col: str, wanted: DataFrame, size: int) -> DataFrame:
    """``set`` and ``hashes`` of the sets in ``wanted`` (``set``, ``text_key``), made once more from one text of each."""
    import pyarrow as pa

    def run(batches):
        seen: set[int] = set()
        for batch in bounded(batches, 0):
            names, sets = [], []
            for text in texts_of(batch):
                h = shingle_set(text, size)
                name = _name(h)
                if name not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    names.append(name)
                    sets.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["set", "hashes"])

    keys = wanted.select("text_key").distinct()
    keys = F.broadcast(keys) if keys.count() <= MAX_BROADCAST else keys
    text = F.col(text_col).cast("string")
    texts = docs.select(text.alias("text"), F.xxhash64(text).alias("text_key")).join(keys, "text_key", "left_semi").select("text")
    found = texts.mapInArrow(run, "`set` bigint, hashes array<bigint>")
    return found.groupBy("set").agg(F.first("hashes").alias("hashes"))


def _whole_sets(docs: DataFrame, text_col: str, names: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """``set`` and ``hashes`` of the sets in ``names``."""
    wanted = written(sets.join(names.distinct(), "set").groupBy("set").agg(F.min("text_key").alias("text_key")), "candidate-sets")
    return written(_sets_of(docs, text_col, wanted, size), "candidate-hashes")


def _decided(docs: DataFrame, text_col: str, pairs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """``a``, ``b``, ``linked`` of distinct pairs, by the whole sets."""
    hashes = _whole_sets(docs, text_col, pairs.select(F.col("a").alias("set")).union(pairs.select("b")), sets, size)
    left, right = (hashes.select(F.col("set").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    overlap = F.size(F.array_intersect("ha", "hb")).cast("long")
    sizes = (F.size("ha") + F.size("hb")).cast("long")
    return written(both.select("a", "b", (overlap * (100 + percent) >= sizes * percent).alias("linked")), "decided")


def _second_members(found: DataFrame, again: DataFrame, roots: DataFrame, part: int) -> DataFrame:
    """``gid``, ``set``, ``label`` of the groups to traverse again that are not one component.

    Groups in one part as they are. Of groups in several parts, members outside the component that most of them
    belong to meet the members of every part: two members of different components include one such member.
    """
    rows = found.select("gid", "token", "many", F.explode("members").alias("set"))
    labelled = rows.join(roots, rows["set"] == roots["node"], "left").withColumn("label", F.coalesce("root", "set")).drop("node", "root")
    single = labelled.where("not many").join(again, "gid", "left_semi").select("gid", "set", "label")
    open_ones = single.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    single = single.join(open_ones, "gid", "left_semi")
    many = labelled.where("many")
    counts = many.groupBy("token", "label").agg(F.count_distinct("set").alias("n"))
    heads = counts.groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("head"), (F.sum("n") - F.max("n")).alias("others"))
    heads = heads.where("others > 0").withColumn("splits", F.ceil(F.col("others") / part).cast("int"))
    many = many.join(heads, "token")
    homes = many.select("token", "gid", "set", "label", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"))
    split = F.pmod(F.xxhash64("set"), F.col("splits").cast("long")).cast("int")
    guests = many.where("label <> head").select("token", "set", "label", split.alias("split")).distinct()
    parts = many.select("token", "gid").distinct()
    guests = guests.join(parts, "token").select("token", "gid", "set", "label", "split")
    return single.union(homes.union(guests).select(F.xxhash64("gid", "split").alias("gid"), "set", "label"))


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    percent: int = PERCENT,
    part: int = PART,
    cells: int = CELLS,
    held: int = HELD,
) -> DataFrame:
    """Set size and component of every row, over all links between sets of a similarity of ``percent`` or more.

    Returns ``id_col``, ``n_shingles`` and ``component_id``: the smallest id reachable over links, itself included.
    Null, empty and blank texts have no shingles and link with nothing; fewer words than ``size`` make one shingle.
    Rows with equal sets are linked. Very long texts are hashed in pieces of 1 MB and compared whole. A row without an
    id keeps its links but is never a component's name; one with no id at all has a null name. Repeated rows give
    repeated results, empty tables none. No other column is read. Sets and shingles are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    sketch = frequency_sketch(docs, text_col, size, cells)
    rows = written(signatures(docs, sketch, id_col, text_col, size, percent), "set-signatures")
    firsts = rows.where("bits is not null")
    tokens = firsts.select("set", "n", F.posexplode("rarest").alias("at", "token")).withColumn("left", F.col("n") - F.col("at"))
    found = written(groups(tokens, percent, part).dropDuplicates(["gid"]), "groups")
    wanted = written(found.select(F.explode("members").alias("set")).distinct(), "members")
    wanted = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST else wanted
    signed = written(firsts.join(wanted, "set").select("set", "n", "bits").dropDuplicates(["set"]), "member-signatures")
    with small_batches(spark):
        members = found.select("gid", F.explode("members").alias("set")).join(signed, "set").withColumn("label", F.col("set"))
        first = written(candidates(members, percent), "candidates")
        decided = _decided(docs, text_col, first.select("a", "b").distinct(), firsts, size, percent)
        links = decided.where("linked").select("a", "b")
        roots = connected_components(links)
        again = first.join(decided.where("not linked"), ["a", "b"]).select("gid").union(found.where("many").select("gid")).distinct()
        second = _second_members(found, again, roots, part).join(signed, "set")
        second = written(open_members(second, percent), "second-members")
        if not second.isEmpty():
            large = second.where("large")
            hashes = _whole_sets(docs, text_col, large.select("set"), firsts, size)
            parts = large.join(hashes, "set").union(second.where("not large").withColumn("hashes", F.lit(None).cast("array<bigint>")).select("set", "gid", "label", "large", "hashes"))
            more = written(links_of(parts.join(signed, "set"), percent, held), "second-links")
            links = links.union(more.where("linked").select("a", "b"))
            rest = more.where("not linked").select("a", "b").distinct().join(decided.select("a", "b"), ["a", "b"], "left_anti")
            rest = written(rest, "candidates")
            if not rest.isEmpty():
                links = links.union(_decided(docs, text_col, rest, firsts, size, percent).where("linked").select("a", "b"))
            roots = connected_components(links)
    classes = rows.where("n > 0").groupBy("set").agg(F.min("id").alias("least")).join(roots, F.col("set") == roots["node"], "left")
    classes = classes.select("set", "least", F.coalesce("root", "set").alias("root"))
    names = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(classes.join(names, "root").select("set", "component_id"), "components")
    # Read anew from tables, a set with very many copies can be split by Spark.
    full = rows.where("n > 0").join(named, "set").select("id", "n", "component_id")
    out = full.union(rows.where("n = 0").select("id", "n", "id"))
    return out.toDF(id_col, "n_shingles", "component_id")
