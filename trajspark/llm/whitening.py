"""Whitening of embeddings along their leading principal components, found by FEAST contour integration.

Vectors become exact integers, so that equal ones are known and sums and deviations are exact. Spark gathers
the distinct vectors, their sums and their centred second moments; what reaches the driver has the size of the
dimension squared and nothing of the rows. There, inertia counts (signs of the pivots of an LDL' factorisation
of the shifted covariance) isolate the wanted eigenvalues in intervals. For each interval, a quadrature of
solves with complex shifts around it projects a random block onto its eigenvectors, Rayleigh-Ritz extracts
them, and the count says whether one is missing.
"""

from __future__ import annotations

import dataclasses
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import small_batches, written

SCALE = 256
#: Shifts on the upper half of a contour; columns that a block has beyond the eigenvalues counted inside.
NODES, SPARE = 8, 8
#: Iterations before a block grows, and the residual (as a share of the norm) at which a pair is done.
ROUNDS, RESIDUAL = 6, 2e-14
#: Width, as a share of the norm, at which eigenvalues in one interval count as a cluster and stay together.
CLUSTER = 1e-9
#: An eigenvalue below this share of the norm, times the dimension, is zero: its component has no whitened value.
ZERO = 1e-14
SLICE = 4 << 20
_PARTIAL = "i int, total decimal(38,0)"


@dataclasses.dataclass
class Whitening:
    """``n`` distinct vectors with ``sums`` by dimension; components as columns, eigenvalues falling."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def scales(self) -> np.ndarray:
        """Reciprocal deviations along the components, NaN where there is no variance."""
        least = ZERO * self.dimension * max(self.values, default=0.0)
        return np.array([1 / np.sqrt(e) if e > least else np.nan for e in self.values])


# -- eigenvectors of a symmetric matrix --------------------------------------------------------------


def eigenvalues_above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix exceed ``shift``, by the inertia of ``a - shift``.

    LDL' with one-by-one and two-by-two pivots chosen over the whole remainder (Bunch and Parlett). A
    two-by-two pivot has one eigenvalue of each sign.
    """
    a = a - shift * np.eye(len(a))
    above = 0
    while len(a):
        diagonal = np.abs(a.diagonal())
        p, off = int(diagonal.argmax()), np.abs(np.triu(a, 1))
        r, s = divmod(int(off.argmax()), len(a))
        if diagonal[p] >= 0.6404 * off[r, s]:
            if diagonal[p] == 0:
                break
            above += a[p, p] > 0
            keep = np.delete(np.arange(len(a)), p)
            column = a[keep, p]
            a = a[np.ix_(keep, keep)] - np.outer(column, column / a[p, p])
        else:
            above += 1
            keep = np.delete(np.arange(len(a)), [r, s])
            columns = a[np.ix_(keep, [r, s])]
            a = a[np.ix_(keep, keep)] - columns @ np.linalg.solve(a[np.ix_([r, s], [r, s])], columns.T)
    return above


def isolated(a: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Disjoint intervals (low, high, eigenvalues inside) that hold the ``wanted`` largest eigenvalues of a matrix
    of norm 1 at most, each with one eigenvalue or a cluster."""
    todo, done = [(-0.01, 1.01, len(a), 0)], []
    while todo:
        low, high, more, fewer = todo.pop()
        if more == fewer or fewer >= wanted:
            continue
        if more == fewer + 1 and high - low < 0.1 or high - low < CLUSTER:
            done.append((low, high, more - fewer))
            continue
        middle = (low + high) / 2
        at = eigenvalues_above(a, middle)
        todo += [(low, middle, more, at), (middle, high, at, fewer)]
    return done


def eigenpairs_inside(a: np.ndarray, low: float, high: float, count: int, rng: np.random.Generator) -> np.ndarray:
    """The ``count`` eigenvectors, as columns, of the eigenvalues of ``a`` between ``low`` and ``high``."""
    points, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(0.5j * np.pi * (1 - points))
    centre, radius = (low + high) / 2, (high - low) / 2
    shifted = (centre + radius * turn)[:, None, None] * np.eye(len(a)) - a
    width = min(len(a), count + SPARE)
    while True:
        block = rng.standard_normal((len(a), width))
        for _ in range(ROUNDS):
            solved = np.linalg.solve(shifted, np.broadcast_to(block.astype(complex), (NODES, *block.shape)))
            basis = np.linalg.qr(np.einsum("k,kij->ij", weights * turn, solved).real)[0]
            ritz, small = np.linalg.eigh(basis.T @ a @ basis)
            block = basis @ small
            inside = (ritz > low) & (ritz <= high)
            left = np.linalg.norm(a @ block[:, inside] - block[:, inside] * ritz[inside], axis=0)
            if inside.sum() == count and (left <= RESIDUAL * len(a)).all():
                return block[:, inside]
        if width == len(a):
            raise ArithmeticError(f"{count} eigenvalues lie in ({low}, {high}], {int(inside.sum())} were found")
        width = min(len(a), 2 * width)


def leading_components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix without negative ones, falling, and unit eigenvectors."""
    wanted, norm = min(wanted, len(v)), np.abs(v).sum(axis=0).max(initial=0.0)
    if norm == 0:
        return np.zeros(wanted), np.eye(len(v))[:, :wanted]
    rng, a = np.random.default_rng(0), (v + v.T) / (2 * norm)
    found = np.hstack([eigenpairs_inside(a, *x, rng) for x in isolated(a, wanted)])
    basis = np.linalg.qr(found)[0]
    values, small = np.linalg.eigh(basis.T @ a @ basis)
    order = values.argsort()[::-1][:wanted]
    return np.maximum(values[order], 0) * norm, basis @ small[:, order]


# -- sums over vectors -------------------------------------------------------------------------------


def _integers(vectors: DataFrame, vector_col: str, scale: int) -> Column:
    return F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * scale))


def _usable(vector_col: str) -> Column:
    known = lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))  # noqa: E731  NaN is above infinity
    return F.col(vector_col).isNotNull() & F.forall(vector_col, known)


def _matrices(batches, at: int, dimension: int):
    """Slices of batches with their vectors as a matrix of longs."""
    rows = max(1, SLICE // (8 * max(1, dimension)))
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            part = batch.slice(begin, rows)
            yield part, part.column(at).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dimension)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: longs where they fit, else Python's integers."""
    if n * (np.abs(x.astype(float)).max(initial=0) + 1) + max(map(abs, sums), default=0) < 2.0**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _deviation(y: np.ndarray) -> list[Decimal | None]:
    """Sums of squares of the rows, exact; null beyond 38 digits."""
    if y.dtype != object and (y.astype(float) ** 2).sum(axis=1).max(initial=0) < 2.0**62:
        return list(map(Decimal, (y * y).sum(axis=1).tolist()))
    exact = [sum(int(c) ** 2 for c in row) for row in y.tolist()]
    return [Decimal(d) if d < 10**38 else None for d in exact]


def _sums(distinct: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """The number of vectors and their sum."""
    import pyarrow as pa

    def run(batches):
        n, high, low = 0, np.zeros(dimension, np.int64), np.zeros(dimension, np.int64)
        for _, x in _matrices(batches, 0, dimension):
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        totals = [n, *((int(h) << 32) + int(l) for h, l in zip(high, low, strict=True))]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dimension), pa.int32()), pa.array(map(Decimal, totals), pa.decimal128(38, 0))], ["i", "total"])

    total = {r.i: int(r.total) for r in distinct.mapInArrow(run, _PARTIAL).groupBy("i").agg(F.sum("total").alias("total")).collect()}
    return total.get(-1, 0), [total.get(i, 0) for i in range(dimension)]


def _covariance(distinct: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Second moments about the mean, added up row by row of the matrix."""
    import pyarrow as pa

    d, schema = len(sums), pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))])

    def partial(batches):
        total = np.zeros((d, d))
        for _, x in _matrices(batches, 0, d):
            y = _centred(x, n, sums).astype(float) / n
            total += y.T @ y
        for i in range(d):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i]])], schema=schema)

    def added(batches):
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows[i] = rows.get(i, 0) + np.array(row)
        for i, row in rows.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([row])], schema=schema)

    ddl = "i int, row array<double>"
    found = distinct.mapInArrow(partial, ddl).repartition("i").mapInArrow(added, ddl).collect()
    v = np.array([r.row for r in sorted(found, key=lambda r: r.i)]).reshape(d, d) / n
    return (v + v.T) / 2


def _identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """Largest entry by which the covariance of the whitened distinct vectors departs from the identity."""
    import pyarrow as pa

    scales = model.scales()
    k = int(np.isfinite(scales).sum())
    if k == 0:
        return None
    n, sums, project = model.n, model.sums, model.vectors[:, :k] * scales[:k]

    def run(batches):
        """Moments of each slice about its own mean, merged as slices pass."""
        count, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for _, x in _matrices(batches, 0, len(sums)):
            w = _centred(x, n, sums).astype(float) / n @ project
            own = w.mean(axis=0)
            step, total = own - mean, count + len(w)
            spread += (w - own).T @ (w - own) + np.outer(step, step) * (count * len(w) / total)
            mean, count = mean + step * (len(w) / total), total
        yield pa.RecordBatch.from_pydict({"n": [count], "mean": [mean.tolist()], "spread": [spread.ravel().tolist()]})

    parts = [r for r in distinct.mapInArrow(run, "n bigint, mean array<double>, spread array<double>").collect() if r.n]  # one a task
    mean = sum(r.n * np.array(r["mean"]) for r in parts) / n
    spread = sum(np.array(r.spread).reshape(k, k) + r.n * np.outer(np.array(r["mean"]) - mean, np.array(r["mean"]) - mean) for r in parts)
    return float(np.abs(spread / n - np.eye(k)).max())


# -- the operator ------------------------------------------------------------------------------------


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = 4, scale: int = SCALE) -> Whitening:
    """Learn from each distinct vector of ``floor(scale * entry)`` once.

    Vectors that are null or hold null or non-finite entries are left out. The dimension is the length that
    most of the others have (of several the greatest); vectors of other lengths are left out as well. Copies
    have no weight. Without any vector there are no components; where the vectors do not vary along a
    component, it has the variance zero and no whitened value.
    """
    usable = vectors.where(_usable(vector_col))
    lengths = usable.groupBy(F.size(vector_col).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dimension = lengths.d if lengths else 0
    if dimension == 0:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    same = usable.where(F.size(vector_col) == dimension).select(_integers(vectors, vector_col, scale).alias("x"))
    distinct = written(same.distinct(), "distinct-vectors")
    with small_batches(vectors.sparkSession):
        n, sums = _sums(distinct, dimension)
        v = _covariance(distinct, n, sums)
        values, directions = leading_components(v, components)
        trace = float(v.trace())
        model = Whitening(n, sums, directions, values, values / trace if trace > 0 else np.full(len(values), np.nan))
        model.identity_error = _identity_error(distinct, model)
    return model


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "doc_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """A row for each usable vector of the model's dimension and each component.

    Returns ``id_col``, ``component`` (from 1), ``n``, ``deviation`` (the squared length of ``n * x - sums``, an
    exact decimal, null beyond 38 digits), ``whitened``, ``explained`` and ``identity_error``; the last three
    are null where nothing varies. Ids may be null or repeated: rows are independent of each other. Vectors of any
    length pass in slices of 4 MB, or one row. No other column of ``vectors`` is read.
    """
    import pyarrow as pa

    d, k, n, sums = model.dimension, len(model.values), model.n, model.sums
    kind = vectors.schema[id_col].dataType.simpleString()
    project, explained, error = model.vectors * model.scales(), model.explained, model.identity_error

    def run(batches):
        for part, x in _matrices(batches, 1, d):
            if not k:
                continue
            y, rows = _centred(x, n, sums), len(x)
            w = (y.astype(float) / n @ project).ravel()
            at = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(at),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n)),
                    pa.array(_deviation(y), pa.decimal128(38, 0)).take(at),
                    pa.array(w, mask=np.isnan(w)),
                    pa.array(np.tile(explained, rows), mask=np.tile(np.isnan(explained), rows)),
                    pa.array([error] * (rows * k), pa.float64()),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    rows = vectors.where(_usable(vector_col) & (F.size(vector_col) == d)).select(F.col(id_col).alias("id"), _integers(vectors, vector_col, scale).alias("x"))
    ddl = f"id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, ddl).withColumnRenamed("id", id_col)
