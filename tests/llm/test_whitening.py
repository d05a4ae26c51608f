import math

import numpy as np
import pytest

from trajspark.llm import queries, whitening as w

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k=4):
    """All by numpy's own eigenvectors: n, deviation and whitened by row and component, explained, eigenvalues."""
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v in rows]
    fit = np.array(sorted({tuple(v) for v in x}))
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    white = (np.array(x) - s / n) @ vectors / np.sqrt(values)
    return n, [int(((n * np.array(v) - s) ** 2).sum()) for v in x], white, values / np.trace(y.T @ y / n)


def check(found, rows, k=4):
    n, deviation, white, explained = brute(rows, k)
    got = {(r.vec_id, r.component): r for r in found.collect()}
    assert len(got) == len(rows) * min(k, white.shape[1])
    for c in range(white.shape[1]):
        mine = np.array([got[i, c + 1].whitened for i, _ in rows])
        sign = np.sign(mine @ white[:, c])
        assert np.allclose(mine * sign, white[:, c], atol=1e-8, rtol=1e-8)
    for (i, _), d in zip(rows, deviation, strict=True):
        assert got[i, 1].deviation == d and got[i, 1].n == n
    any_row = got[rows[0][0], 1]
    assert any_row.identity_error < 1e-9
    assert [got[rows[0][0], c + 1].explained for c in range(white.shape[1])] == pytest.approx(explained, rel=1e-9)


@pytest.mark.parametrize("seed", range(4))
def test_inertia_counts_eigenvalues(seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((17, 17))
    a = a + a.T - (np.diag(np.diag(a + a.T)) if seed % 2 else 0)
    values = np.linalg.eigvalsh(a)
    for shift in [*(values[:-1] + values[1:]) / 2, values[0] - 1, values[-1] + 1]:
        assert w.eigenvalues_above(a, shift) == (values > shift).sum()


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1, 0.5], [3, 3, 3, 1, 1, 0], [1, 1 - 1e-7, 1 - 2e-7, 0.9, 0.9, 0.1], [2, 0, 0, 0, 0, 0], [0] * 6, [1] * 40, list(1 + np.arange(60) / 1e4)])
def test_contours_find_all_leading_pairs(values):
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((len(values),) * 2))[0]
    a = (q * values) @ q.T
    got, vectors = w.leading_components(a, 4)
    assert np.allclose(got, sorted(values)[::-1][:4], atol=1e-12 * max(1, max(values)))
    assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)
    assert np.linalg.norm(a @ vectors - vectors * got) < 1e-11


def test_as_brute_force_with_copies_and_bad_rows(spark):
    rng = np.random.default_rng(3)
    v = (rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12))).astype(np.float32)
    rows = [(i, v[i % 240].tolist()) for i in range(300)]
    bad = [(900, None), (901, [math.nan] * 12), (902, [math.inf] + [0.0] * 11), (903, [None] + [0.0] * 11), (904, []), (905, [1.0])]
    df = spark.createDataFrame([(i, x, 0) for i, x in rows + bad], SCHEMA).repartition(5)
    check(w.whiten(df, w.fit(df), "vec_id"), rows)


def test_few_dimensions_and_hot_vector(spark):
    rows = [(i, [0.5, -0.25, 1.0]) for i in range(200)] + [(i, [i / 256, (i * i % 97) / 64, -float(i % 5)]) for i in range(200, 260)]
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA)
    check(w.whiten(df, w.fit(df), "vec_id"), rows)


def test_nothing_varies(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)], SCHEMA)
    got = w.whiten(df, w.fit(df), "vec_id").collect()
    assert len(got) == 4 and {(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, None)}
    empty = df.where("false")
    assert w.whiten(empty, w.fit(empty), "vec_id").collect() == []


def test_rank_one_has_no_whitened_value_beyond_it(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0) for i in range(9)], SCHEMA)
    got = {(r.vec_id, r.component): r for r in w.whiten(df, w.fit(df), "vec_id").collect()}
    assert got[0, 1].explained == pytest.approx(1) and got[0, 1].identity_error < 1e-9
    assert [got[3, c].whitened is None for c in (1, 2, 3)] == [False, True, True]


def test_huge_entries_are_exact(spark):
    rows = [(0, [1e15, 0.0]), (1, [0.0, 3.0]), (2, [5.0, -1e15])]
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], "vec_id bigint, embedding array<double>, label int")
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((3 * c - t) ** 2 for c, t in zip(v, s, strict=True)) for (i, _), v in zip(rows, x, strict=True)}
    assert {r.vec_id: int(r.deviation) for r in w.whiten(df, w.fit(df), "vec_id").collect()} == want


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, float(i), [float(i), float(i * i % 7)], 1) for i in range(8)], "i int, x double, component array<double>, n int")
    got = w.whiten(df, w.fit(df, "component", components=1), "i", "component")
    assert got.columns == ["i", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 8


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(queries.op11_embedding_whitening(spark, sf), [x for x in rows if x[1] is not None and all(c is not None and math.isfinite(c) for c in x[1])])
