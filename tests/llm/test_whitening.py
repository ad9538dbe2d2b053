"""Whitening against eigenvectors of the covariance in numpy."""

import math

import numpy as np

from kinefuse.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, component string, y int, label int"


def whitened(spark, vectors, components=32):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 7, "x", 3, 1) for i, v in enumerate(vectors)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3), components)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return out.collect()


def held_to(rows, vectors, components, rank=None):
    """Every figure of the rows, by whole numbers and by a dense decomposition."""
    used = {i: [math.floor(64 * float(np.float32(x))) + 1_000_000 for x in v] for i, v in vectors.items()}
    n, d = len(used), len(next(iter(used.values())))
    sums = [sum(x[k] for x in used.values()) for k in range(d)]
    x = np.array([[float(n * a - s) / n for a, s in zip(v, sums)] for v in used.values()])
    values, vectors_ = np.linalg.eigh(x.T @ x / n)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    k = min(components, d if rank is None else rank)
    assert len(rows) == n * k
    at = {(r.vec_id, r.component): r for r in rows}
    for j in range(k):
        projected = x @ vectors_[:, j] / math.sqrt(values[j])
        found = np.array([at[i, j + 1].whitened for i in used])
        sign = 1 if found @ projected > 0 else -1
        assert np.abs(found * sign - projected).max() < 1e-8, j
        for i, v in used.items():
            row = at[i, j + 1]
            assert row.n == n and row.deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums))
            assert abs(row.explained - values[j] / values.sum()) < 1e-12 and row.identity_error < 1e-10


def test_against_dense(spark):
    rng = np.random.default_rng(1)
    plain = (rng.standard_normal((300, 40)) * np.linspace(1, 3, 40) + rng.standard_normal(40) * 5).astype(np.float32)
    plain[:90] = plain[0]  # a third of all rows are one vector
    vectors = dict(enumerate(plain.tolist()))
    odd = [None, [None] * 40, [math.nan] * 40, [math.inf] + [0.0] * 39, [1.0], [], [2.0, 3.0]]
    held_to(whitened(spark, [*plain.tolist(), *odd]), vectors, 32)


def test_low_rank_and_repeated_values(spark):
    rng = np.random.default_rng(2)
    low = np.repeat(rng.integers(-3, 4, (60, 3)), 2, axis=1).astype(float)
    held_to(whitened(spark, low.tolist()), dict(enumerate(low.tolist())), 32, rank=3)
    # Every variance is the same: components are any basis, whitened rows still have the identity as covariance.
    corners = [[s if k == j else 0.0 for k in range(5)] for j in range(5) for s in (1.0, -1.0)]
    rows = whitened(spark, corners)
    assert len(rows) == 50 and all(abs(r.explained - 0.2) < 1e-12 and r.identity_error < 1e-10 for r in rows)


def test_few_components_of_many_dimensions(spark):
    rng = np.random.default_rng(4)
    wide = (rng.standard_normal((200, 6)) * [90, 40, 20, 9, 4, 2]) @ rng.standard_normal((6, 90))
    wide = wide.astype(np.float32).tolist()
    held_to(whitened(spark, wide, 3), dict(enumerate(wide)), 3)


def test_nothing_to_whiten(spark):
    assert whitened(spark, []) == [] and whitened(spark, [None, [math.nan]]) == []
    assert whitened(spark, [[1.0, 2.0]]) == [] and whitened(spark, [[0.5, 0.5]] * 4) == []


def test_exact_where_longs_do_not_reach(spark):
    vectors = {0: [1e9, -3e8], 1: [0.0, 1.0], 2: [5.0, 6.0]}
    rows = whitened(spark, vectors.values(), 2)
    used = [[math.floor(64 * float(np.float32(x))) for x in v] for v in vectors.values()]
    sums = [sum(x) for x in zip(*used)]
    wanted = [sum((3 * a - s) ** 2 for a, s in zip(v, sums)) for v in used]
    assert {r.vec_id: r.deviation for r in rows} == {i: x if x < 2**63 else None for i, x in enumerate(wanted)}
