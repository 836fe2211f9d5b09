"""Eigenpairs against numpy's, whitening against a plain computation on exact numbers."""

import math

import numpy as np
import pytest

from taleweave.llm import eigen
from taleweave.llm.whitening import deviations, whitened
from tests.llm.test_corpus_ops import SF

SCHEMA = "vec_id long, embedding array<float>, label int, x int, v string, n string, component int"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], v, 0, i, "a", None, 9) for i, v in enumerate(vectors)], SCHEMA)


def brute(vectors, components=4):
    """x of the kept rows (by place), and n, S, eigenvalues, trace of the distinct ones."""
    x = {i: [math.floor(256.0 * float(np.float32(c))) for c in v] for i, v in enumerate(vectors) if v and all(c is not None and math.isfinite(c) for c in v)}
    distinct = sorted(set(map(tuple, x.values())))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    fit = np.array(distinct, float)
    covariance = (fit - fit.mean(axis=0)).T @ (fit - fit.mean(axis=0)) / n
    values, vectors = np.linalg.eigh(covariance)
    return x, n, sums, values[::-1][:components], vectors[:, ::-1][:, :components], float(np.trace(covariance))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 64, 150])
@pytest.mark.parametrize("kind", ["random", "low rank", "clustered", "equal", "blocks", "tiny", "huge"])
def test_leading_eigenpairs(n, kind):
    rng = np.random.default_rng(n)
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    spread = {"random": rng.random(n), "low rank": np.where(np.arange(n) < 3, 5.0 - np.arange(n), 0), "clustered": 1 + 1e-9 * np.arange(n), "equal": np.where(np.arange(n) < 3, 2.0, 1.0)}
    a = q @ np.diag(spread[kind]) @ q.T if kind in spread else np.diag(np.arange(n) % 3 + 1.0)
    a = {"tiny": a * 1e-200, "huge": a * 1e200}.get(kind, a)
    a = (a + a.T) / 2
    values, vectors = eigen.leading(a, 4)
    scale = np.abs(a).max()
    assert np.allclose(values / scale, np.linalg.eigvalsh(a / scale)[::-1][:4], atol=1e-13 * n, rtol=0)
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
    assert np.abs(a / scale @ vectors.T - vectors.T * (values / scale)).max() < 1e-13 * max(n, 10)


def test_zero_and_empty_matrices():
    assert eigen.leading(np.zeros((0, 0)), 4)[0].shape == (0,)
    values, vectors = eigen.leading(np.zeros((5, 5)), 4)
    assert (np.abs(values) < 1e-300).all() and np.allclose(vectors @ vectors.T, np.eye(4))


def test_sturm_counts():
    rng = np.random.default_rng(3)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.linspace(-4, 4, 101)
    assert (eigen.count_below(d, e, at) == [(values < x).sum() for x in at]).all()


def vectors():
    rng = np.random.default_rng(8)
    axes = np.linalg.qr(rng.standard_normal((12, 12)))[0]
    out = (rng.standard_normal((400, 12)) * [9, 7, 5, 3, 1, 1, 0.5, 0.5, 0.1, 0.1, 0.01, 0] @ axes).tolist()
    out += out[:50] * 3 + [None, [], [None] * 12, [float("nan"), *[0.0] * 11], [float("inf"), *[0.0] * 11], [1.0, 2.0], [-0.0] * 12, [0.0] * 12]
    return out


def test_whitening(spark):
    given = vectors()
    got = whitened(table(spark, given).repartition(5)).collect()
    usable = [None if v is not None and len(v) != 12 else v for v in given]
    x, n, sums, values, axes, trace = brute(usable)
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c) for i in x for c in (1, 2, 3, 4))
    signs = {}
    for r in got:
        row = np.array(x[r.vec_id], float)
        want = (row - np.array(sums) / n) @ axes[:, r.component - 1] / math.sqrt(values[r.component - 1])
        if abs(want) > 1e-3:
            signs.setdefault(r.component, np.sign(want * r.whitened))
        assert abs(r.whitened * signs.get(r.component, 1) - want) < 1e-9
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x[r.vec_id], sums))
        assert abs(r.explained - values[r.component - 1] / trace) < 1e-12 and r.identity_error < 1e-10
    distinct = {tuple(x[r.vec_id]): [q.whitened for q in sorted(got, key=lambda q: q.component) if q.vec_id == r.vec_id] for r in got}
    white = np.array(list(distinct.values()))
    assert np.abs(np.cov(white.T, bias=True) - np.eye(4)).max() < 1e-10


def test_few_vectors_and_no_variance(spark):
    assert whitened(table(spark, [[1.0, 2.0]] * 3)).count() == 0
    assert whitened(table(spark, [])).count() == 0
    assert whitened(table(spark, [None, [None]])).count() == 0
    rows = whitened(table(spark, [[1.0, 0.0], [0.0, 1.0], [0.0, 1.0]], [None, 4, 4])).collect()
    assert sorted((str(r.vec_id), r.component, r.n) for r in rows) == [("4", 1, 2), ("4", 1, 2), ("None", 1, 2)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and abs(r.explained - 1) < 1e-12 for r in rows)


def test_deviations_beyond_a_long_are_null():
    x = np.array([[3, -4], [1 << 40, 0]], np.int64)
    assert deviations(x, 10, [5, 6]) == [(30 - 5) ** 2 + (-40 - 6) ** 2, None]
    assert deviations(x[:1], 10, [5, 6]) == [(30 - 5) ** 2 + (-40 - 6) ** 2]


def test_query_on_the_small_table(spark):
    from taleweave.llm.queries import QUERIES

    given = [r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    rows = QUERIES["op13_whitening"](spark, SF).collect()
    x, n, sums, values, axes, trace = brute(given)
    assert len(rows) == 4 * len(x) and {r.n for r in rows} == {n}
    for r in rows:
        assert abs(r.explained / (values[r.component - 1] / trace) - 1) < 1e-9 and r.identity_error < 1e-9
        want = (np.array(x[r.vec_id], float) - np.array(sums) / n) @ axes[:, r.component - 1] / math.sqrt(values[r.component - 1])
        assert abs(abs(r.whitened) - abs(want)) < 1e-6
