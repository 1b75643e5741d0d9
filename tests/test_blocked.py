"""Blocked factorisations against the matrices they multiply out to."""

import numpy as np
import pytest

from gridloom.operators import blocked


def frame(spark, m):
    i, j = np.nonzero(m)
    return spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(i, j, strict=True)], "i long, j long, v double")


def array(df, rows, cols):
    out = np.zeros((rows, cols))
    for r in df.collect():
        out[r["i"], r["j"]] += r["v"]
    return out


@pytest.mark.parametrize(("n", "size"), [(1, 4), (11, 4), (9, 16)])
def test_cholesky(spark, n, size):
    x = np.random.default_rng(n).normal(size=(n, n))
    m = x @ x.T + np.eye(n)
    low = array(blocked.cholesky(frame(spark, m), size), n, n)
    assert np.allclose(low, np.linalg.cholesky(m), atol=1e-9)


@pytest.mark.parametrize(("n", "size"), [(1, 4), (11, 4)])
def test_lu_with_pivots_from_other_blocks(spark, n, size, monkeypatch):
    monkeypatch.setattr(blocked, "FAN", 2)
    m = np.random.default_rng(n).normal(size=(n, n))
    m[0, 0] = 0 if n > 1 else 3.0
    low, up, order = blocked.lu(frame(spark, m), size)
    low, up = array(low, n, n), array(up, n, n)
    rows = [r["row"] for r in sorted(order.collect())]
    assert sorted(rows) == list(range(n))
    assert np.allclose(low, np.tril(low)) and np.allclose(np.diag(low), 1) and np.allclose(up, np.triu(up), atol=1e-9)
    assert np.allclose(low @ up, m[rows], atol=1e-9) and np.abs(low).max() < 30


def test_what_cannot_be_factored(spark):
    with pytest.raises(Exception, match="singular"):
        low, _, _ = blocked.lu(frame(spark, np.ones((6, 6))), 2)
        low.collect()
    with pytest.raises(Exception, match="[Pp]ositive"):
        blocked.cholesky(frame(spark, -np.eye(3)), 2).collect()
    with pytest.raises(ValueError, match="square"):
        blocked.lu(frame(spark, np.ones((2, 3))))
    with pytest.raises(ValueError, match="depend"):
        blocked.tall_qr(frame(spark, np.ones((9, 2))))
    with pytest.raises(ValueError, match="more columns"):
        blocked.tall_qr(frame(spark, np.ones((2, 9))))
    assert blocked.cholesky(frame(spark, np.zeros((0, 0)))).collect() == []


def test_tall_matrices_by_a_tree(spark, monkeypatch):
    monkeypatch.setattr(blocked, "FAN", 2)
    m = np.random.default_rng(1).normal(size=(203, 7)) * np.logspace(0, 6, 7)
    q, r = blocked.tall_qr(frame(spark, m).repartition(9))
    q, r = array(q, 203, 7), array(r, 7, 7)
    assert np.allclose(q @ r, m, rtol=1e-9, atol=1e-6) and np.allclose(q.T @ q, np.eye(7), atol=1e-12)
    assert np.allclose(r, np.triu(r)) and (np.diag(r) > 0).all()
    u, w, vt = blocked.tall_svd(frame(spark, m).repartition(5))
    u, vt, w = array(u, 203, 7), array(vt, 7, 7), np.array([x["w"] for x in w.orderBy("j").collect()])
    assert np.allclose(w, np.linalg.svd(m, compute_uv=False), rtol=1e-9)
    assert np.allclose(u * w @ vt, m, rtol=1e-9, atol=1e-6) and np.allclose(u.T @ u, np.eye(7), atol=1e-9)
