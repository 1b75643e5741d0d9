"""Queries of factorisations: every component of the vectors enters."""

import os

import numpy as np
import pandas as pd
import pytest

from gridloom.plans import catalog, matrix_queries  # noqa: F401


def parts(df):
    out = {}
    for key, own in df.toPandas().groupby([c for c in ("m", "part") if c in df.columns]):
        got = np.zeros((own.i.max() + 1, own.j.max() + 1))
        got[own.i, own.j] = own.v
        out[key] = got
    return out


@pytest.mark.parametrize("name", ["lu", "cholesky", "qr", "svd", "eigen_symmetric", "eigen", "inverse", "scalars", "adjugate", "solve"])
def test_factorisations_take_all_components(spark, small, name):
    vectors = pd.read_parquet(os.path.join(small, "embeddings.parquet"))
    got = parts(catalog.QUERIES[f"matrix_{name}"](spark, small))
    for label, own in vectors.groupby("label"):
        x = np.stack(own.embedding.tolist()).astype(float)
        g, n = x.T @ x + np.eye(x.shape[1]), x.shape[1]
        assert n == 64
        part = lambda p, label=label: got[(str(label), p)]
        if name == "lu":
            a, b = part("l") @ part("u"), g[part("order")[0].astype(int)]
        elif name == "cholesky":
            a, b = part("l") @ part("l").T, g
        elif name == "qr":
            a, b = part("q") @ part("r"), g
        elif name == "svd":
            a, b = part("u") * part("w") @ part("vt"), g
        elif name == "eigen_symmetric":
            a, b = part("vectors") * part("values") @ part("vectors").T, g
        elif name == "eigen":
            a, b = g @ part("vectors_real"), part("vectors_real") * part("real")
        elif name == "inverse":
            a, b = part("inverse") @ g, np.eye(n)
        elif name == "scalars":
            a, b = [part("norm2")[0, 0], np.log(part("det")[0, 0])], [np.linalg.norm(g, 2), np.linalg.slogdet(g)[1]]
        elif name == "adjugate":
            a, b = part("adjugate") @ g / np.linalg.det(g), np.eye(n)
        else:
            a, b = g @ got[(str(label),)], np.arange(1.0, n + 1)[:, None]
        assert np.allclose(a, b, atol=1e-6)
