"""Ray queries against brute force, over more suppliers than any prefix of keys."""

import numpy as np
import pytest

from gridloom.plans import catalog, scene_queries  # noqa: F401

SIDE = 50


def distances(keys):
    """Of each ray and key the nearer root, infinite where it's missed."""
    row, col = (a.ravel() for a in np.mgrid[:SIDE, :SIDE])
    d = np.stack([col - SIDE / 2 + 0.5, row - SIDE / 2 + 0.5, np.full(len(row), 25.0)], axis=1)
    d /= np.sqrt((d * d).sum(axis=1))[:, None]
    centre = np.stack([(keys % 7 - 3) * 6, (keys % 5 - 2) * 6, 30 + keys % 11], axis=1).astype(float)
    b = -2 * d @ centre.T
    disc = b * b - 4 * ((centre * centre).sum(axis=1) - (2.0 + keys % 3) ** 2)
    return np.where(disc > 1e-7, (-b - np.sqrt(np.maximum(disc, 0))) / 2, np.inf)


@pytest.mark.parametrize("name", ["raytrace_nearest", "raytrace_first_hit"])
def test_rays_meet_every_supplier(spark, tmp_path, name):
    keys = np.array([*range(35, 45), *range(900, 1100), 5000])
    spark.createDataFrame([(int(k), "x") for k in keys], "s_suppkey bigint, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    t = distances(keys)
    seen = set()
    for r in catalog.QUERIES[name](spark, str(tmp_path)).collect():
        own = t[r["row"] * SIDE + r["col"]]
        if r["k"] is None:
            assert not np.isfinite(own).any()
            continue
        at = int(np.flatnonzero(keys == r["k"])[0])
        assert abs(own[at] - r["t"]) < 1e-5
        assert own[at] <= own.min() + 1e-9 if name == "raytrace_nearest" else at == np.flatnonzero(np.isfinite(own))[0]
        seen.add(r["k"])
    assert any(k > 40 for k in seen)
