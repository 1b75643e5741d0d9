"""Near-duplicates among vectors against all pairs, and the rules for odd rows."""

import numpy as np
import pytest

from gridloom.llm import crosspolytope as C

SCHEMA = "vec_id long, embedding array<double>, label int, n long, a string"


def by_pairs(rows, similar=C.SIMILAR):
    """n_links and the least id reached, by plain loops over (id, vector, label)."""

    def fits(v, label):
        return label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if fits(v, label) else None for _, v, label in rows]
    near = [{j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= similar} for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


def run(spark, rows):
    got = C.near_vectors(spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_hadamard_is_orthogonal():
    m = C.hadamard(np.eye(8))
    assert np.allclose(m @ m.T, np.eye(8)) and set(np.round(np.abs(m) * np.sqrt(8), 9).ravel()) == {1.0}


@pytest.mark.parametrize("dim", [64, 50])
def test_recall_at_the_least_cosine(dim):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 3000, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * b
    seeds = np.zeros(len(a), np.uint64)
    (own, more), (own2, more2) = C.buckets(a, seeds), C.buckets(b, seeds)
    met = (own == own2) | (more == own2[:, :, None]).any(axis=2) | (more2 == own[:, :, None]).any(axis=2)
    assert met.any(axis=1).mean() > 0.999


def test_all_pairs_of_groups_and_chains(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for centre in range(6):
        base = rng.normal(size=32)
        base /= np.linalg.norm(base)
        for k in range(30):
            v = base + rng.normal(size=32) * (0.018 if centre else 0.03)
            rows.append((len(rows), (v * (1 + k)).tolist(), centre % 3))
        rows += [(len(rows) + k, rows[-1][1], centre % 3) for k in range(5)]
    rows += [(len(rows) + k, rng.normal(size=32).tolist(), 1) for k in range(40)]
    expected = by_pairs(rows)
    assert sum(r[1] for r in expected) > 1000 and any(not r[3] for r in expected)
    assert run(spark, rows) == expected
    monkeypatch.setattr(C, "SMALL", 4)  # by products of groups
    monkeypatch.setattr(C, "PAIRS", 64)
    x = np.array([r[1] for r in rows])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    group = np.array([r[2] for r in rows])
    order = np.argsort(group, kind="stable")
    u, g = unit[order], group[order]
    pairs = {(int(a), int(b)) for a, b in zip(*C.linked(u, g, np.ones(len(u), bool), np.zeros(len(u), int), 0.98), strict=True)}
    assert pairs == {(i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if g[i] == g[j] and u[i] @ u[j] >= 0.98}


def test_buckets_in_cells(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    rows = [(k, (base + rng.normal(size=16) * 0.08).tolist(), 1) for k in range(90)]
    monkeypatch.setattr(C, "CELL", 16)
    assert run(spark, rows) == by_pairs(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1), (2, [2.0, 4.0], 1), (3, [1.0, 2.0], None), (4, None, 1), (5, [], 1), (6, [0.0, -0.0], 1), (7, [1.0, nan], 1), (8, [1.0, inf], 1),
        (9, [1.0, None], 1), (10, [1.0, 2.0, 0.0], 1), (11, [1.0, 2.0], 2), (None, [1e200, 2e200], 1), (None, [3.0, -1.0], 3), (12, [-1.0, -2.0], 1), (13, [0.0, 1.0], 4), (14, [-0.0, 1.0], 4),
    ]
    expected = by_pairs([(i, v if v is None or not any(x is not None and abs(x) > 1e100 for x in v) or v[1] == inf else [1.0, 2.0], y) for i, v, y in rows])
    assert run(spark, rows) == expected


def test_empty_table(spark):
    assert run(spark, []) == []
