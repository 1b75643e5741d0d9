"""Regions against plain flooding, over bands of few lines, and the rounds that a spiral takes."""

import numpy as np
import pytest

from gridloom.operators import regions, sequential
from gridloom.raster import Raster


def raster(spark, images, maxval=9):
    rows = [(name, r, c, [int(v) for v in np.atleast_1d(m[r, c])]) for name, m in images.items() for r in range(m.shape[0]) for c in range(m.shape[1])]
    m = next(iter(images.values()))
    depth = 1 if m.ndim == 2 else m.shape[2]
    return Raster(spark.createDataFrame(rows, "image string, row long, col long, s array<bigint>"), *m.shape[:2], maxval, depth)


def spread(m, starts):
    """Cells reached from starts over cells of the start's colour."""
    seen, todo = set(starts), list(starts)
    while todo:
        r, c = todo.pop()
        for a, b in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
            if 0 <= a < m.shape[0] and 0 <= b < m.shape[1] and (a, b) not in seen and np.all(m[a, b] == m[r, c]):
                seen.add((a, b))
                todo.append((a, b))
    return seen


def spiral(n):
    m = np.zeros((n, n), int)
    r = c = n // 2
    step, way = 2, [(0, 1), (1, 0), (0, -1), (-1, 0)]
    m[r, c] = 1
    for k in range(4 * n):
        for _ in range(step):
            r, c = r + way[k % 4][0], c + way[k % 4][1]
            if not (0 <= r < n and 0 <= c < n):
                return m
            m[r, c] = 1
        step += 2 * (k % 2)
    return m


@pytest.mark.parametrize("band", [1, 40, 1 << 16])
def test_labels_floods_and_fills(spark, monkeypatch, band):
    monkeypatch.setattr(regions, "BAND", band)
    rng = np.random.default_rng(band)
    images = {"a": (rng.random((17, 13)) < 0.6).astype(int), "b": rng.integers(0, 3, (17, 13)), "c": spiral(17)[:, :13], "d": np.ones((17, 13), int)}
    r = raster(spark, images)
    runs, _ = regions.regions(r.px, r.width)
    got = {(x["image"], x["row"], c): x["label"] for x in runs.collect() for c in range(x["first"], x["last"] + 1)}
    for name, m in images.items():
        for row in range(17):
            for col in range(13):
                assert got[name, row, col] == min(a * 13 + b for a, b in spread(m, [(row, col)]))
    outside = {(x["image"], x["row"], x["col"]) for x in regions.flood(r, 1).collect()}
    rim = [(a, b) for a in range(17) for b in range(13) if a in (0, 16) or b in (0, 12)]
    assert outside == {(name, *x) for name, m in images.items() for x in spread(m, [x for x in rim if m[x] == 1])}
    masked = {(x["image"], x["row"], x["col"]): x["s"] for x in sequential.mask(r, 1).px.collect()}
    assert {k for k, s in masked.items() if s == [1]} == outside and len(masked) == 4 * 17 * 13
    seeds = [(0, 0), (8, 8), (16, 5), (99, 99)]
    painted = {(x["image"], x["row"], x["col"]): x["s"] for x in regions.fill(r, seeds, (7,)).px.collect()}
    for name, m in images.items():
        inside = set().union(*(spread(m, [x]) for x in seeds[:3]))
        assert all(painted[name, a, b] == [7 if (a, b) in inside else m[a, b]] for a in range(17) for b in range(13))


@pytest.mark.parametrize(("band", "most"), [(80, 10), (650, 8), (1 << 16, 0)])  # a band is a line, ten lines, the image
def test_a_spiral_takes_few_rounds(spark, monkeypatch, band, most):
    monkeypatch.setattr(regions, "BAND", band)
    m = spiral(61)  # of 30 turns
    r = raster(spark, {"a": m})
    runs, rounds = regions.regions(r.px.where(r.plane() == 1), r.width)
    assert runs.select("label").distinct().count() == 1 and rounds <= most


def test_colours_of_planes_and_nothing(spark):
    m = np.zeros((4, 5, 3), int)
    m[:2, :, 1] = 5
    r = raster(spark, {"a": m})
    assert sum(x["s"] == [1, 2, 3] for x in regions.fill(r, [(0, 4)], (1, 2, 3)).px.collect()) == 10
    assert regions.fill(r, [], (1, 2, 3)) is r
    with pytest.raises(ValueError, match="planes"):
        regions.fill(r, [(0, 0)], (1,))
    empty = Raster(r.px.limit(0), 4, 5, 9, 3)
    assert regions.fill(empty, [(0, 0)], (1, 2, 3)).px.collect() == [] and regions.flood(empty, 1).collect() == []
