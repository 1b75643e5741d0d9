"""Rays over grids against every ray with every object."""

import math

import numpy as np
import pytest

from gridloom.operators import scene


def roots(o, d, c, radius):
    to = [x - y for x, y in zip(o, c, strict=True)]
    b = 2 * sum(x * y for x, y in zip(d, to, strict=True))
    disc = b * b - 4 * (sum(x * x for x in to) - radius * radius)
    if disc > scene.TINY:
        return (-b - math.sqrt(disc)) / 2
    return -b / 2 if disc >= -scene.TINY else None


def crossing(o, d, a, b, c):
    m = np.column_stack([np.subtract(b, a), np.subtract(c, a), np.negative(d)])
    if abs(np.linalg.det(m)) < scene.TINY:
        return None
    u, v, t = np.linalg.solve(m, np.subtract(o, a))
    return float(t) if u >= 0 and v >= 0 and u + v <= 1 else None


def by_loops(rays, spheres, triangles, hit):
    out = []
    for key, o, d in rays:
        found = [(t, k) for k, c, r in spheres if (t := roots(o, d, c, r)) is not None] + [(t, k) for k, a, b, c in triangles if (t := crossing(o, d, a, b, c)) is not None]
        best = min(found, key=lambda h: h if hit == "nearest" else (h[1], h[0]), default=(None, None))
        out.append((key, best[1], None if best[0] is None else round(best[0], 6)))
    return sorted(out)


def unit(v):
    return tuple(float(x) for x in np.array(v) / np.linalg.norm(v))


@pytest.fixture(scope="module")
def things():
    rng = np.random.default_rng(12)
    point = lambda s=20: tuple(float(x) for x in rng.uniform(-s, s, 3))
    rays = [(k, point(30) if k % 3 else (0.0, 0.0, 0.0), unit(rng.normal(size=3))) for k in range(150)]
    rays += [(200, (0.0, 0.0, -50.0), (0.0, 0.0, 1.0)), (201, (5.0, 5.0, 5.0), (1.0, 0.0, 0.0)), (202, (99.0, 99.0, 0.0), (0.0, 0.0, 1.0)), (203, (0.0, 0.0, 0.0), (0.0, -1.0, 0.0))]
    spheres = [(k, point(), float(rng.uniform(0.2, 2))) for k in range(70)] + [(100, (0.0, 0.0, 0.0), 60.0), (101, (3.0, 0.0, 0.0), 15.0)]
    spheres += [(300 + k, (7.0, 7.0, 7.0), 0.5 + k / 100) for k in range(12)]  # many in one cell
    triangles = [(400 + k, point(), point(), point()) for k in range(30)]
    return rays, spheres, triangles


SPHERE = "k long, centre struct<x:double, y:double, z:double>, radius double"
CORNER = "struct<x:double, y:double, z:double>"


@pytest.mark.parametrize("hit", ["nearest", "first"])
@pytest.mark.parametrize("shares", [False, True])
def test_grids_find_what_loops_find(spark, things, monkeypatch, hit, shares):
    rays, spheres, triangles = things
    if shares:
        monkeypatch.setattr(scene, "RAYS", 7)
        monkeypatch.setattr(scene, "OBJECTS", 3)
    table = spark.createDataFrame(rays, f"ray long, o {CORNER}, d {CORNER}")
    a, b = spark.createDataFrame(spheres, SPHERE), spark.createDataFrame(triangles, f"k long, a {CORNER}, b {CORNER}, c {CORNER}")
    got = scene.trace(table, a, hit, ("ray",), b)
    rows = sorted((r["ray"], r["k"], None if r["t"] is None else round(r["t"], 6)) for r in got.collect())
    expected = by_loops(rays, spheres, triangles, hit)
    assert [r[:2] for r in rows] == [r[:2] for r in expected]
    assert [r[2] for r in rows] == pytest.approx([r[2] for r in expected], abs=1e-5)
    assert len({r[1] for r in expected}) > (3 if hit == "first" else 1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_large_objects_lie_in_few_cells(spark, things):
    rays, spheres, _ = things
    objects = scene.boxed(spark.createDataFrame(spheres, SPHERE), None)
    grids = scene.grids_of(objects)
    cells = scene.object_cells(objects, grids).groupBy("k").count().collect()
    assert len(grids.sides) > 1 and max(r["count"] for r in cells) <= scene.TOUCHED**3 and len(cells) == len(spheres)


def test_no_objects_and_no_rays(spark, things):
    rays, spheres, _ = things
    table, all_of = spark.createDataFrame(rays[:3], f"ray long, o {CORNER}, d {CORNER}"), spark.createDataFrame(spheres, SPHERE)
    assert [tuple(r)[1:] for r in scene.trace(table, all_of.limit(0), key=("ray",)).collect()] == [(None, None)] * 3
    assert scene.trace(table.limit(0), all_of, key=("ray",)).collect() == []
