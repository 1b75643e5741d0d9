"""Tall images: what a format can't name, a task can't hold or a grid can't join."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import raster
from gridloom.operators import geometry, scene, sequential
from gridloom.plans import raster_queries
from gridloom.raster import Raster
from gridloom.sources import formats


def tall(spark, height, width, maxval=255, keep="true"):
    """A gray image with a sample that's known for each cell, without those that aren't kept."""
    px = spark.range(height * width).where(keep)
    v = (F.col("id") * 7 + F.expr(f"id div {width}")) % (maxval + 1)
    return Raster(px.select(F.lit("a").alias("image"), F.expr(f"id div {width}").alias("row"), (F.col("id") % width).alias("col"), F.array(v).alias("s")), height, width, maxval)


@pytest.mark.parametrize("name, height, maxval", [("mgr", 5000, 1), ("gif", 66000, 255), ("ilbm", 66000, 255), ("lispm", 66000, 255), ("tga", 66000, 255)])
def test_tall_images_are_files_by_bands(spark, name, height, maxval):
    r = tall(spark, height, 2, maxval)
    files = formats.encoded(r, name, formats.band_rows(r))
    assert files.count() == -(-height // formats.band_rows(r)) > 1
    got = raster_queries._there_and_back(r, name).select("row", "col", F.col("s")[0].alias("v"))
    want = r.px.select("row", "col", F.col("s")[0].alias("v"))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


@pytest.mark.parametrize("name, width, maxval, depth", [("ilbm", 2, 255, 3), ("mda", 8, 1, 1), ("pcx", 2, 255, 1), ("leaf", 2, 255, 1), ("sgi", 2, 255, 1), ("sir", 2, 255, 1), ("sir", 2, 255, 3)])
def test_heights_that_formats_cannot_name(spark, name, width, maxval, depth):
    r = tall(spark, 66000, width, maxval)
    r = r.with_cell(F.array(*((F.col("s")[0] * (k + 1)) % (maxval + 1) for k in range(depth))), depth=depth)
    got = raster_queries._there_and_back(r, name).select("row", "col", F.slice("s", 1, depth).alias("s"))
    want = r.px.select("row", "col", "s")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


@pytest.mark.parametrize("name, maxval, times", [("bmp", 255, 1), ("pfm", 255, 257), ("xwd", 255, 1), ("png", 255, 1), ("tiff", 255, 1), ("icon", 1, 1), ("g3", 1, 1)])
def test_tasks_hold_a_band_of_an_image(spark, name, maxval, times):
    r = tall(spark, 9000, 16, maxval)
    rows = formats.band_rows(r)
    files = formats.encoded(r, name, rows)
    assert sorted(f["top"] for f in files.select("top").collect()) == list(range(0, 9000, rows)) and rows * r.width * r.depth <= formats.FILE_CELLS
    got = raster_queries._there_and_back(r, name).select("row", "col", F.col("s")[0].alias("v"))
    want = r.px.select("row", "col", (F.col("s")[0] * times).alias("v"))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_bands_without_cells_are_written(spark):
    r = tall(spark, 600, 3, keep="id < 30 or id > 1700")
    got = formats.decoded(formats.encoded(r, "png", 192), "png").collect()
    assert len(got) == 1800 and len({(x["row"], x["col"]) for x in got}) == 1800
    own = {(x["row"], x["col"]): x["s"][0] for x in r.px.collect()}
    assert all(x["s"][0] == own.get((x["row"], x["col"]), 0) for x in got)


def test_files_are_decoded_by_parts(spark, monkeypatch):
    monkeypatch.setattr(formats, "AT_ONCE", 10)
    m = np.arange(7 * 4 * 3).reshape(7, 4, 3)
    files = spark.createDataFrame([("x", bytearray(formats.bmp_encode(m, 255)))], "image string, content binary")
    got = formats.decoded(files, "bmp").collect()
    assert {(x["row"], x["col"]): x["s"] for x in got} == {(i, j): m[i, j].tolist() for i in range(7) for j in range(4)}
    assert {(x["image"], x["height"], x["width"], x["maxval"]) for x in got} == {("x", 7, 4, 255)}


@pytest.mark.parametrize("degrees", [0, 30, 90, 151, 180, 200, -77])
@pytest.mark.parametrize("height, width", [(23, 4), (3, 17)])
def test_rotated_by_loops(spark, degrees, height, width):
    r = tall(spark, height, width, keep="id % 7 <> 3")
    own = {(x["row"], x["col"]): x["s"][0] for x in r.px.collect()}
    out = geometry.rotate(r, degrees, (9,))
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    want = {}
    for row in range(out.height):
        for col in range(out.width):
            x, y = col - (out.width - 1) / 2, row - (out.height - 1) / 2
            at = math.floor(y * c + x * s + (height - 1) / 2 + 0.5), math.floor(x * c - y * s + (width - 1) / 2 + 0.5)
            want[row, col] = own.get(at, 9)
    got = out.px.collect()
    assert len(got) == len(want) and {(x["row"], x["col"]): x["s"][0] for x in got} == want


@pytest.mark.parametrize("degrees, smooth", [(20, True), (-35, True), (20, False), (-35, False)])
def test_sheared_by_loops(spark, degrees, smooth):
    height, width, slope = 19, 5, math.tan(math.radians(degrees))
    r = tall(spark, height, width)
    v = {(x["row"], x["col"]): x["s"][0] for x in r.px.collect()}
    out = geometry.shear(r, degrees, smooth)
    want = {(row, col): 0 for row in range(height) for col in range(out.width)}
    for row in range(height):
        shift = row * abs(slope) if slope > 0 else (height - row) * abs(slope)
        whole = math.floor(shift if smooth else shift + 0.5)
        part = math.floor((shift - whole) * 4096) if smooth else 0
        for col in range(width + 1):
            if col + whole < out.width:
                want[row, col + whole] = (v.get((row, col - 1), 0) * part + v.get((row, col), 0) * (4096 - part) + 2048) // 4096
    got = out.px.collect()
    assert len(got) == len(want) and {(x["row"], x["col"]): x["s"][0] for x in got} == want


@pytest.mark.parametrize("move", [lambda r: geometry.rotate(r, 30), lambda r: geometry.shear(r, 10)])
def test_only_what_an_image_covers_is_joined(spark, monkeypatch, move):
    r, made, real = tall(spark, 2000, 3), [], geometry.full_grid
    monkeypatch.setattr(geometry, "full_grid", lambda *a, **k: made.append((real(*a, **k), k.get("beyond", False))) or made[-1][0])
    out = move(r)
    joined, rest = ([g.count() for g, beyond in made if beyond == b] for b in (False, True))
    assert sum(joined) <= 12 * out.height and sum(joined) + sum(rest) == out.height * out.width


@pytest.mark.parametrize("height, move", [(4000, lambda r: geometry.rotate(r, 30)), (200, lambda r: geometry.shear(r, 89.6))])
def test_canvases_are_small_in_files(spark, tmp_path, height, move):
    out = move(tall(spark, height, 3))
    out.flat().write.parquet(str(tmp_path / "out"))
    got, size = spark.read.parquet(str(tmp_path / "out")), sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert got.count() == out.height * out.width > 5_000_000 and size < 0.4 * out.height * out.width


@pytest.mark.parametrize("block", [(1, 1), (5, 3), (64, 2)])
@pytest.mark.parametrize("first, last", [(4, 6), (0, 12), (7, 6), (-3, 2), (11, 20), (15, 20)])
def test_cells_beyond_a_span_by_blocks(spark, monkeypatch, block, first, last):
    monkeypatch.setattr(raster, "BLOCK", block)
    span = F.col("row") % 2 + first, F.lit(last)
    within, beyond = (sorted((x["row"], x["col"]) for x in raster.full_grid(tall(spark, 2, 2), 7, 13, span, beyond=b).collect()) for b in (False, True))
    assert within == [(row, col) for row in range(7) for col in range(13) if row % 2 + first <= col <= last]
    assert sorted(within + beyond) == [(row, col) for row in range(7) for col in range(13)]


@pytest.mark.parametrize("move", [lambda r: geometry.jitter(r, 3, 5), lambda r: geometry.spread(r, 2, 5), lambda r: geometry.sample(r, 2 * r.height, 2)])
def test_grids_are_not_broadcast(spark, move):
    got = move(tall(spark, 3000, 3)).px
    assert got.count() > 0
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_curve_is_followed_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(sequential, "STRETCH", 2)
    path = np.array(sequential.hilbert_path(5))
    assert (sequential.hilbert_place(path[:, 0], path[:, 1], 5) == np.arange(4**5)).all()
    for height, width, maxval in ((20000, 1, 255), (37, 5, 254), (9, 40, 7)):
        r = tall(spark, height, width, maxval, "id % 11 <> 4")
        own = {(x["row"], x["col"]): x["s"][0] for x in r.px.collect()}
        cells = np.array(list(np.ndindex(height, width)))
        order = (max(height, width) - 1).bit_length()
        want, left = {}, 0
        for row, col in cells[np.argsort(sequential.hilbert_place(cells[:, 0], cells[:, 1], order))].tolist():
            left += own.get((row, col), 0)
            want[row, col] = int(left >= maxval / 2)
            left -= want[row, col] * maxval
        got = sequential.hilbert_bitmap(r).px.collect()
        assert len(got) == len(want) and {(x["row"], x["col"]): x["s"][0] for x in got} == want


@pytest.mark.parametrize("palette", [None, [(0,), (90,), (255,)], [(k,) for k in range(0, 250, 6)]])
def test_diffused_line_by_line(spark, monkeypatch, palette):
    monkeypatch.setattr(sequential, "AT_ONCE", 20)
    height, width = 40, 6
    r = tall(spark, height, width, keep="id % 5 <> 1 and id not between 60 and 100 and id < 200")
    m, want = np.zeros((height + 1, width + 2)), {}
    for x in r.px.collect():
        m[x["row"], x["col"] + 1] = x["s"][0]
    for row in range(height):
        step = 1 if row % 2 == 0 else -1
        for c in range(1, width + 1)[::step]:
            got = (m[row, c] >= 127.5) * 255 if palette is None else min(palette, key=lambda p: (p[0] - min(max(m[row, c], 0), 255)) ** 2)[0]
            want[row, c - 1], left = got, m[row, c] - got
            for at, share in (((row, c + step), 7), ((row + 1, c - step), 3), ((row + 1, c), 5), ((row + 1, c + step), 1)):
                m[at] += left * share / 16
    out = (sequential.diffuse_bitmap(r) if palette is None else sequential.diffuse_palette(r, palette)).px
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()  # no image is held whole
    got = out.collect()
    assert len(got) == len(want) and {(x["row"], x["col"]): x["s"][0] for x in got} == {k: v // 255 if palette is None else v for k, v in want.items()}


@pytest.mark.parametrize("hit", ["nearest", "first"])
def test_rays_and_objects_that_are_alike_are_taken_once(spark, monkeypatch, hit):
    v = lambda *x: F.struct(*(F.lit(float(k)).alias(n) for k, n in zip(x, "xyz", strict=True)))
    spheres = spark.range(5, 605).select(F.col("id").alias("k"), v(0, 0, 30).alias("centre"), (F.col("id") % 2 + 2).cast("double").alias("radius"))
    rays = spark.range(900).select(F.col("id").alias("ray"), v(0, 0, 0).alias("o"), F.when(F.col("id") % 3 == 0, v(0, 1, 0)).otherwise(v(0, 0, 1)).alias("d"))
    laid, walked = [], []
    lying, walking = scene.object_cells, scene.walked_cells
    monkeypatch.setattr(scene, "object_cells", lambda objects, grids: laid.append(objects.count()) or lying(objects, grids))
    monkeypatch.setattr(scene, "walked_cells", lambda own, grids: walked.append(own.count()) or walking(own, grids))
    got = scene.trace(rays, spheres, hit, ("ray",)).collect()
    assert laid == [2] and walked == [2] and len(got) == 900
    assert all((x["k"], x["t"]) == ((None, None) if x["ray"] % 3 == 0 else (5, 27.0)) for x in got)
