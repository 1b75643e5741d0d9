"""Operators on images: identities, tiny rasters by hand, and plain loops over random ones."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import color
from gridloom.operators import aggregate, assemble, combine, generate, geometry, matrix, neighbours, point, scene, select, sequential
from gridloom.raster import Raster
from gridloom.sources import anymap


def make(spark, values, maxval=255, image="a"):
    """A raster from lists of rows; a cell is a number or a tuple."""
    rows = [(image, i, j, list(v) if isinstance(v, tuple) else [v]) for i, line in enumerate(values) for j, v in enumerate(line)]
    px = spark.createDataFrame(rows, "image string, row bigint, col bigint, s array<bigint>")
    return Raster(px, len(values), len(values[0]), maxval, len(rows[0][3]))


def back(r):
    out = [[None] * r.width for _ in range(r.height)]
    for x in r.px.collect():
        out[x["row"]][x["col"]] = x["s"][0] if r.depth == 1 else tuple(x["s"])
    return out


@pytest.fixture(scope="module")
def values():
    rng = random.Random(3)
    return [[rng.randrange(256) for _ in range(9)] for _ in range(7)]


@pytest.fixture(scope="module")
def img(spark, values):
    return make(spark, values)


@pytest.fixture(scope="module")
def dots(spark, values):
    return make(spark, [[int(v > 120) for v in line] for line in values], 1)


def test_twice_is_the_same(img, values):
    assert back(point.invert(point.invert(img))) == values
    assert back(geometry.flip(img, "transpose,transpose")) == values
    assert back(geometry.flip(img, "rotate90,rotate270")) == values
    assert back(point.from_row_differences(point.row_differences(img))) == values
    assert back(point.channels(combine.stack(img, img), [1])) == values
    assert back(geometry.sample(geometry.enlarge(img, 3), 7, 9)) == values
    assert back(combine.join_planes(img, img, img)) == [[(v, v, v) for v in line] for line in values]
    assert back(point.swap_bytes(point.swap_bytes(point.depth(img, 65535)))) == back(point.depth(img, 65535))
    assert back(select.cut(geometry.pad(img, 2, 1, 3, 4), left=2, width=9, top=3, height=7)) == values


def test_errors(img):
    with pytest.raises(ValueError):
        point.channels(img, [1])
    with pytest.raises(ValueError):
        select.cut(img, left=5, width=9)
    with pytest.raises(ValueError):
        combine.arithmetic(img, select.cut(img, width=3), "add")
    with pytest.raises(ValueError):
        color.parse("no such colour")


def around(values, i, j, n=1):
    h, w = len(values), len(values[0])
    return [values[a][b] for a in range(max(0, i - n), min(h, i + n + 1)) for b in range(max(0, j - n), min(w, j + n + 1))]


def test_neighbourhoods_by_loops(img, values, dots):
    h, w = len(values), len(values[0])
    cross = [[0, 1, 0], [1, 1, 1], [0, 1, 0]]
    near = lambda i, j: [values[a][b] for a, b in ((i, j), (i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)) if 0 <= a < h and 0 <= b < w]
    assert back(neighbours.dilate(img, cross)) == [[max(near(i, j)) for j in range(w)] for i in range(h)]
    assert back(neighbours.erode(img, cross)) == [[min(near(i, j)) for j in range(w)] for i in range(h)]
    assert back(neighbours.opening(img, cross)) == back(neighbours.dilate(neighbours.erode(img, cross), cross))
    inner = lambda i, j: 0 < i < h - 1 and 0 < j < w - 1
    box = [[int(sum(around(values, i, j)) / 9 + 0.5) if inner(i, j) else values[i][j] for j in range(w)] for i in range(h)]
    assert back(neighbours.box(img)) == box
    assert back(neighbours.convolve(img, [[1 / 9] * 3] * 3)) == box
    few = [[v // 64 for v in line] for line in values]
    mode = [[max(set(a), key=lambda v: (a.count(v), -v)) for j in range(w) for a in [around(few, i, j, 2)]] for i in range(h)]
    assert back(neighbours.modal(make_from(img, few), 2)) == mode
    alive = back(dots)
    count = lambda i, j: sum(around(alive, i, j)) - alive[i][j]
    assert back(neighbours.life(dots)) == [[int(count(i, j) == 3 or (count(i, j) == 2 and alive[i][j])) for j in range(w)] for i in range(h)]
    median = [[sorted(around(values, i, j))[4] if inner(i, j) else None for j in range(w)] for i in range(h)]
    got = back(neighbours.trimmed_mean(img, 0.5))
    assert all(m is None or m == g for a, b in zip(median, got, strict=True) for m, g in zip(a, b, strict=True))


def make_from(r, values):
    return make(r.px.sparkSession, values)


def test_edges_and_borders(spark):
    step = make(spark, [[0, 0, 255, 255]] * 4)
    assert back(neighbours.edges(step)) == [[0] * 4, [0, 255, 255, 0], [0, 255, 255, 0], [0] * 4]
    assert back(neighbours.relief(make(spark, [[10] * 5] * 3))) == [[0] * 5, [0, 127, 127, 127, 0], [0] * 5]
    assert back(neighbours.relief(make(spark, [[1, 2, 3, 4], [4, 5, 200, 3], [250, 249, 9, 1]]))) == [[0] * 4, [0, 177, 117, 0], [0] * 4]  # 250 + 127 - 200; 249 + 127 - 3 beyond a byte
    lone = make(spark, [[1, 1, 1], [1, 0, 1], [1, 1, 1]], 1)
    assert back(neighbours.clean(lone)) == [[1] * 3] * 3
    tiny = make(spark, [[7]])
    assert back(neighbours.edges(tiny)) == [[0]] and back(neighbours.box(tiny)) == [[7]]


def test_values_by_hand(spark):
    gray = lambda line: [(v, v, v) for v in line]
    got = combine.anaglyph(make(spark, [gray([10, 20, 30, 40])]), make(spark, [gray([50, 60, 70, 80])]), 2)
    assert back(got) == [[(0, 20, 20), (50, 30, 30), (60, 40, 40), (70, 0, 0)]]
    assert back(point.equalize(make(spark, [[0, 0, 1, 2]]))) == [[0, 0, 171, 255]]  # 128 and 191 before scaling
    assert back(point.normalize(make(spark, [list(range(0, 100, 10))]), 20, 10)) == [[0, 1, 33, 65, 97, 129, 160, 192, 224, 255]]
    assert back(point.normalize(make(spark, [[7, 7]]), low=5, high=9)) == [[159, 159]]
    assert back(point.normalize(make(spark, [[(100, 100, 100), (200, 100, 0)]]), low=0, high=128, keep_hues=True)) == [[(200, 200, 200), (255, 200, 0)]]  # 100 to 200 and 118 to 236: twice both
    assert back(generate.ramp(spark, 4, 4, "rectangle"))[:3] == [[0, 63, 127, 63], [63, 127, 191, 127], [127, 191, 255, 191]]
    assert back(generate.ramp(spark, 4, 4, "ellipse"))[:3] == [[0, 0, 0, 0], [0, 127, 191, 127], [0, 191, 255, 191]]
    assert back(generate.distance_kernel(spark, 3, 3)) == [[140, 145, 140], [145, 255, 145], [140, 145, 140]]
    assert back(generate.distance_kernel(spark, 2, 2)) == [[255, 255], [255, 255]]
    assert back(geometry.globe(make(spark, [[1, 2, 3, 4, 5]] * 2), 2)) == [[0] * 5, [1, 2, 3, 4, 5]]
    # rows of six, strips of three; sin(60 degrees) leaves no border: 0.2 rounds to 0; the last column of a strip is kept
    assert back(geometry.globe(make(spark, [[1, 2, 3, 4, 5, 6]] * 3), 2))[1] == [1, 2, 3, 4, 5, 6]


def test_clusters_curves_and_crops(spark):
    half = make(spark, [[127, 128, 155], [169, 170, 240], [185, 198, 213]])
    # 9, 11, 10 / 12, 17, 16 / 13, 14, 15 of 18: 127, 155, 141 / 170, 240, 226 / 184, 198, 212
    assert back(point.cluster_bitmap(half, 3)) == [[0, 0, 1], [0, 0, 1], [1, 0, 1]]
    for side in (3, 4, 8):
        flat = back(point.cluster_bitmap(make(spark, [[128] * (4 * side)] * (4 * side)), side, whole=True))
        assert np.mean(flat) == pytest.approx(0.5, abs=1 / side**2)
        assert sorted(v for line in point.CLUSTERS[side] for v in line) == list(range(side * side, 2 * side * side))
    assert back(point.gamma_planes(make(spark, [[(64, 64, 64)]]), (1.0, 2.0, 0.5))) == [[(64, 128, 16)]]
    dot = make(spark, [[0, 0, 0], [0, 5, 0], [0, 0, 0]])
    assert {(r["row"], r["col"]) for r in select.crop(dot, (0,), ("left",)).collect()} == {(i, j) for i in range(3) for j in range(2)}
    assert select.crop(dot, (0,)).count() == 1


def test_objects_are_transformed(spark):
    m = [[0, 1, 0, 1], [1, 0, 0, 2], [0, 0, 3, 0], [0, 0, 0, 1]]
    p = "named_struct('x', 1D, 'y', 2D, 'z', 3D)"
    ball = spark.sql(f"select {p} as centre, 4D as radius, array({p}) as vertices")
    assert tuple(scene.transform_spheres(ball, m).first()["centre"]) == (3, 3, 9) and scene.transform_spheres(ball, m).first()["radius"] == 4
    assert tuple(scene.transform_spheres(ball, m, "as_written").first()["centre"]) == (1, 2, 3)
    assert tuple(scene.transform_polygons(ball, m).first()["vertices"][0]) == (3, 3, 9)
    assert tuple(scene.transform_polygons(ball, m, mode="as_written").first()["vertices"][0]) == (2, 1, 1)


def test_matrices_are_divided(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(3, 3)), rng.normal(size=(3, 3)) + 3 * np.eye(3)
    got = {(r["i"], r["j"]): r["v"] for r in matrix.divide(as_matrix(spark, x), as_matrix(spark, y)).collect()}
    assert np.allclose([[got[i, j] for j in range(3)] for i in range(3)], x @ np.linalg.inv(y))
    half = {(r["i"], r["j"]): r["v"] for r in matrix.divide_cells(as_matrix(spark, x), 2.0).collect()}
    assert np.allclose([[half[i, j] for j in range(3)] for i in range(3)], x / 2)


def test_grids_are_made_by_many_tasks(spark, img):
    parts = geometry.full_grid(img, 40, 50).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and sum(r["count"] for r in parts) == 2000


def test_minkowski_of_known_shapes(spark):
    ring = make(spark, [[1, 1, 1, 0], [1, 0, 1, 0], [1, 1, 1, 1]], 1)
    assert [tuple(r)[1:] for r in aggregate.minkowski(ring).collect()] == [(9, 18, 0)]
    two = make(spark, [[1, 0, 1]], 1)
    assert [tuple(r)[1:] for r in aggregate.minkowski(two).collect()] == [(2, 8, 2)]


def test_flood_and_mask(spark):
    rng = random.Random(1)
    values = [[int(rng.random() < 0.6) for _ in range(14)] for _ in range(11)]
    reach = {(i, j) for i in range(11) for j in range(14) if values[i][j] and (i in (0, 10) or j in (0, 13))}
    todo = list(reach)
    while todo:
        i, j = todo.pop()
        for a, b in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
            if 0 <= a < 11 and 0 <= b < 14 and values[a][b] and (a, b) not in reach:
                reach.add((a, b))
                todo.append((a, b))
    assert back(sequential.mask(make(spark, values, 1))) == [[int((i, j) in reach) for j in range(14)] for i in range(11)]


def test_diffusion_keeps_the_mean(spark):
    flat = make(spark, [[100] * 40] * 40)
    mean = np.mean(back(sequential.diffuse_bitmap(flat)))
    assert abs(mean - 100 / 255) < 0.02
    assert abs(np.mean(back(sequential.hilbert_bitmap(flat))) - 100 / 255) < 0.02
    path = sequential.hilbert_path(3)
    assert len(set(path)) == 64 and all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in itertools.pairwise(path))


def test_deconvolution_undoes_projection(spark):
    profile = [90, 80, 60, 30, 10]
    n = len(profile)
    line = [sum(2 * (math.sqrt((j + 1) ** 2 - k**2) - math.sqrt(max(0, j**2 - k**2))) * profile[j] for j in range(k, n)) for k in range(n)]
    r = make(spark, [[int(v + 0.5) for v in line]], 100000)
    assert all(abs(a - b) <= 1 for a, b in zip(back(sequential.abel(r, 0))[0], profile, strict=True))


def test_palette_and_quantize(spark):
    r = make(spark, [[(0, 0, 0), (1, 0, 0), (250, 250, 250)], [(0, 1, 0), (255, 255, 255), (251, 250, 250)]])
    got = aggregate.palette(r, 2)
    assert sorted(got) == [(0, 0, 0), (252, 251, 251)]
    assert len({c for line in back(assemble.quantize(r, 2)) for c in line}) == 2
    assert aggregate.median_cut([], 3) == []
    many = [((k, 255 - k, k // 2), 1 + k % 3) for k in range(256)]
    assert len(aggregate.median_cut(many, 16)) == 16


def test_resampling(spark, img, values):
    assert back(geometry.resample(img, 7, 9)) == values
    assert back(geometry.resample(make(spark, [[9] * 6] * 4), 3, 5, "lanczos")) == [[9] * 5] * 3
    for name in geometry.FILTERS:
        sums = {}
        for k, _, w in geometry.filter_weights(10, 7, name):
            sums[k] = sums.get(k, 0) + w
        assert len(sums) == 7 and all(abs(s - 1) < 1e-9 for s in sums.values())
    assert back(geometry.stretch(make(spark, [[0, 10]]), 2, 1)) == [[0, 5, 10, 10]]
    assert back(geometry.rotate(make(spark, [[1, 2], [3, 4]]), 90)) == back(geometry.flip(make(spark, [[1, 2], [3, 4]]), "rotate90"))
    assert back(geometry.shear(make(spark, [[5, 5], [5, 5]]), 45, smooth=False)) in ([[5, 5, 0, 0], [0, 5, 5, 0]], [[0, 5, 5, 0], [5, 5, 0, 0]])


def test_assembly(spark):
    a, b = make(spark, [[1, 2]]), make(spark, [[3], [4]])
    assert back(assemble.concat([a, b])) == [[1, 2, 3], [0, 0, 4]]
    assert back(assemble.concat([a, b], down=True, justify="max")) == [[1, 2], [0, 3], [0, 4]]
    places, height, width = assemble.montage([(2, 3), (1, 1), (2, 2)])
    cells = [(r + i, c + j) for (r, c), (h, w) in zip(places, [(2, 3), (1, 1), (2, 2)], strict=True) for i in range(h) for j in range(w)]
    assert len(set(cells)) == len(cells) == 11 and max(r for r, _ in cells) < height and max(c for _, c in cells) < width


def test_colors():
    assert color.parse("#f00") == (255, 0, 0) and color.parse("rgb:ff/80/0") == (255, 128, 0) and color.parse("white", 15) == (15, 15, 15) and color.parse("rgbi:1/0/0.5") == (255, 0, 128)


def test_hsv_round_trip(spark):
    px = [(r, g, b) for r in range(0, 256, 51) for g in range(0, 256, 51) for b in range(0, 256, 51)]
    r = make(spark, [px])
    assert back(point.brighten(r)) == [px]


def test_scene(spark):
    s = scene.parse("5, 5\n0, 0, 0\n0, 0, 1\n0, 1, 0\n0.5, 0.5, 0.5\n31, 30, 0, 0, 100, 1 0 0\n31, 5, 0, 0, 50, 0, 1, 0\n7, 1\n")
    assert s.height == 5 and [k for k, *_ in s.spheres] == [0, 1] and scene.numbers("a, 2 3,") == [0.0, 2.0, 3.0]
    near = {(x["row"], x["col"]): x["k"] for x in scene.render(spark, s).collect()}
    first = {(x["row"], x["col"]): x["k"] for x in scene.render(spark, s, "first").collect()}
    assert near[2, 2] == 1 and first[2, 2] == 0
    empty = scene.parse("2, 2\n0 0 0\n0 0 1\n0 1 0\n0.1 0.2 0.3\n")
    assert {tuple(x["c"]) for x in scene.render(spark, empty).collect()} == {(0.1, 0.2, 0.3)}


#: CRC and length of small bitmaps as raw files.
GOLDEN = [("white", 2, 16, (3892756435, 12)), ("black", 1, 1, (1576602925, 8)), ("gray", 7, 7, (4272952448, 14)), ("gray", 8, 8, (1634688086, 15))]


@pytest.mark.parametrize("kind, height, width, want", GOLDEN)
def test_written_bitmaps_have_known_checksums(spark, kind, height, width, want):
    raw = anymap.encoded(generate.bitmap(spark, height, width, kind), "P4").collect()[0]["content"]
    assert anymap.checksum(bytes(raw)) == want


def test_inverted_and_cut_bitmaps_have_known_checksums(spark):
    one = lambda r: anymap.checksum(bytes(anymap.encoded(r, "P4").collect()[0]["content"]))
    assert one(point.invert(generate.bitmap(spark, 7, 7, "white"))) == (2595564405, 14)
    assert one(point.invert(generate.bitmap(spark, 8, 8, "gray"))) == (2896726098, 15)
    assert one(select.cut(generate.bitmap(spark, 50, 50, "gray"), left=5, top=5, width=30, height=30)) == (3412257956, 129)


@pytest.mark.parametrize("format, depth, maxval", [("P1", 1, 1), ("P2", 1, 255), ("P3", 3, 1000), ("P4", 1, 1), ("P5", 1, 65535), ("P6", 3, 255), ("P7", 4, 255), ("P7", 2, 999)])
def test_files_round_trip(format, depth, maxval):
    m = np.random.default_rng(1).integers(0, maxval + 1, (5, 11, depth))
    raw = anymap.encode(m, maxval, format)
    (h, got), (h2, again) = anymap.decode_all(raw + b"\n" + raw if format in ("P1", "P2", "P3", "P7") else raw + raw)
    assert (got == m).all() and (again == m).all() and (h.height, h.width, h.depth, h.maxval) == (5, 11, depth, maxval)
    if format not in ("P1", "P2", "P3"):
        with pytest.raises(ValueError):
            anymap.decode(raw[:-1])


def test_comments_and_folders(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P2 # one\n# two\n2 2\n# three\n255\n1 2\n3 4\n")
    (tmp_path / "b.pgm").write_bytes(b"P5\n2 2\n255\n\x05\x06\x07\x08")
    r = anymap.read_raster(spark, str(tmp_path))
    assert sorted(tuple(x["s"]) for x in r.px.collect()) == [(k,) for k in range(1, 9)]
    anymap.write(r, str(tmp_path / "out"), "P5")
    assert len(list((tmp_path / "out").glob("*.pgm"))) == 2
    again = anymap.read_raster(spark, str(tmp_path / "out"))
    assert again.px.count() == 8


def test_stream_of_files(spark, tmp_path):
    from gridloom.streaming import frames

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.pgm").write_bytes(b"P5\n2 1\n255\n" + bytes([k, 9]))
    got = []
    q = frames.each_batch(frames.frames(spark, str(tmp_path / "in"), 2), lambda df, n: got.extend(df.select("s").collect()), str(tmp_path / "checkpoint"))
    q.awaitTermination(120)
    assert sorted(x["s"][0] for x in got) == [0, 1, 2, 9, 9, 9]
    assert frames.group_of(7) == (1, "B")


def as_matrix(spark, m, name="a"):
    return spark.createDataFrame([(name, i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "m string, i bigint, j bigint, v double")


def parts(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["part"], {})[r["i"], r["j"]] = r["v"]
    return {p: np.array([[v[i, j] for j in range(max(b for _, b in v) + 1)] for i in range(max(a for a, _ in v) + 1)]) for p, v in out.items()}


def test_matrix_identities(spark):
    rng = np.random.default_rng(0x23657876 % 2**32)
    m = rng.normal(size=(4, 4))
    a = as_matrix(spark, m)
    lu = parts(matrix.lu(a))
    assert np.allclose(lu["l"] @ lu["u"], m[lu["order"][0].astype(int)]) and np.isclose(lu["det"][0, 0], np.linalg.det(m))
    qr, svd = parts(matrix.qr(a)), parts(matrix.svd(a))
    assert np.allclose(qr["q"] @ qr["r"], m) and np.allclose(svd["u"] * svd["w"] @ svd["vt"], m)
    for how in ("gauss", "lu", "qr", "svd"):
        assert np.allclose(parts(matrix.inverse(a, how))["inverse"] @ m, np.eye(4))
    sym = m + m.T + 10 * np.eye(4)
    s = as_matrix(spark, sym)
    low = parts(matrix.cholesky(s))["l"]
    assert np.allclose(low @ low.T, sym)
    e = parts(matrix.eigen_symmetric(s))
    assert np.allclose(sym @ e["vectors"], e["vectors"] * e["values"])
    g = parts(matrix.eigen(a))
    values, vectors = g["real"] + 1j * g["imag"], g["vectors_real"] + 1j * g["vectors_imag"]
    assert np.allclose(m @ vectors, vectors * values)
    adj = parts(matrix.adjugate(a))["adjugate"]
    assert np.allclose(adj / np.linalg.det(m), np.linalg.inv(m))
    k = parts(matrix.scalars(a))
    assert k["rank"][0, 0] == 4 and np.isclose(k["norm2"][0, 0], np.linalg.norm(m, 2)) and np.isclose(k["cond"][0, 0], np.linalg.cond(m)) and k["is_singular"][0, 0] == 0
    y = rng.normal(size=(4, 2))
    for how in ("lu", "qr", "svd"):
        x = matrix.solve(a, as_matrix(spark, y), how).collect()
        got = np.zeros((4, 2))
        for r in x:
            got[r["i"], r["j"]] = r["v"]
        assert np.allclose(m @ got, y)
    assert matrix.predicates(s.drop("m")).collect()[0]["is_symmetric"]
    q = as_matrix(spark, np.linalg.qr(m)[0]).drop("m")
    for rows in (True, False):
        assert matrix.is_orthogonal(q, 4, rows).collect()[0][0] is True and matrix.is_orthogonal(a.drop("m"), 4, rows).collect()[0][0] is False
    few = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0)], "i bigint, j bigint, v double")
    assert matrix.equal(few, matrix.unit(spark, 2)).collect()[0][0] is True and matrix.is_orthogonal(few, 2).collect()[0][0] is True
    got = {(r["i"], r["j"]): r["v"] for r in matrix.solve(s, as_matrix(spark, y), "cholesky").collect()}
    assert np.allclose(sym @ np.array([[got[i, j] for j in range(2)] for i in range(4)]), y)
    p = {(r["i"], r["j"]): r["v"] for r in matrix.power(a.drop("m"), 5, 4).collect()}
    assert np.allclose([[p[i, j] for j in range(4)] for i in range(4)], np.linalg.matrix_power(m, 5))


def test_matrix_text(spark, tmp_path):
    m = matrix.matrix(spark, [[1.5, 2], [3, -4]])
    matrix.write_text(m.coalesce(1), str(tmp_path / "m"))
    raw = "".join(f.read_text() for f in sorted((tmp_path / "m").glob("part-*")))
    (tmp_path / "one.txt").write_text(raw)
    assert {(r["i"], r["j"], r["v"]) for r in matrix.read_text(spark, str(tmp_path / "one.txt")).collect()} == {(0, 0, 1.5), (0, 1, 2.0), (1, 0, 3.0), (1, 1, -4.0)}


def test_bar_code_check_digit():
    assert generate.upc_digits(0, 72890, 11)[:11] == [0, 7, 2, 8, 9, 0, 0, 0, 0, 1, 1]
    assert (3 * sum(generate.upc_digits(0, 72890, 11)[0::2]) + sum(generate.upc_digits(0, 72890, 11)[1::2])) % 10 == 0


def test_random_operators_repeat(img):
    for f in (lambda: geometry.jitter(img, 2, 5), lambda: geometry.spread(img, 2, 5)):
        assert back(f()) == back(f())


def test_stitch_finds_the_offset(spark):
    rng = random.Random(5)
    whole = [[rng.randrange(256) for _ in range(20)] for _ in range(6)]
    a, b = make(spark, [line[:12] for line in whole]), make(spark, [line[8:] for line in whole])
    best = combine.best_offsets(a, b, range(-1, 2), range(5, 11), 1).collect()[0]
    assert (best["dr"], best["dc"], best["mean"]) == (0, 8, 0.0)
    assert back(combine.stitch(a, b, 0, 8)) == whole


def test_lookup_and_nearest(spark):
    r = make(spark, [[0, 1, 2, 9]])
    assert back(combine.lookup(r, [(5, 6), (7, 8)], (1, 1))) == [[(5, 6), (7, 8), (1, 1), (1, 1)]]
    assert back(combine.remap(make(spark, [[10, 15, 20]]), [(10,), (20,)])) == [[10, 10, 20]]
    assert combine.psnr(r, r).collect()[0]["y"] is None
    assert F is not None


def test_ordered_dither_of_side_sixteen():
    from gridloom.operators.point import tessellation

    m = tessellation()
    # fixed values: the first line and the last column of the published matrix
    assert m[0] == [1, 235, 59, 219, 15, 231, 55, 215, 2, 232, 56, 216, 12, 228, 52, 212]
    assert [line[15] for line in m] == [212, 116, 244, 92, 220, 124, 252, 86, 214, 118, 246, 94, 222, 126, 254, 84]
    assert sorted(v for line in m for v in line) == list(range(256))
