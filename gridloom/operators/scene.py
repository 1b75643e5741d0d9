"""Ray casting: rays joined with the objects of a scene, the nearest or the first hit of each.

Small scenes are held as one array that every ray is tested against by an array expression,
so a hit needs neither a join nor a shuffle.  Scenes of any size go over uniform grids: an
object lies in the few cells of the grid that suits its size, a ray walks the cells it
crosses, and the two meet in an equi-join on the cell; what is tested exactly is only there.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.vector import cross, dot, normalize, sub, vec
from gridloom.raster import CELL, Raster, grid

#: What counts as zero, the distance of the picture plane, and the record codes.
TINY = 1e-7
FOCAL = 25.0
SPHERE, TRIANGLE = 31, 21
#: Objects up to which a scene is held in an expression.
MAX_INLINE = 2000

Triple = tuple[float, float, float]


@dataclass(frozen=True)
class Scene:
    """height, width, camera, look_at, up and background; spheres (radius, centre, colour) and triangles (three corners, colour), by line number."""

    height: int
    width: int
    camera: Triple
    look_at: Triple
    up: Triple
    background: Triple
    spheres: tuple[tuple[int, float, Triple, Triple], ...] = ()
    triangles: tuple[tuple[int, tuple[Triple, Triple, Triple], Triple], ...] = ()


def numbers(line: str) -> list[float]:
    """The fields of a record: apart by commas, blanks or both; what isn't a number counts 0."""
    out = []
    for field in re.split(r"[,\s]+", line.strip().strip(",")):
        try:
            out.append(float(field))
        except ValueError:
            out.append(0.0)
    return out


def parse(text: str) -> Scene:
    """A scene file: size, camera, look-at, up, background, then objects by code; other codes are passed over."""
    lines = [numbers(line) for line in text.splitlines() if line.strip()]
    three = lambda v: (v[0], v[1], v[2])
    spheres, triangles = [], []
    for k, v in enumerate(lines[5:]):
        if v[0] == SPHERE:
            spheres.append((k, v[1], three(v[2:5]), three(v[5:8])))
        elif v[0] == TRIANGLE:
            triangles.append((k, (three(v[1:4]), three(v[4:7]), three(v[7:10])), three(v[10:13])))
    return Scene(int(lines[0][0]), int(lines[0][1]), *(three(v) for v in lines[1:5]), tuple(spheres), tuple(triangles))


def read_scene(spark: SparkSession, path: str) -> Scene:
    """A scene file of any store that Spark reads; a scene is small, so it's parsed on the driver."""
    return parse(spark.read.text(path, wholetext=True).first()[0])


def rays(spark: SparkSession, height: int, width: int) -> DataFrame:
    """One ray a cell: image, row, col, d (a unit vector through the cell's middle)."""
    d = normalize(vec(F.col("col") - width / 2 + 0.5, F.col("row") - height / 2 + 0.5, F.lit(FOCAL)))
    return grid(spark, height, width).select(*CELL, d.alias("d"))


def view_matrix(scene: Scene) -> list[list[float]]:
    """Rows u, v, n with the negative dot product of the position, not normalised."""
    minus = lambda a, b: tuple(x - y for x, y in zip(a, b, strict=True))
    times = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    n = minus(scene.look_at, scene.camera)
    v = times(n, scene.up)
    u = times(v, n)
    return [[*a, -sum(x * y for x, y in zip(a, scene.camera, strict=True))] for a in (u, v, n)] + [[0.0, 0.0, 0.0, 1.0]]


def transform(points: DataFrame, m: list[list[float]], mode: str = "intended") -> DataFrame:
    """Points (p struct<x, y, z>) through a 4 x 4 matrix.  as_written leaves translation out and sets z from the second component."""
    w = 0.0 if mode == "as_written" else 1.0
    line = lambda k: m[k][0] * F.col("p.x") + m[k][1] * F.col("p.y") + m[k][2] * F.col("p.z") + m[k][3] * w
    return points.withColumn("p", vec(line(0), line(1), line(1) if mode == "as_written" else line(2)))


def transform_spheres(spheres: DataFrame, m: list[list[float]], mode: str = "intended") -> DataFrame:
    """Spheres (centre struct<x, y, z>) through a 4 x 4 matrix: their centres move, radii stay.  as_written leaves them where they are."""
    if mode == "as_written":
        return spheres
    return transform(spheres.withColumnRenamed("centre", "p"), m).withColumnRenamed("p", "centre")


def transform_polygons(polygons: DataFrame, m: list[list[float]], vertices: str = "vertices", mode: str = "intended") -> DataFrame:
    """Polygons (an array of struct<x, y, z>) through a 4 x 4 matrix, vertex by vertex, as points are."""
    w = 0.0 if mode == "as_written" else 1.0
    line = lambda p, k: m[k][0] * p["x"] + m[k][1] * p["y"] + m[k][2] * p["z"] + m[k][3] * w
    return polygons.withColumn(vertices, F.transform(vertices, lambda p: vec(line(p, 0), line(p, 1), line(p, 1 if mode == "as_written" else 2))))


def sphere_distance(o: Column, d: Column, centre: Column, radius: Column) -> Column:
    """Along the unit ray d from o: the nearer root, the only one, or null."""
    to = sub(o, centre)
    b = 2 * dot(d, to)
    disc = b * b - 4 * (dot(to, to) - radius * radius)
    return F.when(disc > TINY, (-b - F.sqrt(F.greatest(disc, F.lit(0.0)))) / 2).when(disc >= -TINY, -b / 2)


def triangle_distance(o: Column, d: Column, a: Column, b: Column, c: Column) -> Column:
    """Along d from o to the triangle a, b, c; null beside it or if parallel (by barycentric coordinates)."""
    e1, e2 = sub(b, a), sub(c, a)
    p = cross(d, e2)
    det = F.nullif(F.when(F.abs(dot(e1, p)) < TINY, F.lit(0.0)).otherwise(dot(e1, p)), F.lit(0.0))
    t = sub(o, a)
    u = dot(t, p) / det
    q = cross(t, e1)
    v = dot(d, q) / det
    return F.when((u >= 0) & (v >= 0) & (u + v <= 1), dot(e2, q) / det)


def plane_distance(o: Column, d: Column, a: Column, b: Column, c: Column) -> Column:
    """Along d from o to the plane of a, b, c, wherever in it; null if parallel."""
    n = cross(sub(b, a), sub(c, a))
    den = dot(n, d)
    return F.when(F.abs(den) > TINY, dot(n, sub(a, o)) / F.nullif(den, F.lit(0.0)))


def _hits(scene: Scene, o: Column, d: Column) -> list[Column]:
    """A struct (t, k, colour) for each object, t null where it's missed."""
    out = []
    for k, radius, centre, colour in scene.spheres:
        out.append(F.struct(sphere_distance(o, d, vec(*centre), F.lit(radius)).alias("t"), F.lit(k).alias("k"), vec(*colour).alias("c")))
    for k, corners, colour in scene.triangles:
        out.append(F.struct(triangle_distance(o, d, *(vec(*p) for p in corners)).alias("t"), F.lit(k).alias("k"), vec(*colour).alias("c")))
    return out


def render(spark: SparkSession, scene: Scene, hit: str = "nearest") -> DataFrame:
    """image, row, col, k (the object, or null) and c (its colour, or the background): nearest or first in the list's order."""
    if len(scene.spheres) + len(scene.triangles) > MAX_INLINE:
        raise ValueError(f"use trace for more than {MAX_INLINE} objects")
    bg = vec(*scene.background)
    px = rays(spark, scene.height, scene.width)
    hits = _hits(scene, vec(0, 0, 0), F.col("d"))
    if not hits:
        return px.select(*CELL, F.lit(None).cast("int").alias("k"), bg.alias("c"))
    real = F.filter(F.array(*hits), lambda h: h["t"].isNotNull())
    key = real if hit == "nearest" else F.transform(real, lambda h: F.struct(h["k"].alias("k"), h["t"].alias("t"), h["c"].alias("c")))
    best = F.array_min(key)
    return px.select(*CELL, best.alias("h")).select(*CELL, F.col("h.k").alias("k"), F.coalesce("h.c", bg).alias("c"))


#: Cells of the finest grid along an axis at most; how much coarser each next grid is; cells along an axis that an object may touch.
FINEST, COARSER, TOUCHED = 64, 4, 2
#: Rays, and objects, of one cell that meet in one place.
RAYS, OBJECTS = 1 << 15, 1 << 11

AXES = "xyz"


@dataclass(frozen=True)
class Grids:
    """Grids over one box, from the finest to a single cell: cells along an axis of each."""

    low: tuple[float, float, float]
    high: tuple[float, float, float]
    sides: tuple[int, ...]

    def first(self, level: int) -> int:
        """The number of a grid's first cell; cells of all grids are numbered one after the other."""
        return sum(n**3 for n in self.sides[:level])

    def place(self, level: int, *at: Column) -> Column:
        n = self.sides[level]
        return (self.first(level) + (at[0] * n + at[1]) * n + at[2]).cast("bigint")

    def index(self, level: int, axis: int, x: Column) -> Column:
        n, low, high = self.sides[level], self.low[axis], self.high[axis]
        return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((x - low) * (n / (high - low))).cast("int")))


def boxed(spheres: DataFrame | None, triangles: DataFrame | None) -> DataFrame:
    """Spheres (k, centre, radius) and triangles (k, a, b, c) as one table with the corners low and high of their boxes, a little wider than they are."""
    parts, margin = [], lambda v: 1e-6 * (1 + F.abs(v))
    wide = lambda lo, hi: (vec(*(x - margin(x) for x in lo)).alias("low"), vec(*(x + margin(x) for x in hi)).alias("high"))
    if spheres is not None:
        ends = [[F.col(f"centre.{n}") + sign * F.abs("radius") for n in AXES] for sign in (-1, 1)]
        parts.append(spheres.select("k", "centre", "radius", *wide(*ends)))
    if triangles is not None:
        ends = [[pick(*(F.col(f"{p}.{n}") for p in "abc")) for n in AXES] for pick in (F.least, F.greatest)]
        parts.append(triangles.select("k", "a", "b", "c", *wide(*ends)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def unlike(objects: DataFrame) -> DataFrame:
    """Objects of one place and shape as that with the least k."""
    shape = [c for c in objects.columns if c != "k"]
    return objects.groupBy(*shape).agg(F.min(F.struct("k")).alias("k")).select("k.k", *shape)


def grids_of(objects: DataFrame) -> Grids | None:
    """Grids for the boxes of objects, with about as many cells of the finest as there are objects; None without any."""
    corners = [F.min(f"low.{n}").alias(f"l{n}") for n in AXES] + [F.max(f"high.{n}").alias(f"h{n}") for n in AXES]
    got = objects.agg(F.count("*").alias("n"), *corners).collect()[0]
    if not got["n"]:
        return None
    side, sides = max(1, min(FINEST, round(got["n"] ** (1 / 3)))), []
    while side > 1:
        sides.append(side)
        side = -(-side // COARSER)
    return Grids(tuple(got[f"l{n}"] for n in AXES), tuple(got[f"h{n}"] for n in AXES), (*sides, 1))


def object_cells(objects: DataFrame, grids: Grids) -> DataFrame:
    """objects with a row for each cell that their box touches, in the finest grid in which these are at most TOUCHED along every axis."""
    spans = []
    for level in range(len(grids.sides)):
        ends = [(grids.index(level, k, F.col(f"low.{n}")), grids.index(level, k, F.col(f"high.{n}"))) for k, n in enumerate(AXES)]
        fits = F.lit(True)
        for lo, hi in ends:
            fits = fits & (hi - lo < TOUCHED)
        spans.append((level, fits, ends))
    which = F.coalesce(*(F.when(fits, F.lit(level)) for level, fits, _ in spans), F.lit(len(spans) - 1))

    def every(level: int, x: Column, y: Column, z: Column) -> Column:
        return F.flatten(F.transform(x, lambda i: F.flatten(F.transform(y, lambda j: F.transform(z, lambda m: grids.place(level, i, j, m))))))

    cells = F.lit(None)
    for level, _, ends in reversed(spans):
        cells = F.when(F.col("level") == level, every(level, *(F.sequence(lo, hi) for lo, hi in ends))).otherwise(cells)
    return objects.withColumn("level", which).withColumn("cell", F.explode(cells)).drop("level", "low", "high")


def walked_cells(rays: DataFrame, grids: Grids) -> DataFrame:
    """rays (o, d and more) with a row for each cell, of every grid, that the line o + t d crosses, before and behind o.

    Between one wall and the next a line is in the cell of the middle.  Each step is a column
    of its own, so that it's worked out once a ray.
    """

    def at(axis: str, x: Column) -> Column:
        """Where the line has this coordinate; null if it has it everywhere or nowhere."""
        return (x - F.col(f"o.{axis}")) / F.nullif(F.col(f"d.{axis}"), F.lit(0.0))

    def between(axis: str, n: int, low: float, high: float) -> Column:
        walls = F.array(*(F.lit(low + i * ((high - low) / n)) for i in range(1, n)))
        return F.transform(walls, lambda x: at(axis, x))

    axes = list(zip(AXES, grids.low, grids.high, strict=True))
    ends = [(at(n, F.lit(low)), at(n, F.lit(high))) for n, low, high in axes]
    inside = F.lit(True)
    for name, low, high in axes:
        inside = inside & ((F.col(f"d.{name}") != 0) | F.col(f"o.{name}").between(low, high))
    out = rays.withColumns({"first": F.greatest(*(F.least(*e) for e in ends)), "last": F.least(*(F.greatest(*e) for e in ends)), "inside": inside})
    out = out.where("inside and first <= last").drop("inside")
    sides = list(enumerate(grids.sides))
    walls = {f"walls{k}": F.concat(*(between(name, n, low, high) for name, low, high in axes)) for k, n in sides if n > 1}
    out = out.withColumns(walls) if walls else out
    crossed = lambda k: F.filter(f"walls{k}", lambda t: (t > F.col("first")) & (t < F.col("last")))
    out = out.withColumns({f"stops{k}": F.array_sort(F.concat(F.array("first", "last"), *([crossed(k)] if n > 1 else []))) for k, n in sides})

    def cells(k: int) -> Column:
        def cell(t: Column) -> Column:
            return grids.place(k, *(grids.index(k, i, F.col(f"o.{name}") + t * F.col(f"d.{name}")) for i, name in enumerate(AXES)))

        stops = F.col(f"stops{k}")
        middles = F.transform(F.slice(stops, 1, F.size(stops) - 1), lambda t, i: (t + stops[i + 1]) / 2)
        return F.array_distinct(F.transform(middles, cell))

    out = out.withColumn("cell", F.explode(F.concat(*(cells(k) for k, _ in sides))))
    return out.drop("first", "last", *walls, *(f"stops{k}" for k, _ in sides))


#: Pairs of a ray and an object that are tested at a time.
AT_ONCE = 1 << 18


def _meeting(line: list[str], hit: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best hit of each ray of a place among its objects, as sphere_distance and triangle_distance find it."""

    def dot(a, b):
        return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]

    def cross(a, b):
        return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]

    def minus(a, b):
        return tuple(x - y for x, y in zip(a, b, strict=True))

    def meet(rays: pa.Table, objects: pa.Table) -> pa.Table:
        objects = objects.take(pc.sort_indices(objects, [("k", "ascending")], null_placement="at_start"))
        number = lambda name: objects[name].to_numpy().astype(float)[None, :]
        corner = lambda name: tuple(number(f"{name}_{n}") for n in AXES)
        every = np.stack([rays[n].to_numpy() for n in line])
        step, found, which, far = max(1, AT_ONCE // max(1, len(objects))), [], [], []
        for first in range(0, every.shape[1], step):
            part = every[:, first : first + step, None]
            o, d = part[:3], part[3:]
            t = np.full((part.shape[1], len(objects)), np.nan)
            with np.errstate(all="ignore"):
                if "a_x" in objects.column_names:
                    a = corner("a")
                    e1, e2 = minus(corner("b"), a), minus(corner("c"), a)
                    p = cross(d, e2)
                    det = dot(e1, p)
                    to = minus(o, a)
                    u, q = dot(to, p) / det, cross(to, e1)
                    v = dot(d, q) / det
                    t = np.where((np.abs(det) >= TINY) & (u >= 0) & (v >= 0) & (u + v <= 1), dot(e2, q) / det, np.nan)
                if "radius" in objects.column_names:
                    to, radius = minus(o, corner("centre")), number("radius")
                    b = 2 * dot(d, to)
                    disc = b * b - 4 * (dot(to, to) - radius * radius)
                    near = np.where(disc > TINY, (-b - np.sqrt(np.maximum(disc, 0.0))) / 2, np.where(disc >= -TINY, -b / 2, np.nan))
                    t = np.where(np.isnan(near), t, near)
            met = ~np.isnan(t)
            best = met.argmax(axis=1) if hit == "first" else np.where(met, t, np.inf).argmin(axis=1)  # of equal ones the first, that of the least k
            some = np.flatnonzero(met.any(axis=1))
            found.append(some + first)
            which.append(best[some])
            far.append(t[some, best[some]])
        found, which, far = (np.concatenate(x) for x in (found, which, far))
        return pa.table({**{n: pa.array(every[k, found]) for k, n in enumerate(line)}, "k": objects["k"].take(pa.array(which)), "t": pa.array(far)})

    return lambda rays, objects: meet(rays, objects) if len(rays) and len(objects) else pa.table({**{n: pa.array([], pa.float64()) for n in line}, "k": objects["k"].slice(0, 0), "t": pa.array([], pa.float64())})


def trace(ray_table: DataFrame, spheres: DataFrame | None, hit: str = "nearest", key: tuple[str, ...] = ("row", "col"), triangles: DataFrame | None = None) -> DataFrame:
    """Rays (key, d and, unless all start at the origin, o) against spheres (k, centre, radius) and triangles (k, a, b, c) of any number.

    Gives the key, k and t of the nearest hit, or of the first in the order of k; null without one.
    Hits behind o count, with a negative t, as the originals have it; of equally near hits the least k.

    Of objects that are alike only the one of the least k can be hit, and rays that are alike
    have the same hit: both are taken once.  Rays meet objects cell by cell.  A cell that very many rays cross, or in which very many
    objects lie, is dealt out: rays by their line, objects by their key, and every share of the
    one meets every share of the other apart.  The best of a ray is an aggregate that is
    partly made before the shuffle.  What is broadcast is a row for each cell with objects,
    of at most FINEST ** 3 cells and those of the coarser grids.
    """
    objects = unlike(boxed(spheres, triangles))
    grids = grids_of(objects)
    none = ray_table.select(*key, F.lit(None).cast(objects.schema["k"].dataType).alias("k"), F.lit(None).cast("double").alias("t"))
    if grids is None:
        return none
    o = F.col("o") if "o" in ray_table.columns else vec(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    given = ray_table.select(*key, *(p[n].alias(f"{name}_{n}") for name, p in (("o", o), ("d", F.col("d"))) for n in AXES))
    line = [f"{name}_{n}" for name in "od" for n in AXES]
    own = given.select(*line).where("not (d_x = 0 and d_y = 0 and d_z = 0)").distinct()
    own = own.select(*line, *(vec(*(F.col(f"{name}_{n}") for n in AXES)).alias(name) for name in "od"))
    walked = walked_cells(own, grids)
    lying = object_cells(objects, grids)
    filled = lying.groupBy("cell").agg(F.count("*").alias("n"))
    crossed = walked.join(F.broadcast(filled), "cell").groupBy("cell", "n").agg(F.count("*").alias("m"))
    shares = crossed.select("cell", F.ceil(F.col("m") / RAYS).cast("int").alias("by_ray"), F.ceil(F.col("n") / OBJECTS).cast("int").alias("by_object"))
    shares = F.broadcast(shares)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = walked.join(shares, "cell").withColumn("i", F.pmod(F.xxhash64(*line), "by_ray").cast("int")).withColumn("j", upto("by_object")).drop("by_ray", "by_object")
    two = lying.join(shares, "cell").withColumn("j", F.pmod(F.xxhash64("k"), "by_object").cast("int")).withColumn("i", upto("by_ray")).drop("by_ray", "by_object")
    place, parts = ["cell", "i", "j"], {"centre": AXES, "a": AXES, "b": AXES, "c": AXES, "radius": ""}
    shape = [F.col(f"{name}.{n}").alias(f"{name}_{n}") if axes else F.col(name) for name, axes in parts.items() if name in two.columns for n in axes or "-"]
    two = two.select(*place, "k", *shape)
    out = one.select(*line).schema.add("k", two.schema["k"].dataType).add("t", "double")
    hits = one.select(*place, *line).groupBy(*place).cogroup(two.groupBy(*place)).applyInArrow(_meeting(line, hit), out)
    order = F.struct("t", "k") if hit == "nearest" else F.struct("k", "t")
    best = hits.groupBy(*line).agg(F.min(order).alias("h"))
    return given.join(best, line, "left").select(*key, F.col("h.k").alias("k"), F.col("h.t").alias("t"))


def picture(rendered: DataFrame, scene: Scene, scale: float = 255.0) -> Raster:
    """A rendered table as a raster: colours of 0..1 times scale (1 leaves them as they are, cut to integers)."""
    s = F.array(*(F.floor(F.col(f"c.{n}") * scale).cast("bigint") for n in "xyz"))
    return Raster(rendered.select(*CELL, s.alias("s")), scene.height, scene.width, 255, 3)
