"""Queries of ray casting, generators and the remaining operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import vector as vec
from gridloom.operators import draw, generate, regions, scene, sequential
from gridloom.plans.catalog import bits, few, gray, query, rgb, table
from gridloom.raster import Raster

SIDE = 50


def spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers as spheres: k, centre, radius."""
    k = F.col("s_suppkey")
    centre = vec.vec(((k % 7 - 3) * 6).cast("double"), ((k % 5 - 2) * 6).cast("double"), (30 + k % 11).cast("double"))
    return table(spark, sf_dir, "supplier").select(k.cast("bigint").alias("k"), centre.alias("centre"), (2 + k % 3).cast("double").alias("radius"))


RAYS = f"""WITH r AS (SELECT x.row, y.col, y.col - 24.5::DOUBLE AS x, x.row - 24.5::DOUBLE AS y, 25.0::DOUBLE AS z FROM (SELECT unnest(range({SIDE})) AS row) x, (SELECT unnest(range({SIDE})) AS col) y),
d AS (SELECT row, col, x / sqrt(x*x + y*y + z*z) AS x, y / sqrt(x*x + y*y + z*z) AS y, z / sqrt(x*x + y*y + z*z) AS z FROM r),
s AS (SELECT s_suppkey::BIGINT AS k, ((s_suppkey % 7 - 3) * 6)::DOUBLE AS cx, ((s_suppkey % 5 - 2) * 6)::DOUBLE AS cy, (30 + s_suppkey % 11)::DOUBLE AS cz, (2 + s_suppkey % 3)::DOUBLE AS radius FROM supplier),
b AS (SELECT row, col, k, -2 * (x * cx + y * cy + z * cz) AS b, cx*cx + cy*cy + cz*cz - radius*radius AS c FROM d, s),
h AS (SELECT row, col, k, (-b - sqrt(b * b - 4 * c)) / 2 AS t FROM b WHERE b * b - 4 * c > 1e-7),
n AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY {{order}}) AS place FROM h)
SELECT d.row, d.col, n.k, round(n.t, 6) AS t FROM d LEFT JOIN n ON n.row = d.row AND n.col = d.col AND n.place = 1"""


def _traced(spark, sf_dir, hit):
    rays = scene.rays(spark, SIDE, SIDE).select("row", "col", "d")
    return scene.trace(rays, spheres(spark, sf_dir), hit).select("row", "col", "k", F.round("t", 6).alias("t"))


@query(RAYS.format(order="t, k"))
def raytrace_nearest(spark, sf_dir):
    return _traced(spark, sf_dir, "nearest")


@query(RAYS.format(order="k"))
def raytrace_first_hit(spark, sf_dir):
    return _traced(spark, sf_dir, "first")


#: A ray for each order, from a place of its customer, against spheres, or a triangle for each nation.
ORDER_RAYS = """WITH o AS (SELECT o_orderkey::BIGINT AS ray, (o_custkey % 9 - 4)::DOUBLE AS ox, (o_custkey % 4 - 2)::DOUBLE AS oy, 0.0::DOUBLE AS oz,
  (o_orderkey % 101 - 50)::DOUBLE AS x, (o_orderkey // 101 % 91 - 45)::DOUBLE AS y, 60.0::DOUBLE AS z FROM orders),
d AS (SELECT ray, ox, oy, oz, x / sqrt(x*x + y*y + z*z) AS x, y / sqrt(x*x + y*y + z*z) AS y, z / sqrt(x*x + y*y + z*z) AS z FROM o),
{objects}
n AS (SELECT *, row_number() OVER (PARTITION BY ray ORDER BY {order}) AS place FROM h)
SELECT d.ray, n.k, round(n.t, 6) AS t FROM d LEFT JOIN n ON n.ray = d.ray AND n.place = 1"""
AS_SPHERES = """s AS (SELECT s_suppkey::BIGINT AS k, ((s_suppkey % 7 - 3) * 6)::DOUBLE AS cx, ((s_suppkey % 5 - 2) * 6)::DOUBLE AS cy, (30 + s_suppkey % 11)::DOUBLE AS cz, (2 + s_suppkey % 3)::DOUBLE AS radius FROM supplier),
b AS (SELECT ray, k, 2 * (x * (ox - cx) + y * (oy - cy) + z * (oz - cz)) AS b, (ox - cx) * (ox - cx) + (oy - cy) * (oy - cy) + (oz - cz) * (oz - cz) - radius * radius AS c FROM d, s),
h AS (SELECT ray, k, CASE WHEN b * b - 4 * c > 1e-7 THEN (-b - sqrt(b * b - 4 * c)) / 2 ELSE -b / 2 END AS t FROM b WHERE b * b - 4 * c >= -1e-7),"""
AS_TRIANGLES = """g AS (SELECT n_nationkey::BIGINT AS k, (n_nationkey % 5 * 8 - 16)::DOUBLE - 0.317::DOUBLE AS ax, (n_nationkey // 5 * 8 - 16)::DOUBLE + 0.213::DOUBLE AS ay, (40 + n_nationkey % 3)::DOUBLE AS az FROM nation),
f AS (SELECT *, 7.0::DOUBLE AS ex, 1.0::DOUBLE AS ey, 2.0::DOUBLE AS ez, 1.0::DOUBLE AS fx, 7.0::DOUBLE AS fy, -1.0::DOUBLE AS fz FROM g),
p AS (SELECT ray, k, x, y, z, ox - ax AS tx, oy - ay AS ty, oz - az AS tz, ex, ey, ez, fx, fy, fz, y * fz - z * fy AS px, z * fx - x * fz AS py, x * fy - y * fx AS pz FROM d, f),
q AS (SELECT *, ex * px + ey * py + ez * pz AS det, ty * ez - tz * ey AS qx, tz * ex - tx * ez AS qy, tx * ey - ty * ex AS qz FROM p),
u AS (SELECT ray, k, (tx * px + ty * py + tz * pz) / det AS u, (x * qx + y * qy + z * qz) / det AS v, (fx * qx + fy * qy + fz * qz) / det AS t FROM q WHERE abs(det) >= 1e-7),
h AS (SELECT ray, k, t FROM u WHERE u >= 0 AND v >= 0 AND u + v <= 1),"""


def order_rays(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    start = vec.vec((c % 9 - 4).cast("double"), (c % 4 - 2).cast("double"), F.lit(0.0))
    d = vec.normalize(vec.vec((o % 101 - 50).cast("double"), (F.floor(o / 101) % 91 - 45).cast("double"), F.lit(60.0)))
    return table(spark, sf_dir, "orders").select(o.cast("bigint").alias("ray"), start.alias("o"), d.alias("d"))


def _order_rays(spark, sf_dir, hit):
    return scene.trace(order_rays(spark, sf_dir), spheres(spark, sf_dir), hit, ("ray",)).select("ray", "k", F.round("t", 6).alias("t"))


@query(ORDER_RAYS.format(objects=AS_SPHERES, order="t, k"))
def raytrace_orders_nearest(spark, sf_dir):
    return _order_rays(spark, sf_dir, "nearest")


@query(ORDER_RAYS.format(objects=AS_SPHERES, order="k"))
def raytrace_orders_first_hit(spark, sf_dir):
    return _order_rays(spark, sf_dir, "first")


@query(ORDER_RAYS.format(objects=AS_TRIANGLES, order="t, k"))
def raytrace_orders_triangles(spark, sf_dir):
    n = F.col("n_nationkey")
    a = [(n % 5 * 8 - 16).cast("double") - 0.317, (F.floor(n / 5) * 8 - 16).cast("double") + 0.213, (40 + n % 3).cast("double")]
    corner = lambda *e: vec.vec(*(x + y for x, y in zip(a, e, strict=True)))
    triangles = table(spark, sf_dir, "nation").select(n.cast("bigint").alias("k"), corner(0.0, 0.0, 0.0).alias("a"), corner(7.0, 1.0, 2.0).alias("b"), corner(1.0, 7.0, -1.0).alias("c"))
    return scene.trace(order_rays(spark, sf_dir), None, "nearest", ("ray",), triangles).select("ray", "k", F.round("t", 6).alias("t"))


TEXT = """40, 50
0, 0, 0
0, 0, 1
0, 1, 0
0.1, 0.2, 0.3
31, 8, 0, 0, 40 1, 0, 0
31, 5, 6, 4, 30, 0 1 0
21, -20, -20, 60, 20, -20, 60, 0, 20, 60, 0, 0, 1
99, 1, 2
"""


@query()
def render_scene(spark, sf_dir):
    """As many lines as the image of the orders has, with their gray in the light of the scene."""
    r = gray(spark, sf_dir)
    s = scene.parse(TEXT.replace("40, 50", f"{r.height}, {r.width}"))
    return _shaded(r, scene.picture(scene.render(spark, s), s))


@query("SELECT s_suppkey::BIGINT AS k, x.x * 2.0::DOUBLE - 3 AS x, x.x + 1.0::DOUBLE AS y, 4.0::DOUBLE AS z FROM supplier, LATERAL (SELECT (s_suppkey % 9)::DOUBLE AS x) x")
def transform_points(spark, sf_dir):
    k = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select(k.cast("bigint").alias("k"), vec.vec((k % 9).cast("double"), F.lit(1.0), F.lit(4.0)).alias("p"))
    return scene.transform(points, [[2, 0, 0, -3], [1, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]).select("k", "p.x", "p.y", "p.z")


MOVE = [[2, 0, 0, -3], [1, 1, 0, 0], [0, 0, 1, 5], [0, 0, 0, 1]]


@query("SELECT s_suppkey::BIGINT AS k, 2.0::DOUBLE * ((s_suppkey % 7 - 3) * 6) - 3 AS x, ((s_suppkey % 7 - 3) * 6 + (s_suppkey % 5 - 2) * 6)::DOUBLE AS y, (35 + s_suppkey % 11)::DOUBLE AS z, (2 + s_suppkey % 3)::DOUBLE AS radius FROM supplier")
def transform_spheres(spark, sf_dir):
    return scene.transform_spheres(spheres(spark, sf_dir), MOVE).select("k", "centre.x", "centre.y", "centre.z", "radius")


@query("""SELECT s_suppkey::BIGINT AS k, n, 2 * x - 3 AS x, x + y AS y, z + 5 AS z FROM supplier, LATERAL (SELECT unnest([0, 1, 2])::BIGINT AS n) t,
LATERAL (SELECT (s_suppkey % 7 + n)::DOUBLE AS x, (s_suppkey % 5 - n)::DOUBLE AS y, (n * n)::DOUBLE AS z) p""")
def transform_polygons(spark, sf_dir):
    k = F.col("s_suppkey")
    corner = lambda n: vec.vec((k % 7 + n).cast("double"), (k % 5 - n).cast("double"), F.lit(float(n * n)))
    polygons = table(spark, sf_dir, "supplier").select(k.cast("bigint").alias("k"), F.array(*(corner(n) for n in range(3))).alias("vertices"))
    return scene.transform_polygons(polygons, MOVE).select("k", F.posexplode("vertices").alias("n", "p")).select("k", F.col("n").cast("bigint").alias("n"), "p.x", "p.y", "p.z")


@query("""WITH v AS (SELECT s_suppkey::BIGINT AS k, (s_suppkey % 7)::DOUBLE AS a, (s_suppkey % 5)::DOUBLE AS b, 2.0::DOUBLE AS c, 1.0::DOUBLE AS d, (s_suppkey % 3)::DOUBLE AS e, 3.0::DOUBLE AS f FROM supplier)
SELECT k, a*d + b*e + c*f AS dot, b*f - c*e AS cx, c*d - a*f AS cy, a*e - b*d AS cz, round(sqrt(a*a + b*b + c*c), 9) AS length, round(degrees(acos((a*d + b*e + c*f) / (sqrt(a*a + b*b + c*c) * sqrt(d*d + e*e + f*f)))), 6) AS angle,
round(sqrt((a-d)*(a-d) + (b-e)*(b-e) + (c-f)*(c-f)), 9) AS distance FROM v""")
def vector_functions(spark, sf_dir):
    k = F.col("s_suppkey")
    d = table(spark, sf_dir, "supplier").select(k.cast("bigint").alias("k"), vec.vec((k % 7).cast("double"), (k % 5).cast("double"), F.lit(2.0)).alias("a"), vec.vec(F.lit(1.0), (k % 3).cast("double"), F.lit(3.0)).alias("b"))
    a, b = F.col("a"), F.col("b")
    c = vec.cross(a, b)
    return d.select("k", vec.dot(a, b).alias("dot"), c["x"].alias("cx"), c["y"].alias("cy"), c["z"].alias("cz"), F.round(vec.length(a), 9).alias("length"), F.round(vec.angle(a, b), 6).alias("angle"), F.round(vec.distance(a, b), 9).alias("distance"))


def grid_sql(height: int, width: int, *planes: str) -> str:
    return f"SELECT row, col, {', '.join(f'({p})::BIGINT AS p{k}' for k, p in enumerate(planes))} FROM (SELECT unnest(range({height})) AS row), (SELECT unnest(range({width})) AS col)"


GENERATED = {
    "make_constant": (lambda s: generate.constant(s, 20, 30, (1, 2, 3)), grid_sql(20, 30, "1", "2", "3")),
    "make_white": (lambda s: generate.bitmap(s, 2, 16, "white"), grid_sql(2, 16, "1")),
    "make_chequer": (lambda s: generate.bitmap(s, 7, 7, "gray"), grid_sql(7, 7, "(row + col + 1) % 2")),
    "ramp_across": (lambda s: generate.ramp(s, 10, 64, "lr"), grid_sql(10, 64, "(col * 255) // 63")),
    "ramp_down": (lambda s: generate.ramp(s, 64, 10, "tb"), grid_sql(64, 10, "(row * 255) // 63")),
    "ramp_rectangle": (lambda s: generate.ramp(s, 40, 40, "rectangle"), grid_sql(40, 40, "floor(255 - ((abs(20 - row) / 20.0::DOUBLE)::REAL + (abs(20 - col) / 20.0::DOUBLE)::REAL)::DOUBLE / 2 * 255)")),
    "ramp_ellipse": (lambda s: generate.ramp(s, 40, 60, "ellipse"), grid_sql(40, 60, "floor((255::REAL - least(1::REAL, (abs(20 - row) / 20.0::DOUBLE)::REAL * (abs(20 - row) / 20.0::DOUBLE)::REAL + (abs(30 - col) / 30.0::DOUBLE)::REAL * (abs(30 - col) / 30.0::DOUBLE)::REAL) * 255::REAL)::DOUBLE)")),
    "all_tuples": (lambda s: generate.all_tuples(s, 3, 4), grid_sql(1, 125, "col // 25", "(col // 5) % 5", "col % 5")),
    "gaussian": (lambda s: generate.gaussian(s, 21, 21, 4.0), "WITH z AS (SELECT row, col, exp(-((row - 10) * (row - 10) + (col - 10) * (col - 10)) / 32.0) AS z FROM (SELECT unnest(range(21)) AS row), (SELECT unnest(range(21)) AS col)) SELECT row, col, floor(z * 255 / (SELECT sum(z) FROM z) + 0.5)::BIGINT AS p0 FROM z"),
    "distance_kernel": (lambda s: generate.distance_kernel(s, 5, 5), "WITH z AS (SELECT row, col, 1 / (1 + 6 * sqrt((row - 2.0::DOUBLE) * (row - 2.0::DOUBLE) + (col - 2.0::DOUBLE) * (col - 2.0::DOUBLE))) AS z FROM (SELECT unnest(range(5)) AS row), (SELECT unnest(range(5)) AS col)) SELECT row, col, floor(255 * (z / (2 * (SELECT max(z) FROM z)) + 0.5))::BIGINT AS p0 FROM z"),
    "distance_kernel_even": (lambda s: generate.distance_kernel(s, 4, 6), "WITH z AS (SELECT row, col, 1 / (1 + 6 * sqrt((row - 1.5::DOUBLE) * (row - 1.5::DOUBLE) + (col - 2.5::DOUBLE) * (col - 2.5::DOUBLE))) AS z FROM (SELECT unnest(range(4)) AS row), (SELECT unnest(range(6)) AS col)) SELECT row, col, floor(255 * (z / (2 * (SELECT max(z) FROM z)) + 0.5))::BIGINT AS p0 FROM z"),
    "rainbow": (lambda s: generate.rainbow(s, 2, 60, [(255, 0, 0), (0, 255, 0), (0, 0, 255)]), grid_sql(2, 60, *(f"floor([{a}][(col * 3 // 60 + 1)::INT] * (1 - (col * 3 / 60.0::DOUBLE - col * 3 // 60)) + [{b}][(col * 3 // 60 + 1)::INT] * (col * 3 / 60.0::DOUBLE - col * 3 // 60) + 0.5)" for a, b in (("255, 0, 0", "0, 0, 255"), ("0, 255, 0", "255, 0, 0"), ("0, 0, 255", "0, 255, 0"))))),
    "wheel": (lambda s: generate.wheel(s, 41), None),
    "noise": (lambda s: generate.noise(s, 30, 30, 7), None),
    "bar_code": (lambda s: generate.upc(s, 0, 72890, 11, 4), None),
    "clouds": (lambda s: generate.clouds(s, 30, 40, 7), None),
    "terrain": (lambda s: generate.terrain(s, 30, 40, 7), None),
    "craters": (lambda s: generate.craters(s, 60, 60, 7), None),
    "rough_edge": (lambda s: generate.rough_edge(s, 30, 40, 7), None),
    "pattern_gingham": (lambda s: generate.pattern(s, 30, 40, "gingham", 7), None),
    "pattern_madras": (lambda s: generate.pattern(s, 30, 40, "madras", 7), None),
    "pattern_poles": (lambda s: generate.pattern(s, 30, 40, "poles", 7), None),
    "pattern_camo": (lambda s: generate.pattern(s, 30, 40, "camo", 7), None),
    "chromaticity": (lambda s: generate.chromaticity(s, 64), None),
}


def _shaded(image: Raster, shade: Raster) -> DataFrame:
    """The image's cells with each plane of another one, laid out over it again and again, as their shade."""
    at = [F.pmod(F.col(c), F.lit(n)).alias(f"at_{c}") for c, n in (("row", shade.height), ("col", shade.width))]
    other = shade.px.select(F.col("row").alias("at_row"), F.col("col").alias("at_col"), F.col("s").alias("t"))
    both = image.px.select("row", "col", F.col("s")[0].alias("v"), *at).join(other, ["at_row", "at_col"])
    return both.select("row", "col", *(F.floor(F.col("v") * F.col("t")[k] / F.lit(shade.maxval)).cast("bigint").alias(f"p{k}") for k in range(shade.depth)))


#: Height, width, planes and scale of the images that are made.
SIZES = {
    "make_constant": (20, 30, 3, 255), "make_white": (2, 16, 1, 1), "make_chequer": (7, 7, 1, 1), "ramp_across": (10, 64, 1, 255), "ramp_down": (64, 10, 1, 255), "ramp_rectangle": (40, 40, 1, 255),
    "ramp_ellipse": (40, 60, 1, 255), "all_tuples": (1, 125, 3, 4), "gaussian": (21, 21, 1, 255), "distance_kernel": (5, 5, 1, 255), "distance_kernel_even": (4, 6, 1, 255), "rainbow": (2, 60, 3, 255),
}


def _made(name, f, sql):
    """The gray image in the shades of one that is made: its SQL has that image's."""
    if sql:
        height, width, planes, maxval = SIZES[name]
        shades = ", ".join(f"(v * p{k}) // {maxval} AS p{k}" for k in range(planes))
        sql = f"SELECT i.row, i.col, {shades} FROM img i JOIN ({sql}) made ON made.row = i.row % {height} AND made.col = i.col % {width}"
    query(sql, name)(lambda spark, sf_dir: _shaded(gray(spark, sf_dir), f(spark)))


for _name, (_f, _sql) in GENERATED.items():
    _made(_name, _f, _sql)


# ---- operators with state along an image: no SQL, tested against plain loops


@query()
def diffuse_bitmap(spark, sf_dir):
    return sequential.diffuse_bitmap(gray(spark, sf_dir)).flat()


@query()
def diffuse_palette(spark, sf_dir):
    return sequential.diffuse_palette(rgb(spark, sf_dir), [(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255)]).flat()


@query()
def hilbert_bitmap(spark, sf_dir):
    return sequential.hilbert_bitmap(gray(spark, sf_dir)).flat()


@query()
def abel(spark, sf_dir):
    return sequential.abel(gray(spark, sf_dir), 50).flat()




#: Cells reached from cells of the same value, four ways.
REACH = """reach AS (
  SELECT row, col, {v} AS v FROM img, size WHERE {start}
  UNION SELECT i.row, i.col, i.{v} FROM reach r JOIN img i ON i.{v} = r.v AND ((i.row = r.row AND abs(i.col - r.col) = 1) OR (i.col = r.col AND abs(i.row - r.row) = 1))
)"""


@query("WITH RECURSIVE " + REACH.format(v="bit", start="bit = 1 AND (row = 0 OR row = height - 1 OR col = 0 OR col = width - 1)") + """
SELECT img.row, img.col, (reach.v IS NOT NULL)::BIGINT AS p0 FROM img LEFT JOIN reach ON img.row = reach.row AND img.col = reach.col""")
def mask_from_edges(spark, sf_dir):
    return sequential.mask(bits(spark, sf_dir)).flat()


SEEDS = [(0, 0), (3, 50), (10, 99), (11, 7), (14, 30)]


@query("WITH RECURSIVE " + REACH.format(v="bit", start=" OR ".join(f"(row = {r} AND col = {c})" for r, c in SEEDS)) + """
SELECT img.row, img.col, CASE WHEN reach.v IS NULL THEN few ELSE 15 END AS p0 FROM img LEFT JOIN reach ON img.row = reach.row AND img.col = reach.col""")
def fill_seeds(spark, sf_dir):
    r = bits(spark, sf_dir)
    marked = regions.fill(r, SEEDS, (2,)).px.select("row", "col", (F.col("s")[0] == 2).alias("in"))
    return few(spark, sf_dir).px.join(marked, ["row", "col"]).select("row", "col", F.when(F.col("in"), 15).otherwise(F.col("s")[0]).cast("bigint").alias("p0"))


@query()
def stereogram(spark, sf_dir):
    return sequential.stereogram(few(spark, sf_dir)).flat()


@query("SELECT row, col, CASE WHEN row BETWEEN 2 AND 5 AND col BETWEEN 10 AND 19 THEN 255 ELSE v END AS p0 FROM img")
def draw_rectangle(spark, sf_dir):
    return draw.draw(gray(spark, sf_dir), draw.rectangle(2, 10, 4, 10), (255,)).flat()


@query("SELECT row, col, CASE WHEN row = col AND row <= 9 THEN 0 ELSE v END AS p0 FROM img")
def draw_line(spark, sf_dir):
    return draw.draw(gray(spark, sf_dir), draw.line((0, 0), (9, 9)), (0,)).flat()


@query()
def draw_label(spark, sf_dir):
    return draw.label(gray(spark, sf_dir), "rows and cols", 2, 3, (255,)).flat()
