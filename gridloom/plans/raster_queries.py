"""Queries of the operators on images."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import aggregate, assemble, combine, geometry, neighbours, point, select
from gridloom.plans.catalog import bits, few, gray, other, query, rgb, rgb2, sparse
from gridloom.raster import Raster

P3 = "v AS p0, g AS p1, b AS p2"


def each(template: str, names: str = "vgb") -> str:
    """template for each plane: {x} is the sample, {k} its number."""
    return ", ".join(template.format(x=x, k=k) + f" AS p{k}" for k, x in enumerate(names))


# ---- single cells

ONE = {
    "channels": (lambda r: point.channels(r, [2, 0]), "SELECT row, col, b AS p0, v AS p1 FROM img"),
    "multiply": (lambda r: point.multiply(r, 1.5), "SELECT row, col, " + each("least(255, floor({x} * 1.5 + 0.5))::BIGINT") + " FROM img"),
    "divide": (lambda r: point.divide(r, 4), "SELECT row, col, " + each("floor({x} * 0.25 + 0.5)::BIGINT") + " FROM img"),
    "plus": (lambda r: point.plus(r, 40), "SELECT row, col, " + each("least(255, {x} + 40)") + " FROM img"),
    "minus": (lambda r: point.minus(r, 40), "SELECT row, col, " + each("greatest(0, {x} - 40)") + " FROM img"),
    "at_least": (lambda r: point.at_least(r, 99), "SELECT row, col, " + each("greatest({x}, 99)") + " FROM img"),
    "at_most": (lambda r: point.at_most(r, 99), "SELECT row, col, " + each("least({x}, 99)") + " FROM img"),
    "invert": (point.invert, "SELECT row, col, " + each("255 - {x}") + " FROM img"),
    "depth": (lambda r: point.depth(r, 15), "SELECT row, col, " + each("({x} * 15 + 127) // 255") + " FROM img"),
    "gamma_709": (lambda r: point.gamma(r, "709"), "SELECT row, col, " + each("least(255, floor((CASE WHEN {x} / 255.0 < 0.018 THEN 4.5 * {x} / 255.0 ELSE 1.099 * pow({x} / 255.0, 0.45) - 0.099 END) * 255 + 0.5))::BIGINT") + " FROM img"),
    "gamma_srgb_back": (lambda r: point.gamma(r, "srgb", back=True), "SELECT row, col, " + each("least(255, floor((CASE WHEN {x} / 255.0 < 0.04045 THEN {x} / 255.0 / 12.92 ELSE pow(({x} / 255.0 + 0.055) / 1.055, 2.4) END) * 255 + 0.5))::BIGINT") + " FROM img"),
    "gamma_power": (lambda r: point.gamma(r, "power", 2.0, back=True), "SELECT row, col, " + each("least(255, floor({x} * {x} / 255.0 + 0.5))::BIGINT") + " FROM img"),
    "dim": (lambda r: point.dim(r, 0.6), "SELECT row, col, " + each("({x} * 39321) // 65536") + " FROM img"),
    "flash": (lambda r: point.flash(r, 0.3), "SELECT row, col, " + each("{x} + ((255 - {x}) * 19660) // 65536") + " FROM img"),
    "tv_lines": (lambda r: point.tv_lines(r, 0.5), "SELECT row, col, " + each("CASE WHEN row % 2 = 1 THEN {x} ELSE ({x} * 32768) // 65536 END") + " FROM img"),
    "change_colors": (
        lambda r: point.change_colors(r, [((200, 100, 50), (0, 0, 0)), ((50, 50, 50), (9, 9, 9))], 20),
        "WITH d AS (SELECT *, (v-200)*(v-200)+(g-100)*(g-100)+(b-50)*(b-50) AS d1, (v-50)*(v-50)+(g-50)*(g-50)+(b-50)*(b-50) AS d2 FROM img) SELECT row, col, "
        + each("CASE WHEN d1 <= 7803 THEN 0 WHEN d2 <= 7803 THEN 9 ELSE {x} END") + " FROM d",
    ),
    "color_mask": (lambda r: point.color_mask(point.depth(r, 3), (1, 2, 0)), "SELECT row, col, CASE WHEN (v * 3 + 127) // 255 = 1 AND (g * 3 + 127) // 255 = 2 AND (b * 3 + 127) // 255 = 0 THEN 0 ELSE 1 END::BIGINT AS p0 FROM img"),
    "to_gray": (point.gray, "SELECT row, col, (77 * v + 150 * g + 29 * b) // 256 AS p0 FROM img"),
    "swap_bytes": (lambda r: point.swap_bytes(point.depth(r, 65535)), "WITH d AS (SELECT row, col, " + ", ".join(f"({x} * 65535 + 127) // 255 AS {x}" for x in "vgb") + " FROM img) SELECT row, col, " + each("({x} % 256) * 256 + {x} // 256") + " FROM d"),
    "copy": (point.identity, f"SELECT row, col, {P3} FROM img"),
    "stretch_contrast": (lambda r: point.stretch(r, 50, 200), "SELECT row, col, " + each("CASE WHEN {x} <= 50 THEN 0 WHEN {x} >= 200 THEN 255 ELSE (({x} - 50) * 255 + 75) // 150 END::BIGINT") + " FROM img"),
    "row_differences": (point.row_differences, "SELECT row, col, " + each("({x} - coalesce(lag({x}) OVER (PARTITION BY col ORDER BY row), 0) + 127 + 512) % 256") + " FROM img"),
    "row_differences_back": (lambda r: point.from_row_differences(point.row_differences(r)), f"SELECT row, col, {P3} FROM img"),
    "opacity": (point.with_opacity, "SELECT row, col, floor(v * (b / 255.0) + 0.5)::BIGINT AS p0, floor(g * (b / 255.0) + 0.5)::BIGINT AS p1, b AS p2 FROM img"),
    "brighten_same": (point.brighten, f"SELECT row, col, {P3} FROM img"),
    "ordered_colors": (lambda r: point.ordered_colors(r, 1, (5, 9, 5)), "WITH m AS (SELECT *, [0, 2, 3, 1][(row % 2 * 2 + col % 2 + 1)::INT] AS d FROM img) SELECT row, col, " + ", ".join(f"((((({n} - 1) * 4 * {x}) // 255 + d) // 4) * 255) // ({n} - 1) AS p{k}" for k, (x, n) in enumerate((("v", 5), ("g", 9), ("b", 5)))) + " FROM m"),
}


def _one(name, f, sql, source):
    query(sql, name)(lambda spark, sf_dir: f(source(spark, sf_dir)).flat())


for _name, (_f, _sql) in ONE.items():
    _one(_name, _f, _sql, rgb)

GRAY = {
    "threshold": (lambda r: point.threshold(r, 0.4), "SELECT row, col, (v >= 102)::BIGINT AS p0 FROM img"),
    "ordered_bitmap": (point.ordered_bitmap, """WITH digits AS (SELECT n, n & 3 AS d0, n >> 2 & 3 AS d1, n >> 4 & 3 AS d2, n >> 6 & 3 AS d3 FROM (SELECT unnest(range(256)) AS n)),
dither AS (SELECT n, (8 + 8 * ((d0 & 1) + (d0 >> 1)) + 4 * ((d1 & 1) + (d1 >> 1)) + 2 * ((d2 & 1) + (d2 >> 1)) + (d3 & 1) + (d3 >> 1)) % 16 AS r, (8 + 8 * (d0 & 1) + 4 * (d1 & 1) + 2 * (d2 & 1) + (d3 & 1)) % 16 AS c FROM digits)
SELECT row, col, (v > (n * 255) // 256)::BIGINT AS p0 FROM img JOIN dither ON r = row % 16 AND c = col % 16"""),
    "color_ramp": (lambda r: point.color_ramp(r, (0, 0, 128), (255, 200, 0)), "SELECT row, col, (v * 255) // 255 AS p0, (v * 200) // 255 AS p1, (128 * (255 - v)) // 255 AS p2 FROM img"),
    "normalize_contrast": (
        point.normalize,
        """WITH h AS (SELECT v, count(*) AS n FROM img GROUP BY v),
        t AS (SELECT (count(*) * 2) // 100 AS dark, count(*) // 100 AS bright FROM img),
        c AS (SELECT v, sum(n) OVER (ORDER BY v) AS up, sum(n) OVER (ORDER BY v DESC) AS down FROM h),
        e AS (SELECT CASE WHEN min(dark) = 0 THEN 0 ELSE min(v) FILTER (up >= dark) END AS lo, CASE WHEN min(bright) = 0 THEN 255 ELSE max(v) FILTER (down >= bright) END AS hi FROM c, t)
        SELECT row, col, CASE WHEN v < lo THEN 0 WHEN v > hi THEN 255 ELSE least(255, (127 + (v - lo) * 255) // (hi - lo)) END::BIGINT AS p0 FROM img, e""",
    ),
    "equalize": (
        point.equalize,
        """WITH h AS (SELECT v, count(*) AS n FROM img GROUP BY v),
        c AS (SELECT v, floor(coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 255 / (sum(n) OVER ())::BIGINT + 0.5) AS raw FROM h),
        m AS (SELECT v, least(255, floor(raw * (255::DOUBLE / max(raw) OVER ()) + 0.5))::BIGINT AS t FROM c)
        SELECT row, col, t AS p0 FROM img JOIN m USING (v)""",
    ),
    "rank_levels": (point.distinct_ranks, "WITH d AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::BIGINT AS k FROM (SELECT DISTINCT v FROM img)) SELECT row, col, k AS p0 FROM img JOIN d USING (v)"),
    "cut": (lambda r: select.cut(r, left=10, width=50, top=2, bottom=-3), "SELECT row - 2 AS row, col - 10 AS col, v AS p0 FROM img, size WHERE col BETWEEN 10 AND 59 AND row BETWEEN 2 AND height - 3"),
    "cut_padded": (lambda r: select.cut(r, left=95, width=10, top=0, height=3, pad=True), "SELECT r.row, c.col, coalesce(v, 0) AS p0 FROM (SELECT unnest(range(3)) AS row) r, (SELECT unnest(range(10)) AS col) c LEFT JOIN img ON img.row = r.row AND img.col = c.col + 95"),
    "even_rows": (select.deinterlace, "SELECT row // 2 AS row, col, v AS p0 FROM img WHERE row % 2 = 0"),
    "odd_rows": (lambda r: select.deinterlace(r, True), "SELECT row // 2 AS row, col, v AS p0 FROM img WHERE row % 2 = 1"),
    "retile": (lambda r: select.retile(r, 3, 1, 20, 0), "WITH t AS (SELECT unnest(range(3)) AS j) SELECT row, col - j * 20 + j * 60 AS col, v AS p0 FROM img, t WHERE col - j * 20 BETWEEN 0 AND 59"),
    "flip_leftright": (lambda r: geometry.flip(r, "leftright"), "SELECT row, 99 - col AS col, v AS p0 FROM img"),
    "flip_topbottom": (lambda r: geometry.flip(r, "topbottom"), "SELECT height - 1 - row AS row, col, v AS p0 FROM img, size"),
    "flip_transpose": (lambda r: geometry.flip(r, "transpose"), "SELECT col AS row, row AS col, v AS p0 FROM img"),
    "rotate_90": (lambda r: geometry.flip(r, "rotate90"), "SELECT 99 - col AS row, row AS col, v AS p0 FROM img"),
    "rotate_180": (lambda r: geometry.flip(r, "rotate180"), "SELECT height - 1 - row AS row, 99 - col AS col, v AS p0 FROM img, size"),
    "rotate_270": (lambda r: geometry.flip(r, "rotate270"), "SELECT col AS row, height - 1 - row AS col, v AS p0 FROM img, size"),
    "enlarge": (lambda r: geometry.enlarge(r, 2), "WITH t AS (SELECT unnest(range(2)) AS k) SELECT row * 2 + a.k AS row, col * 2 + c.k AS col, v AS p0 FROM img, t a, t c"),
    "tile": (lambda r: geometry.tile(r, r.height + 5, 250), "SELECT r.row, c.col, v AS p0 FROM (SELECT unnest(range((SELECT height + 5 FROM size))) AS row) r, (SELECT unnest(range(250)) AS col) c JOIN img ON img.row = r.row % (SELECT height FROM size) AND img.col = c.col % 100"),
    "sample": (lambda r: geometry.sample(r, r.height * 2, 70), "SELECT r.row, c.col, v AS p0 FROM (SELECT unnest(range((SELECT 2 * height FROM size))) AS row) r, (SELECT unnest(range(70)) AS col) c JOIN img ON img.row = r.row // 2 AND img.col = c.col * 100 // 70"),
    "pad": (lambda r: geometry.pad(r, 2, 3, 0, 1, (7,)), "SELECT r.row, c.col, coalesce(v, 7) AS p0 FROM (SELECT unnest(range((SELECT height + 1 FROM size))) AS row) r, (SELECT unnest(range(105)) AS col) c LEFT JOIN img ON img.row = r.row AND img.col = c.col - 2"),
    "margin": (lambda r: geometry.margin(r, 1, (9,)), "SELECT r.row, c.col, coalesce(v, 9) AS p0 FROM (SELECT unnest(range((SELECT height + 2 FROM size))) AS row) r, (SELECT unnest(range(102)) AS col) c LEFT JOIN img ON img.row = r.row - 1 AND img.col = c.col - 1"),
    "drip": (geometry.drip, "WITH t AS (SELECT least(height - 1, row + v // 4) AS r2, col, max_by(v, row) AS v FROM img, size GROUP BY 1, 2) SELECT img.row, img.col, coalesce(t.v, 0) AS p0 FROM img LEFT JOIN t ON t.r2 = img.row AND t.col = img.col"),
    "stretch_linear": (lambda r: geometry.stretch(r, 2, 1), "WITH n AS (SELECT row, col, v, coalesce(lead(v) OVER (PARTITION BY row ORDER BY col), v) AS t FROM img), k AS (SELECT unnest(range(2)) AS k) SELECT row, col * 2 + k AS col, (v * (2 - k) + t * k) // 2 AS p0 FROM n, k"),
    "halve": (lambda r: geometry.resample(r, r.height, 50), "SELECT row, col // 2 AS col, floor(sum(v) * 0.5 + 0.5)::BIGINT AS p0 FROM img GROUP BY 1, 2"),
    "halve_fixed": (lambda r: geometry.resample_fixed(r, r.height, 50), "SELECT row, col // 2 AS col, floor(sum(v) * 0.5 + 0.5)::BIGINT AS p0 FROM img GROUP BY 1, 2"),
    "globe": (lambda r: geometry.globe(r, 4), """WITH g AS (SELECT row, col, sin(pi() * row / height) AS f, col % 25 AS x FROM img, size), h AS (SELECT *, floor((1 - f) * 25 / 2 + 0.5)::BIGINT AS bd FROM g),
        s AS (SELECT row, col, CASE WHEN x >= bd AND x <= 25 - bd AND f > 0 THEN least(99, col - x + floor((x - bd) / f))::BIGINT END AS c0 FROM h)
        SELECT s.row, s.col, coalesce(v, 0) AS p0 FROM s LEFT JOIN img ON img.row = s.row AND img.col = s.c0"""),
    "box_blur": (lambda r: neighbours.box(r, 3, 3), "BOX"),
    "convolve": (lambda r: neighbours.convolve(r, [[0, -0.25, 0], [-0.25, 2, -0.25], [0, -0.25, 0]]), "CONV"),
    "edges": (neighbours.edges, "EDGE"),
    "enhance": (lambda r: neighbours.enhance(r, 5), "ENHANCE"),
    "relief": (neighbours.relief, "SELECT a.row, a.col, CASE WHEN a.row BETWEEN 1 AND height - 2 AND a.col BETWEEN 1 AND 98 THEN (d.v + 127 - u.v + 256) % 256 ELSE 0 END::BIGINT AS p0 FROM img a LEFT JOIN img d ON d.row = a.row + 1 AND d.col = a.col - 1 LEFT JOIN img u ON u.row = a.row AND u.col = a.col + 1, size"),
    "dilate": (lambda r: neighbours.dilate(r, [[0, 1, 0], [1, 1, 1], [0, 1, 0]]), "SELECT a.row, a.col, max(b.v) AS p0 FROM img a JOIN img b ON abs(a.row - b.row) + abs(a.col - b.col) <= 1 AND b.row BETWEEN a.row - 1 AND a.row + 1 GROUP BY 1, 2"),
    "erode": (lambda r: neighbours.erode(r, [[0, 1, 0], [1, 1, 1], [0, 1, 0]]), "SELECT a.row, a.col, min(b.v) AS p0 FROM img a JOIN img b ON abs(a.row - b.row) + abs(a.col - b.col) <= 1 AND b.row BETWEEN a.row - 1 AND a.row + 1 GROUP BY 1, 2"),
    "sharpness_map": (neighbours.sharpness_map, "SHARP"),
    "trimmed_median": (lambda r: neighbours.trimmed_mean(r, 0.5), """WITH k AS (SELECT a, c FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS c)),
        n AS (SELECT row, col, greatest(0, least(height - 1, row + a)) AS r0, greatest(0, least(99, col + c)) AS c0 FROM img, k, size)
        SELECT n.row, n.col, list_sort(list(i.v))[5] AS p0 FROM n JOIN img i ON i.row = n.r0 AND i.col = n.c0 GROUP BY 1, 2"""),
    "optimal_estimate": (lambda r: neighbours.optimal_estimate(r, 0.1), None),
    "antialias": (neighbours.antialias, None),
    "shear": (lambda r: geometry.shear(r, 10), """WITH p AS (SELECT row, col, v, row * SLOPE::DOUBLE AS sh, lag(v, 1, 0) OVER (PARTITION BY row ORDER BY col) AS u FROM img),
        q AS (SELECT *, floor(sh)::BIGINT AS w, floor((sh - floor(sh)) * 4096)::BIGINT AS f FROM p),
        m AS (SELECT row, col + w AS col, (f * u + (4096 - f) * v + 2048) // 4096 AS v FROM q UNION ALL SELECT row, 100 + w, (f * v + 2048) // 4096 FROM q WHERE col = 99),
        g AS (SELECT r.row, c.col FROM (SELECT unnest(range(height)) AS row FROM size) r, (SELECT unnest(range(100 + floor(height * SLOPE::DOUBLE + 0.999999)::BIGINT)) AS col FROM size) c)
        SELECT g.row, g.col, coalesce(m.v, 0) AS p0 FROM g LEFT JOIN m USING (row, col)""".replace("SLOPE", "0.17632698070846498")),
    "rotate_30": (lambda r: geometry.rotate(r, 30), None),
    "resample_lanczos": (lambda r: geometry.resample(r, r.height, 40, "lanczos"), None),
    "jitter": (lambda r: geometry.jitter(r, 3, 5), None),
    "spread": (lambda r: geometry.spread(r, 2, 5), None),
    "perspective": (lambda r: geometry.perspective(r, [(5, 0), (90, 2), (0, 8), (99, 9)], 10, 50), None),
}

NEAR = """WITH k AS (SELECT a, c FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS c)),
n AS (SELECT i.row + a AS row, i.col + c AS col, -a AS a, -c AS c, v FROM img i, k), 
s AS (SELECT i.row, i.col, i.v, {parts} FROM img i JOIN n USING (row, col) GROUP BY 1, 2, 3)
SELECT row, col, CASE WHEN row BETWEEN 1 AND height - 2 AND col BETWEEN 1 AND 98 THEN {inner} ELSE {edge} END::BIGINT AS p0 FROM s, size"""
NEAR_SQL = {
    "BOX": NEAR.format(parts="sum(n.v) AS t", inner="floor(t / 9.0 + 0.5)", edge="v"),
    "CONV": NEAR.format(parts="sum(n.v * CASE WHEN a = 0 AND c = 0 THEN 2 WHEN abs(a) + abs(c) = 1 THEN -0.25 ELSE 0 END) AS t", inner="least(255, greatest(0, floor(t + 0.5)))", edge="v"),
    "EDGE": NEAR.format(parts="sum(n.v * c * (2 - abs(a))) AS x, sum(n.v * a * (2 - abs(c))) AS y", inner="least(255, floor(sqrt(x * x + y * y) / 1.8))", edge="0"),
    "ENHANCE": NEAR.format(parts="sum(n.v) AS t", inner="least(255, greatest(0, floor((v - 0.5::DOUBLE * t / 9) / 0.5::DOUBLE + 0.5)))", edge="v"),
    "SHARP": NEAR.format(parts="sum(abs(i.v - n.v)) AS t", inner="t", edge="0"),
}
for _name, (_f, _sql) in GRAY.items():
    _one(_name, _f, NEAR_SQL.get(_sql, _sql), gray)

BITS = {
    "life": (neighbours.life, "WITH k AS (SELECT a, c FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS c) WHERE a <> 0 OR c <> 0), n AS (SELECT row + a AS row, col + c AS col, count(*) AS n FROM img, k WHERE bit = 1 GROUP BY 1, 2) SELECT row, col, (coalesce(n, 0) = 3 OR (coalesce(n, 0) = 2 AND bit = 1))::BIGINT AS p0 FROM img LEFT JOIN n USING (row, col)"),
    "clean_bitmap": (lambda r: neighbours.clean(r, 3), "WITH k AS (SELECT a, c FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS c) WHERE a <> 0 OR c <> 0), n AS (SELECT i.row, i.col, i.bit, sum((coalesce(o.bit, 1) = i.bit)::INT) AS n FROM img i CROSS JOIN k LEFT JOIN img o ON o.row = i.row + a AND o.col = i.col + c GROUP BY 1, 2, 3) SELECT row, col, CASE WHEN n < 3 THEN 1 - bit ELSE bit END AS p0 FROM n"),
    "density": (lambda r: neighbours.density(r, 3, 3), "SELECT a.row, a.col, (sum(b.bit) * 9) // count(*) AS p0 FROM img a JOIN img b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2"),
    "shrink_bitmap": (lambda r: neighbours.shrink_bitmap(r, 2), "SELECT row // 2 AS row, col // 2 AS col, (avg(bit) >= 0.5)::BIGINT AS p0 FROM img, size WHERE row // 2 < height // 2 GROUP BY 1, 2"),
}
for _name, (_f, _sql) in BITS.items():
    _one(_name, _f, _sql.replace("(sum(b.bit) * 9) // count(*)", "((sum(b.bit) * 9) // count(*))::BIGINT"), bits)


@query("""WITH n AS (SELECT a.row, a.col, b.few AS v, count(*) AS n FROM img a JOIN img b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2, 3)
SELECT row, col, v AS p0 FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, v) AS k FROM n) WHERE k = 1""")
def modal(spark, sf_dir):
    return neighbours.modal(few(spark, sf_dir), 1).flat()


# ---- aggregates


@query("SELECT sum(v)::BIGINT AS sum, avg(v) AS mean, min(v) AS min, max(v) AS max FROM img")
def summary(spark, sf_dir):
    return aggregate.summary(gray(spark, sf_dir)).drop("image")


for _how, _v in (("sum", "least(255, sum(v))::BIGINT"), ("mean", "floor(avg(v) + 0.5)::BIGINT"), ("min", "min(v)"), ("max", "max(v)")):
    query(f"SELECT col, {_v} AS v FROM sparse GROUP BY col", f"column_{_how}")(lambda spark, sf_dir, how=_how: aggregate.columns(sparse(spark, sf_dir), how).select("col", "v"))


@query("SELECT v, n, (sum(n) OVER (ORDER BY v))::BIGINT AS up, (sum(n) OVER (ORDER BY v DESC))::BIGINT AS down FROM (SELECT v, count(*) AS n FROM sparse GROUP BY v)")
def levels(spark, sf_dir):
    return aggregate.levels(sparse(spark, sf_dir)).drop("image")


@query("SELECT v, g, b, floor(0.2989::DOUBLE * v + 0.5866::DOUBLE * g + 0.1145::DOUBLE * b + 0.5)::BIGINT AS lum, n, (row_number() OVER (ORDER BY n DESC, v, g, b) - 1)::BIGINT AS place FROM (SELECT v, g, b, count(*) AS n FROM img GROUP BY 1, 2, 3)")
def colors_by_count(spark, sf_dir):
    return aggregate.colors(rgb(spark, sf_dir)).select(*(F.col("s")[k].alias(n) for k, n in enumerate("vgb")), "lum", "n", "place")


@query("SELECT v, (row_number() OVER (ORDER BY v) - 1)::BIGINT AS place, n FROM (SELECT v, count(*) AS n FROM img GROUP BY 1)")
def colors_by_value(spark, sf_dir):
    return aggregate.colors(gray(spark, sf_dir), "rgb").select(F.col("s")[0].alias("v"), "place", "n")


@query("SELECT ((v - 10) * 8) // 191 AS bucket, least(count(*), 1000)::BIGINT AS n FROM img WHERE v BETWEEN 10 AND 200 GROUP BY 1")
def buckets(spark, sf_dir):
    return aggregate.buckets(gray(spark, sf_dir), 10, 200, 8, 1000).drop("image")


PAIRS = """WITH m AS (SELECT unnest([0, 45, 90, 135]) AS angle, unnest([0, 1, 1, 1]) AS dr, unnest([1, -1, 0, 1]) AS dc),
r AS (SELECT few AS v, (dense_rank() OVER (ORDER BY few) - 1)::BIGINT AS k FROM (SELECT DISTINCT few FROM img)),
p AS (SELECT row, col, k FROM img JOIN r ON r.v = img.few),
o AS (SELECT angle, a.k AS i, c.k AS j FROM p a, m JOIN p c ON c.row = a.row + dr AND c.col = a.col + dc),
q AS (SELECT angle, i, j, count(*) AS n FROM (SELECT * FROM o UNION ALL SELECT angle, j, i FROM o) GROUP BY 1, 2, 3)"""


@query(PAIRS + " SELECT * FROM q")
def co_occurrence(spark, sf_dir):
    return aggregate.co_occurrence(few(spark, sf_dir)).drop("image")


SHARE = "(CASE angle WHEN 0 THEN 2 * height * 99 WHEN 90 THEN 2 * (height - 1) * 100 ELSE 2 * (height - 1) * 99 END)"


@query(PAIRS + f""", t AS (SELECT angle, i, j, n / {SHARE} AS p FROM q, size), k AS (SELECT angle, sum(i * p) AS mean FROM t GROUP BY 1)
SELECT angle, round(sum(p * p), 9) AS asm, round(sum((i - j) * (i - j) * p), 9) AS contrast, round(sum(p / (1 + (i - j) * (i - j))), 9) AS idm, round(-sum(p * log10(p + 1e-9)), 9) AS entropy,
round(sum((i + 1 - mean) * (i + 1 - mean) * p), 9) AS variance, round((sum(i * j * p) - mean * mean) / (sum(i * i * p) - mean * mean), 9) AS correlation FROM t JOIN k USING (angle) GROUP BY angle, mean""")
def texture(spark, sf_dir):
    got = aggregate.texture(few(spark, sf_dir))
    return got.select("angle", *(F.round(n, 9).alias(n) for n in ("asm", "contrast", "idm", "entropy", "variance", "correlation")))


@query()
def texture_all(spark, sf_dir):
    return aggregate.texture(few(spark, sf_dir)).drop("image")


EULER = """WITH m AS (SELECT unnest(['tile', 'across', 'across', 'down', 'down', 'vertex', 'vertex', 'vertex', 'vertex']) AS kind, unnest([0, 0, 0, 0, 1, 0, 0, 1, 1]) AS a, unnest([0, 0, 1, 0, 0, 0, 1, 0, 1]) AS c),
e AS (SELECT kind, row + a AS row, col + c AS col, max({v}) AS v FROM img, m GROUP BY 1, 2, 3)"""


@query(EULER.format(v="bit") + ", n AS (SELECT count(*) FILTER (kind = 'tile') AS t, count(*) FILTER (kind IN ('across', 'down')) AS e, count(*) FILTER (kind = 'vertex') AS x FROM e WHERE v > 0) SELECT t AS area, 2 * e - 4 * t AS perimeter, t - e + x AS euler FROM n")
def minkowski(spark, sf_dir):
    return aggregate.minkowski(bits(spark, sf_dir)).drop("image")


@query(EULER.format(v="few") + ", n AS (SELECT v AS level, count(*) FILTER (kind = 'tile') AS t, count(*) FILTER (kind IN ('across', 'down')) AS e, count(*) FILTER (kind = 'vertex') AS x FROM e GROUP BY 1), s AS (SELECT level, (sum(t) OVER w)::BIGINT AS t, (sum(e) OVER w)::BIGINT AS e, (sum(x) OVER w)::BIGINT AS x FROM n WINDOW w AS (ORDER BY level DESC)) SELECT level, t AS area, 2 * e - 4 * t AS perimeter, t - e + x AS euler FROM s")
def minkowski_levels(spark, sf_dir):
    return aggregate.minkowski_levels(few(spark, sf_dir)).drop("image")


@query("""WITH k AS (SELECT a, c FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS c)),
n AS (SELECT i.row + a AS row, i.col + c AS col, v FROM img i, k)
SELECT round(sum(abs(i.v - n.v)) / (any_value(height) * 100.0 * 8) / 255, 9) AS sharpness FROM img i JOIN n USING (row, col), size WHERE row BETWEEN 1 AND height - 2 AND col BETWEEN 1 AND 98""")
def sharpness(spark, sf_dir):
    return neighbours.sharpness(gray(spark, sf_dir)).select(F.round("sharpness", 9).alias("sharpness"))


@query("SELECT any_value(height)::INT AS height, 100 AS width, 1 AS depth, 255::BIGINT AS maxval, count(*) AS n_cells FROM img, size")
def describe(spark, sf_dir):
    return aggregate.describe(gray(spark, sf_dir)).drop("image")


@query()
def palette(spark, sf_dir):
    got = aggregate.palette(rgb(spark, sf_dir), 16)
    return spark.createDataFrame([(k, *c) for k, c in enumerate(got)], "place int, r bigint, g bigint, b bigint")


# ---- selections that don't give an image


@query("SELECT col AS at, v AS p0 FROM img WHERE row = 5")
def slice_row(spark, sf_dir):
    return select.series(gray(spark, sf_dir), row=5).drop("image")


@query("SELECT row AS at, g AS p1 FROM img WHERE col = 7")
def slice_column(spark, sf_dir):
    return select.series(rgb(spark, sf_dir), col=7, plane=1).drop("image")


@query("SELECT min(row) AS top, max(row) AS bottom, min(col) AS left, max(col) AS right FROM img WHERE few <> 3")
def bounds(spark, sf_dir):
    return select.bounds(few(spark, sf_dir), (3,)).drop("image")


@query("WITH f AS (SELECT * FROM sparse WHERE v > 200), b AS (SELECT min(row) AS t, max(row) AS u, min(col) AS l, max(col) AS r FROM f) SELECT row - t AS row, col - l AS col, CASE WHEN v > 200 THEN v ELSE 0 END AS v FROM sparse, b WHERE row BETWEEN t AND u AND col BETWEEN l AND r")
def crop(spark, sf_dir):
    r = sparse(spark, sf_dir).map(lambda x: F.when(x > 200, x).otherwise(F.lit(0)).cast("bigint"))
    return select.crop(r, (0,)).select("row", "col", F.col("s")[0].alias("v"))


@query("SELECT few AS v FROM (SELECT few, count(*) AS n, min(row * 100 + col) AS k FROM img, size WHERE row IN (0, height - 1) AND col IN (0, 99) GROUP BY 1) ORDER BY n DESC, k LIMIT 1")
def background(spark, sf_dir):
    return select.background_of_corners(few(spark, sf_dir)).select(F.col("s")[0].alias("v"))


@query("SELECT row // 10 AS tile_row, col // 30 AS tile_col, row % 10 AS row, col % 30 AS col, v FROM img")
def dice(spark, sf_dir):
    return select.dice(gray(spark, sf_dir), 30, 10).select("tile_row", "tile_col", "row", "col", F.col("s")[0].alias("v"))


@query("WITH t AS (SELECT unnest(range(4)) AS j) SELECT row // 10 AS tile_row, j AS tile_col, row % 10 AS row, col - j * 25 AS col, v FROM img, t WHERE col - j * 25 BETWEEN 0 AND 29")
def dice_overlapping(spark, sf_dir):
    return select.dice(gray(spark, sf_dir), 30, 10, h_overlap=5).select("tile_row", "tile_col", "row", "col", F.col("s")[0].alias("v"))


# ---- two images

TWO = {
    "add": "least(255, v + w)", "subtract": "greatest(0, v - w)", "multiply": "(v * w) // 255", "difference": "abs(v - w)", "minimum": "least(v, w)", "maximum": "greatest(v, w)",
    "mean": "(v + w + 1) // 2", "compare": "(CASE WHEN v > w THEN 2 WHEN v < w THEN 0 ELSE 1 END)::BIGINT", "and": "v & w", "or": "v | w", "nand": "255 - (v & w)", "nor": "255 - (v | w)", "xor": "xor(v, w)",
}
for _how, _sql in TWO.items():
    query(f"SELECT row, col, {_sql} AS p0 FROM img", f"arithmetic_{_how}")(lambda spark, sf_dir, how=_how: combine.arithmetic(gray(spark, sf_dir), other(spark, sf_dir), how).flat())
for _how, _op in (("shiftleft", "((v << (w // 64)) & 255)"), ("shiftright", "(v >> (w // 64))")):
    query(f"SELECT row, col, {_op}::BIGINT AS p0 FROM img", f"arithmetic_{_how}")(
        lambda spark, sf_dir, how=_how: combine.arithmetic(gray(spark, sf_dir), other(spark, sf_dir).map(lambda x: F.floor(x / 64).cast("bigint")), how).flat()
    )


@query("SELECT row, col, " + ", ".join(f"abs({x} - w) AS p{k}" for k, x in enumerate("vgb")) + " FROM img")
def arithmetic_one_plane(spark, sf_dir):
    return combine.arithmetic(rgb(spark, sf_dir), other(spark, sf_dir), "difference").flat()


def _piece(r: Raster) -> Raster:
    return select.cut(r, left=0, width=40, top=0, height=8)


@query("SELECT i.row, i.col, CASE WHEN o.w IS NULL THEN i.v ELSE least(255, greatest(0, floor(0.75 * i.v + 0.25 * o.w + 0.5))) END::BIGINT AS p0 FROM img i LEFT JOIN img o ON o.row = i.row - 3 AND o.col = i.col - 30 AND o.row < 8 AND o.col < 40")
def overlay(spark, sf_dir):
    return combine.overlay(gray(spark, sf_dir), _piece(other(spark, sf_dir)), align="center", yoff=3, opacity=0.25).flat()


@query("SELECT i.row, i.col, CASE WHEN o.w IS NULL THEN i.v ELSE least(255, floor((1 - o.bit) * i.v + o.bit * o.w + 0.5)) END::BIGINT AS p0 FROM img i LEFT JOIN img o ON o.row = i.row AND o.col = i.col - 60 AND o.row < 8 AND o.col < 40")
def overlay_alpha(spark, sf_dir):
    return combine.overlay(gray(spark, sf_dir), _piece(other(spark, sf_dir)), align="right", alpha=_piece(bits(spark, sf_dir))).flat()


@query("SELECT i.row, i.col, coalesce(o.w, i.v) AS p0 FROM img i LEFT JOIN img o ON o.row = i.row - 2 AND o.col = i.col - 50 AND o.row < 8 AND o.col < 40")
def paste(spark, sf_dir):
    return combine.paste(gray(spark, sf_dir), _piece(other(spark, sf_dir)), -50, 2).flat()


@query("SELECT i.row, i.col, CASE WHEN o.bit IS NULL THEN i.bit ELSE xor(i.bit, o.bit) END AS p0 FROM img i LEFT JOIN img o ON o.row = i.row - 1 AND o.col = i.col - 5 AND o.row < 8 AND o.col < 40")
def paste_xor(spark, sf_dir):
    return combine.paste(bits(spark, sf_dir), _piece(bits(spark, sf_dir)), 5, 1, "xor").flat()


@query("SELECT row, col, " + ", ".join(f"{a} + (({b} - {a}) * 16384) // 65536 + CASE WHEN ({b} - {a}) * 16384 < 0 AND (({b} - {a}) * 16384) % 65536 <> 0 THEN -1 ELSE 0 END AS p{k}" for k, (a, b) in enumerate(zip("vgb", "wvg"))) + " FROM img")
def fade(spark, sf_dir):
    return combine.fade(rgb(spark, sf_dir), rgb2(spark, sf_dir), 0.25).flat()


@query("""WITH l AS (SELECT row, col, (77 * v + 150 * g + 29 * b) // 256 AS l, (77 * w + 150 * v + 29 * g) // 256 AS r FROM img)
SELECT row, col, max(r) AS p0, max(l) AS p1, max(l) AS p2 FROM (
  SELECT row, col - 5 AS col, l, 0 AS r FROM l WHERE col >= 5 UNION ALL SELECT row, col + 5, 0, r FROM l WHERE col < 95) GROUP BY row, col""")
def anaglyph(spark, sf_dir):
    return combine.anaglyph(rgb(spark, sf_dir), rgb2(spark, sf_dir), 10).flat()


@query("SELECT row, col, least(255, greatest(0, 2 * v - w)) AS p0 FROM img")
def sharpen_by_mask(spark, sf_dir):
    return combine.sharpen_by_mask(gray(spark, sf_dir), other(spark, sf_dir)).flat()


@query("SELECT row, col, CASE WHEN few < 10 THEN few * few ELSE 77 END AS p0, CASE WHEN few < 10 THEN 255 - few ELSE 7 END AS p1 FROM img")
def lookup(spark, sf_dir):
    return combine.lookup(few(spark, sf_dir), [(k * k, 255 - k) for k in range(10)], (77, 7)).flat()


@query("WITH t AS (SELECT p_size::BIGINT AS v, max(p_retailprice) AS p FROM part GROUP BY 1) SELECT s.row, s.col, coalesce(floor(p)::BIGINT, 1) AS p0 FROM sparse s LEFT JOIN t USING (v)")
def lookup_join(spark, sf_dir):
    from gridloom.plans.catalog import table

    part = table(spark, sf_dir, "part").groupBy(F.array(F.col("p_size").cast("bigint")).alias("key")).agg(F.array(F.floor(F.max("p_retailprice")).cast("bigint")).alias("t"))
    return combine.lookup_join(sparse(spark, sf_dir), part, (1,)).flat()


@query("SELECT row, col, v AS p0, w AS p1, v AS p2, g AS p3, b AS p4 FROM img")
def stack(spark, sf_dir):
    return combine.stack(gray(spark, sf_dir), other(spark, sf_dir), rgb(spark, sf_dir)).flat()


@query("SELECT row, col, v AS p0, w AS p1, (few * 255) // 15 AS p2 FROM img")
def join_planes(spark, sf_dir):
    return combine.join_planes(gray(spark, sf_dir), other(spark, sf_dir), few(spark, sf_dir)).flat()


@query("SELECT 0 AS plane, row, col, v AS p0 FROM img UNION ALL SELECT 1, row, col, g FROM img UNION ALL SELECT 2, row, col, b FROM img")
def split_planes(spark, sf_dir):
    parts = [p.flat().select(F.lit(k).alias("plane"), "*") for k, p in enumerate(combine.split_planes(rgb(spark, sf_dir)))]
    return parts[0].union(parts[1]).union(parts[2])


PALETTE = [(0, 0, 0), (255, 255, 255), (200, 60, 60), (60, 200, 60), (60, 60, 200), (128, 128, 128)]
_NEAREST = "WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a}, {b}, {c})" for k, (a, b, c) in enumerate(PALETTE)) + ") t(k, x, y, z)), d AS (SELECT i.row, i.col, x, y, z, (v-x)*(v-x)+(g-y)*(g-y)+(b-z)*(b-z) AS d, row_number() OVER (PARTITION BY i.row, i.col ORDER BY (v-x)*(v-x)+(g-y)*(g-y)+(b-z)*(b-z), k) AS n FROM img i, p) "


@query(_NEAREST + "SELECT row, col, x::BIGINT AS p0, y::BIGINT AS p1, z::BIGINT AS p2 FROM d WHERE n = 1")
def remap(spark, sf_dir):
    return combine.remap(rgb(spark, sf_dir), PALETTE).flat()


@query("SELECT row, col, CASE WHEN few IN (1, 4, 9) THEN few ELSE 0 END AS p0 FROM img")
def remap_exact(spark, sf_dir):
    return combine.remap(few(spark, sf_dir), [(1,), (4,), (9,)], (0,)).flat()


@query("""WITH d AS (SELECT pow((0.2989::DOUBLE * (v - w) + 0.5866::DOUBLE * (g - v) + 0.1145::DOUBLE * (b - g)) / 255, 2) AS y,
pow((-0.16874::DOUBLE * (v - w) - 0.33126::DOUBLE * (g - v) + 0.5::DOUBLE * (b - g)) / 255, 2) AS cb, pow((0.5::DOUBLE * (v - w) - 0.41869::DOUBLE * (g - v) - 0.08131::DOUBLE * (b - g)) / 255, 2) AS cr FROM img)
SELECT round(10 * log10(1 / avg(y)), 6) AS y, round(10 * log10(1 / avg(cb)), 6) AS cb, round(10 * log10(1 / avg(cr)), 6) AS cr FROM d""")
def psnr(spark, sf_dir):
    got = combine.psnr(rgb(spark, sf_dir), rgb2(spark, sf_dir))
    return got.select(*(F.round(n, 6).alias(n) for n in ("y", "cb", "cr")))


@query("""WITH m AS (SELECT dr, dc FROM (SELECT unnest(range(-1, 2)) AS dr), (SELECT unnest(range(-2, 3)) AS dc)),
s AS (SELECT dr, dc, avg((a.v - b.w) * (a.v - b.w)) AS mean FROM img b, m JOIN img a ON a.row = b.row + dr AND a.col = b.col + dc GROUP BY 1, 2)
SELECT place::INT AS place, dr, dc, round(mean, 6) AS mean FROM (SELECT *, row_number() OVER (ORDER BY mean, dr, dc) AS place FROM s) WHERE place <= 9""")
def best_offsets(spark, sf_dir):
    got = combine.best_offsets(gray(spark, sf_dir), other(spark, sf_dir), range(-1, 2), range(-2, 3))
    return got.select("place", "dr", "dc", F.round("mean", 6).alias("mean"))


@query("SELECT r.row, c.col, coalesce(a.v, b.w, 0) AS p0 FROM (SELECT unnest(range((SELECT height + 2 FROM size))) AS row) r, (SELECT unnest(range(190)) AS col) c LEFT JOIN img a ON a.row = r.row AND a.col = c.col LEFT JOIN img b ON b.row = r.row - 2 AND b.col = c.col - 90")
def stitch(spark, sf_dir):
    return combine.stitch(gray(spark, sf_dir), other(spark, sf_dir), 2, 90).flat()


# ---- assemblies


@query("SELECT row, col, v AS p0 FROM img UNION ALL SELECT row, col + 100, w FROM img UNION ALL SELECT row, col + 200, (few * 255 + 7) // 15 FROM img")
def concat_across(spark, sf_dir):
    return assemble.concat([gray(spark, sf_dir), other(spark, sf_dir), few(spark, sf_dir)]).flat()


@query("SELECT row, col, v AS p0 FROM img UNION ALL SELECT height + r.row, c.col, coalesce(i.w, 5) FROM (SELECT unnest(range(8)) AS row) r, (SELECT unnest(range(100)) AS col) c CROSS JOIN size LEFT JOIN img i ON i.row = r.row AND i.col = c.col - 30 AND i.col < 40")
def concat_down(spark, sf_dir):
    return assemble.concat([gray(spark, sf_dir), _piece(other(spark, sf_dir))], down=True, justify="center", fill=(5,)).flat()


@query("SELECT v, g, b, (row_number() OVER (ORDER BY v, g, b) - 1)::BIGINT AS place FROM (SELECT DISTINCT v, g, b FROM img)")
def distinct_colors(spark, sf_dir):
    return assemble.distinct_colors(rgb(spark, sf_dir)).select(*(F.col("s")[k].alias(n) for k, n in enumerate("vgb")), "place")


@query("WITH f AS (SELECT unnest(range(3)) AS frame), k AS (SELECT frame, (frame * 65536) // 2 AS k FROM f) SELECT 'a-' || lpad(frame::VARCHAR, 4, '0') AS image, row, col, v + floor((w - v) * k / 65536)::BIGINT AS p0 FROM img, k")
def transition(spark, sf_dir):
    r = assemble.transition(gray(spark, sf_dir), other(spark, sf_dir), 3)
    return r.px.select("image", "row", "col", F.col("s")[0].alias("p0"))


@query()
def quantize(spark, sf_dir):
    return assemble.quantize(rgb(spark, sf_dir), 8).flat()


@query()
def contact_sheet(spark, sf_dir):
    return assemble.contact_sheet([gray(spark, sf_dir), rgb(spark, sf_dir), few(spark, sf_dir)], 20, 2).flat()


@query()
def montage(spark, sf_dir):
    return assemble.montage_of([gray(spark, sf_dir), _piece(other(spark, sf_dir)), _piece(gray(spark, sf_dir))]).flat()


@query()
def shadow(spark, sf_dir):
    return assemble.shadow(few(spark, sf_dir)).flat()


# ---- file formats, there and back: each image written in a format, by bands if it is tall, and read again


def _there_and_back(r: Raster, format: str, **options):
    from gridloom.sources import formats

    read = formats.decoded(formats.encoded(r, format, formats.band_rows(r)), format, **options)
    return read.select("row", "col", F.col("s"))


for _name in ("png", "tiff", "xwd", "sir", "fs", "lispm", "sgi", "fits"):
    query("SELECT row, col, v AS p0 FROM img", f"file_{_name}")(lambda spark, sf_dir, n=_name: _there_and_back(gray(spark, sf_dir), n).select("row", "col", F.col("s")[0].alias("p0")))
query("SELECT row, col, v * 257 AS p0 FROM img", "file_pfm")(lambda spark, sf_dir: _there_and_back(gray(spark, sf_dir), "pfm").select("row", "col", F.col("s")[0].alias("p0")))
for _name in ("gif", "ilbm", "leaf", "bmp", "tga", "pcx", "sun"):
    query("SELECT row, col, v AS p0, v AS p1, v AS p2 FROM img", f"file_{_name}")(lambda spark, sf_dir, n=_name: _there_and_back(gray(spark, sf_dir), n).select("row", "col", *(F.col("s")[k].alias(f"p{k}") for k in range(3))))
for _name in ("png", "tiff", "xwd", "sir", "ilbm"):
    query("SELECT row, col, v AS p0, g AS p1, b AS p2 FROM img", f"file_{_name}_color")(lambda spark, sf_dir, n=_name: _there_and_back(rgb(spark, sf_dir), n).select("row", "col", *(F.col("s")[k].alias(f"p{k}") for k in range(3))))
for _name in ("xbm", "wbmp", "cmuwm", "mgr", "atk", "mrf", "g3", "escp2"):
    query("SELECT row, col, bit AS p0 FROM img", f"file_{_name}")(lambda spark, sf_dir, n=_name: _there_and_back(bits(spark, sf_dir), n).select("row", "col", F.col("s")[0].alias("p0")))
# whole words: half of the filling of 12 columns on the left; whole bytes and four lines
query("SELECT row, col, max(bit) AS p0 FROM (SELECT row, col + 6 AS col, bit FROM img UNION ALL SELECT r.row, c.c AS col, 1 FROM (SELECT DISTINCT row FROM img) r, (SELECT unnest([0, 1, 2, 3, 4, 5, 106, 107, 108, 109, 110, 111]) AS c) c) GROUP BY row, col", "file_icon")(lambda spark, sf_dir: _there_and_back(bits(spark, sf_dir), "icon").select("row", "col", F.col("s")[0].alias("p0")))
query("SELECT row, col, bit AS p0 FROM img WHERE col < 96 UNION ALL SELECT r.r, c.c, 0 FROM (SELECT unnest(range(height, (height + 3) // 4 * 4)) AS r FROM size) r, (SELECT unnest(range(96)) AS c) c", "file_mda")(lambda spark, sf_dir: _there_and_back(bits(spark, sf_dir), "mda").select("row", "col", F.col("s")[0].alias("p0")))


# ---- images written and read by rows, in many tasks


def _by_rows(r: Raster, format: str, repeat: int = 1):
    from gridloom import shared
    from gridloom.sources import rowscan

    folder = shared.new_folder(r.px.sparkSession, "rows")
    rowscan.write_rows(r, folder, format, repeat=repeat)
    return folder


def _scanned(spark, folder: str, planes: int = 1):
    from gridloom.sources import rowscan

    return rowscan.scan(spark, folder, ("row", "col", "s")).select("row", "col", *(F.col("s")[k].alias(f"p{k}") for k in range(planes)))


@query("SELECT row, col, v AS p0, g AS p1, b AS p2 FROM img")
def rows_color(spark, sf_dir):
    return _scanned(spark, _by_rows(rgb(spark, sf_dir), "P6"), 3)


@query("SELECT row, col, bit AS p0 FROM img")
def rows_bitmap(spark, sf_dir):
    return _scanned(spark, _by_rows(bits(spark, sf_dir), "P4"))


@query("SELECT row, col, v * 257 AS p0 FROM img")
def rows_two_bytes(spark, sf_dir):
    return _scanned(spark, _by_rows(point.depth(gray(spark, sf_dir), 65535), "P7"))


@query("SELECT row * 3 + k AS row, col, v AS p0 FROM img, (SELECT unnest([0, 1, 2])::BIGINT AS k)")
def rows_repeated(spark, sf_dir):
    return _scanned(spark, _by_rows(gray(spark, sf_dir), "P5", repeat=3))


@query("SELECT row, max(v) AS most, sum(v)::BIGINT AS total FROM img, size WHERE 2 * row >= height AND 2 * row < height + 20 GROUP BY row")
def rows_band(spark, sf_dir):
    r = gray(spark, sf_dir)
    first = -(-r.height // 2)
    band = _scanned(spark, _by_rows(r, "P5")).where((F.col("row") >= first) & (F.col("row") < -(-(r.height + 20) // 2)))
    return band.groupBy("row").agg(F.max("p0").alias("most"), F.sum("p0").alias("total"))


# ---- clustered dithers, curves by plane, crops by side

for _side, _own in point.CLUSTERS.items():
    _flat = [v for line in _own for v in line]
    query(f"SELECT row, col, (v > ({_flat}[(row % {_side} * {_side} + col % {_side} + 1)::INT] * 255) // {2 * _side * _side})::BIGINT AS p0 FROM img", f"cluster_{_side}")(lambda spark, sf_dir, n=_side: point.cluster_bitmap(gray(spark, sf_dir), n).flat())


@query("SELECT row, col, " + ", ".join(f"least(255, floor(pow({x} / 255.0::DOUBLE, {1 / p!r}::DOUBLE) * 255 + 0.5))::BIGINT AS p{k}" for k, (x, p) in enumerate(zip("vgb", (2.2, 1.5, 0.8)))) + " FROM img")
def gamma_planes(spark, sf_dir):
    return point.gamma_planes(rgb(spark, sf_dir), (2.2, 1.5, 0.8)).flat()


@query("""WITH b AS (SELECT min(row) AS top, min(col) AS l FROM img WHERE few <> 0)
SELECT row - top AS row, col - l AS col, few AS p0 FROM img, b WHERE row >= top AND col >= l""")
def crop_sides(spark, sf_dir):
    return select.crop(few(spark, sf_dir), (0,), ("top", "left")).select("row", "col", F.col("s")[0].alias("p0"))
