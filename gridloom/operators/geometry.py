"""Flips, scaling, rotation and other moves of cells.

Moves that only rename coordinates are projections.  Resampling is a join with a small
table of (out, in, weight) for each axis, made on the driver from the sizes alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.raster import CELL, Raster, clamp, full_grid, rounded


def _moved(r: Raster, row: Column, col: Column, **changed) -> Raster:
    return replace(r, px=r.px.select("image", row.cast("bigint").alias("row"), col.cast("bigint").alias("col"), "s"), **changed)


def flip(r: Raster, how: str) -> Raster:
    """leftright, topbottom, transpose, rotate90 (counterclockwise), rotate180, rotate270; several apart by commas are done in turn."""
    first, _, rest = how.partition(",")
    row, col, h, w = F.col("row"), F.col("col"), r.height, r.width
    to = {
        "leftright": (row, w - 1 - col, h, w), "topbottom": (h - 1 - row, col, h, w), "transpose": (col, row, w, h), "none": (row, col, h, w),
        "rotate90": (w - 1 - col, row, w, h), "rotate180": (h - 1 - row, w - 1 - col, h, w), "rotate270": (col, h - 1 - row, w, h),
    }[first]
    out = _moved(r, to[0], to[1], height=to[2], width=to[3])
    return flip(out, rest) if rest else out


def enlarge(r: Raster, n: int) -> Raster:
    """Each cell n x n times."""
    each = F.sequence(F.lit(0), F.lit(n - 1))
    px = r.px.withColumn("a", F.explode(each)).withColumn("b", F.explode(each))
    px = px.select("image", (F.col("row") * n + F.col("a")).alias("row"), (F.col("col") * n + F.col("b")).alias("col"), "s")
    return replace(r, px=px, height=r.height * n, width=r.width * n)


def tile(r: Raster, height: int, width: int) -> Raster:
    """Copies side by side up to a size."""
    span = lambda at, size, own: F.explode(F.sequence(F.col(at), F.lit(size - 1).cast("bigint"), F.lit(own).cast("bigint")))
    px = r.px.where((F.col("row") < height) & (F.col("col") < width))
    px = px.withColumn("r2", span("row", height, r.height)).withColumn("c2", span("col", width, r.width))
    return replace(r, px=px.select("image", F.col("r2").alias("row"), F.col("c2").alias("col"), "s"), height=height, width=width)


def sample(r: Raster, height: int, width: int) -> Raster:
    """Nearest cell of each new one: floor(place * old / new)."""
    g = full_grid(r, height, width)
    src = g.withColumn("r0", F.least(F.expr(f"row * {r.height} div {height}"), F.lit(r.height - 1))).withColumn("c0", F.least(F.expr(f"col * {r.width} div {width}"), F.lit(r.width - 1)))
    own = r.px.select("image", F.col("row").alias("r0"), F.col("col").alias("c0"), "s")
    return replace(r, px=src.join(own.hint("merge"), ["image", "r0", "c0"]).select(*CELL, "s"), height=height, width=width)


def area_weights(old: int, new: int, first: int = 0, last: int | None = None) -> list[tuple[int, int, float]]:
    """Shares of the old cells in the new ones from first to before last, by overlap."""
    out, scale = [], old / new
    for k in range(first, new if last is None else last):
        a, b = k * scale, (k + 1) * scale
        for j in range(int(a), min(old, math.ceil(b - 1e-12))):
            share = (min(b, j + 1) - max(a, j)) / scale
            if share > 1e-12:
                out.append((k, j, share))
    return out


def _sinc(x: float) -> float:
    return 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)


def _bspline3(x: float) -> float:
    x = abs(x)
    return 2 / 3 - x * x + x**3 / 2 if x < 1 else (2 - x) ** 3 / 6 if x < 2 else 0.0


def _cubic(b: float, c: float) -> Callable[[float], float]:
    def f(x: float) -> float:
        x = abs(x)
        if x < 1:
            return ((12 - 9 * b - 6 * c) * x**3 + (-18 + 12 * b + 6 * c) * x**2 + 6 - 2 * b) / 6
        if x < 2:
            return ((-b - 6 * c) * x**3 + (6 * b + 30 * c) * x**2 + (-12 * b - 48 * c) * x + 8 * b + 24 * c) / 6
        return 0.0

    return f


def _bessel(x: float) -> float:
    if x == 0:
        return math.pi / 4
    z, term, total, k = math.pi * x / 2, math.pi * x / 2, 0.0, 0
    while abs(term) > 1e-17 * max(1.0, abs(total)) or k < abs(z):
        total += term
        k += 1
        term *= -z * z / (k * (k + 1))
    return total / (2 * x)


def _i0(x: float) -> float:
    term, total, k = 1.0, 0.0, 0
    while term > 1e-17 * total:
        total += term
        k += 1
        term *= (x / 2 / k) ** 2
    return total


#: Name -> (kernel, how far it reaches, whether it needs a window).
FILTERS: dict[str, tuple[Callable[[float], float], float, bool]] = {
    "box": (lambda x: 1.0 if -0.5 <= x < 0.5 else 0.0, 0.5, False),
    "triangle": (lambda x: max(0.0, 1 - abs(x)), 1.0, False),
    "quadratic": (lambda x: 0.75 - x * x if abs(x) < 0.5 else (abs(x) - 1.5) ** 2 / 2 if abs(x) < 1.5 else 0.0, 1.5, False),
    "cubic": (_bspline3, 2.0, False),
    "catrom": (_cubic(0.0, 0.5), 2.0, False),
    "mitchell": (_cubic(1 / 3, 1 / 3), 2.0, False),
    "gauss": (lambda x: math.exp(-2 * x * x) * math.sqrt(2 / math.pi), 1.25, False),
    "sinc": (_sinc, 4.0, True),
    "bessel": (_bessel, 3.2383, True),
    "hanning": (lambda x: 0.5 + 0.5 * math.cos(math.pi * x), 1.0, False),
    "hamming": (lambda x: 0.54 + 0.46 * math.cos(math.pi * x), 1.0, False),
    "blackman": (lambda x: 0.42 + 0.5 * math.cos(math.pi * x) + 0.08 * math.cos(2 * math.pi * x), 1.0, False),
    "kaiser": (lambda x: _i0(6.5 * math.sqrt(max(0.0, 1 - x * x))) / _i0(6.5), 1.0, False),
    "normal": (lambda x: math.exp(-x * x / 2) / math.sqrt(2 * math.pi), 1.0, False),
    "hermite": (lambda x: (2 * abs(x) - 3) * x * x + 1 if abs(x) < 1 else 0.0, 1.0, False),
    "lanczos": (lambda x: _sinc(x) * _sinc(x / 3) if abs(x) < 3 else 0.0, 3.0, False),
}


def filter_weights(old: int, new: int, name: str, first: int = 0, last: int | None = None) -> list[tuple[int, int, float]]:
    """Normalised weights of the old cells in the new ones from first to before last, by a kernel widened when shrinking."""
    f, reach, windowed = FILTERS[name]
    wide = max(1.0, old / new)
    out = []
    for k in range(first, new if last is None else last):
        centre = (k + 0.5) * old / new
        near = range(max(0, math.floor(centre - reach * wide)), min(old, math.ceil(centre + reach * wide)))
        own = {}
        for j in near:
            x = (j + 0.5 - centre) / wide
            w = f(x) * (FILTERS["hanning"][0](x / reach) if windowed and abs(x) <= reach else 1.0)
            if w:
                own[j] = w
        total = sum(own.values()) or 1.0
        out += [(k, j, w / total) for j, w in own.items()]
    return out


def _resampled(px: DataFrame, axis: str, old: int, new: int, name: str | None, depth: int, unit: int = 0) -> DataFrame:
    """x, an array of doubles, summed by weight along an axis.  The table of weights has a few entries for each place of the axis and is made by the tasks that read it."""
    other = "col" if axis == "row" else "row"

    def weights(batches):
        for pdf in batches:
            own = [w for k in pdf.id.tolist() for w in (area_weights(old, new, k, k + 1) if name is None else filter_weights(old, new, name, k, k + 1))]
            yield pd.DataFrame(own, columns=["out", axis, "w"])

    table = px.sparkSession.range(new).mapInPandas(weights, f"out bigint, {axis} bigint, w double")
    if unit:
        table = table.withColumn("w", F.floor(F.col("w") * unit + 0.5).cast("double"))
    return px.join(table, axis).groupBy("image", F.col("out").alias(axis), other).agg(F.array(*(F.sum(F.col("x")[k] * F.col("w")) for k in range(depth))).alias("x"))


def resample(r: Raster, height: int, width: int, name: str | None = None) -> Raster:
    """Another size by area mixing or one of FILTERS."""
    px = r.px.select(*CELL, F.transform("s", lambda x: x.cast("double")).alias("x"))
    px = _resampled(_resampled(px, "row", r.height, height, name, r.depth), "col", r.width, width, name, r.depth)
    return replace(r, px=px.select(*CELL, F.transform("x", lambda x: clamp(F.floor(x + 0.5 + 1e-9), r.maxval)).alias("s")), height=height, width=width)


#: Fixed-point unit of sample_fixed.
UNIT = 4096


def resample_fixed(r: Raster, height: int, width: int) -> Raster:
    """Area mixing with weights in 12-bit fixed point."""
    px = r.px.select(*CELL, F.transform("s", lambda x: x.cast("double")).alias("x"))
    for axis, old, new in (("row", r.height, height), ("col", r.width, width)):
        px = _resampled(px, axis, old, new, None, r.depth, UNIT).withColumn("x", F.transform("x", lambda x: F.floor((x + UNIT // 2) / UNIT).cast("double")))
    return replace(r, px=px.select(*CELL, F.transform("x", lambda x: clamp(x, r.maxval)).alias("s")), height=height, width=width)


def stretch(r: Raster, x_scale: int, y_scale: int, edge: str = "repeat") -> Raster:
    """Whole-number enlargement with straight interpolation to the next cell; the last is repeated, runs to black, or is dropped."""
    px, planes = r.px, range(r.depth)
    for axis, other, n in (("col", "row", x_scale), ("row", "col", y_scale)):
        w = Window.partitionBy("image", other).orderBy(axis)
        next_ = F.lead("s").over(w)
        px = px.withColumn("t", F.coalesce(next_, F.col("s") if edge != "black" else F.transform("s", lambda x: x * 0)))
        if edge == "drop":
            px = px.withColumn("more", next_.isNotNull()).where("more").drop("more")
        px = px.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        mix = F.array(*(F.floor((F.col("s")[p] * (n - F.col("k")) + F.col("t")[p] * F.col("k")) / F.lit(n)).cast("bigint") for p in planes))
        px = px.select("image", other, (F.col(axis) * n + F.col("k")).alias(axis), mix.alias("s"))
    drop = int(edge == "drop")
    return replace(r, px=px.select(*CELL, "s"), height=(r.height - drop) * y_scale, width=(r.width - drop) * x_scale)


def shear(r: Raster, degrees: float, smooth: bool = True, background: tuple[int, ...] | None = None) -> Raster:
    """Rows moved sideways in proportion to their number; smooth mixes each cell with the one before by the fraction."""
    slope = math.tan(math.radians(degrees))
    extra = int((r.height * abs(slope)) + 0.999999)
    bg = F.array(*(F.lit(int(v)).cast("bigint") for v in (background or (0,) * r.depth)))
    shift = F.col("row") * abs(slope) if slope > 0 else (r.height - F.col("row")) * abs(slope)
    px = r.px.withColumn("shift", shift).withColumn("whole", F.floor(F.col("shift") if smooth else F.col("shift") + 0.5).cast("bigint"))
    part = F.floor((F.col("shift") - F.col("whole")) * UNIT).cast("bigint") if smooth else F.lit(0).cast("bigint")
    px = px.withColumn("part", part)
    w = Window.partitionBy("image", "row").orderBy("col")
    mix = lambda a, b: F.zip_with(a, b, lambda x, y: F.floor((y * F.col("part") + x * (UNIT - F.col("part")) + UNIT // 2) / F.lit(UNIT)).cast("bigint"))
    body = px.select("image", "row", (F.col("col") + F.col("whole")).alias("col"), mix(F.col("s"), F.coalesce(F.lag("s").over(w), bg)).alias("s"))
    tail = px.where(F.col("col") == r.width - 1).select("image", "row", (F.col("col") + F.col("whole") + 1).alias("col"), mix(bg, F.col("s")).alias("s"))
    width = r.width + extra
    got = body.union(tail).where(F.col("col") < width)
    span = F.floor(shift if smooth else shift + 0.5), F.floor(shift if smooth else shift + 0.5) + r.width
    return replace(r, px=_within(r, r.height, width, span, r.width + 1, lambda g: g.join(got, list(CELL), "left"), bg), width=width)


def _within(r: Raster, height: int, width: int, span: tuple[Column, Column], across: int, found: Callable[[DataFrame], DataFrame], bg: Column) -> DataFrame:
    """The cells of a new grid: those within the span of their line with what is found for them, the rest background that's neither joined nor shuffled."""
    own = found(full_grid(r, height, width, span, across)).select(*CELL, F.coalesce("s", bg).alias("s"))
    return own.unionByName(full_grid(r, height, width, span, beyond=True).select(*CELL, bg.alias("s")))


def warp(r: Raster, height: int, width: int, source: Callable[[Column, Column], tuple[Column, Column]], background: tuple[int, ...] | None = None, span: tuple[Column, Column] | None = None, across: int | None = None) -> Raster:
    """Each cell of a new grid shows the old cell nearest to source(row, col); outside is background, as is all beyond the span of a line."""
    bg = F.array(*(F.lit(int(v)).cast("bigint") for v in (background or (0,) * r.depth)))
    row, col = source(F.col("row"), F.col("col"))
    own = r.px.select("image", F.col("row").alias("r0"), F.col("col").alias("c0"), "s")

    def found(g: DataFrame) -> DataFrame:
        g = g.withColumn("r0", F.floor(row + 0.5).cast("bigint")).withColumn("c0", F.floor(col + 0.5).cast("bigint"))
        return g.join(own.hint("merge"), ["image", "r0", "c0"], "left")

    span = span or (F.lit(0), F.lit(width - 1))
    return replace(r, px=_within(r, height, width, span, across or width, found, bg), height=height, width=width)


def rotate(r: Raster, degrees: float, background: tuple[int, ...] | None = None) -> Raster:
    """Counterclockwise about the middle, onto a canvas that holds all of it.

    The canvas of a tall image has far more cells than the image; a line of it meets the image
    between two columns at most, and only what lies there, or two cells beside, is joined.
    """
    a = math.radians(degrees)
    c, s = math.cos(a), math.sin(a)
    width = math.ceil(abs(r.width * c) + abs(r.height * s) - 1e-9)
    height = math.ceil(abs(r.width * s) + abs(r.height * c) - 1e-9)

    def source(row: Column, col: Column) -> tuple[Column, Column]:
        x, y = col - (width - 1) / 2, row - (height - 1) / 2
        return y * c + x * s + (r.height - 1) / 2, x * c - y * s + (r.width - 1) / 2

    y, lows, highs, across = F.col("row") - (height - 1) / 2, [F.lit(0.0)], [F.lit(width - 1.0)], width
    for along, size, shift in ((s, r.height, -y * c), (c, r.width, y * s)):  # |x * along - shift| <= size / 2
        if abs(along) > 1e-9:
            ends = [(shift + sign * size / 2) / along + (width - 1) / 2 for sign in (-1, 1)]
            lows.append(F.least(*ends) - 2)
            highs.append(F.greatest(*ends) + 2)
            across = min(across, math.ceil(size / abs(along)) + 5)
    return warp(r, height, width, source, background, (F.ceil(F.greatest(*lows)), F.floor(F.least(*highs))), across)


def perspective(r: Raster, corners: list[tuple[float, float]], height: int, width: int) -> Raster:
    """The quadrilateral with these corners (x, y; top left, top right, bottom left, bottom right) as a rectangle."""
    import numpy as np

    rows, want = [], []
    for (x, y), (u, v) in zip(corners, ((0, 0), (width - 1, 0), (0, height - 1), (width - 1, height - 1)), strict=True):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        want += [x, y]
    m = [float(k) for k in np.linalg.solve(np.array(rows, float), np.array(want, float))] + [1.0]

    def source(row: Column, col: Column) -> tuple[Column, Column]:
        d = F.nullif(m[6] * col + m[7] * row + m[8], F.lit(0.0))
        return (m[3] * col + m[4] * row + m[5]) / d, (m[0] * col + m[1] * row + m[2]) / d

    return warp(r, height, width, source)


def pad(r: Raster, left: int = 0, right: int = 0, top: int = 0, bottom: int = 0, fill: tuple[int, ...] | None = None) -> Raster:
    """A border of one colour."""
    bg = F.array(*(F.lit(int(v)).cast("bigint") for v in (fill or (0,) * r.depth)))
    height, width = r.height + top + bottom, r.width + left + right
    px = r.px.select("image", (F.col("row") + top).alias("row"), (F.col("col") + left).alias("col"), "s")
    g = full_grid(r, height, width).where(~(F.col("row").between(top, top + r.height - 1) & F.col("col").between(left, left + r.width - 1)))
    return replace(r, px=px.unionByName(g.withColumn("s", bg)), height=height, width=width)


def pad_to(r: Raster, height: int, width: int, halign: float = 0.5, valign: float = 0.5, fill: tuple[int, ...] | None = None) -> Raster:
    """A border up to a size, divided by ratio."""
    dx, dy = max(0, width - r.width), max(0, height - r.height)
    left, top = int(dx * halign + 0.5), int(dy * valign + 0.5)
    return pad(r, left, dx - left, top, dy - top, fill)


def margin(r: Raster, n: int, fill: tuple[int, ...] | None = None) -> Raster:
    return pad(r, n, n, n, n, fill)


def globe(r: Raster, strips: int) -> Raster:
    """Strips that narrow to the poles, to be cut out and glued round a ball; black between.

    Columns beyond the last whole strip begin another one.  At the pole itself, where a strip has no width, all is black.
    """
    w = r.width // strips
    factor = F.sin(F.lit(math.pi) * F.col("row") / r.height)
    border = rounded((1 - factor) * w / 2)
    x = F.col("col") % w
    g = full_grid(r, r.height, r.width).withColumn("inside", (x >= border) & (x <= w - border) & (factor > 0))
    from_ = F.col("col") - x + F.floor((x - border) / F.nullif(factor, F.lit(0.0)))
    g = g.withColumn("c0", F.when(F.col("inside"), F.least(F.lit(r.width - 1), from_)).cast("bigint"))
    own = r.px.select("image", "row", F.col("col").alias("c0"), "s")
    return replace(r, px=g.join(own, ["image", "row", "c0"], "left").select(*CELL, F.coalesce("s", F.array(*[F.lit(0).cast("bigint")] * r.depth)).alias("s")))


def drip(r: Raster) -> Raster:
    """Every gray cell falls by a quarter of its value, within the image; the lowest source wins, cells nobody reached are 0."""
    to = F.least(F.lit(r.height - 1).cast("bigint"), F.col("row") + F.floor(r.plane() / F.lit(4)).cast("bigint"))
    got = r.px.groupBy("image", to.alias("to"), "col").agg(F.max_by("s", "row").alias("s")).withColumnRenamed("to", "row")
    full = full_grid(r, r.height, r.width).join(got, list(CELL), "left")
    return replace(r, px=full.select(*CELL, F.coalesce("s", F.array(F.lit(0).cast("bigint"))).alias("s")))


def jitter(r: Raster, most: int, seed: int) -> Raster:
    """Every row moved sideways by a seeded number of columns, edge cells repeated."""
    move = F.pmod(F.xxhash64(F.lit(seed), "image", "row"), F.lit(2 * most + 1)) - most
    g = full_grid(r, r.height, r.width).withColumn("c0", clamp(F.col("col") - move, r.width - 1))
    own = r.px.select("image", "row", F.col("col").alias("c0"), "s")
    return replace(r, px=g.join(own.hint("merge"), ["image", "row", "c0"]).select(*CELL, "s"))


def spread(r: Raster, most: int, seed: int) -> Raster:
    """Every cell shows a seeded one at most that far away, within the image."""
    move = lambda axis, salt, size: clamp(F.col(axis) + F.pmod(F.xxhash64(F.lit(seed + salt), *CELL), F.lit(2 * most + 1)) - most, size - 1)
    g = full_grid(r, r.height, r.width).withColumn("r0", move("row", 0, r.height)).withColumn("c0", move("col", 1, r.width))
    own = r.px.select("image", F.col("row").alias("r0"), F.col("col").alias("c0"), "s")
    return replace(r, px=g.join(own.hint("merge"), ["image", "r0", "c0"]).select(*CELL, "s"))


