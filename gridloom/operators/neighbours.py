"""Operators on a cell and those around it.

``block`` gives every cell a matrix of its neighbourhood by two windows: along rows, then
along columns of what that gave.  Windows are partitioned by (image, row) and (image,
col), so no partition holds more than a line of an image, and cells are shuffled twice
whatever the neighbourhood's size.  Images must be complete; outside is null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.raster import CELL, Raster, clamp, rounded


def block(r: Raster, up: int = 1, side: int = 1) -> DataFrame:
    """CELL, s and nb: 2 * up + 1 lists of 2 * side + 1 cells, null outside the image."""
    across = Window.partitionBy("image", "row").orderBy("col")
    down = Window.partitionBy("image", "col").orderBy("row")
    px = r.px.withColumn("line", F.array(*(F.lead("s", k).over(across) if k > 0 else F.lag("s", -k).over(across) for k in range(-side, side + 1))))
    return px.withColumn("nb", F.array(*(F.lead("line", k).over(down) if k > 0 else F.lag("line", -k).over(down) for k in range(-up, up + 1)))).select(*CELL, "s", "nb")


def _cells(up: int, side: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(2 * up + 1) for b in range(2 * side + 1)]


def at(a: int, b: int, plane: int) -> Column:
    """The sample at place (a, b) of nb, null outside."""
    return F.get(F.get(F.get("nb", F.lit(a)), F.lit(b)), F.lit(plane))


def _sum(parts) -> Column:
    return reduce(lambda x, y: x + y, parts)


def _inner(r: Raster, up: int = 1, side: int = 1) -> Column:
    return F.col("row").between(up, r.height - 1 - up) & F.col("col").between(side, r.width - 1 - side)


def per_plane(r: Raster, f: Callable[[Callable[[int, int], Column]], Column], up: int = 1, side: int = 1, border: str = "copy", **changed) -> Raster:
    """f, given a function of places in the neighbourhood, in each plane; cells whose neighbourhood isn't whole are copied, black, or computed too."""
    planes = range(r.depth)
    new = F.array(*(f(lambda a, b, k=k: at(a, b, k)).cast("bigint") for k in planes))
    edge = {"copy": F.col("s"), "black": F.transform("s", lambda x: x * 0), "clip": None}[border]
    s = new if edge is None else F.when(_inner(r, up, side), new).otherwise(edge)
    return replace(r, px=block(r, up, side).select(*CELL, s.alias("s")), **changed)


def convolve(r: Raster, kernel: list[list[float]]) -> Raster:
    """Weighted sums, rounded and held within the scale; the border is copied."""
    up, side = len(kernel) // 2, len(kernel[0]) // 2
    f = lambda v: clamp(F.floor(_sum(F.lit(float(w)) * v(a, b) for a, line in enumerate(kernel) for b, w in enumerate(line)) + 0.5), r.maxval)
    return per_plane(r, f, up, side)


def kernel_of(samples: list[list[int]], maxval: int, offset: bool = True) -> list[list[float]]:
    """Weights from an image: with offset, samples stand for -1..1 around the middle; else for 0..1."""
    return [[2.0 * v / maxval - 1.0 if offset else v / maxval for v in line] for line in samples]


def box(r: Raster, height: int = 3, width: int = 3) -> Raster:
    """The mean of a rectangle around each cell: two running windows, not a neighbourhood of its cells."""
    up, side = height // 2, width // 2
    across = Window.partitionBy("image", "row").orderBy("col").rowsBetween(-side, side)
    down = Window.partitionBy("image", "col").orderBy("row").rowsBetween(-up, up)
    px = r.px.withColumn("h", F.array(*(F.sum(r.plane(k)).over(across) for k in range(r.depth))))
    px = px.withColumn("t", F.array(*(F.sum(F.col("h")[k]).over(down) for k in range(r.depth))))
    mean = F.transform("t", lambda x: clamp(F.floor(x / F.lit(float(height * width)) + 0.5), r.maxval))
    return replace(r, px=px.select(*CELL, F.when(_inner(r, up, side), mean).otherwise(F.col("s")).alias("s")))


def edges(r: Raster) -> Raster:
    """Sobel magnitude over 1.8, held at maxval; black border."""

    def f(v):
        x = v(0, 2) + 2 * v(1, 2) + v(2, 2) - v(0, 0) - 2 * v(1, 0) - v(2, 0)
        y = v(0, 0) + 2 * v(0, 1) + v(0, 2) - v(2, 0) - 2 * v(2, 1) - v(2, 2)
        return clamp(F.floor(F.sqrt((x * x + y * y).cast("double")) / 1.8), r.maxval)

    return per_plane(r, f, border="black")


def enhance(r: Raster, n: int = 9) -> Raster:
    """Sharper by the difference from the mean of 3 x 3; the border is copied."""
    phi = n / 10
    f = lambda v: clamp(F.floor((v(1, 1) - phi * _sum(v(a, b) for a, b in _cells(1, 1)) / 9) / (1 - phi) + 0.5), r.maxval)
    return per_plane(r, f)


def relief(r: Raster) -> Raster:
    """The cell below and to the left less the one to the right, around the middle of the scale; black border.

    The result isn't held within the scale: what is kept is what the one or two bytes of a raw sample hold.
    """
    size = 256 if r.maxval < 256 else 65536
    return per_plane(r, lambda v: F.pmod(v(2, 0) + (r.maxval // 2 - v(1, 2)), F.lit(size)), border="black")


def _around(r: Raster, template: list[list[int]], worst, plane: int) -> list[Column]:
    return [F.coalesce(at(a, b, plane), F.lit(worst).cast("bigint")) for a, line in enumerate(template) for b, w in enumerate(line) if w]


def dilate(r: Raster, template: list[list[int]]) -> Raster:
    """The largest sample under the template, within the image."""
    up, side = len(template) // 2, len(template[0]) // 2
    new = F.array(*(F.array_max(F.array(*_around(r, template, 0, k))) for k in range(r.depth)))
    return replace(r, px=block(r, up, side).select(*CELL, new.alias("s")))


def erode(r: Raster, template: list[list[int]]) -> Raster:
    """The smallest sample under the template, within the image."""
    up, side = len(template) // 2, len(template[0]) // 2
    new = F.array(*(F.array_min(F.array(*_around(r, template, r.maxval, k))) for k in range(r.depth)))
    return replace(r, px=block(r, up, side).select(*CELL, new.alias("s")))


def opening(r: Raster, template: list[list[int]]) -> Raster:
    return dilate(erode(r, template), template)


def closing(r: Raster, template: list[list[int]]) -> Raster:
    return erode(dilate(r, template), template)


def modal(r: Raster, n: int = 3) -> Raster:
    """The commonest sample within n cells, the smallest of equals, within the image."""

    def f(k):
        all_ = F.array_sort(F.array_compact(F.array(*(at(a, b, k) for a, b in _cells(n, n)))))
        best = F.aggregate(
            all_, F.struct(F.lit(-1).cast("bigint").alias("v"), F.lit(0).alias("run"), F.lit(-1).cast("bigint").alias("best"), F.lit(0).alias("most")),
            lambda acc, x: _run(acc, x),
        )
        return best["best"]

    return replace(r, px=block(r, n, n).select(*CELL, F.array(*(f(k) for k in range(r.depth))).alias("s")))


def _run(acc: Column, x: Column) -> Column:
    run = F.when(acc["v"] == x, acc["run"] + 1).otherwise(F.lit(1))
    more = run > acc["most"]
    return F.struct(x.alias("v"), run.cast("int").alias("run"), F.when(more, x).otherwise(acc["best"]).alias("best"), F.when(more, run).otherwise(acc["most"]).cast("int").alias("most"))


def _eight() -> list[tuple[int, int]]:
    return [(a, b) for a, b in _cells(1, 1) if (a, b) != (1, 1)]


def sharpness(r: Raster) -> DataFrame:
    """Mean difference from the eight neighbours over inner cells, by all cells: image, sharpness."""
    d = _sum(F.abs(F.col("s")[k] - at(a, b, k)) for k in range(r.depth) for a, b in _eight())
    inner = block(r).where(_inner(r)).select("image", d.alias("d"))
    return inner.groupBy("image").agg((F.sum("d") / F.lit(float(r.height * r.width * r.depth * 8)) / F.lit(float(r.maxval))).alias("sharpness"))


def sharpness_map(r: Raster) -> Raster:
    """Sum of the differences from the eight neighbours; black border."""
    return per_plane(r, lambda v: _sum(F.abs(v(1, 1) - v(a, b)) for a, b in _eight()), border="black")


def clean(r: Raster, least: int = 1, color: int | None = None) -> Raster:
    """Cells of a bitmap with fewer than least neighbours of their colour change it; outside is white."""
    here = F.col("s")[0]
    alike = _sum((F.coalesce(at(a, b, 0), F.lit(1)) == here).cast("int") for a, b in _eight())
    flip = alike < least
    if color is not None:
        flip = flip & (here == color)
    return replace(r, px=block(r).select(*CELL, F.array(F.when(flip, 1 - here).otherwise(here)).alias("s")))


def life(r: Raster) -> Raster:
    """One step of the game of life; white lives, outside is dead."""
    n = _sum(F.coalesce(at(a, b, 0), F.lit(0).cast("bigint")) for a, b in _eight())
    alive = (n == 3) | ((n == 2) & (F.col("s")[0] == 1))
    return replace(r, px=block(r).select(*CELL, F.array(alive.cast("bigint")).alias("s")))


def density(r: Raster, width: int, height: int) -> Raster:
    """A bitmap to gray: the share of white in a rectangle around each cell, within the image, on a scale of its cells."""
    up, side = height // 2, width // 2
    across = Window.partitionBy("image", "row").orderBy("col").rowsBetween(-side, width - side - 1)
    down = Window.partitionBy("image", "col").orderBy("row").rowsBetween(-up, height - up - 1)
    px = r.px.withColumn("w", F.sum(r.plane()).over(across)).withColumn("n", F.count("*").over(across))
    px = px.withColumn("w", F.sum("w").over(down)).withColumn("n", F.sum("n").over(down))
    maxval = min(65535, width * height)
    return replace(r, px=px.select(*CELL, F.array(F.floor(F.col("w") * maxval / F.col("n")).cast("bigint")).alias("s")), maxval=maxval)


def shrink_bitmap(r: Raster, n: int, value: float = 0.5) -> Raster:
    """n x n cells of a bitmap to one: white where their share of white is value or more."""
    px = r.px.groupBy("image", F.expr(f"row div {n}").alias("row"), F.expr(f"col div {n}").alias("col")).agg(F.avg(r.plane()).alias("w"))
    px = px.where((F.col("row") < r.height // n) & (F.col("col") < r.width // n))
    return replace(r, px=px.select(*CELL, F.array((F.col("w") >= value).cast("bigint")).alias("s")), height=r.height // n, width=r.width // n)


def antialias(r: Raster, background: int = 0, foreground: int | None = None, weight: float = 1 / 3) -> Raster:
    """Cells where background and foreground meet in a step take the weighted mean of 3 x 3; the border is copied."""
    front = r.maxval if foreground is None else foreground
    side = (1 - weight) / 8

    def f(v):
        step = lambda x: ((v(0, 1) == x).cast("int") + (v(2, 1) == x).cast("int") >= 1) & ((v(1, 0) == x).cast("int") + (v(1, 2) == x).cast("int") >= 1)
        mean = F.floor(v(1, 1) * weight + side * _sum(v(a, b) for a, b in _eight()) + 0.5)
        stair = ((v(1, 1) == background) & step(front)) | ((v(1, 1) == front) & step(background))
        return F.when(stair, clamp(mean, r.maxval)).otherwise(v(1, 1))

    return per_plane(r, f)


def trimmed_mean(r: Raster, alpha: float) -> Raster:
    """The mean of 3 x 3 without the alpha share of the largest and of the smallest; 0.5 is the median.  The border repeats the nearest cells."""

    def f(k):
        near = F.array_sort(F.array(*(F.coalesce(at(a, b, k), at(1, b, k), at(a, 1, k), at(1, 1, k)) for a, b in _cells(1, 1))))
        drop = min(4, int(alpha * 9 + 1e-9)) if alpha < 0.5 else 4
        kept = F.slice(near, drop + 1, 9 - 2 * drop)
        return rounded(F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, x: a + x) / F.lit(float(9 - 2 * drop)))

    return replace(r, px=block(r).select(*CELL, F.array(*(f(k) for k in range(r.depth))).alias("s")))


def optimal_estimate(r: Raster, noise: float) -> Raster:
    """Cells drawn to the local mean where the local variance is within that of the noise (a share of the scale); the border is copied."""
    level = (noise * r.maxval) ** 2

    def f(v):
        mean = _sum(v(a, b) for a, b in _cells(1, 1)) / 9.0
        var = _sum(v(a, b) * v(a, b) for a, b in _cells(1, 1)) / 9.0 - mean * mean
        share = F.coalesce(F.greatest(var - level, F.lit(0.0)) / F.nullif(F.greatest(var, F.lit(level)), F.lit(0.0)), F.lit(0.0))
        return clamp(F.floor(mean + share * (v(1, 1) - mean) + 0.5), r.maxval)

    return per_plane(r, f)
