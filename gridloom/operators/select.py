"""Cutting, splitting and re-tiling: filters on coordinates, pushed into the scan where the cells come from one."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.raster import CELL, Raster, full_grid


def _span(size: int, first: int | None, last: int | None, n: int | None) -> tuple[int, int]:
    """First and past-the-last place from any two of first, last and number; negatives count from the far edge."""
    at = lambda k: k + size if k is not None and k < 0 else k
    first, last = at(first), at(last)
    if n is None:
        first, last = (0 if first is None else first), (size - 1 if last is None else last)
    elif first is None and last is not None:
        first = last - n + 1
    else:
        first = first or 0
        last = first + n - 1
    if last < first:
        raise ValueError(f"nothing from {first} to {last}")
    return first, last + 1


def cut(r: Raster, left=None, right=None, width=None, top=None, bottom=None, height=None, pad: bool = False) -> Raster:
    """A rectangle of each image; beyond its edges is an error, or black with pad."""
    (a, b), (c, d) = _span(r.width, left, right, width), _span(r.height, top, bottom, height)
    if not pad and (a < 0 or c < 0 or b > r.width or d > r.height):
        raise ValueError(f"{c}..{d - 1}, {a}..{b - 1} isn't within {r.height} x {r.width}")
    px = r.px.where(F.col("row").between(c, d - 1) & F.col("col").between(a, b - 1))
    px = px.select("image", (F.col("row") - c).alias("row"), (F.col("col") - a).alias("col"), "s")
    out = replace(r, px=px, height=d - c, width=b - a)
    if pad and (a < 0 or c < 0 or b > r.width or d > r.height):
        black = F.array(*[F.lit(0).cast("bigint")] * r.depth)
        out = replace(out, px=full_grid(r, d - c, b - a).join(px, list(CELL), "left").select(*CELL, F.coalesce("s", black).alias("s")))
    return out


def deinterlace(r: Raster, odd: bool = False) -> Raster:
    """Every second row."""
    k = int(odd)
    px = r.px.where(F.col("row") % 2 == k).withColumn("row", F.expr("row div 2"))
    return replace(r, px=px, height=(r.height + 1 - k) // 2)


def series(r: Raster, row: int | None = None, col: int | None = None, plane: int | None = None) -> DataFrame:
    """The samples along a row or a column, numbered from 0: image, at, and the planes."""
    along, fixed, at = ("col", "row", row) if row is not None else ("row", "col", col)
    planes = [r.plane(k).alias(f"p{k}") for k in (range(r.depth) if plane is None else [plane])]
    return r.px.where(F.col(fixed) == at).select("image", F.col(along).alias("at"), *planes)


def bounds(r: Raster, background: tuple[int, ...]) -> DataFrame:
    """image and the smallest rectangle that holds all cells of another colour."""
    other = r.px.where(F.col("s") != F.array(*(F.lit(int(v)).cast("bigint") for v in background)))
    return other.groupBy("image").agg(F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("col").alias("left"), F.max("col").alias("right"))


def crop(r: Raster, background: tuple[int, ...], sides: tuple[str, ...] = ("top", "bottom", "left", "right")) -> DataFrame:
    """Each image cut to its bounds on the sides that are named: image, row, col, s.  Sizes may now differ by image."""
    whole = {"top": 0, "bottom": r.height - 1, "left": 0, "right": r.width - 1}
    box = bounds(r, background).select("image", *(F.col(c) if c in sides else F.lit(v).cast("bigint").alias(c) for c, v in whole.items()))
    px = r.px.join(box, "image").where(F.col("row").between(F.col("top"), F.col("bottom")) & F.col("col").between(F.col("left"), F.col("right")))
    return px.select("image", (F.col("row") - F.col("top")).alias("row"), (F.col("col") - F.col("left")).alias("col"), "s")


def background_of_corners(r: Raster) -> DataFrame:
    """image and the colour that most of its four corners have, ties to the one at the top left first."""
    corner = r.px.where(F.col("row").isin(0, r.height - 1) & F.col("col").isin(0, r.width - 1))
    n = corner.groupBy("image", "s").agg(F.count("*").alias("n"), F.min(F.struct("row", "col")).alias("first"))
    place = F.row_number().over(Window.partitionBy("image").orderBy(F.desc("n"), "first"))
    return n.withColumn("k", place).where("k = 1").select("image", "s")


def dice(r: Raster, width: int, height: int, h_overlap: int = 0, v_overlap: int = 0) -> DataFrame:
    """Tiles, maybe overlapping: image, tile_row, tile_col, row, col, s."""

    def tiles(at: str, size: int, step: int, whole: int):
        most = max(0, -(-(whole - size) // step)) if whole > size else 0
        first = F.greatest(F.lit(0), F.ceil((F.col(at) - size + 1) / F.lit(step))).cast("bigint")
        return F.sequence(first, F.greatest(first, F.least(F.lit(most), F.floor(F.col(at) / F.lit(step))).cast("bigint")))

    px = r.px.withColumn("tile_row", F.explode(tiles("row", height, height - v_overlap, r.height)))
    px = px.withColumn("tile_col", F.explode(tiles("col", width, width - h_overlap, r.width)))
    return px.select("image", "tile_row", "tile_col", (F.col("row") - F.col("tile_row") * (height - v_overlap)).alias("row"), (F.col("col") - F.col("tile_col") * (width - h_overlap)).alias("col"), "s")


def split(r: Raster, path: str) -> None:
    """Each image in a folder of its own."""
    r.px.write.partitionBy("image").parquet(path)


def retile(r: Raster, x_tiles: int, y_tiles: int, x_step: int, y_step: int) -> Raster:
    """Overlapping windows side by side: tile (i, j) shows the image from (i * y_step, j * x_step) on."""
    tw, th = r.width - (x_tiles - 1) * x_step, r.height - (y_tiles - 1) * y_step
    if tw <= 0 or th <= 0:
        raise ValueError("steps leave no tile")
    span = lambda at, tile, step, n: F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (F.col(at) - k * step).between(0, tile - 1))
    px = r.px.withColumn("i", F.explode(span("row", th, y_step, y_tiles))).withColumn("j", F.explode(span("col", tw, x_step, x_tiles)))
    px = px.select("image", (F.col("row") - F.col("i") * y_step + F.col("i") * th).alias("row"), (F.col("col") - F.col("j") * x_step + F.col("j") * tw).alias("col"), "s")
    return replace(r, px=px, height=th * y_tiles, width=tw * x_tiles)
