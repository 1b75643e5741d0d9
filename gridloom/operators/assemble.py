"""Images put together: concatenation, sheets, palettes over several, composites of other operators."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from gridloom.operators import aggregate, combine, geometry, neighbours, point
from gridloom.raster import CELL, Raster, full_grid


def _named(r: Raster, image: str) -> Raster:
    return replace(r, px=r.px.withColumn("image", F.lit(image)))


def promote(*parts: Raster) -> list[Raster]:
    """All on the largest depth and maxval."""
    depth, maxval = max(p.depth for p in parts), max(p.maxval for p in parts)
    out = []
    for p in parts:
        p = point.depth(p, maxval) if p.maxval != maxval else p
        out.append(p if p.depth == depth else p.with_cell(F.array(*[p.plane(0)] * depth), depth=depth))
    return out


def concat(parts: list[Raster], down: bool = False, justify: str = "min", fill: tuple[int, ...] | None = None, image: str = "a") -> Raster:
    """Side by side, or one below the other; smaller ones at the start, middle or end of the other axis."""
    parts = promote(*parts)
    height = sum(p.height for p in parts) if down else max(p.height for p in parts)
    width = max(p.width for p in parts) if down else sum(p.width for p in parts)
    place = lambda size, own: {"min": 0, "center": (size - own) // 2, "max": size - own}[justify]
    at, moved = 0, []
    for p in parts:
        dr, dc = (at, place(width, p.width)) if down else (place(height, p.height), at)
        at += p.height if down else p.width
        moved.append(p.px.select(F.lit(image).alias("image"), (F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), "s"))
    px = reduce(lambda a, b: a.unionByName(b), moved)
    out = Raster(px, height, width, parts[0].maxval, parts[0].depth)
    if any((p.width != width) if down else (p.height != height) for p in parts):
        bg = F.array(*(F.lit(int(v)).cast("bigint") for v in (fill or (0,) * out.depth)))
        full = full_grid(_named(parts[0], image), height, width)
        out = replace(out, px=full.join(px, list(CELL), "left").select(*CELL, F.coalesce("s", bg).alias("s")))
    return out


def contact_sheet(parts: list[Raster], size: int = 100, across: int = 6) -> Raster:
    """Thumbnails of at most size x size in rows."""
    thumbs = []
    for p in promote(*parts):
        k = min(1.0, size / max(p.height, p.width))
        small = geometry.resample(p, max(1, round(p.height * k)), max(1, round(p.width * k)))
        thumbs.append(geometry.pad_to(small, size, size))
    return concat([concat(thumbs[k : k + across]) for k in range(0, len(thumbs), across)], down=True)


def montage(sizes: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int, int]:
    """Places (row, col) for rectangles (height, width) on shelves, tallest first, and the sheet's size."""
    width = max([w for _, w in sizes] + [int(sum(h * w for h, w in sizes) ** 0.5)], default=0)
    places, top, shelf, left, wide = [(0, 0)] * len(sizes), 0, 0, 0, 0
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k][0], -sizes[k][1], k)):
        h, w = sizes[k]
        if left and left + w > width:
            top, shelf, left = top + shelf, 0, 0
        places[k] = (top, left)
        left, shelf = left + w, max(shelf, h)
        wide = max(wide, left)
    return places, top + shelf, wide


def montage_of(parts: list[Raster], image: str = "a") -> Raster:
    """All images on one sheet."""
    parts = promote(*parts)
    places, height, width = montage([(p.height, p.width) for p in parts])
    px = reduce(lambda a, b: a.unionByName(b), (p.px.select(F.lit(image).alias("image"), (F.col("row") + r).alias("row"), (F.col("col") + c).alias("col"), "s") for p, (r, c) in zip(parts, places, strict=True)))
    black = F.array(*[F.lit(0).cast("bigint")] * parts[0].depth)
    full = full_grid(_named(parts[0], image), height, width).join(px, list(CELL), "left")
    return Raster(full.select(*CELL, F.coalesce("s", black).alias("s")), height, width, parts[0].maxval, parts[0].depth)


def quantize(r: Raster, n: int, **options) -> Raster:
    """A palette of n colours for all images of r together, and every cell as the nearest of it."""
    return combine.remap(r, aggregate.palette(r, n, **options))


def distinct_colors(r: Raster):
    """The palette of all colours there are, in order: s, place."""
    return aggregate.colors(replace(r, px=r.px.withColumn("image", F.lit("all"))), "rgb").select("s", "place")


def transition(a: Raster, b: Raster, frames: int = 30) -> Raster:
    """frames images from a to b, named by number."""
    px = a.px.join(b.px.withColumnRenamed("s", "t"), list(CELL)).withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))
    k = F.floor(F.col("frame") * 65536 / F.lit(max(1, frames - 1))).cast("bigint")
    mixed = F.zip_with("s", "t", lambda x, y: x + F.shiftright((y - x) * k, 16))
    return replace(a, px=px.select(F.concat_ws("-", "image", F.lpad(F.col("frame").cast("string"), 4, "0")).alias("image"), "row", "col", mixed.alias("s")))


def shadow(r: Raster, x: int = 6, y: int = 6, blur: int = 5, darkness: float = 0.5) -> Raster:
    """Darkened, blurred copy of what isn't the first corner's colour, behind it."""
    bg = r.px.where("row = 0 and col = 0").select("image", F.col("s").alias("bg"))
    marked = r.px.join(bg, "image")
    mask = Raster(marked.select(*CELL, F.array(F.when(F.col("s") == F.col("bg"), F.lit(0)).otherwise(F.lit(255)).cast("bigint")).alias("s")), r.height, r.width)
    soft = neighbours.box(mask, blur, blur).px.select("image", (F.col("row") + y).alias("row"), (F.col("col") + x).alias("col"), F.col("s")[0].alias("m"))
    px = marked.join(soft, list(CELL), "left")
    dark = F.transform("s", lambda v: F.floor(v * (1 - darkness * F.coalesce(F.col("m"), F.lit(0)) / 255.0)).cast("bigint"))
    return replace(r, px=px.select(*CELL, F.when(F.col("s") == F.col("bg"), dark).otherwise(F.col("s")).alias("s")))
