"""Operators on two or more images: joins on (image, row, col), lookups and nearest colours.

Aligned images meet in an equi-join on the cell, which spreads evenly.  A lookup table or
palette is broadcast only as a list of at most MAX_LOOKUP entries; larger ones are joined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import color
from gridloom.raster import CELL, Raster, clamp, rounded

#: Entries of a lookup or palette up to which it's sent to every executor.
MAX_LOOKUP = 65_536


def _pair(a: Raster, b: Raster) -> DataFrame:
    """Cells of both, as s and t; images of the same name meet."""
    if (a.height, a.width) != (b.height, b.width):
        raise ValueError("images differ in size")
    return a.px.join(b.px.withColumnRenamed("s", "t"), list(CELL))


def _planes(a: Raster, b: Raster) -> list[tuple[Column, Column]]:
    if a.depth != b.depth and 1 not in (a.depth, b.depth):
        raise ValueError("images differ in depth")
    n = max(a.depth, b.depth)
    return [(F.col("s")[min(k, a.depth - 1)], F.col("t")[min(k, b.depth - 1)]) for k in range(n)]


def _functions(m: int) -> dict[str, Callable[[Column, Column], Column]]:
    return {
        "add": lambda x, y: clamp(x + y, m),
        "subtract": lambda x, y: clamp(x - y, m),
        "multiply": lambda x, y: F.floor(x * y / F.lit(m)),
        "difference": lambda x, y: F.abs(x - y),
        "minimum": F.least,
        "maximum": F.greatest,
        "mean": lambda x, y: F.floor((x + y + 1) / F.lit(2)),
        "compare": lambda x, y: F.when(x > y, F.lit(2)).when(x < y, F.lit(0)).otherwise(F.lit(1)),
        "and": lambda x, y: x.bitwiseAND(y),
        "or": lambda x, y: x.bitwiseOR(y),
        "nand": lambda x, y: F.lit(m).cast("bigint") - x.bitwiseAND(y),
        "nor": lambda x, y: F.lit(m).cast("bigint") - x.bitwiseOR(y),
        "xor": lambda x, y: x.bitwiseXOR(y),
        "shiftleft": lambda x, y: F.call_function("shiftleft", x, y.cast("int")).bitwiseAND(m),
        "shiftright": lambda x, y: F.call_function("shiftright", x, y.cast("int")),
    }


def arithmetic(a: Raster, b: Raster, how: str) -> Raster:
    """Sample by sample; one plane against many is used for each."""
    m = a.maxval
    if how in ("and", "or", "nand", "nor", "xor", "shiftleft", "shiftright") and (m + 1) & m:
        raise ValueError("bits need a maxval of all ones")
    f = _functions(m)[how]
    s = F.array(*(f(x, y).cast("bigint") for x, y in _planes(a, b)))
    return Raster(_pair(a, b).select(*CELL, s.alias("s")), a.height, a.width, 2 if how == "compare" else m, max(a.depth, b.depth))


def _offset(size: int, over: int, align: str, shift: int) -> int:
    start = {"left": 0, "top": 0, "center": (size - over) // 2, "middle": (size - over) // 2, "right": size - over, "bottom": size - over, "beyondleft": -over, "above": -over, "beyondright": size, "below": size}
    return start[align] + shift


def overlay(under: Raster, over: Raster, align: str = "left", valign: str = "top", xoff: int = 0, yoff: int = 0, opacity: float = 1.0, alpha: Raster | None = None) -> Raster:
    """over, placed on under, as far as opacity and alpha let it through."""
    dx, dy = _offset(under.width, over.width, align, xoff), _offset(under.height, over.height, valign, yoff)
    move = lambda px, name: px.select("image", (F.col("row") + dy).alias("row"), (F.col("col") + dx).alias("col"), F.col("s").alias(name))
    px = under.px.join(move(over.px, "t"), list(CELL), "left")
    share: Column = F.lit(float(opacity))
    if alpha is not None:
        px = px.join(move(alpha.px, "a"), list(CELL), "left")
        share = share * F.coalesce(F.col("a")[0] / F.lit(float(alpha.maxval)), F.lit(0.0))
    mixed = F.zip_with("s", "t", lambda x, y: clamp(F.floor((1 - share) * x + share * y + 0.5), under.maxval))
    return replace(under, px=px.select(*CELL, F.when(F.col("t").isNull(), F.col("s")).otherwise(mixed).alias("s")))


def paste(into: Raster, piece: Raster, x: int, y: int, how: str = "replace") -> Raster:
    """piece at column x, row y (negatives from the far edge); or, and, xor combine bits."""
    dx, dy = (x if x >= 0 else x + into.width), (y if y >= 0 else y + into.height)
    there = piece.px.select("image", (F.col("row") + dy).alias("row"), (F.col("col") + dx).alias("col"), F.col("s").alias("t"))
    f = {"replace": lambda a, b: b, "or": lambda a, b: a.bitwiseOR(b), "and": lambda a, b: a.bitwiseAND(b), "xor": lambda a, b: a.bitwiseXOR(b)}[how]
    px = into.px.join(there, list(CELL), "left")
    return replace(into, px=px.select(*CELL, F.when(F.col("t").isNull(), F.col("s")).otherwise(F.zip_with("s", "t", f)).alias("s")))


def fade(a: Raster, b: Raster, factor: float) -> Raster:
    """From a to b by a factor of 0..1, in 16-bit fixed point."""
    k = int(factor * 65536)
    return replace(a, px=_pair(a, b).select(*CELL, F.zip_with("s", "t", lambda x, y: x + F.shiftright((y - x) * k, 16)).alias("s")))


def anaglyph(left: Raster, right: Raster, offset: int = 30) -> Raster:
    """Left luminance in green and blue, right in red, each moved by half the offset against the other; where one is missing its planes are 0."""
    half = offset >> 1

    def moved(r: Raster, by: int, name: str):
        lum = (color.fast_luminosity if r.maxval <= 255 else lambda *p: rounded(color.luminosity(*p)))(*(r.plane(k) for k in range(3)))
        return r.px.select("image", "row", (F.col("col") + by).alias("col"), lum.alias(name)).where(F.col("col").between(0, left.width - 1))

    px = moved(left, -half, "l").join(moved(right, offset - half, "r"), list(CELL), "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return replace(left, px=px.select(*CELL, F.array(zero("r"), zero("l"), zero("l")).alias("s")), depth=3)


def sharpen_by_mask(r: Raster, mask: Raster) -> Raster:
    """2 x - mask, held within the scale."""
    return replace(r, px=_pair(r, mask).select(*CELL, F.zip_with("s", "t", lambda x, y: clamp(2 * x - y, r.maxval)).alias("s")))


def lookup(index: Raster, table: list[tuple[int, ...]], missing: tuple[int, ...] | None = None, maxval: int = 255) -> Raster:
    """Cells are numbers into a table; those beyond it get missing, by default the first entry."""
    if len(table) > MAX_LOOKUP:
        raise ValueError(f"use lookup_join for more than {MAX_LOOKUP} entries")
    spark = index.px.sparkSession
    lut = F.broadcast(spark.createDataFrame([(k, [int(v) for v in t]) for k, t in enumerate(table)], "v bigint, t array<bigint>"))
    px = index.px.withColumn("v", index.plane()).join(lut, "v", "left")
    other = F.array(*(F.lit(int(v)).cast("bigint") for v in (missing or table[0])))
    return replace(index, px=px.select(*CELL, F.coalesce("t", other).alias("s")), maxval=maxval, depth=len(table[0]))


def lookup_join(index: Raster, table: DataFrame, missing: tuple[int, ...], maxval: int = 255) -> Raster:
    """lookup in a table (key array<bigint>, t array<bigint>) of any size: an equi-join."""
    px = index.px.join(table.withColumnRenamed("key", "s"), "s", "left")
    other = F.array(*(F.lit(int(v)).cast("bigint") for v in missing))
    return replace(index, px=px.select(*CELL, F.coalesce("t", other).alias("s")), maxval=maxval, depth=len(missing))


def stack(*parts: Raster) -> Raster:
    """The planes of all, one after the other."""
    px = reduce(lambda a, b: a.join(b[1].px.withColumnRenamed("s", f"s{b[0]}"), list(CELL)), enumerate(parts[1:], 1), parts[0].px.withColumnRenamed("s", "s0"))
    return replace(parts[0], px=px.select(*CELL, F.concat(*(f"s{k}" for k in range(len(parts)))).alias("s")), depth=sum(p.depth for p in parts))


def join_planes(red: Raster, green: Raster, blue: Raster) -> Raster:
    """Three gray images as one colour image, on the largest of their scales (truncated)."""
    most = max(red.maxval, green.maxval, blue.maxval)
    to_most = lambda own: lambda x: F.floor(x * most / F.lit(own)).cast("bigint")
    scaled = [replace(p, px=p.px.select(*CELL, F.transform("s", to_most(p.maxval)).alias("s"))) for p in (red, green, blue)]
    return replace(stack(*scaled), maxval=most)


def split_planes(r: Raster) -> list[Raster]:
    return [replace(r, px=r.px.select(*CELL, F.array(r.plane(k)).alias("s")), depth=1) for k in range(r.depth)]


def nearest(r: Raster, palette: list[tuple[int, ...]]) -> DataFrame:
    """Each distinct colour with the place of the nearest in the palette (the first of equals) and its squared distance: s, place, d."""
    if len(palette) > MAX_LOOKUP:
        raise ValueError(f"a palette has at most {MAX_LOOKUP} colours")
    found = r.px.select("s").distinct()
    entries = F.array(*(F.struct(color.distance2(F.col("s"), _lit(c), r.depth).alias("d"), F.lit(k).cast("bigint").alias("place")) for k, c in enumerate(palette)))
    return found.withColumn("m", F.array_min(entries)).select("s", F.col("m.place").alias("place"), F.col("m.d").alias("d"))


def _lit(c: tuple[int, ...]) -> Column:
    return F.array(*(F.lit(int(v)).cast("bigint") for v in c))


def remap(r: Raster, palette: list[tuple[int, ...]], missing: tuple[int, ...] | None = None) -> Raster:
    """Every cell as the nearest colour of the palette; with missing, only exact ones match."""
    near = nearest(r, palette)
    table = F.array(*(_lit(c) for c in palette))
    to = F.get(table, F.col("place").cast("int"))
    if missing is not None:
        to = F.when(F.col("d") == 0, to).otherwise(_lit(missing))
    return replace(r, px=r.px.join(near.select("s", to.alias("t")), "s").select(*CELL, F.col("t").alias("s")))


def psnr(a: Raster, b: Raster) -> DataFrame:
    """Peak signal to noise in dB, by image: of luminance and, in colour, of both chromas; null where they are the same."""
    px = _pair(a, b)
    if a.depth == 1:
        parts = {"y": (F.col("s")[0], F.col("t")[0])}
    else:
        p, q = [F.col("s")[k] for k in range(3)], [F.col("t")[k] for k in range(3)]
        parts = {"y": (color.luminosity(*p), color.luminosity(*q)), "cb": (color.chroma_b(*p), color.chroma_b(*q)), "cr": (color.chroma_r(*p), color.chroma_r(*q))}
    mse = px.groupBy("image").agg(*(F.avg(F.pow((x - y).cast("double") / a.maxval, F.lit(2.0))).alias(n) for n, (x, y) in parts.items()))
    db = lambda n: F.when(F.col(n) > 1e-9, 10 * F.log10(1 / F.when(F.col(n) > 1e-9, F.col(n))))
    return mse.select("image", *(db(n).alias(n) for n in parts))


def best_offsets(a: Raster, b: Raster, rows: range, cols: range, keep: int = 9) -> DataFrame:
    """The keep offsets (dr, dc) of b against a at which their overlap differs least: mean squared difference, ties by offset."""
    moves = F.array(*(F.struct(F.lit(dr).cast("bigint").alias("dr"), F.lit(dc).cast("bigint").alias("dc")) for dr in rows for dc in cols))
    moved = b.px.withColumn("m", F.explode(moves)).select("image", (F.col("row") + F.col("m.dr")).alias("row"), (F.col("col") + F.col("m.dc")).alias("col"), "m.dr", "m.dc", F.col("s").alias("t"))
    d = F.aggregate(F.zip_with("s", "t", lambda x, y: (x - y) * (x - y)), F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    sums = moved.join(a.px, list(CELL)).groupBy("image", "dr", "dc").agg(F.sum(d).alias("total"), F.count("*").alias("n"))
    score = F.col("total") / F.col("n")
    place = F.row_number().over(Window.partitionBy("image").orderBy(score, "dr", "dc"))
    return sums.withColumn("mean", score).withColumn("place", place).where(F.col("place") <= keep).select("image", "place", "dr", "dc", "mean")


def stitch(a: Raster, b: Raster, dr: int, dc: int) -> Raster:
    """a with b moved by (dr, dc) beside it; a wins where both are; black elsewhere."""
    top, left = min(0, dr), min(0, dc)
    height, width = max(a.height, b.height + dr) - top, max(a.width, b.width + dc) - left
    one = a.px.select("image", (F.col("row") - top).alias("row"), (F.col("col") - left).alias("col"), F.col("s").alias("a"))
    two = b.px.select("image", (F.col("row") + dr - top).alias("row"), (F.col("col") + dc - left).alias("col"), F.col("s").alias("b"))
    from gridloom.raster import full_grid

    px = full_grid(a, height, width).join(one, list(CELL), "left").join(two, list(CELL), "left")
    return Raster(px.select(*CELL, F.coalesce("a", "b", F.array(*[F.lit(0).cast("bigint")] * a.depth)).alias("s")), height, width, a.maxval, a.depth)
