"""Operators on single cells: no shuffle, all of it in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from gridloom.functions import color
from gridloom.raster import CELL, Raster, clamp, rounded


def channels(r: Raster, planes: list[int]) -> Raster:
    """The named planes, in that order."""
    if not planes or max(planes) >= r.depth or min(planes) < 0:
        raise ValueError(f"planes {planes} of {r.depth}")
    return r.with_cell(F.array(*(r.plane(k) for k in planes)), depth=len(planes))


def multiply(r: Raster, factor: float) -> Raster:
    return r.map(lambda x: clamp(rounded(x * F.lit(float(factor))), r.maxval))


def divide(r: Raster, divisor: float) -> Raster:
    return multiply(r, 1.0 / divisor)


def plus(r: Raster, n: int) -> Raster:
    return r.map(lambda x: clamp(x + n, r.maxval))


def minus(r: Raster, n: int) -> Raster:
    return plus(r, -n)


def at_least(r: Raster, n: int) -> Raster:
    return r.map(lambda x: clamp(F.greatest(x, F.lit(n).cast("bigint")), r.maxval))


def at_most(r: Raster, n: int) -> Raster:
    return r.map(lambda x: clamp(F.least(x, F.lit(n).cast("bigint")), r.maxval))


def invert(r: Raster) -> Raster:
    return r.map(lambda x: r.maxval - x)


def depth(r: Raster, maxval: int) -> Raster:
    """The samples on another scale, rounded."""
    return r.map(lambda x: F.floor((x * maxval + r.maxval // 2) / F.lit(r.maxval)).cast("bigint"), maxval=maxval)


def gamma_planes(r: Raster, powers: tuple[float, ...]) -> Raster:
    """A power curve of its own for each plane."""
    curve = lambda k: F.floor(F.pow(r.plane(k) / F.lit(float(r.maxval)), F.lit(1 / powers[k])) * r.maxval + 0.5)
    return r.with_cell(F.array(*(F.least(curve(k).cast("bigint"), F.lit(r.maxval).cast("bigint")) for k in range(r.depth))))


def gamma(r: Raster, curve: str = "709", power: float = 2.2, back: bool = False) -> Raster:
    """A transfer curve: power, 709 or srgb; back undoes it.  The curve is a function of the sample, so each is looked up or computed alike."""
    curves = {
        ("709", False): color.to_709, ("709", True): color.from_709, ("srgb", False): color.to_srgb, ("srgb", True): color.from_srgb,
        ("power", False): lambda x: F.pow(x, F.lit(1 / power)), ("power", True): lambda x: F.pow(x, F.lit(power)),
    }
    f = curves[curve, back]
    return r.map(lambda x: F.least(F.floor(f(x / F.lit(float(r.maxval))) * r.maxval + 0.5).cast("bigint"), F.lit(r.maxval).cast("bigint")))


def fixed(factor: float) -> int:
    """A factor in 16-bit fixed point."""
    return int(factor * 65536)


def dim(r: Raster, factor: float) -> Raster:
    return r.map(lambda x: F.shiftright(x * fixed(factor), 16))


def flash(r: Raster, factor: float) -> Raster:
    return r.map(lambda x: x + F.shiftright((r.maxval - x) * fixed(factor), 16))


def tv_lines(r: Raster, factor: float) -> Raster:
    """Even rows dimmed."""
    return r.with_cell(F.when(F.col("row") % 2 == 1, F.col("s")).otherwise(F.transform("s", lambda x: F.shiftright(x * fixed(factor), 16))))


def _tuple(values) -> Column:
    return F.array(*(F.lit(int(v)).cast("bigint") for v in values))


def change_colors(r: Raster, pairs: list[tuple[tuple[int, ...], tuple[int, ...]]], closeness: float = 0.0, remainder: tuple[int, ...] | None = None) -> Raster:
    """The first pair (old, new) whose old colour is near enough decides; others stay or become remainder."""
    near = 3 * (r.maxval * closeness / 100) ** 2
    rest = F.col("s") if remainder is None else _tuple(remainder)
    out = rest
    for old, new in reversed(pairs):
        out = F.when(color.distance2(F.col("s"), _tuple(old), r.depth) <= near, _tuple(new)).otherwise(out)
    return r.with_cell(out)


def color_mask(r: Raster, value: tuple[int, ...]) -> Raster:
    """A bitmap, black where the cell has that colour."""
    return r.with_cell(F.array(F.when(F.col("s") == _tuple(value), F.lit(0)).otherwise(F.lit(1)).cast("bigint")), depth=1, maxval=1)


def gray(r: Raster) -> Raster:
    """Luminosity: in integers up to a maxval of 255, else rounded."""
    p = [r.plane(k) for k in range(3)]
    y = color.fast_luminosity(*p) if r.maxval <= 255 else rounded(color.luminosity(*p))
    return r.with_cell(F.array(y.cast("bigint")), depth=1)


def color_ramp(r: Raster, black: tuple[int, int, int], white: tuple[int, int, int]) -> Raster:
    """Gray to colours between two."""
    v = r.plane()
    return r.with_cell(F.array(*(F.floor((a * (r.maxval - v) + b * v) / F.lit(r.maxval)).cast("bigint") for a, b in zip(black, white, strict=True))), depth=3)


def threshold(r: Raster, value: float = 0.5) -> Raster:
    """A bitmap, white from value * maxval on."""
    return r.with_cell(F.array((r.plane() >= value * r.maxval).cast("bigint")), maxval=1)


def bayer(power: int) -> list[list[int]]:
    """The ordered dither matrix of side 2 ** power, by its rule of recursion."""
    m = [[0]]
    for _ in range(power):
        n = len(m)
        step = ((0, 2), (3, 1))
        m = [[4 * m[i % n][j % n] + step[i // n][j // n] for j in range(2 * n)] for i in range(2 * n)]
    return m


def _at(matrix: list[list[int]]) -> Column:
    n = len(matrix)
    flat = F.array(*(F.lit(v) for line in matrix for v in line))
    return F.element_at(flat, ((F.col("row") % n) * n + F.col("col") % n + 1).cast("int"))


def tessellation(power: int = 4) -> list[list[int]]:
    """The order in which the cells of a square of side 2 ** power turn white: each next one as far as can be from those before.

    The four digits of a number, from the lowest, say by how many halves of what is left of the
    square its cell lies from the middle: 1 is a step across, 2 a step down, 3 both, one after the other.
    """
    side = 1 << power
    out = [[0] * side for _ in range(side)]
    for n in range(side * side):
        row = col = side // 2
        for level in range(power):
            digit, step = n >> 2 * level & 3, side >> level + 1
            row += step * ((digit & 1) + (digit >> 1))
            col += step * (digit & 1)
        out[row % side][col % side] = n
    return out


def ordered_bitmap(r: Raster) -> Raster:
    """Gray to a bitmap by an ordered dither of side 16: white where the sample exceeds its share."""
    bound = [[v * r.maxval // 256 for v in line] for line in tessellation()]
    return r.with_cell(F.array((r.plane() > _at(bound)).cast("bigint")), maxval=1)


#: Orders in which the cells of a clustered dither of side 3, 4 and 8 turn white; the other half of each chequer is what is left to 2 * side ** 2 - 1.
CLUSTERS = {
    3: [[9, 11, 10], [12, 17, 16], [13, 14, 15]],
    4: [[18, 20, 19, 16], [27, 28, 29, 22], [26, 31, 30, 21], [23, 25, 24, 17]],
    8: [
        [64, 69, 77, 87, 86, 76, 68, 67], [70, 94, 100, 109, 108, 99, 93, 75], [78, 101, 114, 116, 115, 112, 98, 83], [88, 110, 123, 124, 125, 118, 107, 85],
        [89, 111, 122, 127, 126, 117, 106, 84], [79, 102, 119, 121, 120, 113, 97, 82], [71, 95, 103, 104, 105, 96, 92, 74], [65, 72, 80, 90, 91, 81, 73, 66],
    ],
}


def cluster_bitmap(r: Raster, side: int, whole: bool = False) -> Raster:
    """Gray to a bitmap by a clustered dither of side 3, 4 or 8: white where the sample exceeds its share.

    The original repeats the first quarter of its matrix only, the dark half of the scale's cells; whole takes all four.
    """
    own, last = CLUSTERS[side], 2 * side * side
    other = [[last - 1 - v for v in line] for line in own]
    matrix = [a + b for a, b in zip(own, other, strict=True)] + [b + a for a, b in zip(own, other, strict=True)] if whole else own
    bound = [[v * r.maxval // last for v in line] for line in matrix]
    return r.with_cell(F.array((r.plane() > _at(bound)).cast("bigint")), maxval=1)


def ordered_colors(r: Raster, power: int = 2, shades: tuple[int, int, int] = (5, 9, 5)) -> Raster:
    """Ordered dither of each plane to a number of shades, spread over the old scale."""
    n2, d = 4**power, _at(bayer(power))
    level = lambda k: F.floor((F.floor((shades[k] - 1) * n2 * r.plane(k) / F.lit(r.maxval)) + d) / F.lit(n2)).cast("bigint")
    return r.with_cell(F.array(*(F.floor(level(k) * r.maxval / F.lit(shades[k] - 1)).cast("bigint") for k in range(3))))


def swap_bytes(r: Raster) -> Raster:
    """Two-byte samples with their bytes swapped; one-byte ones as they are."""
    return r if r.maxval < 256 else r.map(lambda x: F.shiftleft(x.bitwiseAND(255), 8) + F.shiftright(x, 8), maxval=65535)


def as_bitmap(r: Raster) -> Raster:
    """A one-plane raster of maxval 1 as a bitmap, others unchanged: a change of header."""
    return r


def identity(r: Raster) -> Raster:
    return r


def brighten(r: Raster, saturation: int = 0, value: int = 0, normalize: bool = False) -> Raster:
    """Saturation and value changed by per cents; normalize first stretches the values found to the whole scale."""
    h, s, v = color.hsv(r.plane(0), r.plane(1), r.plane(2), r.maxval)
    px = r.px.select(*CELL, h.alias("h"), s.alias("sat"), v.alias("v"))
    if normalize:
        ends = px.groupBy("image").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        px = px.join(ends, "image").withColumn("v", F.coalesce((F.col("v") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.col("v")))
    sat = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("sat") * (100 + saturation) / 100))
    val = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("v") * (100 + value) / 100))
    rgb = color.from_hsv(F.col("h"), sat, val)
    return Raster(px.select(*CELL, F.array(*(rounded(c * r.maxval) for c in rgb)).alias("s")), r.height, r.width, r.maxval, 3)


#: RGB to YIQ and back.
YIQ = ((0.299, 0.587, 0.114), (0.596, -0.274, -0.322), (0.211, -0.523, 0.312))
RGB = ((1.0, 0.956, 0.621), (1.0, -0.272, -0.647), (1.0, -1.106, 1.703))


def _mul(m, v: list[Column]) -> list[Column]:
    return [reduce(lambda a, b: a + b, (c * x for c, x in zip(line, v, strict=True))) for line in m]


def legal_video(r: Raster, keep: str = "all") -> Raster:
    """Colours whose composite signal would leave -20..120 % or the chroma -..100 % lose saturation.  keep: all, legal, illegal or corrected cells; others black."""
    y, i, q = _mul(YIQ, [r.plane(k) / F.lit(float(r.maxval)) for k in range(3)])
    amplitude = F.sqrt(i * i + q * q)
    most = F.least(1.2 - y, y + 0.2)
    legal = amplitude <= most
    scale = F.when(legal, F.lit(1.0)).otherwise(F.greatest(most, F.lit(0.0)) / F.nullif(amplitude, F.lit(0.0)))
    fixed_ = F.array(*(clamp(rounded(F.greatest(c, F.lit(0.0)) * r.maxval), r.maxval) for c in _mul(RGB, [y, i * scale, q * scale])))
    black = _tuple([0, 0, 0])
    out = {"all": F.when(legal, F.col("s")).otherwise(fixed_), "legal": F.when(legal, F.col("s")).otherwise(black), "illegal": F.when(legal, black).otherwise(F.col("s")), "corrected": F.when(legal, black).otherwise(fixed_)}
    return r.with_cell(out[keep])




def stretch(r: Raster, black: int, white: int) -> Raster:
    """Contrast: black and below to 0, white and above to maxval, linear between."""
    span = max(1, white - black)
    return r.map(lambda x: F.when(x <= black, F.lit(0)).when(x >= white, F.lit(r.maxval)).otherwise(F.floor(((x - black) * r.maxval + span // 2) / F.lit(span))).cast("bigint"))


def histogram(r: Raster):
    """image, v, n over the first plane, or luminosity of three; at most maxval + 1 rows an image."""
    v = r.plane() if r.depth == 1 else rounded(color.luminosity(*(r.plane(k) for k in range(3))))
    return r.px.groupBy("image", v.alias("v")).agg(F.count("*").alias("n"))


def normalize(r: Raster, low_percent: float = 2.0, high_percent: float = 1.0, low: int | None = None, high: int | None = None, keep_hues: bool = False) -> Raster:
    """Contrast between the levels up to which low_percent and down to which high_percent of the cells lie, in whole cells.

    low and high, if given, are those levels.  With keep_hues a colour's planes are all scaled as its luminosity is.
    A share of less than a cell leaves its end of the scale where it is; if only one level is left, it becomes half of maxval.
    """
    v = r.plane() if r.depth == 1 else F.floor(color.luminosity(*(r.plane(k) for k in range(3)))).cast("bigint")
    h, one = r.px.groupBy("image", v.alias("v")).agg(F.count("*").alias("n")), Window.partitionBy("image")
    share = lambda percent: F.floor(F.sum("n").over(one) * F.lit(float(percent)) / 100.0)
    h = h.withColumn("up", F.sum("n").over(one.orderBy("v"))).withColumn("down", F.sum("n").over(one.orderBy(F.desc("v"))))
    h = h.withColumn("lows", share(low_percent)).withColumn("highs", share(high_percent))
    ends = h.groupBy("image").agg(
        F.min(F.when(F.col("lows") == 0, F.lit(0)).when(F.col("up") >= F.col("lows"), F.col("v"))).alias("lo"),
        F.max(F.when(F.col("highs") == 0, F.lit(r.maxval)).when(F.col("down") >= F.col("highs"), F.col("v"))).alias("hi"),
    )
    ends = ends.select("image", *(c if given is None else F.lit(given).alias(c) for c, given in (("lo", low), ("hi", high))))
    px = r.px.join(ends, "image")
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    new = lambda x: F.when(x < F.col("lo"), F.lit(0)).when(x > F.col("hi"), F.lit(r.maxval)).otherwise(F.least(F.lit(r.maxval), div_by(r.maxval // 2 + (x - F.col("lo")) * r.maxval, span))).cast("bigint")
    if keep_hues and r.depth == 3:
        old = v.cast("bigint")
        scale = (new(old) / F.nullif(old, F.lit(0))).cast("float")
        s = F.transform("s", lambda x: F.least(F.lit(r.maxval).cast("bigint"), F.coalesce(F.floor((x * scale).cast("float").cast("double") + 0.5), F.lit(0)).cast("bigint")))
    else:
        s = F.transform("s", new)
    return Raster(px.select(*CELL, s.alias("s")), r.height, r.width, r.maxval, r.depth)


def div_by(a, b):
    """Whole quotient of bigints of 0 or more."""
    return F.floor(a / b)


def equalize_map(r: Raster, v=None):
    """image, v, to: the equalising map of the levels 0..maxval, the brightest that occurs to maxval."""
    h = r.px.groupBy("image", (r.plane() if v is None else v).alias("v")).agg(F.count("*").alias("n"))
    every = h.select("image").distinct().withColumn("v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(r.maxval).cast("bigint"))))
    one = Window.partitionBy("image")
    h = every.join(h, ["image", "v"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    h = h.withColumn("raw", F.floor((F.sum("n").over(one.orderBy("v")) - F.col("n")) * F.lit(float(r.maxval)) / F.sum("n").over(one) + 0.5))
    top = F.max(F.when(F.col("n") > 0, F.col("raw"))).over(one)
    scaled = F.least(F.lit(r.maxval), F.floor(F.col("raw") * (F.lit(float(r.maxval)) / F.nullif(top, F.lit(0))) + 0.5))
    return h.select("image", "v", F.coalesce(scaled, F.col("raw")).cast("bigint").alias("to"))


def equalize(r: Raster) -> Raster:
    """Histogram equalisation, by luminosity; colours keep their hue and saturation and get the value their value maps to."""
    if r.depth == 1:
        px = r.px.withColumn("v", r.plane()).join(equalize_map(r), ["image", "v"])
        return Raster(px.select(*CELL, F.array("to").alias("s")), r.height, r.width, r.maxval, 1)
    planes = [r.plane(k) for k in range(3)]
    levels = equalize_map(r, F.floor(color.luminosity(*planes)).cast("bigint"))
    px = r.px.withColumn("v", F.greatest(*planes)).join(levels, ["image", "v"])
    h, s, _ = color.hsv(*planes, r.maxval)
    new = color.from_hsv(h, s, F.col("to") / F.lit(float(r.maxval)))
    return Raster(px.select(*CELL, F.array(*(F.floor(c * r.maxval).cast("bigint") for c in new)).alias("s")), r.height, r.width, r.maxval, 3)


def rank_colors(r: Raster, by: str = "intensity"):
    """Each distinct colour's place by luminosity (or by count, most first), ties by colour: image, s, rank from 0."""
    n = r.px.groupBy("image", "s").agg(F.count("*").alias("n"))
    own = F.col("s")
    lum = color.luminosity(own[0], own[1], own[2]) if r.depth == 3 else own[0]
    order = [lum, own] if by == "intensity" else [F.desc("n"), own]
    return n.select("image", "s", (F.row_number().over(Window.partitionBy("image").orderBy(*order)) - 1).cast("bigint").alias("rank"))


def distinct_ranks(r: Raster, by: str = "intensity") -> Raster:
    """Every cell as its colour's rank."""
    px = r.px.join(rank_colors(r, by), ["image", "s"])
    return Raster(px.select(*CELL, F.array("rank").alias("s")), r.height, r.width, r.maxval, 1)


def row_differences(r: Raster) -> Raster:
    """Each sample less the one in the row above, around the middle of the scale, modulo its size."""
    w = Window.partitionBy("image", "col").orderBy("row")
    before = F.coalesce(F.lag("s").over(w), F.transform("s", lambda x: x * 0))
    return r.with_cell(F.zip_with("s", before, lambda a, b: F.pmod(a - b + r.maxval // 2, F.lit(r.maxval + 1).cast("bigint"))))


def from_row_differences(r: Raster) -> Raster:
    """The inverse of row_differences: running sums modulo the scale."""
    w = Window.partitionBy("image", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return r.with_cell(F.array(*(F.pmod(F.sum(r.plane(k) - r.maxval // 2).over(w), F.lit(r.maxval + 1).cast("bigint")) for k in range(r.depth))))


def normalized(r: Raster):
    """Samples from 0 to 1 as doubles: image, row, col, x."""
    return r.px.select(*CELL, F.transform("s", lambda x: x / F.lit(float(r.maxval))).alias("x"))


def denormalized(px, height: int, width: int, maxval: int, depth_: int) -> Raster:
    return Raster(px.select(*CELL, F.transform("x", lambda x: clamp(rounded(F.greatest(x, F.lit(0.0)) * maxval), maxval)).alias("s")), height, width, maxval, depth_)


def with_opacity(r: Raster, undo: bool = False) -> Raster:
    """The last plane is opacity: multiply the others by it, or divide them."""
    alpha = r.plane(r.depth - 1) / F.lit(float(r.maxval))
    f = (lambda x: clamp(rounded(F.coalesce(x / F.nullif(alpha, F.lit(0.0)), F.lit(0.0))), r.maxval)) if undo else (lambda x: rounded(x * alpha))
    return r.with_cell(F.array(*(f(r.plane(k)) for k in range(r.depth - 1)), r.plane(r.depth - 1)))
