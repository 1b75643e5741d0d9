"""Images made from nothing but parameters: a range of cells and expressions on them."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import color
from gridloom.raster import CELL, Raster, clamp, grid, rounded


def _of(spark: SparkSession, height: int, width: int, maxval: int, *planes: Column) -> Raster:
    px = grid(spark, height, width).select(*CELL, F.array(*(p.cast("bigint") for p in planes)).alias("s"))
    return Raster(px, height, width, maxval, len(planes))



def constant(spark: SparkSession, height: int, width: int, value: tuple[int, ...], maxval: int = 255) -> Raster:
    return _of(spark, height, width, maxval, *(F.lit(v) for v in value))


def bitmap(spark: SparkSession, height: int, width: int, kind: str = "white") -> Raster:
    """White, black or gray, the last a chequer that starts white at the top left."""
    value = {"white": F.lit(1), "black": F.lit(0), "gray": (F.col("row") + F.col("col") + 1) % 2}[kind]
    return _of(spark, height, width, 1, value)


def ramp(spark: SparkSession, height: int, width: int, kind: str = "lr", maxval: int = 255) -> Raster:
    """From 0 to maxval: lr, tb; from the corners to the middle: rectangle, by the mean distance from both middle lines; ellipse, by the square of the distance."""
    row, col = F.col("row"), F.col("col")
    if kind == "lr":
        v = F.floor(col * maxval / F.lit(max(1, width - 1)))
    elif kind == "tb":
        v = F.floor(row * maxval / F.lit(max(1, height - 1)))
    else:
        up, side = max(1, height // 2), max(1, width // 2)
        r, c = ((F.abs(half - x) / F.lit(float(half))).cast("float") for x, half in ((row, up), (col, side)))  # single precision, as the bounds of levels depend on it
        if kind == "rectangle":
            v = F.floor(maxval - (r + c).cast("double") / 2.0 * maxval)
        else:
            v = F.floor((F.lit(maxval).cast("float") - F.least(r * r + c * c, F.lit(1.0).cast("float")) * F.lit(maxval).cast("float")).cast("double"))
    return _of(spark, height, width, maxval, clamp(v, maxval))


def gaussian(spark: SparkSession, height: int, width: int, sigma: float, maxval: int = 255) -> Raster:
    """A hump whose samples sum to about maxval."""
    y, x = F.col("row") - (height - 1) / 2, F.col("col") - (width - 1) / 2
    z = lambda d: math.exp(-d * d / (2 * sigma * sigma))
    total = sum(z(r - (height - 1) / 2) for r in range(height)) * sum(z(c - (width - 1) / 2) for c in range(width))
    return _of(spark, height, width, maxval, rounded(F.exp(-(x * x + y * y) / F.lit(2 * sigma * sigma)) * maxval / F.lit(total)))


def all_tuples(spark: SparkSession, depth: int, maxval: int) -> Raster:
    """Every tuple once, in order, in one row."""
    n = (maxval + 1) ** depth
    digits = [F.expr(f"(col div {(maxval + 1) ** (depth - 1 - k)}) % {maxval + 1}") for k in range(depth)]
    return _of(spark, 1, n, maxval, *digits)


def distance_kernel(spark: SparkSession, height: int, width: int, weight: float = 6.0, maxval: int = 255) -> Raster:
    """A convolution kernel that falls with the distance from the middle, 1 / (1 + weight * distance), in offset form: the largest is maxval, 0 would be half of it."""
    falls = lambda y, x: 1.0 / (1.0 + weight * math.sqrt((y - (height - 1) / 2) ** 2 + (x - (width - 1) / 2) ** 2))
    top = max(falls(y, x) for y in (height // 2, (height - 1) // 2) for x in (width // 2, (width - 1) // 2))
    y, x = F.col("row") - (height - 1) / 2, F.col("col") - (width - 1) / 2
    k = F.lit(1.0) / (1.0 + weight * F.sqrt(y * y + x * x))
    return _of(spark, height, width, maxval, F.floor(maxval * (k / F.lit(2 * top) + 0.5)))


def noise(spark: SparkSession, height: int, width: int, seed: int, maxval: int = 255) -> Raster:
    """Seeded samples 0..maxval-1, alike at every partitioning."""
    return _of(spark, height, width, maxval, F.pmod(F.xxhash64(F.lit(seed), "row", "col"), F.lit(maxval)))


def wheel(spark: SparkSession, diameter: int, maxval: int = 255) -> Raster:
    """Hue by angle, saturation by distance from the middle; black outside."""
    mid = diameter / 2
    x, y = F.col("col") - mid, F.col("row") - mid
    far = F.sqrt(x * x + y * y) / mid
    hue = F.degrees(F.atan2(y, x))
    rgb = color.from_hsv(F.when(hue < 0, hue + 360).otherwise(hue), F.least(far, F.lit(1.0)), F.lit(1.0))
    return _of(spark, diameter, diameter, maxval, *(F.when(far > 1, F.lit(0)).otherwise(rounded(c * maxval)) for c in rgb))


def rainbow(spark: SparkSession, height: int, width: int, colors: list[tuple[int, int, int]], maxval: int = 255) -> Raster:
    """Straight steps from colour to colour across the width, and back to the first."""
    stops = [*colors, colors[0]]
    n = len(stops) - 1
    t = F.col("col") * n / F.lit(width)
    k = F.floor(t).cast("int")
    pick = lambda p, add: F.get(F.array(*(F.lit(c[p]) for c in stops)), k + add)
    return _of(spark, height, width, maxval, *(F.floor(pick(p, 0) * (1 - (t - k)) + pick(p, 1) * (t - k) + 0.5) for p in range(3)))


def upc_digits(kind: int, manufacturer: int, product: int) -> list[int]:
    """The twelve digits of a bar code, the last a check."""
    digits = [int(c) for c in f"{kind:01d}{manufacturer:05d}{product:05d}"]
    return [*digits, (10 - (3 * sum(digits[0::2]) + sum(digits[1::2])) % 10) % 10]


#: Widths of the four bars of each digit.
UPC_BARS = ("3211", "2221", "2122", "1411", "1132", "1231", "1114", "1312", "1213", "3112")


def upc(spark: SparkSession, kind: int, manufacturer: int, product: int, height: int = 40) -> Raster:
    """A bar code: guard, six digits from white, middle, six from black, guard."""
    digits = upc_digits(kind, manufacturer, product)
    line, now = "101", 0
    for k, d in enumerate(digits):
        if k == 6:
            line += "01010"
        now = int(k >= 6)
        for w in UPC_BARS[d]:
            line += str(now) * int(w)
            now = 1 - now
    line += "101"
    ink = F.substring(F.lit(line), F.col("col").cast("int") + 1, F.lit(1))
    return _of(spark, height, len(line), 1, 1 - ink.cast("bigint"))


def _waves(spark: SparkSession, seed: int, n: int, power: float) -> list[tuple[float, float, float, float]]:
    """Seeded plane waves (amplitude, x, y, phase) of falling strength: a spectral sum for clouds and terrain."""
    import numpy as np

    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        f = float(2 ** rng.uniform(0, 5))
        a = float(rng.uniform(0, 2 * math.pi))
        out.append((f ** (-power), f * math.cos(a), f * math.sin(a), float(rng.uniform(0, 2 * math.pi))))
    return out


def _relief(spark: SparkSession, height: int, width: int, seed: int, power: float, n: int) -> Column:
    waves = _waves(spark, seed, n, power)
    total = math.sqrt(sum(a * a for a, *_ in waves) / 2)
    y, x = F.col("row") * 2 * math.pi / height, F.col("col") * 2 * math.pi / width
    return reduce(lambda p, q: p + q, (a * F.sin(u * x + v * y + ph) for a, u, v, ph in waves)) / (3 * total)


def clouds(spark: SparkSession, height: int, width: int, seed: int, power: float = 1.2, waves: int = 40) -> Raster:
    """White on blue by a sum of seeded waves."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), _relief(spark, height, width, seed, power, waves)))
    return _of(spark, height, width, 255, rounded(t * 255), rounded(t * 255), F.lit(255))


def terrain(spark: SparkSession, height: int, width: int, seed: int, power: float = 1.5, waves: int = 40) -> Raster:
    """Sea, land and snow by height, from a sum of seeded waves."""
    h = _relief(spark, height, width, seed, power, waves)
    lift = F.least(F.lit(1.0), F.abs(h))
    sea, snow = h < 0, h > 0.7
    planes = (F.when(sea, F.lit(0)).when(snow, F.lit(255)).otherwise(rounded(60 + 120 * lift)), F.when(sea, rounded(60 * (1 - lift))).when(snow, F.lit(255)).otherwise(rounded(130 - 40 * lift)), F.when(sea, rounded(130 + 120 * (1 - lift))).when(snow, F.lit(255)).otherwise(F.lit(40)))
    return _of(spark, height, width, 255, *planes)


def craters(spark: SparkSession, height: int, width: int, seed: int, n: int = 200) -> Raster:
    """Gray ground with seeded bowls, each a shaded slope; later ones lie on earlier ones."""
    import numpy as np

    rng = np.random.default_rng(seed)
    bowls = [(k, float(rng.uniform(0, height)), float(rng.uniform(0, width)), float(min(height, width) * 0.02 / math.sqrt(rng.uniform(0.01, 1)))) for k in range(n)]
    px = grid(spark, height, width)
    table = F.broadcast(spark.createDataFrame(bowls, "k bigint, cy double, cx double, size double"))  # n rows, a parameter
    near = px.join(table, (F.abs(F.col("row") - F.col("cy")) <= F.col("size")) & (F.abs(F.col("col") - F.col("cx")) <= F.col("size")))
    y, x = (F.col("row") - F.col("cy")) / F.col("size"), (F.col("col") - F.col("cx")) / F.col("size")
    inside = near.where(x * x + y * y <= 1).groupBy(*CELL).agg(F.max_by(F.struct(x.alias("x"), y.alias("y")), "k").alias("b"))
    shade = F.coalesce(clamp(F.floor(128 - 90 * (F.col("b.x") + F.col("b.y")) / math.sqrt(2)), 255), F.lit(128))
    return Raster(px.join(inside, list(CELL), "left").select(*CELL, F.array(shade.cast("bigint")).alias("s")), height, width)


def rough_edge(spark: SparkSession, height: int, width: int, seed: int, left: int = 10, amplitude: int = 5, fg: tuple[int, int, int] = (0, 0, 0), bg: tuple[int, int, int] = (255, 255, 255)) -> Raster:
    """Two colours with a seeded ragged border down the left."""
    edge = left + F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(2 * amplitude + 1)) - amplitude
    return _of(spark, height, width, 255, *(F.when(F.col("col") < edge, F.lit(a)).otherwise(F.lit(b)) for a, b in zip(bg, fg, strict=True)))


def pattern(spark: SparkSession, height: int, width: int, kind: str, seed: int) -> Raster:
    """gingham, madras (stripes both ways), poles (nearest of seeded points) or camo (levels of waves), in seeded colours."""
    import numpy as np

    rng = np.random.default_rng(seed)
    hues = [tuple(int(v) for v in rng.integers(0, 256, 3)) for _ in range(6)]
    row, col = F.col("row"), F.col("col")
    if kind == "gingham":
        k = ((row * 4 / F.lit(height)).cast("int") + (col * 4 / F.lit(width)).cast("int")) % 3
    elif kind == "madras":
        k = F.when((row + col) % 2 == 0, (row * 16 / F.lit(height)).cast("int") % 6).otherwise((col * 16 / F.lit(width)).cast("int") % 6)
    elif kind == "poles":
        points = [(float(rng.uniform(0, height)), float(rng.uniform(0, width)), n) for n in range(6)]
        k = F.array_min(F.array(*(F.struct(((row - y) * (row - y) + (col - x) * (col - x)).alias("d"), F.lit(n).alias("n")) for y, x, n in points)))["n"]
    else:
        k = F.pmod(F.floor(_relief(spark, height, width, seed, 1.0, 12) * 6), F.lit(6)).cast("int")
    return _of(spark, height, width, 255, *(F.get(F.array(*(F.lit(c[p]) for c in hues)), k.cast("int")) for p in range(3)))


#: Chromaticities of red, green, blue and white in Rec. 709.
REC709 = ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06), (0.3127, 0.3291))


def chromaticity(spark: SparkSession, size: int = 256) -> Raster:
    """The triangle of colours that the primaries of Rec. 709 can mix, at full brightness, over x and y; black outside."""
    import numpy as np

    xyz = np.array([[x, y, 1 - x - y] for x, y in REC709[:3]]).T
    white = np.array([REC709[3][0], REC709[3][1], 1 - sum(REC709[3])]) / REC709[3][1]
    back = np.linalg.inv(xyz * np.linalg.solve(xyz, white))
    x, y = F.col("col") / F.lit(float(size)), (size - 1 - F.col("row")) / F.lit(float(size))
    rgb = [float(a) * x + float(b) * y + float(c) * (1 - x - y) for a, b, c in back]
    top = F.greatest(*rgb)
    inside = F.least(*rgb) >= 0
    return _of(spark, size, size, 255, *(F.when(inside & (top > 0), rounded(color.to_709(F.greatest(c, F.lit(0.0)) / F.nullif(top, F.lit(0.0))) * 255)).otherwise(F.lit(0)) for c in rgb))
