"""Colour as column expressions: luminosity, YCbCr, HSV, gamma, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of red, green and blue in luminosity.
LUMA = (0.2989, 0.5866, 0.1145)
#: The integer weights of fast luminosity, over 256.
FAST_LUMA = (77, 150, 29)
#: Names of the basic colours.
NAMES = {
    "black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "green": (0, 255, 0), "blue": (0, 0, 255),
    "yellow": (255, 255, 0), "cyan": (0, 255, 255), "magenta": (255, 0, 255), "gray": (190, 190, 190), "orange": (255, 165, 0),
    "brown": (165, 42, 42), "purple": (160, 32, 240), "pink": (255, 192, 203), "navy": (0, 0, 128), "maroon": (176, 48, 96),
}


def luminosity(r: Column, g: Column, b: Column) -> Column:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def fast_luminosity(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright((FAST_LUMA[0] * r + FAST_LUMA[1] * g + FAST_LUMA[2] * b).cast("bigint"), 8)


def chroma_b(r: Column, g: Column, b: Column) -> Column:
    return -0.16874 * r - 0.33126 * g + 0.5 * b


def chroma_r(r: Column, g: Column, b: Column) -> Column:
    return 0.5 * r - 0.41869 * g - 0.08131 * b


def from_ycbcr(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    return y + 1.4022 * cr, y - 0.7145 * cr - 0.3456 * cb, y + 1.7710 * cb


def hsv(r: Column, g: Column, b: Column, maxval: int) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value from 0 to 1."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = F.nullif(high - low, F.lit(0)).cast("double")
    hue = F.when(r == high, (g - b) / span).when(g == high, 2 + (b - r) / span).otherwise(4 + (r - g) / span) * 60
    hue = F.coalesce(F.when(hue < 0, hue + 360).otherwise(hue), F.lit(0.0))
    return hue, F.coalesce((high - low) / F.nullif(high, F.lit(0)).cast("double"), F.lit(0.0)), high / F.lit(float(maxval))


def from_hsv(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue from 0 to 1."""
    sector = F.pmod(F.floor(h / 60), F.lit(6))
    f = h / 60 - F.floor(h / 60)
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    pick = lambda *order: reduce(lambda w, k: w.when(sector == k[0], k[1]), enumerate(order[1:], 1), F.when(sector == 0, order[0]))
    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


def to_709(x: Column) -> Column:
    """Linear intensity 0 to 1 to the transfer curve of Rec. 709."""
    return F.when(x < 0.018, 4.5 * x).otherwise(1.099 * F.pow(x, F.lit(0.45)) - 0.099)


def from_709(x: Column) -> Column:
    return F.when(x < 0.018 * 4.5, x / 4.5).otherwise(F.pow((x + 0.099) / 1.099, F.lit(1 / 0.45)))


def to_srgb(x: Column) -> Column:
    return F.when(x < 0.0031308, 12.92 * x).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def from_srgb(x: Column) -> Column:
    return F.when(x < 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def parse(spec: str, maxval: int = 255) -> tuple[int, ...]:
    """A colour from its name, #rgb to #rrrrggggbbbb, rgb:r/g/b in hex, or rgbi:r/g/b from 0 to 1."""
    if spec.startswith("#") and len(spec) in (4, 7, 10, 13):
        n = (len(spec) - 1) // 3
        return tuple((int(spec[1 + k * n : 1 + (k + 1) * n], 16) * maxval * 2 + 16**n - 1) // (2 * (16**n - 1)) for k in range(3))
    if spec.startswith("rgb:"):
        return tuple((int(p, 16) * maxval * 2 + 16 ** len(p) - 1) // (2 * (16 ** len(p) - 1)) for p in spec[4:].split("/"))
    if spec.startswith("rgbi:"):
        return tuple(int(float(p) * maxval + 0.5) for p in spec[5:].split("/"))
    name = spec.lower().replace(" ", "")
    if name not in NAMES:
        raise ValueError(f"no colour {spec!r}")
    return tuple((v * maxval * 2 + 255) // 510 for v in NAMES[name])


def distance2(a: Column, b: Column, depth: int) -> Column:
    """Squared distance of two cells."""
    return reduce(lambda x, y: x + y, ((a[k] - b[k]) * (a[k] - b[k]) for k in range(depth)))
