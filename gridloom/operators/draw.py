"""Lines, curves, shapes and letters drawn onto images.

Shapes are rasterised on the driver, where their parameters are, to a small table of
cells; drawing is a left join with it, and the table is broadcast only up to MAX_CELLS.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import functions as F

from gridloom.raster import CELL, Raster

Cell = tuple[int, int]
MAX_CELLS = 1 << 20


def line(a: Cell, b: Cell) -> list[Cell]:
    """Cells (row, col) from a to b."""
    n = max(abs(b[0] - a[0]), abs(b[1] - a[1]))
    return [(a[0] + _near((b[0] - a[0]) * k, n), a[1] + _near((b[1] - a[1]) * k, n)) for k in range(n + 1)]


def _near(p: int, q: int) -> int:
    return 0 if q == 0 else (2 * p + q) // (2 * q)


def polyline(points: list[Cell]) -> list[Cell]:
    return list(dict.fromkeys(c for a, b in zip(points, points[1:], strict=False) for c in line(a, b)))


def spline(points: list[Cell], steps: int = 16) -> list[Cell]:
    """A quadratic curve through the midpoints of the inner legs, bent towards each inner point."""
    if len(points) < 3:
        return polyline(points)
    mid = lambda a, b: ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
    ends = [points[0], *(mid(a, b) for a, b in zip(points[1:-2], points[2:-1], strict=True)), points[-1]]
    path: list[Cell] = []
    for a, c, b in zip(ends, points[1:-1], ends[1:], strict=False):
        for k in range(steps + 1):
            t = k / steps
            path.append(tuple(math.floor((1 - t) ** 2 * x + 2 * t * (1 - t) * y + t * t * z + 0.5) for x, y, z in zip(a, c, b, strict=True)))
    return polyline(path)


def circle(centre: Cell, radius: int) -> list[Cell]:
    """The cells nearest to a circle."""
    out: dict[Cell, None] = {}
    for k in range(math.ceil(radius / math.sqrt(2)) + 1):
        other = math.floor(math.sqrt(max(0, radius * radius - k * k)) + 0.5)
        for a, b in ((k, other), (other, k)):
            for s in (1, -1):
                for t in (1, -1):
                    out[centre[0] + s * a, centre[1] + t * b] = None
    return list(out)


def rectangle(top: int, left: int, height: int, width: int) -> list[Cell]:
    return [(top + i, left + j) for i in range(height) for j in range(width)]


def polygon(points: list[Cell]) -> list[Cell]:
    """The cells inside a closed outline (even-odd) and on it."""
    out = dict.fromkeys(polyline([*points, points[0]]))
    for row in range(min(r for r, _ in points), max(r for r, _ in points) + 1):
        cuts = sorted(a[1] + (row + 0.5 - a[0]) * (b[1] - a[1]) / (b[0] - a[0]) for a, b in zip(points, [*points[1:], points[0]], strict=True) if (a[0] <= row + 0.5) != (b[0] <= row + 0.5))
        for x, y in zip(cuts[::2], cuts[1::2], strict=True):
            out |= dict.fromkeys((row, col) for col in range(math.ceil(x), math.floor(y) + 1))
    return list(out)


#: Letters of three by five cells, a row an octal digit.
GLYPHS = {
    "A": 0o25755, "B": 0o65656, "C": 0o34443, "D": 0o65556, "E": 0o74647, "F": 0o74644, "G": 0o34553, "H": 0o55755, "I": 0o72227, "J": 0o11152, "K": 0o55655, "L": 0o44447, "M": 0o57755, "N": 0o65555, "O": 0o25552,
    "P": 0o65644, "Q": 0o25563, "R": 0o65655, "S": 0o34216, "T": 0o72222, "U": 0o55557, "V": 0o55552, "W": 0o55775, "X": 0o55255, "Y": 0o55222, "Z": 0o71247, "0": 0o75557, "1": 0o26227, "2": 0o61247, "3": 0o71317,
    "4": 0o55711, "5": 0o74616, "6": 0o34757, "7": 0o71222, "8": 0o75757, "9": 0o75716, ".": 0o00002, ",": 0o00024, "-": 0o00700, ":": 0o02020, "!": 0o22202, "?": 0o71202, " ": 0,
}


def text(s: str, top: int = 0, left: int = 0, size: int = 1) -> list[Cell]:
    """The cells of letters side by side; small ones as capitals, unknown ones blank."""
    out = []
    for k, c in enumerate(s.upper()):
        glyph = GLYPHS.get(c, 0)
        for i in range(5):
            for j in range(3):
                if glyph >> (3 * (4 - i) + 2 - j) & 1:
                    out += [(top + i * size + a, left + (k * 4 + j) * size + b) for a in range(size) for b in range(size)]
    return out


def draw(r: Raster, cells: Iterable[Cell], colour: tuple[int, ...]) -> Raster:
    """The cells of every image in a colour; those outside are left out."""
    inside = [(int(i), int(j)) for i, j in dict.fromkeys(cells) if 0 <= i < r.height and 0 <= j < r.width]
    if len(inside) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    table = F.broadcast(r.px.sparkSession.createDataFrame(inside, "row bigint, col bigint").withColumn("ink", F.lit(True)))
    ink = F.array(*(F.lit(int(v)).cast("bigint") for v in colour))
    return replace(r, px=r.px.join(table, ["row", "col"], "left").select(*CELL, F.when(F.col("ink"), ink).otherwise(F.col("s")).alias("s")))


def label(r: Raster, s: str, top: int, left: int, colour: tuple[int, ...], size: int = 1) -> Raster:
    return draw(r, text(s, top, left, size), colour)
