"""Aggregates over cells: partial sums before every shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import color
from gridloom.operators.point import histogram
from gridloom.raster import Raster, clamp, rounded


def summary(r: Raster) -> DataFrame:
    """image, sum, mean, min and max of all samples."""
    per = r.px.select("image", F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("t"), F.array_min("s").alias("lo"), F.array_max("s").alias("hi"))
    return per.groupBy("image").agg(F.sum("t").alias("sum"), (F.sum("t") / (F.count("*") * r.depth)).alias("mean"), F.min("lo").alias("min"), F.max("hi").alias("max"))


def columns(r: Raster, how: str = "sum") -> DataFrame:
    """For each column and plane: the sum held at maxval, the rounded mean, the least or the largest."""
    v = {"sum": clamp(F.sum("v"), r.maxval), "mean": rounded(F.avg("v")), "min": F.min("v"), "max": F.max("v")}[how]
    return r.long().groupBy("image", "col", "plane").agg(v.alias("v"))


def levels(r: Raster) -> DataFrame:
    """Level, count, and the cells up to and from it: image, v, n, up, down."""
    up = Window.partitionBy("image").orderBy("v")
    down = Window.partitionBy("image").orderBy(F.desc("v"))
    return histogram(r).select("image", "v", "n", F.sum("n").over(up).alias("up"), F.sum("n").over(down).alias("down"))


def colors(r: Raster, order: str = "frequency") -> DataFrame:
    """Distinct colours with their luminosity and count, numbered from 0: by count (then colour), or by colour."""
    n = r.px.groupBy("image", "s").agg(F.count("*").alias("n"))
    by = [F.desc("n"), "s"] if order == "frequency" else ["s"]
    s = F.col("s")
    lum = rounded(color.luminosity(s[0], s[1], s[2])) if r.depth == 3 else s[0]
    return n.select("image", "s", lum.alias("lum"), "n", (F.row_number().over(Window.partitionBy("image").orderBy(*by)) - 1).cast("bigint").alias("place"))


def buckets(r: Raster, start: int, end: int, n: int, most: int | None = None) -> DataFrame:
    """Histogram of values start..end in n buckets, counts held at most: image, bucket, n."""
    v = r.plane()
    px = r.px.where(v.between(start, end)).select("image", F.floor((v - start) * n / F.lit(end - start + 1)).cast("bigint").alias("bucket"))
    count = F.count("*")
    return px.groupBy("image", "bucket").agg((count if most is None else F.least(count, F.lit(most))).cast("bigint").alias("n"))


def co_occurrence(r: Raster, d: int = 1) -> DataFrame:
    """Symmetric counts of gray levels at distance d in four directions: image, angle, i, j, n.  i and j are the levels' ranks."""
    v = r.plane()
    rank = r.px.select("image", v.alias("v")).distinct().withColumn("k", (F.dense_rank().over(Window.partitionBy("image").orderBy("v")) - 1).cast("bigint"))
    px = r.px.select("image", "row", "col", v.alias("v")).join(rank, ["image", "v"]).select("image", "row", "col", "k")
    moves = F.array(*(F.struct(F.lit(a).alias("angle"), F.lit(dr).cast("bigint").alias("dr"), F.lit(dc).cast("bigint").alias("dc")) for a, dr, dc in ((0, 0, d), (45, d, -d), (90, d, 0), (135, d, d))))
    there = px.withColumn("m", F.explode(moves)).select("image", (F.col("row") + F.col("m.dr")).alias("row"), (F.col("col") + F.col("m.dc")).alias("col"), F.col("k").alias("i"), F.col("m.angle").alias("angle"))
    pair = there.join(px.withColumnRenamed("k", "j"), ["image", "row", "col"]).groupBy("image", "angle", "i", "j").agg(F.count("*").alias("n"))
    return pair.union(pair.select("image", "angle", F.col("j").alias("i"), F.col("i").alias("j"), "n")).groupBy("image", "angle", "i", "j").agg(F.sum("n").alias("n"))


FEATURES = ("asm", "contrast", "correlation", "variance", "idm", "sum_average", "sum_variance", "sum_entropy", "entropy", "difference_variance", "difference_entropy", "correlation_1", "correlation_2", "max_correlation")
#: Fixed value: what logarithms are kept away from 0 by.
EPSILON = 1e-9


def features_of(p: np.ndarray) -> list[float]:
    """The texture features of one normalised co-occurrence matrix, levels x levels.

    Variance counts rows from 1
    against a mean that counts them from 0, and the difference variance is that of the
    probabilities themselves.  The largest correlation is the root of the second largest
    eigenvalue.
    """
    n = len(p)
    i, j = np.indices(p.shape)
    log = lambda x: np.log10(x + EPSILON)
    px, py = p.sum(axis=1), p.sum(axis=0)
    k = np.arange(n)
    plus, minus = np.bincount((i + j).ravel(), p.ravel(), 2 * n - 1), np.bincount(abs(i - j).ravel(), p.ravel(), n)
    mean, square = (px * k).sum(), (px * k * k).sum()
    deviation = square - mean * mean
    s_entropy = -(plus * log(plus)).sum()
    h, hx, hy = -(p * log(p)).sum(), -(px * log(px)).sum(), -(py * log(py)).sum()
    both = np.outer(px, py)
    h1, h2 = -(p * log(both)).sum(), -(both * log(both)).sum()
    steps = np.arange(2 * n - 1) + 2
    safe = lambda a: np.divide(1.0, a, out=np.zeros_like(a), where=a > 0)
    q = (p * safe(px)[:, None]) @ (p * safe(py)[None, :]).T
    eigen = np.sort(np.linalg.eigvals(q).real)[::-1]
    return [
        float(x)
        for x in (
            (p * p).sum(), ((i - j) ** 2 * p).sum(), ((i * j * p).sum() - mean * mean) / deviation if deviation > 0 else 0.0, ((i + 1 - mean) ** 2 * p).sum(),
            (p / (1 + (i - j) ** 2)).sum(), (steps * plus).sum(), ((steps - s_entropy) ** 2 * plus).sum(), s_entropy, h, minus.var(), -(minus * log(minus)).sum(),
            (h - h1) / max(hx, hy) if max(hx, hy) > 0 else 0.0, np.sqrt(abs(1 - np.exp(-2 * (h2 - h)))), np.sqrt(max(0.0, eigen[1])) if n > 1 else 0.0,
        )
    ]


def texture(r: Raster, d: int = 1) -> DataFrame:
    """image, angle and the fourteen FEATURES.  Counts are summed by Spark; a group here is a matrix of at most (maxval + 1) squared cells."""
    shares = {0: 2 * r.height * (r.width - 1), 45: 2 * (r.height - 1) * (r.width - 1), 90: 2 * (r.height - 1) * r.width, 135: 2 * (r.height - 1) * (r.width - 1)}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(max(pdf.i.max(), pdf.j.max())) + 1
        p = np.zeros((n, n))
        p[pdf.i, pdf.j] = pdf.n / max(1, shares[int(pdf.angle.iloc[0])])
        return pd.DataFrame([[pdf.image.iloc[0], pdf.angle.iloc[0], *features_of(p)]], columns=["image", "angle", *FEATURES])

    return co_occurrence(r, d).groupBy("image", "angle").applyInPandas(one, "image string, angle int, " + ", ".join(f"{f} double" for f in FEATURES))


def _edges(r: Raster, level):
    """Levels at which each tile, edge and vertex appears: image, kind, level."""
    here = r.px.select("image", "row", "col", level.alias("v"))
    parts = [
        ("tile", [(0, 0)]), ("across", [(0, 0), (0, 1)]), ("down", [(0, 0), (1, 0)]), ("vertex", [(0, 0), (0, 1), (1, 0), (1, 1)]),
    ]
    moves = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for kind, own in parts for a, b in own))
    each = here.withColumn("m", F.explode(moves)).select("image", "v", F.col("m.kind").alias("kind"), (F.col("row") + F.col("m.a")).alias("row"), (F.col("col") + F.col("m.b")).alias("col"))
    return each.groupBy("image", "kind", "row", "col").agg(F.max("v").alias("v"))


def _functionals(n: DataFrame, *keys: str) -> DataFrame:
    t, e, v = F.col("tile"), F.col("across") + F.col("down"), F.col("vertex")
    return n.select(*keys, t.alias("area"), (2 * e - 4 * t).alias("perimeter"), (t - e + v).alias("euler"))


def minkowski(r: Raster) -> DataFrame:
    """Area, perimeter and Euler number of the white cells of a bitmap, by image."""
    n = _edges(r, r.plane()).where("v > 0").groupBy("image").pivot("kind", ["tile", "across", "down", "vertex"]).count().na.fill(0)
    return _functionals(n, "image")


def minkowski_levels(r: Raster) -> DataFrame:
    """The same of the cells at or above each level that occurs: image, level, area, perimeter, euler."""
    n = _edges(r, r.plane()).groupBy("image", F.col("v").alias("level")).pivot("kind", ["tile", "across", "down", "vertex"]).count().na.fill(0)
    w = Window.partitionBy("image").orderBy(F.desc("level"))
    n = n.select("image", "level", *(F.sum(k).over(w).alias(k) for k in ("tile", "across", "down", "vertex")))
    return _functionals(n, "image", "level")


def median_cut(counts: list[tuple[tuple[int, ...], int]], n: int, representative: str = "mean_pixel", spread: str = "norm") -> list[tuple[int, ...]]:
    """A palette of at most n colours from distinct colours and their counts.

    Boxes in order of population; the first with more than one colour is cut at the median
    of its widest plane.  representative: centre, mean_color or mean_pixel.
    """
    if not counts:
        return []
    boxes = [sorted(counts)]
    weight = color.LUMA if spread == "luminosity" and len(counts[0][0]) == 3 else (1.0,) * len(counts[0][0])
    while len(boxes) < n:
        boxes.sort(key=lambda b: (-sum(c for _, c in b), b[0]))
        own = next((k for k, b in enumerate(boxes) if len(b) > 1), None)
        if own is None:
            break
        box = boxes.pop(own)
        wide = max(range(len(weight)), key=lambda p: (max(s[p] for s, _ in box) - min(s[p] for s, _ in box)) * weight[p])
        box.sort(key=lambda x: (x[0][wide], x[0]))
        half, k, seen = sum(c for _, c in box) // 2, 1, box[0][1]
        while k < len(box) - 1 and seen < half:
            seen += box[k][1]
            k += 1
        boxes += [box[:k], box[k:]]
    out = []
    for box in boxes:
        planes = range(len(box[0][0]))
        if representative == "centre":
            out.append(tuple((min(s[p] for s, _ in box) + max(s[p] for s, _ in box)) // 2 for p in planes))
        elif representative == "mean_color":
            out.append(tuple(sum(s[p] for s, _ in box) // len(box) for p in planes))
        else:
            out.append(tuple(sum(s[p] * c for s, c in box) // sum(c for _, c in box) for p in planes))
    return out


#: Distinct colours up to which a palette is made of them as they are.
MAX_COLORS = 32767


def palette(r: Raster, n: int, **options) -> list[tuple[int, ...]]:
    """A palette for all images together.  With more than MAX_COLORS distinct colours the scale is halved until there are no more, so what comes to the driver is bounded."""
    maxval = r.maxval

    def scaled(to: int):
        return F.transform("s", lambda x: F.floor((x * to + r.maxval // 2) / F.lit(r.maxval)).cast("bigint")).alias("s")

    while True:
        found = r.px.groupBy(scaled(maxval)).count().limit(MAX_COLORS + 1).collect()
        if len(found) <= MAX_COLORS:
            colors_ = median_cut([(tuple(c["s"]), c["count"]) for c in found], n, **options)
            return [tuple((v * r.maxval + maxval // 2) // maxval for v in c) for c in colors_]
        maxval //= 2


def describe(r: Raster) -> DataFrame:
    """One row per image: its size, planes and maxval."""
    return r.px.groupBy("image").agg(F.count("*").alias("n_cells")).select("image", F.lit(r.height).alias("height"), F.lit(r.width).alias("width"), F.lit(r.depth).alias("depth"), F.lit(r.maxval).cast("bigint").alias("maxval"), "n_cells")
