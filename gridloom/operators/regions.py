"""Regions of cells of one colour that touch, four ways: labels, flooding from the edge, filling from seeds.

Lines are dealt to bands of about BAND cells.  A task finds the runs of its band (stretches of
one colour along a line) and joins those that touch from line to line, so that a region is one
node for each band.  Nodes that touch across two bands, cell by cell, are the edges of a small
graph whose components are found by large and small stars: its rounds grow with the logarithm
of how many bands a region winds through, not with its area or its turns.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.raster import CELL, Raster
from gridloom.shared import settled

#: Cells of a band, about.
BAND = 1 << 16


def components(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges (a, b) of nodes of any ordered type to (a, b) with b the least node of a's component, a over every other node of it; and the rounds it took.

    Each node's least neighbour is found by an aggregate, partly made before the shuffle, and
    joined back.  Loops and repeated edges, either way round, count once; no edges give no rows.
    """
    edges = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 30))).collect()[0])
    before, now, rounds = None, state(edges), 0
    while before != now and now[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = settled(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = settled(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        before, now, rounds = now, state(edges), rounds + 1
    return edges, rounds


def touching(row: np.ndarray, first: np.ndarray, last: np.ndarray, color: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs, sorted by row and column, of one colour that touch from one line to the next."""
    start, end = row * width + first, row * width + last
    lo = np.searchsorted(end, start + width)
    hi = np.searchsorted(start, end + width, side="right")
    n = np.maximum(hi - lo, 0)
    one = np.repeat(np.arange(len(row)), n)
    two = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    same = color[one] == color[two]
    return one[same], two[same]


def joined(one: np.ndarray, two: np.ndarray, n: int) -> np.ndarray:
    """The least of the nodes 0 .. n - 1 that each reaches."""
    least = np.arange(n)
    while True:
        both = np.minimum(least[one], least[two])
        new = least.copy()
        for at in (one, two, least[one], least[two]):
            np.minimum.at(new, at, both)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def band_rows(width: int) -> int:
    """Lines of a band."""
    return max(1, BAND // max(1, width))


def _runs(px: DataFrame, width: int) -> DataFrame:
    """image, row, first, last, s and node of every run; node names, within its band, the region's first run by its place."""

    def one(table: pa.Table) -> pa.Table:
        row, col = table.column("row").to_numpy(), table.column("col").to_numpy()
        order = np.lexsort((col, row))
        row, col = row[order], col[order]
        s = table.column("s").combine_chunks()
        planes = s.flatten().to_numpy().reshape(len(row), -1)[order]
        _, color = np.unique(planes, axis=0, return_inverse=True)
        color = color.ravel()
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1) | (color[1:] != color[:-1])
        at = np.flatnonzero(new)
        row, first, last, kind = row[at], col[at], col[np.append(at[1:], len(col)) - 1], color[at]
        label = joined(*touching(row, first, last, kind, width), len(at))
        node = (row * width + first)[label]
        names = table.column("image").combine_chunks().take(pa.array(np.zeros(len(at), np.int64)))
        return pa.table({"image": names, "row": row, "first": first, "last": last, "s": s.take(pa.array(order[at])), "node": node})

    banded = px.withColumn("band", F.floor(F.col("row") / F.lit(band_rows(width))).cast("bigint"))
    return banded.groupBy("image", "band").applyInArrow(one, "image string, row bigint, first bigint, last bigint, s array<bigint>, node bigint")


def regions(px: DataFrame, width: int) -> tuple[DataFrame, int]:
    """Runs (image, row, first, last, s) with label, the least place of a cell of the region in its image (row * width + col); and the rounds it took."""
    n = band_rows(width)
    runs = settled(_runs(px.select(*CELL, "s"), width))
    edge = lambda line, shift: runs.where((F.col("row") % n) == line).select("image", (F.col("row") + shift).alias("row"), F.explode(F.sequence("first", "last")).alias("col"), "s", "node")
    name = lambda c: F.struct("image", F.col(c).alias("node"))
    meet = edge(n - 1, 1).withColumnRenamed("node", "above").join(edge(0, 0), ["image", "row", "col", "s"])
    found, rounds = components(meet.select(name("above").alias("a"), name("node").alias("b")))
    named = found.select("a.image", "a.node", F.col("b.node").alias("least"))
    out = runs.join(named, ["image", "node"], "left").select("image", "row", "first", "last", "s", F.coalesce("least", "node").alias("label"))
    return out, rounds


def flood(r: Raster, color: int) -> DataFrame:
    """image, row and col of the cells of a colour that are joined to the image's edge by such cells, four ways."""
    runs, _ = regions(r.px.where(r.plane() == color), r.width)
    at_edge = (F.col("row") == 0) | (F.col("row") == r.height - 1) | (F.col("first") == 0) | (F.col("last") == r.width - 1)
    outer = runs.where(at_edge).select("image", "label").distinct()
    return runs.join(outer, ["image", "label"], "left_semi").select("image", "row", F.explode(F.sequence("first", "last")).alias("col"))


def fill(r: Raster, seeds: list[tuple[int, int]], color: tuple[int, ...]) -> Raster:
    """Every region, of whatever colour, that holds one of the cells seeds (row, col) in a new colour, in every image; seeds outside change nothing."""
    if len(color) != r.depth:
        raise ValueError("the colour has another number of planes")
    if not seeds:
        return r
    runs, _ = regions(r.px, r.width)
    places = F.broadcast(r.px.sparkSession.createDataFrame(seeds, "row bigint, at bigint"))  # the caller's list
    chosen = runs.join(places, "row").where("at between first and last").select("image", "label").distinct()
    painted = runs.join(chosen, ["image", "label"], "left_semi").select("image", "row", F.explode(F.sequence("first", "last")).alias("col"), F.lit(True).alias("in"))
    new = F.array(*(F.lit(c).cast("bigint") for c in color))
    return replace(r, px=r.px.join(painted, list(CELL), "left").select(*CELL, F.when(F.col("in"), new).otherwise(F.col("s")).alias("s")))
