"""The raster relation.

A Raster is a DataFrame with one row per cell, ``image, row, col, s``, where s is an array
with one bigint for each plane, plus what is constant over it: height, width and maxval.
Several images of one size share a Raster; operators keep them apart by ``image``.  Gray
images have one plane, colour ones three.  In bitmaps 0 is black and 1 is white.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = ("image", "row", "col")


@dataclass(frozen=True)
class Raster:
    px: DataFrame
    height: int
    width: int
    maxval: int = 255
    depth: int = 1

    def map(self, f, **changed) -> Raster:
        """The same cells with f(sample) in every plane."""
        return self.with_cell(F.transform("s", f), **changed)

    def with_cell(self, s: Column, **changed) -> Raster:
        """The same cells with s as their planes."""
        return replace(self, px=self.px.select(*CELL, s.alias("s")), **changed)

    def plane(self, k: int = 0) -> Column:
        return F.col("s")[k]

    def long(self) -> DataFrame:
        """One row per sample: image, row, col, plane, v."""
        return self.px.select(*CELL, F.posexplode("s").alias("plane", "v"))

    def flat(self) -> DataFrame:
        """Columns row, col, p0, p1, ...: for output."""
        return self.px.select("row", "col", *(F.col("s")[k].alias(f"p{k}") for k in range(self.depth)))


def cells(df: DataFrame, row: Column, col: Column, *planes: Column, height: int, width: int, maxval: int = 255, image: str = "a") -> Raster:
    """A raster from any table: where each record lies, and its samples."""
    s = F.array(*(p.cast("bigint") for p in planes))
    return Raster(df.select(F.lit(image).alias("image"), row.cast("bigint").alias("row"), col.cast("bigint").alias("col"), s.alias("s")), height, width, maxval, len(planes))


def grid(spark: SparkSession, height: int, width: int, image: str = "a") -> DataFrame:
    """Every (image, row, col), generated in parallel without input."""
    ids = spark.range(height * width)
    return ids.select(F.lit(image).alias("image"), F.expr(f"id div {max(1, width)}").alias("row"), (F.col("id") % max(1, width)).alias("col"))


def images(raster: Raster) -> DataFrame:
    return raster.px.select("image").distinct()


#: Cells of a generated image that one task makes, about; tasks at most, as cells that are made take no memory.
PER_TASK, TASKS = 1 << 20, 1 << 14

#: Lines and columns of a block of cells beyond a span.
BLOCK = 1 << 12, 1 << 8


def full_grid(raster: Raster, height: int, width: int, span: tuple[Column, Column] | None = None, across: int | None = None, beyond: bool = False) -> DataFrame:
    """Every cell of every image of the raster at a new size: a row for each line first, dealt to tasks, and cells there.

    With span, the first and last column of each line by its row, only the cells between (some
    across of them), or those beyond.  These can be the square of an image's cells, and are
    dealt and made by blocks: the same few columns line after line are a small fraction of a
    byte a cell in files by columns, where those of a wide line take 4.  What joins the grid
    should say how (a merge): a grid is far larger than the lines that Spark takes it for, and
    mustn't be broadcast.
    """
    if not (height and width):
        return images(raster).withColumn("row", F.lit(0).cast("bigint")).withColumn("col", F.col("row")).where("false")
    tasks = max(raster.px.sparkSession.sparkContext.defaultParallelism, min(TASKS, height * (across or width) // PER_TASK))
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    long = lambda n: F.lit(n).cast("bigint")
    first, last = (F.greatest(long(0), span[0].cast("bigint")), F.least(long(width - 1), span[1].cast("bigint"))) if span else (long(0), long(width - 1))
    if beyond:
        top, left = F.col("top"), F.col("left")
        corner = lambda size, side: F.explode(F.sequence(long(0), long(size - 1), long(side)))
        blocks = images(raster).withColumn("top", corner(height, BLOCK[0])).withColumn("left", corner(width, BLOCK[1])).repartition(tasks, "image", "top", "left")
        lines = blocks.withColumn("row", F.explode(F.sequence(top, F.least(top + BLOCK[0], long(height)) - 1)))
        lines = lines.select("image", "row", "left", (F.least(left + BLOCK[1], long(width)) - 1).alias("right"), first.alias("first"), last.alias("last")).sortWithinPartitions("image", "left", "row")
        return lines.withColumn("col", F.explode(F.sequence("left", "right"))).where("col < first or col > last or first > last").select(*CELL)
    lines = images(raster).withColumn("row", F.explode(upto(long(0), long(height - 1)))).repartition(tasks, "image", "row")
    cols = upto(first, last)
    return lines.withColumn("col", F.explode(cols))


def rounded(x: Column) -> Column:
    """Nearest integer, halves up, for values of 0 or more."""
    return F.floor(x + 0.5).cast("bigint")


def clamp(x: Column, maxval: int) -> Column:
    return F.least(F.lit(maxval).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), x.cast("bigint")))


def div(a: Column, b: int) -> Column:
    """Integer division of bigints, towards zero."""
    return F.when(a >= 0, F.floor(a / F.lit(b))).otherwise(-F.floor(-a / F.lit(b))).cast("bigint")
