"""Raw files by rows: ranges, pushed filters, tasks that write parts of one image, and jobs that fail."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, LessThanOrEqual

from gridloom.raster import Raster
from gridloom.sources import anymap, rowscan


def image(spark, height, width, depth=1, maxval=255, name="a"):
    ids = spark.range(height * width)
    row, col = F.expr(f"id div {width}"), F.col("id") % width
    planes = [(row * 7 + col * (3 + k) + k) % (maxval + 1) for k in range(depth)]
    return Raster(ids.select(F.lit(name).alias("image"), row.cast("bigint").alias("row"), col.alias("col"), F.array(*planes).alias("s")), height, width, maxval, depth)


def cells(df):
    return sorted((r["row"], r["col"], tuple(r["s"])) for r in df.collect())


@pytest.mark.parametrize(("format", "depth", "maxval"), [("P4", 1, 1), ("P5", 1, 255), ("P5", 1, 1000), ("P6", 3, 255), ("P7", 2, 65535), ("P7", 5, 7)])
@pytest.mark.parametrize("tasks", [1, 5])
def test_written_files_are_those_of_one_task(spark, tmp_path, format, depth, maxval, tasks):
    r = image(spark, 23, 13, depth, maxval)
    rowscan.write_rows(r, str(tmp_path), format, tasks)
    names = os.listdir(tmp_path)
    assert names == ["a." + rowscan.ENDS[format]]
    m = np.zeros((23, 13, depth), np.int64)
    for row, col, s in cells(r.px):
        m[row, col] = s
    raw = (tmp_path / names[0]).read_bytes()
    assert raw == anymap.encode(m, maxval, format)
    got = rowscan.read_rows(spark, str(tmp_path), bytes=16)
    assert (got.height, got.width, got.depth, got.maxval) == (23, 13, depth, maxval)
    assert got.px.rdd.getNumPartitions() > 1 and cells(got.px) == cells(r.px)


def test_a_filter_on_rows_reads_only_their_bytes(spark, tmp_path):
    rowscan.write_rows(image(spark, 400, 50), str(tmp_path), "P5")
    reader = rowscan.Reader(str(tmp_path), ["row"], 1000)
    whole = sum(p.bytes for p in reader.partitions())
    other = IsNotNull(("s",))
    assert list(reader.pushFilters([GreaterThan(("row",), 99), LessThanOrEqual(("row",), 109), other])) == [other]
    parts = reader.partitions()
    assert whole == 400 * 50 and sum(p.bytes for p in parts) == 10 * 50 and (parts[0].first, parts[-1].last) == (100, 110)
    assert list(reader.pushFilters([EqualTo(("image",), "none")])) == [] and sum(p.bytes for p in reader.partitions()) == 0
    band = rowscan.scan(spark, str(tmp_path), ("row", "col"), 1000).where("row > 99 and row <= 109")
    assert band.columns == ["row", "col"] and band.rdd.getNumPartitions() == 1 and band.count() == 500
    assert "PythonUDF" not in band._jdf.queryExecution().executedPlan().toString()


def test_several_images_in_files_and_folders(spark, tmp_path):
    one, two = np.arange(12).reshape(3, 4, 1), np.arange(30).reshape(2, 5, 3)
    (tmp_path / "x.pnm").write_bytes(anymap.encode(one, 255, "P5") + b"\n" + anymap.encode(two, 255, "P6"))
    (tmp_path / "y.pgm").write_bytes(b"P5 # a remark\n2 1\n255\n\x01\x02")
    got = {(os.path.basename(r["image"]), r["row"], r["col"]): r["s"] for r in rowscan.scan(spark, str(tmp_path)).collect()}
    assert len(got) == 12 + 10 + 2 and got["x.pnm", 2, 3] == [11] and got["x.pnm#1", 1, 4] == [27, 28, 29] and got["y.pgm", 0, 1] == [2]
    (tmp_path / "z.pgm").write_bytes(b"P5\n4 4\n255\nshort")
    with pytest.raises(ValueError, match="ends early"):
        list(rowscan.images(str(tmp_path / "z.pgm")))
    (tmp_path / "z.pgm").write_bytes(b"P2\n1 1\n9\n5\n")
    with pytest.raises(ValueError, match="anymap.read"):
        list(rowscan.images(str(tmp_path / "z.pgm")))


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    r = image(spark, 40, 10)
    broken = Raster(r.px.withColumn("col", F.when(F.col("row") == 39, 10).otherwise(F.col("col"))), 40, 10)
    with pytest.raises(Exception, match="outside the image"):
        rowscan.write_rows(broken, str(tmp_path), "P5", 4)
    assert os.listdir(tmp_path) == []


def test_missing_cells_repeated_rows_and_many_images(spark, tmp_path):
    some = image(spark, 9, 4, name="p/q").px.where("row % 4 <> 1").union(image(spark, 9, 4, name="r").px.where("col < 2"))
    rowscan.write_rows(Raster(some, 9, 4), str(tmp_path), "P5", 3, repeat=2)
    assert sorted(os.listdir(tmp_path)) == ["p_q.pgm", "r.pgm"]
    h, m, _ = anymap.decode((tmp_path / "p_q.pgm").read_bytes())
    assert (h.height, h.width) == (18, 4) and not m[2:4].any() and (m[0::2] == m[1::2]).all() and m[4, 3, 0] == 2 * 7 + 9
    _, m, _ = anymap.decode((tmp_path / "r.pgm").read_bytes())
    assert not m[:, 2:].any() and m[17, 1, 0] == 8 * 7 + 3
    rowscan.write_rows(Raster(some.limit(0), 9, 4), str(tmp_path / "none"), "P5")
    assert os.listdir(tmp_path / "none") == []
