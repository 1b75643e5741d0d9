"""The registered queries: an operator over images made of the tables, and the same in SQL.

The images: orders become rasters of 100 columns, a cell an order, with samples from the
price, the customer and the key; lineitem becomes a sparse raster of summed quantities;
suppliers become spheres; order keys become rays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.raster import Raster, cells

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WIDTH = 100


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if sql:
            SQL[key] = _with_images(sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str, *planes, where: str = "true", maxval: int = 255) -> Raster:
    orders = table(spark, sf_dir, "orders").where(where)
    last = orders.agg(F.max("o_orderkey")).collect()[0][0]
    height = -1 if last is None else last // WIDTH
    key = F.col("o_orderkey")
    return cells(orders, F.expr(f"o_orderkey div {WIDTH}"), key % WIDTH, *planes, height=height + 1, width=WIDTH, maxval=maxval)


V = "cast(floor(o_totalprice) as bigint) % 256"
G = "(o_custkey * 7) % 256"
B = "(o_orderkey * 13) % 256"
W = "(o_custkey * 11) % 256"


def gray(spark: SparkSession, sf_dir: str) -> Raster:
    return _orders(spark, sf_dir, F.expr(V))


def other(spark: SparkSession, sf_dir: str) -> Raster:
    return _orders(spark, sf_dir, F.expr(W))


def rgb(spark: SparkSession, sf_dir: str) -> Raster:
    return _orders(spark, sf_dir, F.expr(V), F.expr(G), F.expr(B))


def rgb2(spark: SparkSession, sf_dir: str) -> Raster:
    return _orders(spark, sf_dir, F.expr(W), F.expr(V), F.expr(G))


def bits(spark: SparkSession, sf_dir: str) -> Raster:
    return _orders(spark, sf_dir, F.expr(f"cast({V} >= 128 as bigint)"), maxval=1)


def few(spark: SparkSession, sf_dir: str) -> Raster:
    """Gray of at most 16 levels."""
    return _orders(spark, sf_dir, F.expr(f"({V}) div 16"), maxval=15)


def sparse(spark: SparkSession, sf_dir: str) -> Raster:
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    return cells(items, F.col("l_orderkey"), F.col("l_linenumber"), F.least(F.lit(255), F.col("q").cast("bigint")), height=0, width=8)


#: The same images for SQL.
IMAGES = f"""
img AS (SELECT (o_orderkey // {WIDTH})::BIGINT AS row, (o_orderkey % {WIDTH})::BIGINT AS col,
  (floor(o_totalprice)::BIGINT % 256)::BIGINT AS v, ((o_custkey * 7) % 256)::BIGINT AS g, ((o_orderkey * 13) % 256)::BIGINT AS b,
  ((o_custkey * 11) % 256)::BIGINT AS w, (floor(o_totalprice)::BIGINT % 256 >= 128)::BIGINT AS bit, ((floor(o_totalprice)::BIGINT % 256) // 16)::BIGINT AS few FROM orders),
size AS (SELECT max(row) + 1 AS height, {WIDTH}::BIGINT AS width FROM img),
sparse AS (SELECT l_orderkey::BIGINT AS row, l_linenumber::BIGINT AS col, least(255, sum(l_quantity)::BIGINT)::BIGINT AS v FROM lineitem GROUP BY 1, 2)
"""


def _with_images(sql: str) -> str:
    sql = sql.strip()
    if sql[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {IMAGES.strip()},\n{sql[15:]}"
    if sql[:5].upper() == "WITH ":
        return f"WITH {IMAGES.strip()},\n{sql[5:]}"
    return f"WITH {IMAGES.strip()}\n{sql}"
