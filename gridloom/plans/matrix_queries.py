"""Queries of the matrix operators, over lineitem folded to 8 x 8 and vectors of embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import blocked
from gridloom.operators import matrix as M
from gridloom.plans.catalog import query, sparse, table


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i = row % 8, j = col % 8, v = the sum: whole numbers, so products are exact."""
    px = sparse(spark, sf_dir).px
    return px.groupBy((F.col("row") % 8).alias("i"), (F.col("col") % 8).alias("j")).agg(F.sum(F.col("s")[0]).cast("double").alias("v"))


def other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.apply_indexed(folded(spark, sf_dir), lambda i, j, v: F.pmod(v, F.lit(97.0)) + i - j)


BASE = "WITH a AS (SELECT row % 8 AS i, col % 8 AS j, sum(v)::DOUBLE AS v FROM sparse GROUP BY 1, 2), c AS (SELECT i, j, v % 97 + i - j AS v FROM a) "

PLAIN = {
    "matrix_transpose": (M.transpose, "SELECT j AS i, i AS j, v FROM a"),
    "matrix_scale": (lambda a: M.scale(a, 0.5), "SELECT i, j, v * 0.5::DOUBLE AS v FROM a"),
    "matrix_negative": (M.negative, "SELECT i, j, -v AS v FROM a"),
    "matrix_floor": (lambda a: M.apply(a, lambda v: F.floor(v / 7).cast("double")), "SELECT i, j, floor(v / 7) AS v FROM a"),
    "matrix_part": (lambda a: M.part(a, 2, 1, 3, 4), "SELECT i - 2 AS i, j - 1 AS j, v FROM a WHERE i BETWEEN 2 AND 4 AND j BETWEEN 1 AND 4"),
    "matrix_diagonal": (lambda a: M.diagonal(a, 1), "SELECT i, j, v FROM a WHERE j - i = 1"),
    "matrix_tridiagonal": (lambda a: M.shape(a, "tridiagonal"), "SELECT i, j, v FROM a WHERE abs(i - j) <= 1"),
    "matrix_upper": (lambda a: M.shape(a, "upper"), "SELECT i, j, v FROM a WHERE i <= j"),
    "matrix_lower": (lambda a: M.shape(a, "lower"), "SELECT i, j, v FROM a WHERE i >= j"),
    "matrix_row": (lambda a: M.row(a, 3), "SELECT i, j, v FROM a WHERE i = 3"),
    "matrix_column": (lambda a: M.column(a, 3), "SELECT i, j, v FROM a WHERE j = 3"),
    "matrix_swap_rows": (lambda a: M.swap_rows(a, 1, 6), "SELECT CASE i WHEN 1 THEN 6 WHEN 6 THEN 1 ELSE i END::BIGINT AS i, j, v FROM a"),
    "matrix_resize": (lambda a: M.resize(a, 9, 5, -1.0), "SELECT x.i, y.j, coalesce(v, -1) AS v FROM (SELECT unnest(range(9)) AS i) x CROSS JOIN (SELECT unnest(range(5)) AS j) y LEFT JOIN a ON a.i = x.i AND a.j = y.j"),
    "matrix_trace": (M.trace, "SELECT sum(v) AS trace FROM a WHERE i = j"),
    "matrix_norms": (M.norms, "SELECT (SELECT max(t) FROM (SELECT sum(abs(v)) AS t FROM a GROUP BY j)) AS norm1, (SELECT max(t) FROM (SELECT sum(abs(v)) AS t FROM a GROUP BY i)) AS norm_inf, sqrt(sum(v * v)) AS norm_f FROM a"),
    "matrix_reductions": (M.reductions, "SELECT sum(v) AS sum, min(v) AS min, max(v) AS max FROM a"),
    "matrix_square": (lambda a: M.power(a, 2, 8), "SELECT x.i, y.j, sum(x.v * y.v) AS v FROM a x JOIN a y ON x.j = y.i GROUP BY 1, 2"),
    "matrix_predicates": (lambda a: M.predicates(M.shape(a, "upper")), "SELECT false AS is_diagonal, false AS is_scalar, false AS is_unit, false AS is_null, bool_and(NOT (i > j AND i <= j AND v <> 0)) AS is_upper, false AS is_lower, false AS is_symmetric, false AS is_skew FROM a"),
    "matrix_symmetric": (lambda a: M.predicates(M.add(a, M.transpose(a))).select("is_symmetric", "is_skew"), "WITH s AS (SELECT x.i, x.j, x.v + coalesce(y.v, 0) AS v FROM a x LEFT JOIN a y ON x.i = y.j AND x.j = y.i UNION ALL SELECT y.j, y.i, y.v FROM a y WHERE NOT EXISTS (SELECT 1 FROM a x WHERE x.i = y.j AND x.j = y.i)) SELECT bool_and(s.v = coalesce(t.v, 0)) AS is_symmetric, bool_and(s.v = -coalesce(t.v, 0)) AS is_skew FROM s LEFT JOIN s t ON s.i = t.j AND s.j = t.i"),
}


def _add(name, f, sql):
    sql = BASE + sql.replace("WITH s AS", ", s AS", 1) if not sql.startswith("WITH") else BASE.rstrip() + ", " + sql[5:]
    query(sql, name)(lambda spark, sf_dir: f(folded(spark, sf_dir)))


for _name, (_f, _sql) in PLAIN.items():
    _add(_name, _f, _sql)

TWO = {
    "matrix_add": (M.add, "SELECT i, j, a.v + c.v AS v FROM a JOIN c USING (i, j)"),
    "matrix_subtract": (M.subtract, "SELECT i, j, a.v - c.v AS v FROM a JOIN c USING (i, j)"),
    "matrix_multiply": (M.multiply, "SELECT a.i, c.j, sum(a.v * c.v) AS v FROM a JOIN c ON a.j = c.i GROUP BY 1, 2"),
    "matrix_multiply_blocked": (lambda a, c: M.multiply_blocked(a, c, 3), "SELECT a.i, c.j, sum(a.v * c.v) AS v FROM a JOIN c ON a.j = c.i GROUP BY 1, 2 HAVING sum(a.v * c.v) <> 0"),
    "matrix_equal": (M.equal, "SELECT bool_and(abs(a.v - c.v) <= 2.3e-12 * greatest(1, abs(a.v))) AS equal FROM a JOIN c USING (i, j)"),
}


def _pair(name, f, sql):
    query(BASE + sql, name)(lambda spark, sf_dir: f(folded(spark, sf_dir), other(spark, sf_dir)))


for _name, (_f, _sql) in TWO.items():
    _pair(_name, _f, _sql)


@query(BASE + "SELECT i, sum(v * (j + 1)) AS v FROM a GROUP BY i")
def matrix_times_vector(spark, sf_dir):
    x = spark.range(8).select(F.col("id").alias("j"), (F.col("id") + 1).cast("double").alias("x"))
    return M.times_vector(folded(spark, sf_dir), x)


@query(BASE + "SELECT j, sum(v * (i + 1)) AS v FROM a GROUP BY j")
def vector_times_matrix(spark, sf_dir):
    x = spark.range(8).select(F.col("id").alias("i"), (F.col("id") + 1).cast("double").alias("x"))
    return M.vector_times(x, folded(spark, sf_dir))


DENSE = "SELECT x.i, y.j, coalesce(v, 0) AS v FROM (SELECT unnest(range(8)) AS i) x CROSS JOIN (SELECT unnest(range(8)) AS j) y LEFT JOIN a ON a.i = x.i AND a.j = y.j"


@query(BASE + DENSE)
def matrix_unit(spark, sf_dir):
    return M.multiply(folded(spark, sf_dir), M.unit(spark, 8))


@query(BASE + DENSE)
def matrix_null(spark, sf_dir):
    return M.add(folded(spark, sf_dir), M.null(spark, 8, 8))


@query()
def matrix_random(spark, sf_dir):
    return M.add(folded(spark, sf_dir), M.random(spark, 8, 8, -5, 5, 3))


def _grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric, positive matrices of all components of embeddings, one for each label: m, i, j, v.

    Every task sums the products of its own vectors, so one matrix a label and task is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            label, lists = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1)
            length, flat = lists.value_lengths().to_numpy(), lists.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
            start = np.cumsum(length) - length
            for m in set(label.tolist()):
                for n in np.unique(length[label == m]).tolist():
                    x = flat[start[(label == m) & (length == n)][:, None] + np.arange(n)]
                    held = sums.get(m, np.zeros((0, 0)))
                    total = np.zeros((max(n, len(held)),) * 2)
                    total[: len(held), : len(held)] = held
                    total[:n, :n] += x.T @ x
                    sums[m] = total
        for m, total in sums.items():
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array([m] * total.size, pa.string()), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["m", "i", "j", "v"])

    vectors = table(spark, sf_dir, "embeddings").where("label is not null and embedding is not null")
    parts = vectors.select(F.col("label").cast("string").alias("m"), F.col("embedding").cast("array<double>").alias("x")).mapInArrow(run, "m string, i bigint, j bigint, v double")
    gram = parts.groupBy("m", "i", "j").agg(F.sum("v").alias("v"))
    return gram.select("m", "i", "j", (F.col("v") + F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)).alias("v"))


for _name, _f in (("lu", M.lu), ("cholesky", M.cholesky), ("qr", M.qr), ("svd", M.svd), ("eigen_symmetric", M.eigen_symmetric), ("eigen", M.eigen), ("inverse", M.inverse), ("scalars", M.scalars), ("adjugate", M.adjugate)):
    query(None, f"matrix_{_name}")(lambda spark, sf_dir, f=_f: f(_grams(spark, sf_dir)))


@query()
def matrix_solve(spark, sf_dir):
    a = _grams(spark, sf_dir)
    b = a.where("j = 0").withColumn("v", F.col("i") + 1.0)
    return M.solve(a, b)


# ---- factorisations multiplied out again: the Gram matrices themselves, and unit matrices

GRAM = """WITH v AS (SELECT row_number() OVER () AS n, label::VARCHAR AS m, list_transform(embedding, lambda x: coalesce(x, 0)::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
c AS (SELECT n, m, unnest(range(len(e)))::BIGINT AS i, unnest(e) AS x FROM v),
g AS (SELECT a.m, a.i, b.i AS j, sum(a.x * b.x) + (a.i = b.i)::INT AS v FROM c a JOIN c b ON a.n = b.n GROUP BY 1, 2, 3)
"""
SAME = GRAM + "SELECT m, i, j, round(v, 4) + 0.0 AS v FROM g"
UNIT = GRAM + "SELECT m, i, j, (i = j)::INT::DOUBLE AS v FROM g"


def _part(got: DataFrame, name: str) -> DataFrame:
    return got.where(F.col("part") == name).drop("part")


def _flipped(a: DataFrame) -> DataFrame:
    return a.select("m", F.col("j").alias("i"), F.col("i").alias("j"), "v")


def _shown(a: DataFrame, digits: int) -> DataFrame:
    return a.select("m", "i", "j", (F.round("v", digits) + 0.0).alias("v"))


@query(SAME)
def matrix_cholesky_product(spark, sf_dir):
    low = _part(M.cholesky(_grams(spark, sf_dir)), "l")
    return _shown(M.multiply_each(low, _flipped(low)), 4)


@query(SAME)
def matrix_qr_product(spark, sf_dir):
    got = M.qr(_grams(spark, sf_dir))
    return _shown(M.multiply_each(_part(got, "q"), _part(got, "r")), 4)


@query(SAME)
def matrix_svd_product(spark, sf_dir):
    got = M.svd(_grams(spark, sf_dir))
    w = _part(got, "w").select("m", "j", F.col("v").alias("w"))
    return _shown(M.multiply_each(_part(got, "u").join(w, ["m", "j"]).select("m", "i", "j", (F.col("v") * F.col("w")).alias("v")), _part(got, "vt")), 4)


@query(SAME)
def matrix_eigen_product(spark, sf_dir):
    got = M.eigen_symmetric(_grams(spark, sf_dir))
    vectors, values = _part(got, "vectors"), _part(got, "values").select("m", "j", F.col("v").alias("w"))
    return _shown(M.multiply_each(vectors.join(values, ["m", "j"]).select("m", "i", "j", (F.col("v") * F.col("w")).alias("v")), _flipped(vectors)), 4)


@query(SAME)
def matrix_lu_product(spark, sf_dir):
    got = M.lu(_grams(spark, sf_dir))
    back = _part(got, "order").select("m", F.col("j").alias("i"), F.col("v").cast("bigint").alias("to"))
    product = M.multiply_each(_part(got, "l"), _part(got, "u"))
    return _shown(product.join(back, ["m", "i"]).select("m", F.col("to").alias("i"), "j", "v"), 4)


@query(UNIT)
def matrix_divide(spark, sf_dir):
    a = _grams(spark, sf_dir)
    return _shown(M.divide(a, a), 6)


@query(UNIT)
def matrix_inverse_product(spark, sf_dir):
    a = _grams(spark, sf_dir)
    return _shown(M.multiply_each(M.inverse(a, "qr").drop("part"), a), 6)


# ---- one matrix larger than a task: blocked factorisations, multiplied out again

SIDE = 1024
FOLDED = f"f AS (SELECT o_custkey::BIGINT % {SIDE} AS i, o_orderkey::BIGINT % {SIDE} AS j, sum(floor(o_totalprice)::BIGINT % 256)::DOUBLE AS v FROM orders GROUP BY 1, 2)"
SYMMETRIC = f"""{FOLDED}, o AS (SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM f WHERE i <> j UNION ALL SELECT j, i, v FROM f WHERE i <> j) GROUP BY 1, 2)"""


def _folded_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1,024 x 1,024: whole numbers, one sum for each customer and order modulo 1,024."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy((F.col("o_custkey") % SIDE).cast("bigint").alias("i"), (F.col("o_orderkey") % SIDE).cast("bigint").alias("j")).agg(F.sum(F.floor("o_totalprice") % 256).cast("double").alias("v"))


def _diagonal(spark: SparkSession, v) -> DataFrame:
    return spark.range(SIDE).select(F.col("id").alias("i"), F.col("id").alias("j"), v.cast("double").alias("v"))


def _whole(a: DataFrame) -> DataFrame:
    return a.select("i", "j", (F.round("v", 4) + 0.0).alias("v")).where("v <> 0")


@query(f"WITH {FOLDED} SELECT i, j, sum(v) AS v FROM (SELECT * FROM f UNION ALL SELECT k, k, 500 + k FROM (SELECT unnest(range({SIDE})) AS k)) GROUP BY 1, 2 HAVING sum(v) <> 0")
def matrix_blocked_lu_product(spark, sf_dir):
    a = M.add(_folded_orders(spark, sf_dir), _diagonal(spark, F.col("id") + 500))
    low, up, order = blocked.lu(a)
    return _whole(M.multiply_blocked(low, up).join(order, "i").select(F.col("row").alias("i"), "j", "v"))


@query(f"WITH {SYMMETRIC} SELECT i, j, v FROM o WHERE v <> 0 UNION ALL SELECT k, k, 1 + coalesce(v, 0) FROM (SELECT unnest(range({SIDE})) AS k) d LEFT JOIN (SELECT i, sum(v) AS v FROM o GROUP BY i) t ON t.i = d.k")
def matrix_blocked_cholesky_product(spark, sf_dir):
    off = _folded_orders(spark, sf_dir).where("i <> j")
    off = M.add(off, M.transpose(off))
    sums = off.groupBy("i").agg(F.sum("v").alias("v"))
    a = off.unionByName(_diagonal(spark, F.lit(1.0)).drop("v").join(sums, "i", "left").select("i", "j", (1 + F.coalesce("v", F.lit(0.0))).alias("v")))
    low = blocked.cholesky(a)
    return _whole(M.multiply_blocked(low, M.transpose(low)))


#: Vectors as the rows of a tall matrix, by their place in the order of ids.
TALL = "t AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), a AS (SELECT i, unnest(range(len(e)))::BIGINT AS j, unnest(e) AS v FROM t)"


def _tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "v"))
    return ids.select(F.col("vec_id").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "v")


@query(f"WITH {TALL.replace('row_number() OVER (ORDER BY vec_id) - 1', 'vec_id::BIGINT')} SELECT i, j, round(v, 5) + 0.0 AS v FROM a WHERE round(v, 5) <> 0")
def matrix_tall_qr_product(spark, sf_dir):
    q, r = blocked.tall_qr(_tall(spark, sf_dir))
    product = q.select("i", F.col("j").alias("k"), "v").join(F.broadcast(r.select(F.col("i").alias("k"), "j", F.col("v").alias("w"))), "k")  # r is as small as the columns
    return product.groupBy("i", "j").agg((F.round(F.sum(F.col("v") * F.col("w")), 5) + 0.0).alias("v")).where("v <> 0")


@query(f"WITH {TALL} SELECT x.j AS i, y.j, round(sum(x.v * y.v), 4) + 0.0 AS v FROM a x JOIN a y ON x.i = y.i GROUP BY 1, 2 HAVING round(sum(x.v * y.v), 4) <> 0")
def matrix_tall_svd_gram(spark, sf_dir):
    """v w^2 v': what the columns of the matrix have in common."""
    _, w, vt = blocked.tall_svd(_tall(spark, sf_dir))
    scaled = vt.join(w.withColumnRenamed("j", "i"), "i").select("i", "j", (F.col("v") * F.col("w")).alias("v"))
    return _whole(M.multiply(M.transpose(scaled), scaled))


@query(f"WITH {TALL}, n AS (SELECT DISTINCT j FROM a) SELECT x.j AS i, y.j, 1.0::DOUBLE AS v FROM n x JOIN n y ON x.j = y.j")
def matrix_tall_orthogonal(spark, sf_dir):
    q, _ = blocked.tall_qr(_tall(spark, sf_dir))
    rows = q.groupBy("i").agg(F.collect_list(F.struct("j", "v")).alias("c"))
    pairs = rows.select(F.explode("c").alias("x"), "c").select("x", F.explode("c").alias("y"))
    return _whole(pairs.groupBy(F.col("x.j").alias("i"), F.col("y.j").alias("j")).agg(F.sum(F.col("x.v") * F.col("y.v")).alias("v")))
