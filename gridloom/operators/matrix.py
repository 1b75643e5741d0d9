"""Dense and sparse matrices as tables (i, j, v), and decompositions of matrices that fit one task.

Sums, products, norms and predicates are joins and aggregates of any size.  ``solve`` and
the other decompositions take one matrix per group (column m), each in one task: they are
for very many small matrices, and matrices of at most MAX_CELLS cells.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of a matrix up to which it's decomposed.
MAX_CELLS = 4_000_000


def matrix(spark: SparkSession, rows: list[list[float]]) -> DataFrame:
    return spark.createDataFrame([(i, j, float(v)) for i, line in enumerate(rows) for j, v in enumerate(line)], "i bigint, j bigint, v double")


def unit(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n * n).select(F.expr(f"id div {n}").alias("i"), (F.col("id") % n).alias("j")).withColumn("v", (F.col("i") == F.col("j")).cast("double"))


def null(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    return spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("i"), (F.col("id") % cols).alias("j"), F.lit(0.0).alias("v"))


def random(spark: SparkSession, rows: int, cols: int, low: int, high: int, seed: int) -> DataFrame:
    """Seeded whole numbers low..high."""
    return null(spark, rows, cols).withColumn("v", (F.pmod(F.xxhash64(F.lit(seed), "i", "j"), F.lit(high - low + 1)) + low).cast("double"))


def resize(a: DataFrame, rows: int, cols: int, fill: float = 0.0) -> DataFrame:
    return null(a.sparkSession, rows, cols).drop("v").join(a, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(fill)).alias("v"))


def part(a: DataFrame, row: int, col: int, rows: int, cols: int) -> DataFrame:
    a = a.where(F.col("i").between(row, row + rows - 1) & F.col("j").between(col, col + cols - 1))
    return a.select((F.col("i") - row).alias("i"), (F.col("j") - col).alias("j"), "v")


def shape(a: DataFrame, kind: str) -> DataFrame:
    """The cells of the diagonal, the tridiagonal, or the upper or lower triangle."""
    i, j = F.col("i"), F.col("j")
    return a.where({"diagonal": i == j, "tridiagonal": F.abs(i - j) <= 1, "upper": i <= j, "lower": i >= j}[kind])


def row(a: DataFrame, k: int) -> DataFrame:
    return a.where(F.col("i") == k)


def column(a: DataFrame, k: int) -> DataFrame:
    return a.where(F.col("j") == k)


def diagonal(a: DataFrame, k: int = 0) -> DataFrame:
    return a.where(F.col("j") - F.col("i") == k)


def _both(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """Cell by cell; a missing cell is 0."""
    px = a.join(b.withColumnRenamed("v", "w"), ["i", "j"], "full")
    return px.select("i", "j", f(F.coalesce("v", F.lit(0.0)), F.coalesce("w", F.lit(0.0))).alias("v"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b, lambda x, y: x + y)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b, lambda x, y: x - y)


def apply(a: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return a.withColumn("v", f(F.col("v")))


def apply_indexed(a: DataFrame, f: Callable[[Column, Column, Column], Column]) -> DataFrame:
    return a.withColumn("v", f(F.col("i"), F.col("j"), F.col("v")))


def scale(a: DataFrame, k: float) -> DataFrame:
    return apply(a, lambda v: v * k)


def negative(a: DataFrame) -> DataFrame:
    return apply(a, lambda v: -v)


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product: a join on the inner index, summed by cell."""
    left, right = a.select("i", F.col("j").alias("k"), "v"), b.select(F.col("i").alias("k"), "j", F.col("v").alias("w"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def multiply_blocked(a: DataFrame, b: DataFrame, size: int = 256) -> DataFrame:
    """The product by blocks of size x size, multiplied densely: for large dense matrices, whose join by cell would be n cubed rows."""
    cells = F.collect_list(F.struct(((F.col("i") % size) * size + F.col("j") % size).alias("at"), "v"))
    blocks = lambda m, r, c: m.groupBy(F.expr(f"i div {size}").alias(r), F.expr(f"j div {size}").alias(c)).agg(cells.alias(r + c)).select(r, c, F.struct(F.col(r + c)["at"].alias("at"), F.col(r + c)["v"].alias("v")).alias(r + c))
    pairs = blocks(a, "bi", "bk").join(blocks(b, "bk", "bj"), "bk").select("bi", "bj", F.col("bibk").alias("x"), F.col("bkbj").alias("y"))

    def one(batches):
        for pdf in batches:
            out = []
            for bi, bj, x, y in zip(pdf.bi, pdf.bj, pdf.x, pdf.y, strict=True):
                p, q = (np.bincount(e["at"], e["v"], size * size).reshape(size, size) for e in (x, y))
                z = p @ q
                i, j = np.nonzero(z)
                out.append(pd.DataFrame({"i": bi * size + i, "j": bj * size + j, "v": z[i, j]}))
            yield pd.concat(out) if out else pd.DataFrame({"i": [], "j": [], "v": []})

    return pairs.mapInPandas(one, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def times_vector(a: DataFrame, x: DataFrame) -> DataFrame:
    """a x for a vector (j, x): (i, v)."""
    return a.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def vector_times(x: DataFrame, a: DataFrame) -> DataFrame:
    """x a for a vector (i, x): (j, v)."""
    return a.join(x, "i").groupBy("j").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def power(a: DataFrame, n: int, size: int) -> DataFrame:
    """a to the n-th by squaring."""
    out = None
    while n:
        if n & 1:
            out = a if out is None else multiply(out, a)
        n >>= 1
        a = multiply(a, a) if n else a
    return unit(a.sparkSession, size) if out is None else out


def trace(a: DataFrame, k: int = 0) -> DataFrame:
    return diagonal(a, k).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("trace"))


def norms(a: DataFrame) -> DataFrame:
    """norm1 (column sums), norm_inf (row sums) and norm_f in one row."""
    one = a.groupBy("j").agg(F.sum(F.abs("v")).alias("t")).agg(F.max("t").alias("norm1"))
    inf = a.groupBy("i").agg(F.sum(F.abs("v")).alias("t")).agg(F.max("t").alias("norm_inf"))
    fro = a.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm_f"))
    return one.join(inf).join(fro)  # three tables of one row each


def reductions(a: DataFrame) -> DataFrame:
    return a.agg(F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max"))


def epsilon(v: Column) -> Column:
    """The tolerance of comparisons with v."""
    return F.lit(float(np.finfo(np.float64).eps * 1e4)) * F.greatest(F.lit(1.0), F.abs(v))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two matrices are equal; a cell that is missing is 0."""
    v, w = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("v", "w"))
    return a.join(b.withColumnRenamed("v", "w"), ["i", "j"], "full").agg(F.coalesce(F.bool_and(F.abs(v - w) <= epsilon(v)), F.lit(True)).alias("equal"))


def _all(condition: Column) -> Column:
    return F.coalesce(F.bool_and(condition), F.lit(True))


def predicates(a: DataFrame) -> DataFrame:
    """is_diagonal, is_scalar, is_unit, is_null, is_upper, is_lower, is_symmetric, is_skew in one row."""
    i, j, v = F.col("i"), F.col("j"), F.col("v")
    zero = lambda x: F.abs(x) <= epsilon(F.lit(0.0))
    off, w = F.when(i != j, zero(v)), F.coalesce(F.col("w"), F.lit(0.0))
    mirror = a.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w"))
    diag = F.when(i == j, v)
    spread = F.coalesce(F.max(diag) - F.min(diag), F.lit(0.0))
    return a.join(mirror, ["i", "j"], "left").agg(
        _all(off).alias("is_diagonal"), (_all(off) & zero(spread)).alias("is_scalar"), (_all(off) & _all(F.when(i == j, zero(v - 1)))).alias("is_unit"),
        _all(zero(v)).alias("is_null"), _all(F.when(i > j, zero(v))).alias("is_upper"), _all(F.when(i < j, zero(v))).alias("is_lower"),
        _all(zero(v - w)).alias("is_symmetric"), _all(zero(v + w)).alias("is_skew"),
    )


def is_orthogonal(a: DataFrame, size: int, rows: bool = True) -> DataFrame:
    product = multiply(a, transpose(a)) if rows else multiply(transpose(a), a)
    return equal(apply(product, lambda v: F.when(F.abs(v) < 1e-12, F.lit(0.0)).otherwise(v)), unit(a.sparkSession, size))


def swap_rows(a: DataFrame, x: int, y: int) -> DataFrame:
    i = F.col("i")
    return a.withColumn("i", F.when(i == x, F.lit(y)).when(i == y, F.lit(x)).otherwise(i).cast("bigint"))


def dense(pdf: pd.DataFrame) -> np.ndarray:
    m = np.zeros((int(pdf.i.max()) + 1, int(pdf.j.max()) + 1))
    if m.size > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    m[pdf.i, pdf.j] = pdf.v
    return m


def _per_matrix(a: DataFrame, f: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """f's matrices of every matrix m: m, part, i, j, v."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=["m", "part", "i", "j", "v"])]
        for name, got in f(dense(pdf)).items():
            got = np.atleast_2d(np.asarray(got, float))
            i, j = np.indices(got.shape)
            out.append(pd.DataFrame({"m": pdf.m.iloc[0], "part": name, "i": i.ravel(), "j": j.ravel(), "v": got.ravel()}))
        return pd.concat(out[1:] or out)

    return a.groupBy("m").applyInPandas(one, "m string, part string, i bigint, j bigint, v double")


def _lu(a: np.ndarray) -> dict[str, np.ndarray]:
    n, a, order, sign = len(a), a.copy(), np.arange(len(a)), 1.0
    for k in range(n):
        p = k + int(np.abs(a[k:, k]).argmax())
        if p != k:
            a[[k, p]], order[[k, p]], sign = a[[p, k]], order[[p, k]], -sign
        if a[k, k] != 0:
            a[k + 1 :, k] /= a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
    return {"l": np.tril(a, -1) + np.eye(n), "u": np.triu(a), "order": order[None, :], "det": np.array([[sign * np.prod(np.diag(a))]])}


def lu(a: DataFrame) -> DataFrame:
    """l, u, order (the rows as pivoted) and det."""
    return _per_matrix(a, _lu)


def cholesky(a: DataFrame) -> DataFrame:
    return _per_matrix(a, lambda m: {"l": np.linalg.cholesky(m)})


def qr(a: DataFrame) -> DataFrame:
    return _per_matrix(a, lambda m: dict(zip(("q", "r"), np.linalg.qr(m), strict=True)))


def svd(a: DataFrame) -> DataFrame:
    return _per_matrix(a, lambda m: dict(zip(("u", "w", "vt"), np.linalg.svd(m, full_matrices=False), strict=True)))


def eigen_symmetric(a: DataFrame) -> DataFrame:
    return _per_matrix(a, lambda m: dict(zip(("values", "vectors"), np.linalg.eigh(m), strict=True)))


def _eigen(m: np.ndarray) -> dict[str, np.ndarray]:
    values, vectors = np.linalg.eig(m)
    return {"real": values.real, "imag": values.imag, "vectors_real": vectors.real, "vectors_imag": vectors.imag}


def eigen(a: DataFrame) -> DataFrame:
    return _per_matrix(a, _eigen)


def inverse(a: DataFrame, how: str = "gauss") -> DataFrame:
    """By elimination, lu, qr or svd."""

    def f(m: np.ndarray) -> dict[str, np.ndarray]:
        if how == "qr":
            q, r = np.linalg.qr(m)
            return {"inverse": np.linalg.solve(r, q.T)}
        return {"inverse": np.linalg.pinv(m) if how == "svd" else np.linalg.inv(m)}

    return _per_matrix(a, f)


def multiply_each(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of every m's two matrices, (m, i, j, v) each: a join on m and the inner index."""
    right = b.select("m", F.col("i").alias("k"), "j", F.col("v").alias("w"))
    return a.select("m", "i", F.col("j").alias("k"), "v").join(right, ["m", "k"]).groupBy("m", "i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def divide(a: DataFrame, b: DataFrame, how: str = "gauss") -> DataFrame:
    """a / b for every m: a times the inverse of b."""
    return multiply_each(a, inverse(b, how).drop("part"))


def divide_cells(a: DataFrame, k: float) -> DataFrame:
    """Every cell over a number."""
    return apply(a, lambda v: v / k)


def scalars(a: DataFrame) -> DataFrame:
    """det, rank, cond, norm2 and is_singular, each as a 1 x 1 part."""

    def f(m: np.ndarray) -> dict[str, np.ndarray]:
        w = np.linalg.svd(m, compute_uv=False)
        square = m.shape[0] == m.shape[1]
        det = _lu(m)["det"][0, 0] if square else np.nan
        tiny = np.finfo(float).eps * 1e4 * max(1.0, w[0])
        return {"det": np.array([[det]]), "rank": np.array([[(w > tiny).sum()]]), "cond": np.array([[w[0] / w[-1] if w[-1] > 0 else np.inf]]), "norm2": np.array([[w[0]]]), "is_singular": np.array([[float(square and abs(det) <= tiny)]])}

    return _per_matrix(a, f)


def adjugate(a: DataFrame) -> DataFrame:
    """Cofactors (signed minors) and, transposed, the adjugate."""

    def f(m: np.ndarray) -> dict[str, np.ndarray]:
        n = len(m)
        minor = lambda i, j: np.linalg.det(np.delete(np.delete(m, i, 0), j, 1)) if n > 1 else 1.0
        c = np.array([[(-1) ** (i + j) * minor(i, j) for j in range(n)] for i in range(n)])
        return {"cofactors": c, "adjugate": c.T}

    return _per_matrix(a, f)


def solve(a: DataFrame, b: DataFrame, how: str = "lu", refine: int = 1) -> DataFrame:
    """x of a x = b for every m, b as (m, i, j, v): by lu (refined), cholesky, qr or svd."""
    both = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m, y = dense(pdf[pdf.side == "a"]), dense(pdf[pdf.side == "b"])
        if how == "cholesky":
            low = np.linalg.cholesky(m)
            x = np.linalg.solve(low.T, np.linalg.solve(low, y))
        elif how == "qr":
            q, r = np.linalg.qr(m)
            x = np.linalg.solve(r, q.T @ y)
        elif how == "svd":
            x = np.linalg.lstsq(m, y, rcond=None)[0]
        else:
            x = np.linalg.solve(m, y)
            for _ in range(refine):
                x = x + np.linalg.solve(m, y - m @ x)
        i, j = np.indices(x.shape)
        return pd.DataFrame({"m": pdf.m.iloc[0], "i": i.ravel(), "j": j.ravel(), "v": x.ravel()})

    return both.groupBy("m").applyInPandas(one, "m string, i bigint, j bigint, v double")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A matrix from lines of numbers.  The line's place comes from the file's order, so one file is one matrix."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim(F.col("value"), F.lit(" \n")), r"\n")).alias("i", "line"))
    return lines.select(F.col("i").cast("bigint").alias("i"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("j", "v")).select("i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))


def write_text(a: DataFrame, path: str) -> None:
    """Lines of numbers, one a row, in order."""
    lines = a.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("c"))
    lines.select("i", F.array_join(F.transform("c", lambda x: x["v"].cast("string")), " ").alias("value")).orderBy("i").select("value").write.text(path)
