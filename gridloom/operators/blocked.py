"""Factorisations of one matrix that is larger than a task: by blocks, strips and trees.

A matrix (i, j, v) is cut into square blocks of SIZE, each a row with its cells as bytes.
Cholesky and LU go from block column to block column: the column is factored, then every
block right of it is updated where it lies, joined with its block of the column and its block
of the row; what is broadcast is one block.  LU picks its pivots by a tournament: every block
of the column puts up its SIZE best rows, and winners meet in a tree, so no task holds the
column; rows aren't moved but keep their names, and the order says which came when.  Each
column's step is written to the shared folder, so lineage doesn't grow with the matrix.

Tall matrices, whose columns fit in a task, are factored by a tree over strips of rows: each
strip's triangle, then triangles of triangles.  Q is found from R, twice, so that it is
orthogonal to rounding.  Their singular values are those of R.

Missing cells are 0.  A matrix that can't be factored (not positive, or singular) is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.shared import settled

SIZE = 256
#: Rows of a strip of a tall matrix, at least; triangles that meet in one place of a tree.
STRIP, FAN = 4096, 8

CELLS = "i bigint, j bigint, v double"
BLOCKS = "bi bigint, bj bigint, data binary"


def _cells(batch: pa.RecordBatch, *columns: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy() for c in columns]


def shape(a: DataFrame) -> tuple[int, int]:
    """Rows and columns, by the last cell there is."""
    got = a.agg(F.max("i").alias("i"), F.max("j").alias("j")).collect()[0]
    return (0, 0) if got["i"] is None else (got["i"] + 1, got["j"] + 1)


def to_blocks(a: DataFrame, rows: int, cols: int, size: int) -> DataFrame:
    """Every block of a rows x cols matrix, dense; past its end the diagonal is 1."""
    one = a.groupBy(F.floor(F.col("i") / size).alias("bi"), F.floor(F.col("j") / size).alias("bj")).agg(F.collect_list(F.struct((F.col("i") % size).alias("i"), (F.col("j") % size).alias("j"), "v")).alias("c"))
    spark, m, n = a.sparkSession, -(-rows // size), -(-cols // size)
    every = spark.range(m * n).select(F.floor(F.col("id") / n).alias("bi"), (F.col("id") % n).alias("bj"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                bi, bj = (batch.column(c)[k].as_py() for c in ("bi", "bj"))
                m, cells = np.zeros((size, size)), batch.column("c")[k].values
                if cells is not None:
                    i, j, v = (cells.field(f).to_numpy() for f in "ijv")
                    np.add.at(m, (i, j), v)
                if bi == bj:
                    past = np.arange(max(0, max(rows, cols) - bi * size), size)
                    m[past, past] = 1.0
                yield pa.RecordBatch.from_arrays([pa.array([bi]), pa.array([bj]), pa.array([m.tobytes()], pa.binary())], names=["bi", "bj", "data"])

    return every.join(one, ["bi", "bj"], "left").select("bi", "bj", "c").mapInArrow(run, BLOCKS)


def from_blocks(blocks: DataFrame, rows: int, cols: int, size: int) -> DataFrame:
    """The cells, within the matrix, that aren't 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = np.frombuffer(data).reshape(size, size)[: max(0, rows - bi * size), : max(0, cols - bj * size)]
                i, j = np.nonzero(m)
                yield pa.RecordBatch.from_arrays([pa.array(i + bi * size), pa.array(j + bj * size), pa.array(m[i, j])], names=["i", "j", "v"])

    return blocks.select("bi", "bj", "data").mapInArrow(run, CELLS)


def _each(df: DataFrame, f, size: int, schema: str = BLOCKS, inputs: tuple[str, ...] = ("data",)) -> DataFrame:
    """Rows with f of their blocks as data; bi, bj and what else the schema names stay."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [batch.column(c).to_pylist() for c in inputs]
            out = [np.ascontiguousarray(f(*(None if x is None else np.frombuffer(x).reshape(-1, size) for x in row))).tobytes() for row in zip(*raw, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if c == "data" else batch.column(c) for c in names], names=names)

    return df.mapInArrow(run, schema)


def cholesky(a: DataFrame, size: int = SIZE) -> DataFrame:
    """The lower triangle l of a symmetric positive matrix: a = l l'.  Cells below the diagonal, and on it, are looked at."""
    n, _ = shape(a)
    left = settled(to_blocks(a.where("i >= j").union(a.where("i > j").select("j", "i", "v")), n, n, size).where("bi >= bj"))
    done = []
    for k in range(-(-n // size)):
        corner = _each(left.where((F.col("bi") == k) & (F.col("bj") == k)), np.linalg.cholesky, size)
        held = F.broadcast(corner.select(F.col("data").alias("top")))  # one block
        under = left.where((F.col("bj") == k) & (F.col("bi") > k)).crossJoin(held)
        column = settled(_each(under, lambda x, top: np.linalg.solve(top, x.T).T, size, inputs=("data", "top")).union(corner))
        done.append(column)
        below = column.where(F.col("bi") > k)
        mine, its = below.select("bi", F.col("data").alias("x")), below.select(F.col("bi").alias("bj"), F.col("data").alias("y"))
        rest = left.where(F.col("bj") > k).join(mine, "bi").join(its, "bj")
        left = settled(_each(rest, lambda m, x, y: m - x @ y.T, size, inputs=("data", "x", "y")))
    out = done[0] if done else left
    for column in done[1:]:
        out = out.union(column)
    return from_blocks(out, n, n, size)


def _best(rows: np.ndarray, size: int) -> np.ndarray:
    """Which rows elimination with partial pivoting takes first, in order."""
    m, order = rows.copy(), np.arange(len(rows))
    for k in range(min(size, len(m))):
        p = k + int(np.abs(m[k:, k]).argmax())
        m[[k, p]], order[[k, p]] = m[[p, k]], order[[p, k]]
        if m[k, k] != 0:
            m[k + 1 :, k] /= m[k, k]
            m[k + 1 :, k + 1 :] -= np.outer(m[k + 1 :, k], m[k, k + 1 :])
    return order[:size]


def _tournament(column: DataFrame, size: int) -> list[int]:
    """The rows (their names) that come next, of a block column (bi, names, data)."""

    def play(table: pa.Table) -> pa.Table:
        names = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("names").to_pylist()])
        rows = np.concatenate([np.frombuffer(x).reshape(-1, size) for x in table.column("data").to_pylist()])
        won = _best(rows, size)
        return pa.table({"bi": pa.array([table.column("bi")[0].as_py()]), "names": pa.array([names[won].tobytes()], pa.binary()), "data": pa.array([rows[won].tobytes()], pa.binary())})

    seats, width = column, column.agg(F.max("bi")).collect()[0][0] + 1
    while True:
        seats = seats.groupBy(F.floor(F.col("bi") / FAN).alias("seat")).applyInArrow(lambda t: play(t.sort_by("bi")), "bi bigint, names binary, data binary")
        seats = seats.withColumn("bi", F.floor(F.col("bi") / FAN))
        width = -(-width // FAN)
        if width <= 1:
            return np.frombuffer(seats.collect()[0]["names"], np.int64).tolist()  # SIZE numbers


def lu(a: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """l, u and the order (i, row): row number ``row`` of a is row i of l u.  A square matrix; a singular one is an error."""
    n, cols = shape(a)
    if n != cols:
        raise ValueError("not a square matrix")
    spark, count = a.sparkSession, -(-n // size)
    schema = "bi bigint, bj bigint, names binary, data binary"
    name = F.udf(lambda bi: np.arange(bi * size, (bi + 1) * size).tobytes(), "binary")
    left = settled(to_blocks(a, n, n, size).withColumn("names", name("bi")))
    order, lower, upper = [], [], []
    for k in range(count):
        won = _tournament(left.where(F.col("bj") == k).select("bi", "names", "data"), size)
        order += won
        place = spark.sparkContext.broadcast({r: at for at, r in enumerate(won)})  # SIZE numbers

        def split(batches: Iterator[pa.RecordBatch], taken: bool, place=place) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bi, bj, names, data in zip(*(batch.column(c).to_pylist() for c in ("bi", "bj", "names", "data")), strict=True):
                    names, rows = np.frombuffer(names, np.int64), np.frombuffer(data).reshape(-1, size)
                    mine = np.array([r in place.value for r in names.tolist()], bool)
                    if not taken:
                        mine = ~mine
                    elif mine.any():  # by their places in the order
                        names = np.array([place.value.get(r, -1) for r in names.tolist()])
                    if mine.any():
                        yield pa.RecordBatch.from_arrays([pa.array([bi]), pa.array([bj]), pa.array([names[mine].tobytes()], pa.binary()), pa.array([rows[mine].tobytes()], pa.binary())], names=["bi", "bj", "names", "data"])

        def gathered(table: pa.Table) -> pa.Table:
            at = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("names").to_pylist()])
            rows = np.concatenate([np.frombuffer(x).reshape(-1, size) for x in table.column("data").to_pylist()])
            return pa.table({"bj": pa.array([table.column("bj")[0].as_py()]), "data": pa.array([rows[np.argsort(at)].tobytes()], pa.binary())})

        ahead = left.where(F.col("bj") >= k)
        pivots = ahead.mapInArrow(lambda b, s=split: s(b, True), schema).groupBy("bj").applyInArrow(gathered, "bj bigint, data binary")
        pivots = settled(pivots)
        corner = F.broadcast(pivots.where(F.col("bj") == k).select(F.col("data").alias("corner")))  # one block

        def solved(data: np.ndarray, corner: np.ndarray) -> np.ndarray:
            low, _ = eliminated(corner)
            return np.linalg.solve(low, data)

        line = settled(_each(pivots.crossJoin(corner), solved, size, "bj bigint, data binary", ("data", "corner")))
        upper.append(line.withColumn("bi", F.lit(k).cast("bigint")))
        top = F.broadcast(line.where(F.col("bj") == k).select(F.col("data").alias("top")))  # one block
        rest = settled(ahead.mapInArrow(lambda b, s=split: s(b, False), schema))
        column = rest.where(F.col("bj") == k).crossJoin(top)
        column = settled(_each(column, lambda x, top: np.linalg.solve(np.triu(top).T, x.T).T, size, schema, ("data", "top")))
        lower.append(column)
        own = _each(pivots.where(F.col("bj") == k), lambda x: eliminated(x)[0], size, "bj bigint, data binary")
        first = spark.createDataFrame([(np.array(won, np.int64).tobytes(),)], "names binary")
        lower.append(own.crossJoin(F.broadcast(first)).select(F.lit(k).cast("bigint").alias("bi"), "bj", "names", "data"))
        by_row, by_col = column.select("bi", F.col("data").alias("x")), line.where(F.col("bj") > k).select("bj", F.col("data").alias("y"))
        left = settled(_each(rest.where(F.col("bj") > k).join(by_row, "bi").join(by_col, "bj"), lambda m, x, y: m - x @ y, size, schema, ("data", "x", "y")))
    kept = [r for r in order if r < n]
    places = spark.createDataFrame(list(enumerate(kept)), "i bigint, row bigint") if kept else spark.createDataFrame([], "i bigint, row bigint")
    if not count:
        none = spark.createDataFrame([], CELLS)
        return none, none, places

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bj, names, data in zip(*(batch.column(c).to_pylist() for c in ("bj", "names", "data")), strict=True):
                m = np.frombuffer(data).reshape(-1, size)
                i, j = np.nonzero(m)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(names, np.int64)[i]), pa.array(j + bj * size), pa.array(m[i, j])], names=["row", "j", "v"])

    parts = lower[0]
    for more in lower[1:]:
        parts = parts.union(more)
    l_cells = parts.mapInArrow(named, "row bigint, j bigint, v double").join(places, "row").select("i", "j", "v").where(F.col("j") < n)
    lines = upper[0]
    for more in upper[1:]:
        lines = lines.union(more)
    return l_cells, from_blocks(lines.select("bi", "bj", "data"), n, n, size), places


def eliminated(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """l with a diagonal of 1, and u, of rows that are in order already."""
    m = m.copy()
    for k in range(len(m)):
        if m[k, k] == 0:
            raise ValueError("the matrix is singular")
        m[k + 1 :, k] /= m[k, k]
        m[k + 1 :, k + 1 :] -= np.outer(m[k + 1 :, k], m[k, k + 1 :])
    return np.tril(m, -1) + np.eye(len(m)), np.triu(m)


def _rows(a: DataFrame, cols: int) -> DataFrame:
    """(i, data): whole rows as bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("c")
            size = cells.value_lengths().to_numpy()
            m = np.zeros((batch.num_rows, cols))
            np.add.at(m, (np.repeat(np.arange(batch.num_rows), size), cells.flatten().field("j").to_numpy()), cells.flatten().field("v").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array([line.tobytes() for line in m], pa.binary())], names=["i", "data"])

    return a.groupBy("i").agg(F.collect_list(F.struct("j", "v")).alias("c")).mapInArrow(run, "i bigint, data binary")


def triangle(rows: DataFrame, cols: int) -> np.ndarray:
    """R of the rows (i, data) of a tall matrix, with a diagonal that isn't negative: cols x cols numbers."""

    def reduced(m: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(m, mode="r")
        return np.vstack([r, np.zeros((cols - len(r), cols))]) if len(r) < cols else r

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, cols))
        for batch in batches:
            data = batch.column("data").to_pylist()
            for lo in range(0, len(data), STRIP):
                r = reduced(np.vstack([r, np.frombuffer(b"".join(data[lo : lo + STRIP])).reshape(-1, cols)]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["data"])

    def met(table: pa.Table) -> pa.Table:
        m = np.vstack([np.frombuffer(x).reshape(-1, cols) for x in table.column("data").to_pylist()])
        return pa.table({"data": pa.array([reduced(m).tobytes()], pa.binary())})

    tree = settled(rows.select("data").mapInArrow(strips, "data binary").withColumn("seat", F.monotonically_increasing_id()))
    while (n := tree.count()) > 1:
        seat = F.pmod(F.xxhash64("seat"), F.lit(-(-n // FAN)))
        tree = settled(tree.groupBy(seat.alias("at")).applyInArrow(met, "data binary").withColumn("seat", F.monotonically_increasing_id()))
    got = tree.collect()
    r = np.frombuffer(got[0]["data"]).reshape(cols, cols) if got else np.zeros((cols, cols))
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def _times(rows: DataFrame, m: np.ndarray) -> DataFrame:
    """Every row times a small matrix."""
    shared = rows.sparkSession.sparkContext.broadcast(m)  # cols x cols numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("data").to_pylist())).reshape(batch.num_rows, -1) @ shared.value
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array([line.tobytes() for line in x], pa.binary())], names=["i", "data"])

    return rows.mapInArrow(run, "i bigint, data binary")


def _as_cells(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.frombuffer(b"".join(batch.column("data").to_pylist())).reshape(batch.num_rows, -1)
            i, j = np.nonzero(m)
            yield pa.RecordBatch.from_arrays([batch.column("i").take(pa.array(i)), pa.array(j), pa.array(m[i, j])], names=["i", "j", "v"])

    return rows.mapInArrow(run, CELLS)


def _small(df: DataFrame, m: np.ndarray) -> DataFrame:
    i, j = np.nonzero(m)
    return df.sparkSession.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(i, j, strict=True)], CELLS)


def _orthogonal(a: DataFrame) -> tuple[DataFrame, np.ndarray]:
    rows, cols = shape(a)
    if rows < cols:
        raise ValueError("more columns than rows")
    own = settled(_rows(a, cols))
    first = triangle(own, cols)
    if not cols or np.abs(np.diag(first)).min() <= 1e-13 * np.abs(first).max():
        raise ValueError("columns depend on one another")
    once = settled(_times(own, np.linalg.inv(first)))
    second = triangle(once, cols)
    return settled(_times(once, np.linalg.inv(second))), second @ first


def tall_qr(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """q and r of a matrix with far more rows than columns; r's diagonal is positive.  Columns that depend on one another are an error."""
    q, r = _orthogonal(a)
    return _as_cells(q), _small(a, np.triu(r))


def tall_svd(a: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """u, the singular values (j, w), falling, and v' of a matrix with far more rows than columns."""
    q, r = _orthogonal(a)
    u, w, vt = np.linalg.svd(r)
    values = a.sparkSession.createDataFrame([(k, float(x)) for k, x in enumerate(w)], "j bigint, w double")
    return _as_cells(_times(q, u)), values, _small(a, vt)
