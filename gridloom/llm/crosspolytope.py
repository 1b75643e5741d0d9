"""Near-duplicates among vectors by cross-polytope hashing.

Hashing.  A vector is padded with zeros to a power of two and turned by three rounds of
random signs and a fast Hadamard transform; its hash is the axis (of 2 d, with their signs)
that it then lies nearest to.  FUNCTIONS such hashes and the label make a bucket, TABLES of
them a vector's own buckets.  In each table a vector is also put into PROBES buckets more:
those in which one hash is the second or third nearest axis, by the squares of what the axis
lies further away.  Two vectors are candidates if one's own bucket is among the other's
buckets.  At 64 dimensions and cosine 0.98, the least that links, eight tables miss a pair
with probability 5e-5 and twelve fewer than one of 40,000.

Verification.  Equal vectors of a label are one node with a weight.  The vectors of a bucket
are compared by their cosines in double precision; buckets of more than CELL nodes are cut
into cells, and pairs of cells are compared each in a place of their own.  A pair is counted
in the first bucket it shares only, so pairs are never written out: a group gives each of
its nodes its weight of links and the least node it reaches in the group.  Classes are the
components of what is reached.

Defined results: vectors that are null, empty or zero, or hold null or non-finite
components, and those with a null label, link with nothing.  Vectors of unequal length don't
link.  Repeated rows are vectors of their own that link.  A null id is a vector's like any
other but names a class only if all ids in it are null.  An empty table gives an empty one;
other columns are passed by, whatever their names.  The cosine of two vectors doesn't depend
on their lengths, nor does a tie of axes matter: the first is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import drop, frugal, new_folder, stored
from gridloom.llm.components import join_unique, stars
from gridloom.llm.textvec import mix

SIMILAR = 0.98
TABLES, FUNCTIONS, PROBES = 10, 3, 2
#: Nodes of a bucket that are compared in one place; those of a small one, whose pairs are listed.
CELL, SMALL = 1024, 48
#: Pairs whose cosines are computed at once.
PAIRS = 1 << 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


@lru_cache(maxsize=8)
def _signs(dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([17, dim])).choice(np.array([-1.0, 1.0]), size=(TABLES, FUNCTIONS, 3, dim))


def axes(unit: np.ndarray, table: int, function: int) -> tuple[np.ndarray, np.ndarray]:
    """The three nearest axes of each row after one rotation, 2 k or 2 k + 1 for the negative one, and how much smaller their components are than the largest."""
    x = unit
    for sign in _signs(unit.shape[1])[table, function]:
        x = hadamard(x * sign)
    size = np.abs(x)
    best = np.argsort(-size, axis=1, kind="stable")[:, :3]
    size = np.take_along_axis(size, best, 1)
    return 2 * best + (np.take_along_axis(x, best, 1) < 0), size[:, :1] - size


def padded(unit: np.ndarray) -> np.ndarray:
    n = max(4, 1 << (unit.shape[1] - 1).bit_length())
    return np.pad(unit, ((0, 0), (0, n - unit.shape[1])))


def buckets(unit: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row (of length one) its own bucket in each table, and the further ones: rows x TABLES, rows x TABLES x PROBES.

    seeds has a hash of each row's label.  Buckets are hashes; two that fall into one only give more candidates.
    """
    x, n = padded(unit), len(unit)
    own, more = np.zeros((n, TABLES), np.uint64), np.zeros((n, TABLES, PROBES), np.uint64)
    for t in range(TABLES):
        found = [axes(x, t, f) for f in range(FUNCTIONS)]
        loss = np.concatenate([lost[:, 1:] ** 2 for _, lost in found], axis=1)
        cheap = np.argsort(loss, axis=1, kind="stable")[:, :PROBES]
        for p in range(-1, PROBES):
            h = mix(seeds + np.uint64(t * 1009 + unit.shape[1] * 1000003))
            for f, (axis, _) in enumerate(found):
                use = axis[:, 0]
                if p >= 0:
                    use = np.where(cheap[:, p] == 2 * f, axis[:, 1], np.where(cheap[:, p] == 2 * f + 1, axis[:, 2], use))
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + use.astype(np.uint64))
            if p < 0:
                own[:, t] = h
            else:
                more[:, t, p] = h
    return own.view(np.int64), more.view(np.int64)


def _rows(column: pa.Array) -> list[np.ndarray | None]:
    """The vectors of a list column as doubles; None for one that can't link."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    good = np.isfinite(values) & ~flat.is_null().to_numpy(zero_copy_only=False)
    values = values + 0.0  # no negative zeros
    cut = np.concatenate([[0], np.cumsum(size)])
    bad = np.concatenate([[0], np.cumsum(~good)])
    some = np.concatenate([[0], np.cumsum(np.where(good, values != 0, False))])
    fine = (bad[cut[1:]] == bad[cut[:-1]]) & (some[cut[1:]] > some[cut[:-1]])
    return [values[cut[k] : cut[k + 1]] if fine[k] else None for k in range(len(size))]


def _named(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, whole: bool) -> DataFrame:
    """vec_id and node, the 128-bit digest of label and vector or null where it can't link; if whole also both of them."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_pylist()
            rows = _rows(batch.column(2))
            raw = [None if v is None or y is None else v.tobytes() for v, y in zip(rows, label, strict=True)]
            node = [None if r is None else hashlib.blake2b(r, digest_size=16, key=hashlib.sha256(y.encode()).digest()).digest() for r, y in zip(raw, label, strict=True)]
            columns = [batch.column(0), pa.array(node, pa.binary())]
            if whole:
                columns += [batch.column(1), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=out.fieldNames())

    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vec"))
    out = T.StructType([source.schema["vec_id"], T.StructField("node", T.BinaryType())])
    if whole:
        out = out.add("label", T.StringType()).add("vec", T.BinaryType())
    return source.mapInArrow(run, out)


def _seeds(labels: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    for y in labels:
        if y not in known:
            known[y] = int.from_bytes(hashlib.blake2b(y.encode(), digest_size=8).digest(), "little")
    return np.array([known[y] for y in labels], np.uint64)


def _matrices(vecs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length among the vectors, the places of those, and these as rows of length one."""
    size = np.fromiter(map(len, vecs), np.int64, len(vecs))
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        x = np.frombuffer(b"".join([vecs[k] for k in at]), np.float64).reshape(len(at), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        yield at, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _entries(nodes: DataFrame) -> DataFrame:
    """(bucket, a, own, t): a node's own buckets and the further ones."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, seeds = batch.column(0).to_numpy(), _seeds(batch.column(1).to_pylist())
            for at, unit in _matrices(batch.column(2).to_pylist()):
                own, more = buckets(unit, seeds[at])
                every = np.concatenate([own[:, :, None], more], axis=2)
                first = np.zeros(every.shape, bool)
                first[:, :, 0] = True
                t = np.broadcast_to(np.arange(TABLES, dtype=np.int8)[None, :, None], every.shape)
                each = TABLES * (1 + PROBES)
                yield pa.RecordBatch.from_arrays([pa.array(every.ravel()), pa.array(np.repeat(a[at], each)), pa.array(first.ravel()), pa.array(t.ravel())], names=["bucket", "a", "own", "t"])

    return nodes.select("a", "label", "vec").mapInArrow(run, "bucket long, a long, own boolean, t byte")


def linked(unit: np.ndarray, group: np.ndarray, own: np.ndarray, side: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs x < y of rows of one group, one of which is the group's own, with a cosine of similar or more.

    Rows come group by group.  side is 0 for a row that meets all others of its group, else
    1 or 2 for one that meets those of the other side only.
    """
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(cut, len(group)))
    xs, ys = [], []
    for k in np.flatnonzero(size > SMALL):
        rows = slice(cut[k], cut[k] + size[k])
        x, y = np.nonzero(np.triu(unit[rows] @ unit[rows].T >= similar - 1e-9, 1))
        xs.append(x + cut[k])
        ys.append(y + cut[k])
    few = size[size <= SMALL]
    start = np.repeat(cut[size <= SMALL], few)
    nth = np.arange(len(start)) - np.repeat(np.cumsum(few) - few, few)
    after = np.repeat(few, few) - nth - 1  # rows of its group behind each row
    at = np.flatnonzero(after)
    done = np.cumsum(after[at])
    for lo in range(0, int(done[-1]) if len(at) else 0, PAIRS):
        k = np.arange(lo, min(lo + PAIRS, int(done[-1])))
        r = np.searchsorted(done, k, side="right")
        x = (start + nth)[at[r]]
        y = x + 1 + k - (done[r] - after[at[r]])
        near = np.einsum("ij,ij->i", unit[x], unit[y]) >= similar - 1e-9
        xs.append(x[near])
        ys.append(y[near])
    x, y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (xs, ys))
    fit = (own[x] | own[y]) & ((side[x] == 0) | (side[x] != side[y]))
    x, y = x[fit], y[fit]
    # the decision is made by one formula, however the pair was found
    near = np.concatenate([np.einsum("ij,ij->i", unit[x[lo : lo + PAIRS]], unit[y[lo : lo + PAIRS]]) >= similar for lo in range(0, len(x), PAIRS)] or [np.zeros(0, bool)])
    return x[near], y[near]


def firsts(x: np.ndarray, y: np.ndarray, own: np.ndarray, more: np.ndarray, table: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether the bucket a pair was found in is the first that it shares: the first table, and in it the least bucket."""
    good = np.ones(len(x), bool)
    for t in range(TABLES):
        a, b = own[x, t], own[y, t]
        there, here = (more[y, t] == a[:, None]).any(axis=1), (more[x, t] == b[:, None]).any(axis=1)
        meets = (a == b) | there | here
        good &= ~(meets & (t < table))
        least = np.where(a == b, a, np.minimum(np.where(there, a, b), np.where(here, b, a)))
        good &= ~((t == table) & (least != bucket))
    return good


def _reached(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least row that each row reaches by the pairs."""
    least = np.arange(n)
    while True:
        both = np.minimum(least[x], least[y])
        new = least.copy()
        np.minimum.at(new, x, both)
        np.minimum.at(new, y, both)
        np.minimum.at(new, least[x], both)
        np.minimum.at(new, least[y], both)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _compared(rows: pa.Table, similar: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of whole groups: the nodes with links, the weight of each one's, and the least node it reaches."""
    take = lambda name: rows.column(name).to_numpy()
    a, bucket, weight, i, j, c = (take(n) for n in ("a", "bucket", "size", "i", "j", "c"))
    new = (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    group = np.concatenate([[0], np.cumsum(new)])
    side = np.where(i == j, 0, np.where(c == i, 1, 2))
    labels, vecs = rows.column("label").to_pylist(), rows.column("vec").to_pylist()
    seeds, out = _seeds(labels), []
    names = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    for at, unit in _matrices(vecs):
        x, y = linked(unit, group[at], take("own")[at], side[at], similar)
        same = names[at[x]] == names[at[y]]
        x, y = x[same], y[same]
        if not len(x):
            continue
        used, where = np.unique(np.concatenate([x, y]), return_inverse=True)
        own, more = buckets(unit[used], seeds[at][used])
        x0, y0 = where[: len(x)], where[len(x) :]
        good = np.concatenate([firsts(x0[lo : lo + PAIRS], y0[lo : lo + PAIRS], own, more, take("t")[at][x[lo : lo + PAIRS]], bucket[at][x[lo : lo + PAIRS]]) for lo in range(0, len(x), PAIRS)])
        x, y = x[good], y[good]
        links = np.zeros(len(at), np.int64)
        np.add.at(links, x, weight[at][y])
        np.add.at(links, y, weight[at][x])
        has = np.flatnonzero(links)
        out.append((a[at][has], links[has], a[at][_reached(x, y, len(at))[has]]))
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))


def _links(found: DataFrame, similar: float) -> DataFrame:
    """(a, n, b): within each group, a node's weight of links and the least node it reaches.  A task holds one batch and the group that it ends in."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, key = None, ["bucket", "i", "j"]

        def made(rows: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v) for v in _compared(rows, similar)], names=["a", "n", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            rest = new if rest is None else pa.concat_tables([rest, new])
            last = np.ones(len(rest), bool)
            for name in key:
                values = rest.column(name).to_numpy()
                last &= values == values[-1]
            cut = int(np.argmax(last))
            if cut:
                yield made(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None:
            yield made(rest)

    dealt = found.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(run, "a long, n long, b long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", similar: float = SIMILAR) -> DataFrame:
    """For each row its id, n_links, component_id and kept; the parameters of the search hold for cosines of 0.98 and more."""
    spark, made = vectors.sparkSession, []

    def keep(df: DataFrame) -> DataFrame:
        made.append(new_folder(spark, "vectors"))
        return stored(df, path=made[-1])

    whole = _named(vectors, id_col, vector_col, label_col, True).where("node is not null")
    nodes = whole.groupBy("node").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("size"), F.min("vec_id").alias("least"))
    nodes = keep(nodes.withColumn("a", F.monotonically_increasing_id()))
    entries = keep(_entries(nodes))
    shared = entries.groupBy("bucket").agg(F.sum(F.col("own").cast("int")).alias("o"), F.count("*").alias("n")).where("o > 0 and n > 1")
    shared = keep(shared.select("bucket", F.ceil(F.col("n") / CELL).cast("int").alias("cells")))
    found = join_unique(entries, shared, "bucket").join(nodes.select("a", "label", "vec", "size"), "a")
    found = found.withColumn("c", F.pmod(F.xxhash64("a"), F.col("cells")).cast("int"))
    found = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    found = found.withColumns({"i": F.least("c", "other"), "j": F.greatest("c", "other")}).drop("other", "cells")
    links = keep(_links(found, similar))
    classes = keep(stars(links.select("a", "b")))
    members = keep(classes.union(classes.select("b", "b").distinct()).join(nodes.select("a", "least"), "a"))
    least = members.groupBy("b").agg(F.min("least").alias("component"))
    per_node = (
        nodes.select("a", "node", "size", "least")
        .join(links.groupBy("a").agg(F.sum("n").alias("n")), "a", "left")
        .join(join_unique(members.select("a", "b"), least, "b").select("a", "component"), "a", "left")
        .where("size > 1 or n is not null")
        .select("node", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "least").alias("component"))
    )
    per_node = stored(per_node, path=new_folder(spark, "vectors"))
    rows = stored(_named(vectors, id_col, vector_col, label_col, False), path=new_folder(spark, "vectors"))
    for path in made:
        drop(spark, path)
    joined = join_unique(rows, per_node, "node", "left")
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return joined.select(F.col("vec_id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
