"""Importance resampling by hashed n-gram models, with Gumbel top-k.

Two generative models over hashed features, one of target text and one of all text, give
each document a log importance weight from its features' log p_target - log p_raw.
Features are unigrams and bigrams of tokens (runs of letters and digits, or of marks; ASCII
letters in lower case) and unigrams and bigrams of token shapes (case, digits, which marks,
whether a word repeats the one before).  The raw model counts every document; the target
model counts the texts of at most TARGET labelled rows.

A document's features aren't independent, so it counts as at most EVIDENCE of them: its log
weight is their mean ratio times EVIDENCE (or times their number, if that is less), which
tempers the weights and truncates none: the better the target model explains a document
against the raw one, the likelier it is drawn.  Its key is its log weight plus seeded Gumbel
noise, and those with the k largest keys are drawn: k documents without replacement, each
step in proportion to the weights.

k, if not given, is the effective sample size, (sum of weights) ** 2 / sum of squared
weights: the more the weights of good documents differ, the fewer of them are drawn, and
which of them are is up to weights and noise; junk, with weights near 0, gets no place.

Models are sums of MODEL counts whatever the input; texts are never shuffled, and the
k-th key is found by counting (select.kth_largest).

Defined results: a null text, or one without tokens, has weight 0 and is never drawn;
equal rows (id and text) have equal keys and are drawn together; without any target text
the two models are equal and every document with a token is drawn; an empty table gives
an empty one; other columns are passed by, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import textvec as V
from gridloom.llm.common import frugal, settle
from gridloom.llm.select import kth_largest, ordered_key

#: Cells for tokens, and for shapes.
WORDS, SHAPES = 1 << 13, 1 << 10
MODEL = WORDS + SHAPES
#: Most labelled rows of which the target model is made.
TARGET = 20_000
#: Independent features that a document counts as at most.
EVIDENCE = 16
#: Weights are summed in units of 2 ** -UNIT.
UNIT = 20

_KIND = np.full(256, 1, dtype=np.uint8)  # 0 space, 1 letters, digits and all beyond ASCII, 2 marks and controls
_KIND[:128] = [1 if chr(b).isalnum() else 2 for b in range(128)]
_KIND[V.SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER, _SMALL, _DIGIT = ((np.arange(256) >= a) & (np.arange(256) <= b) for a, b in ((65, 90), (97, 122), (48, 57)))


def features(block: V.Block) -> tuple[np.ndarray, np.ndarray]:
    """The cell of every feature of the block's texts, and its document, document by document."""
    data = block.data
    kind = _KIND[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[block.offsets] = True
    cuts = np.flatnonzero(edge)
    start, end = cuts[:-1], cuts[1:]
    full = kind[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[full], end[full]
    doc, word = block.doc_of(start), kind[start] == 1
    hashes = V.span_hashes(_LOWER[data], start, end)
    follows = np.zeros(len(start), dtype=bool)
    follows[1:] = doc[1:] == doc[:-1]
    upper, small, digit = (V.prefix_count(m[data]) for m in (_UPPER, _SMALL, _DIGIT))
    has = lambda c: c[end] > c[start]
    shape = (_UPPER[data[start]] * 1 + has(upper) * 2 + has(small) * 4 + has(digit) * 8 + np.minimum(end - start, 2) * 16).astype(np.uint64)
    again = np.zeros(len(start), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & follows[1:]
    shape = V.mix(np.where(word, shape + again.astype(np.uint64) * np.uint64(64), hashes) + np.uint64(1))
    two = lambda h: V.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[follows[1:]]
    cells = np.concatenate([hashes % WORDS, two(hashes) % WORDS, WORDS + shape % SHAPES, WORDS + two(shape) % SHAPES]).astype(np.int64)
    pairs = doc[1:][follows[1:]]
    return cells, np.concatenate([doc, pairs, doc, pairs])


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each cell, the target smoothed towards the raw model; tokens and shapes are models of their own."""
    out = np.zeros(MODEL)
    for part in (slice(0, WORDS), slice(WORDS, MODEL)):
        q = (raw[part] + 1) / (raw[part].sum() + len(raw[part]))
        p = (target[part] + q * len(q)) / (target[part].sum() + len(q))
        out[part] = np.log(p / q)
    return out


def log_weights(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log importance weights of documents with n features whose log ratios have these sums."""
    return sums * np.minimum(n, EVIDENCE) / np.maximum(n, 1)


def models(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The log ratios, from one pass over all texts."""
    most = [r[0] for r in target_ids.where(F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(F.xxhash64(F.lit(3), id_col), id_col).limit(TARGET).collect()]
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(most))  # at most TARGET ids

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(MODEL, np.int64), np.zeros(MODEL, np.int64)
        for batch in batches:
            own = np.array([i in wanted.value for i in batch.column(0).to_pylist()], dtype=bool)
            for block in V.blocks(batch.column(1)):
                cells, doc = features(block)
                raw += np.bincount(cells, minlength=MODEL)
                target += np.bincount(cells[own[block.first : block.last][doc]], minlength=MODEL)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["cell", "raw", "target"])

    parts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "cell bigint, raw bigint, target bigint")
    raw, target = np.zeros(MODEL), np.zeros(MODEL)
    for r in parts.groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r["cell"]], target[r["cell"]] = r["raw"], r["target"]
    return log_ratio(raw, target)


def weigh(docs: DataFrame, ratios: np.ndarray, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", passed: tuple[str, ...] = ()) -> DataFrame:
    """For each row its id, the columns passed, n_features, log_weight, and the key of the top-k as a double and as an integer of the same order."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # MODEL doubles
    source = docs.select(F.col(text_col).cast("string").alias("__text"), F.xxhash64(F.lit(seed), id_col, text_col).alias("__noise"), F.col(id_col), *passed)
    return _weighed(source, shared, "", 2)


def _weighed(source: DataFrame, shared, text_col: str, keep: int) -> DataFrame:
    """source's columns from number keep on and what weigh adds; the text is the first column or its field text_col, the noise is the second."""
    out = T.StructType([f for k, f in enumerate(source.schema.fields) if k >= keep or (k == 0 and text_col)])
    for name, kind in (("n_features", T.LongType()), ("log_weight", T.DoubleType()), ("draw", T.DoubleType()), ("rank_key", T.LongType())):
        out = out.add(name, kind)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            noise = V.mix(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            gumbel = -np.log(-np.log((noise >> np.uint64(11)).astype(np.float64) / 2**53 + 2**-54))
            for block in V.blocks(V.text_of(batch.column(0), text_col)):
                cells, doc = features(block)
                n = np.bincount(doc, minlength=block.rows)
                weight = log_weights(np.bincount(doc, weights=shared.value[cells], minlength=block.rows).astype(np.float64), n)
                draw = weight + gumbel[block.first : block.last]
                columns = [c.slice(block.first, block.rows) for k, c in enumerate(batch.columns) if k >= keep or (k == 0 and text_col)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(weight), pa.array(draw), pa.array(ordered_key(draw))], names=out.fieldNames())

    return source.mapInArrow(run, out)


def sample_size(rows: DataFrame) -> int:
    """The effective sample size of rows with a log_weight.  Weights are summed as integers, so that every run gets the same."""
    w = F.exp("log_weight")
    one, two = (F.sum(F.round(x * (1 << UNIT)).cast("decimal(38,0)")) for x in (w, w * w))
    got = rows.agg(one.alias("one"), two.alias("two")).collect()[0]
    return round(int(got["one"]) ** 2 / int(got["two"]) / (1 << UNIT)) if got["two"] else 0


def _least(rows: DataFrame, k: int | None) -> int | None:
    """The smallest rank_key that is drawn; None if all rows are."""
    rows = rows.where("n_features > 0")
    return kth_largest(rows, "rank_key", sample_size(rows) if k is None else k)


def _drawn(rows: DataFrame, least: int | None, k: int | None) -> DataFrame:
    rows = rows.where("n_features > 0")
    if k is not None and k <= 0:
        return rows.limit(0)
    return rows if least is None else rows.where(F.col("rank_key") >= least)


def resample(docs: DataFrame, target_ids: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 29) -> DataFrame:
    """The drawn rows: id, n_features, log_weight, draw (weight and noise), kept (true).

    k = 0 or an empty table gives none; k above the number of documents with a feature gives all of them.
    """
    ratios = models(docs, target_ids, id_col, text_col)
    rows = settle(weigh(docs, ratios, seed, id_col, text_col))
    return _drawn(rows, _least(rows, k), k).drop("rank_key").withColumn("kept", F.lit(True))


def resampled_documents(docs: DataFrame, target_ids: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 29) -> DataFrame:
    """The drawn rows of docs with all their columns; weights are computed anew rather than shuffling texts to them.

    Null and empty texts go, repeated rows stay or go together, and columns of any name are kept.
    """
    ratios = models(docs, target_ids, id_col, text_col)
    least = _least(settle(weigh(docs, ratios, seed, id_col, text_col)), k)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    whole = docs.select(F.struct("*").alias("row"), F.xxhash64(F.lit(seed), id_col, text_col).alias("__noise"))
    return _drawn(_weighed(whole, shared, text_col, 2), least, k).select("row.*")
