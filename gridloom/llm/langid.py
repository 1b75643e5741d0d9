"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs, one from each side, read windows of WINDOW bytes; from both states a softmax
layer labels every byte with a distribution over the languages, and a document's
probabilities are the mean over all bytes of its whole text.  The gates use the
piecewise linear sigmoid and the candidate x / (1 + |x|), which numpy computes ten
times faster than exp and tanh.

The network is trained in numpy by backpropagation through time with Adam, on the
driver, from a bounded sample: about PER_LABEL rows of each label, each with at most
PER_TEXT windows of TRAIN bytes from anywhere in its text.  Texts that are copies give
their windows once.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is
every text if no label is to be learnt from (also for an empty table).  Rows are
labelled as often as they occur, texts read whole whatever their length.  Only the text
is an input of a prediction.  Ties go to the label that is first by code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import textvec as V
from gridloom.llm.common import frugal

PER_LABEL, PER_TEXT, TRAIN, WINDOW = 400, 8, 64, 128
HIDDEN, EPOCHS, BATCH, RATE = 8, 8, 128, 0.02
#: More labels than this are an error, not a silent cut.
MAX_LABELS = 1000
UNKNOWN = "und"
#: Rows that are never learnt from, as SQL over doc_id; a null id is not among them.
HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false)"


@dataclass
class Network:
    """labels; for each direction a table of gate inputs by byte (3H x 256) and the recurrent weights (3H x H); the output layer (C x 2H) and its bias."""

    labels: list[str]
    table: list[np.ndarray]
    recur: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [*self.table, *self.recur, self.out, self.bias]


def _steps(x: np.ndarray, table: np.ndarray, recur: np.ndarray, order: range, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
    """States (L x H x B) of one direction over bytes x (L x B); mask zeroes the state where a window has ended."""
    n, h = recur.shape[1], np.zeros((recur.shape[1], x.shape[1]), np.float32)
    states = np.empty((len(x), *h.shape), np.float32)
    gate, hidden, size = np.empty((3 * n, x.shape[1]), np.float32), np.empty((3 * n, x.shape[1]), np.float32), np.empty_like(h)
    for t in order:
        np.take(table, x[t], axis=1, out=gate, mode="clip")
        np.matmul(recur, h, out=hidden)
        zr, c, back = gate[: 2 * n], gate[2 * n :], hidden[2 * n :]
        zr += hidden[: 2 * n]
        if keep is not None:
            before = zr.copy()
        np.maximum(zr, 0, out=zr)
        np.minimum(zr, 1, out=zr)
        z, r = zr[:n], zr[n:]
        if keep is not None:
            keep.append((t, h.copy(), before, z.copy(), r.copy(), back.copy()))
        back *= r
        c += back
        np.abs(c, out=size)
        size += 1
        c /= size
        if keep is not None:
            keep[-1] += (c.copy(), size.copy())
        c -= h
        c *= z
        h += c
        if mask is not None:
            h *= mask[t]
        states[t] = h
    return states


def _both(net: Network, x: np.ndarray, mask: np.ndarray | None, keep: tuple[list, list] | None = None) -> np.ndarray:
    """Label scores (L x C x B) of every byte."""
    n = net.recur[0].shape[1]
    a = _steps(x, net.table[0], net.recur[0], range(len(x)), mask, keep and keep[0])
    b = _steps(x, net.table[1], net.recur[1], range(len(x) - 1, -1, -1), mask, keep and keep[1])
    scores = np.matmul(net.out[:, :n], a)
    scores += np.matmul(net.out[:, n:], b)
    scores += net.bias[:, None]
    return (scores, a, b) if keep else scores


def _softmax(scores: np.ndarray) -> np.ndarray:
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def _backward(keep: list, x: np.ndarray, d_states: np.ndarray, recur: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of a direction's table and recurrent weights, back through time."""
    n = recur.shape[1]
    d_table, d_recur = np.zeros((256, 3 * n), np.float32), np.zeros_like(recur)
    d_h = np.zeros((n, x.shape[1]), np.float32)
    for t, h, before, z, r, back, c, size in reversed(keep):
        d_h = (d_h + d_states[t]) * mask[t]
        d_c = d_h * z / (size * size)
        d_z = d_h * (c - h)
        d_r = d_c * back
        d_zr = np.concatenate([d_z, d_r]) * ((before > 0) & (before < 1))
        d_gate = np.concatenate([d_zr, d_c])
        d_hidden = np.concatenate([d_zr, d_c * r])
        np.add.at(d_table, x[t], d_gate.T)
        d_recur += d_hidden @ h.T
        d_h = d_h * (1 - z) + recur.T @ d_hidden
    return d_table.T, d_recur


def train(samples: list[tuple[str, bytes]], seed: int = 5) -> Network | None:
    """A network from (label, window) pairs; None if there are none.  Equal samples in any order give equal networks."""
    samples = sorted(samples)
    labels = sorted({label for label, _ in samples})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    n, c = HIDDEN, len(labels)
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    net = Network(labels, [draw(3 * n, 256) for _ in range(2)], [draw(3 * n, n) for _ in range(2)], draw(c, 2 * n), np.zeros(c, np.float32))
    for t in net.table:
        t[: 2 * n] += 0.5  # the middle of the piecewise linear sigmoid
    y = np.array([labels.index(label) for label, _ in samples])
    length = np.array([len(w) for _, w in samples])
    x = np.zeros((len(samples), TRAIN), np.intp)
    for k, (_, w) in enumerate(samples):
        x[k, : len(w)] = np.frombuffer(w, np.uint8)
    weight = (1 / np.bincount(y, weights=length, minlength=c))[y] * length.sum() / c  # labels count alike
    m, v, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    batches = -(-len(samples) // BATCH)
    for _ in range(max(EPOCHS, -(-200 // batches))):
        order = rng.permutation(len(samples))
        for k in range(batches):
            own = order[k::batches]
            xs = np.ascontiguousarray(x[own].T)
            mask = (np.arange(TRAIN)[:, None] < length[own]).astype(np.float32)
            keep: tuple[list, list] = ([], [])
            scores, a, b = _both(net, xs, mask, keep)
            error = _softmax(scores)
            error[:, y[own], np.arange(len(own))] -= 1
            error *= (mask * weight[own] / mask.sum())[:, None, :]
            error = error.astype(np.float32)
            d_out = np.concatenate([np.einsum("lcb,lhb->ch", error, s) for s in (a, b)], axis=1)
            pairs = [_backward(keep[i], xs, np.matmul(net.out[:, i * n : (i + 1) * n].T, error), net.recur[i], mask) for i in range(2)]
            grads = [pairs[0][0], pairs[1][0], pairs[0][1], pairs[1][1], d_out, error.sum(axis=(0, 2))]
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for i, (p, g) in enumerate(zip(net.parts(), grads, strict=True)):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                p -= RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return net


def probabilities(net: Network, block: V.Block, rows: int = 2048) -> np.ndarray:
    """Mean label distribution over the bytes of each text (rows x C); 0 for an empty text."""
    size = np.diff(block.offsets)
    pieces = -(-size // WINDOW)
    doc = np.repeat(np.arange(block.rows), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = block.offsets[:-1][doc] + nth * WINDOW
    length = np.minimum(WINDOW, block.offsets[1:][doc] - start)
    order = np.argsort(-length, kind="stable")  # windows that are cut short come together
    sums = np.zeros((len(doc), len(net.labels)))
    data = np.concatenate([block.data, np.zeros(WINDOW, np.uint8)])
    for k in range(0, len(doc), rows):
        own = order[k : k + rows]
        steps = np.arange(length[own].max())
        x = data[start[own] + steps[:, None]].astype(np.intp)
        mask = None
        if length[own].min() < len(steps):
            mask = (steps[:, None] < length[own]).astype(np.float32)
        p = _softmax(_both(net, x, mask))
        if mask is not None:
            p *= mask[:, None, :]
        sums[own] = p.sum(axis=0, dtype=np.float64).T
    out = np.zeros((block.rows, len(net.labels)))
    np.add.at(out, doc, sums)
    return out / np.maximum(size, 1)[:, None]


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def has_letter(block: V.Block) -> np.ndarray:
    plain = V.prefix_count(_LETTER[block.data])
    out = plain[block.offsets[1:]] > plain[block.offsets[:-1]]
    for k in np.flatnonzero(~out & (np.diff(block.offsets) > 0)):
        out[k] = any(map(str.isalpha, block.data[block.offsets[k] : block.offsets[k + 1]].tobytes().decode()))
    return out


def predict(net: Network | None, block: V.Block) -> tuple[list[str], np.ndarray]:
    if net is None:
        return [UNKNOWN] * block.rows, np.zeros(block.rows)
    p, known = probabilities(net, block), has_letter(block)
    best = p.argmax(axis=1)
    score = np.where(known, np.clip(p[np.arange(block.rows), best], 0, 1), 0.0)
    return [net.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = PER_LABEL) -> Network | None:
    """A network from rows with a text and a label.  What reaches the driver is bounded by per_label, PER_TEXT and TRAIN."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label")).where("text is not null and label is not null")
    counts = rows.groupBy("label").count().limit(MAX_LABELS + 1).collect()
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    if not counts:
        return None
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("label") == r["label"], F.lit(min(1.0, per_label / r["count"]))).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit(71), "id", "text"), F.lit(1 << 30)) < share * (1 << 30)

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, bytes]] = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                if len(raw) <= TRAIN:
                    starts = [0] if raw else []
                else:
                    rng = np.random.default_rng([len(raw), *raw[:8], *raw[-8:]])
                    starts = sorted({int(s) for s in rng.integers(0, len(raw) - TRAIN + 1, min(PER_TEXT, -(-len(raw) // TRAIN)))})
                out += [(label, raw[s : s + TRAIN]) for s in starts]
            yield pa.RecordBatch.from_arrays([pa.array([label for label, _ in out], pa.string()), pa.array([w for _, w in out], pa.binary())], names=["label", "window"])

    windows = rows.where(drawn).select("text", "label").mapInArrow(cut, "label string, window binary").distinct()
    return train([(r["label"], bytes(r["window"])) for r in windows.collect()])


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", passed: dict[str, Column] | None = None) -> DataFrame:
    """For each row its id, the columns in passed, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    source = docs.select(F.col(text_col).cast("string").alias("__text"), F.col(id_col).alias(id_col), *(c.alias(n) for n, c in (passed or {}).items()))
    return _labelled(source, shared, "", 1)


def _labelled(source: DataFrame, shared, text_col: str, keep: int) -> DataFrame:
    """source's columns from number keep on, lang_pred and score; the text is the first column or its field text_col."""
    out = T.StructType(source.schema.fields[keep:]).add("lang_pred", T.StringType()).add("score", T.DoubleType())

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in V.blocks(V.text_of(batch.column(0), text_col), 1 << 20):
                names, score = predict(shared.value, block)
                columns = [c.slice(block.first, block.rows) for c in batch.columns[keep:]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(score)], names=out.fieldNames())

    return source.mapInArrow(run, out)


def identified_documents(docs: DataFrame, labelled: DataFrame, least: float = 0.4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The rows of docs whose language is known with a score of at least ``least``, with all their columns.

    Null texts and those without a letter go, repeated rows stay or go together; without labels none stays.
    """
    net = learn(labelled, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    got = _labelled(docs.select(F.struct("*").alias("row")), shared, text_col, 0)
    return got.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
