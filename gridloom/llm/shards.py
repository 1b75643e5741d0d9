"""Training order: token sequences permuted into fixed-stride binary shards.

Texts are encoded (bpe.Codec) and cut into sequences of LENGTH ids, the last of each text
filled up with an end id.  Sequences are numbered 0 .. n - 1 by the task that encodes them
and their place in it, so the same files cut into the same tasks give the same order, and
another cut gives another (as good) one.  A keyed Feistel network permutes the numbers:
it is a bijection of 2**(2h) >= n values, and a value of n or more is put through it again
until it falls below n (cycle-walking), so every sequence gets a slot of its own and every
slot has a sequence.  Slots are dealt by range to shards of PER_SHARD sequences; slot s lies
in shard s // PER_SHARD at byte (s % PER_SHARD) * LENGTH * width.  A reader that knows the
slot it stopped at goes on from there, and reads in training order what lies in a row.

The encoded texts are kept once, compressed; the shards are then made in WAVES ranges of
slots, one after the other, so that only a part of the sequences is in a shuffle at a time.
Shards are written by the tasks that hold their range, under a name of the attempt, and
renamed when complete, so a lost executor or a task that runs twice leaves whole shards
only.  A shard is one task's partition, by its number.  Rows that describe the sequences come back when all shards are there.

Defined results: a null or empty text has no sequences; a repeated row has its own
sequences; the ids are stored little-endian in 2 bytes if the end id fits, else in 4; an
empty table gives no shards and no rows; other columns are not looked at.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textvec as V
from gridloom.llm.bpe import TEXT, codec, shared_model
from gridloom.llm.common import drop, frugal, new_folder, stored

LENGTH, PER_SHARD, ROUNDS, WAVES = 256, 16384, 6, 4


def feistel(values: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of values in 0 .. n - 1: a permutation of 0 .. n - 1 chosen by key."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = V.mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % (1 << 64)))
    out = values.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (V.mix(right ^ k) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def width(end_id: int) -> np.dtype:
    return np.dtype("<u2" if end_id < 1 << 16 else "<u4")


def _encoded(docs: DataFrame, path: str, pattern: str, length: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """id, part (the task), first (sequences the task had before), n, and the ids as bytes."""
    model, kind = shared_model(docs, path), width(end_id)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, first = codec(model.value, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            for block in V.blocks(batch.column(1), TEXT):
                ids, cut = own.encode(block)
                n = -(-np.diff(cut) // length)
                start = np.cumsum(n) - n
                raw = pa.BinaryArray.from_buffers(pa.binary(), block.rows, [None, pa.py_buffer((cut * kind.itemsize).astype(np.int32)), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.array(np.full(block.rows, part)), pa.array(first + start), pa.array(n), raw], names=["id", "part", "first", "n", "ids"])
                first += int(n.sum())

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, part bigint, first bigint, n bigint, ids binary")


def _store(uri: str):
    """A pyarrow file system and the folder in it; file:, hdfs:, s3: and the like."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


class _Shard:
    """A shard that is being written."""

    def __init__(self, uri: str, number: int) -> None:
        self.store, folder = _store(uri)
        self.store.create_dir(folder, recursive=True)
        self.name = f"{folder}/{shard_name(number)}"
        self.own = f"{self.name}.{uuid.uuid4().hex}"
        self.file = self.store.open_output_stream(self.own)

    def close(self) -> None:
        self.file.close()
        self.store.move(self.own, self.name)


def write_shards(docs: DataFrame, path: str, pattern: str, out_uri: str | None = None, key: int = 97, end_id: int | None = None, length: int = LENGTH, per_shard: int = PER_SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards; a row for each sequence: slot, shard, its byte offset, id, seq (its place in the text), n_tokens without fill, and crc32 of its bytes.

    end_id is by default the first number after the vocabulary.  Without out_uri the
    shards go to a new folder in the checkpoint folder.
    """
    if end_id is None:
        from gridloom.llm.bpe import read_ranks

        end_id = len(read_ranks(path))
    kind, stride = width(end_id), length * width(end_id).itemsize
    spark = docs.sparkSession
    kept = new_folder(spark, "encoded")
    rows = stored(_encoded(docs, path, pattern, length, end_id, id_col, text_col).where("n > 0"), "zstd", kept)
    uri = out_uri or new_folder(spark, "shards")
    sums = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row for each task
    parts = np.array([p for p, _ in sums], np.int64)
    ends = np.cumsum([n for _, n in sums], dtype=np.int64)
    before, total = ends - np.array([n for _, n in sums], np.int64), int(ends[-1]) if sums else 0

    def place(first_shard: int, last_shard: int):
        @frugal
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part, first, n = (batch.column(c).to_numpy() for c in (1, 2, 3))
                who = np.repeat(np.arange(len(n)), n)
                seq = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                slot = feistel((before[np.searchsorted(parts, part)] + first)[who] + seq, total, key)
                shard = slot // per_shard
                own = np.flatnonzero((shard >= first_shard) & (shard < last_shard))
                who, seq = who[own], seq[own]
                at, raw = _binary(batch.column(4), kind)
                start = at[who] + seq * length
                size = np.minimum(length, at[who + 1] - start)
                for k in range(0, max(1, len(own)), 4096):  # sequences copied at once
                    here = slice(k, k + 4096)
                    place = np.arange(length)
                    ids = np.where(place < size[here, None], raw[np.minimum(start[here, None] + place, max(0, len(raw) - 1))] if len(raw) else end_id, end_id).astype(kind)
                    offsets = np.arange(len(ids) + 1, dtype=np.int32) * stride
                    sequences = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                    yield pa.RecordBatch.from_arrays([pa.array(slot[own[here]]), pa.array(shard[own[here]]), batch.column(0).take(pa.array(who[here])), pa.array(seq[here]), sequences], names=["slot", "shard", "id", "seq", "ids"])

        return run

    @frugal
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now, due = None, None, 0
        for batch in batches:
            slot, number = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at, raw = _binary(batch.column(4), kind)
            cuts = np.flatnonzero(np.diff(number, prepend=-1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(number)], strict=True):
                if number[a] != now:
                    if shard:
                        shard.close()
                    now = int(number[a])
                    shard, due = _Shard(uri, now), now * per_shard
                if not np.array_equal(slot[a:b], np.arange(due, due + b - a)):
                    raise ValueError(f"slots from {slot[a]} where those from {due} are due")
                due += b - a
                shard.file.write(memoryview(raw[at[a] : at[b]]).cast("B"))
            ids = raw[at[0] : at[-1]].reshape(len(slot), length)
            sums = [zlib.crc32(row) for row in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(slot % per_shard * stride), batch.column(2), batch.column(3), pa.array((ids != end_id).sum(axis=1)), pa.array(sums, pa.int64())],
                names=["slot", "shard", "offset", "id", "seq", "n_tokens", "crc32"],
            )
        if shard:
            shard.close()

    kind_of = dict(rows.dtypes)["id"]
    shards = -(-total // per_shard)
    done = []
    for w in range(WAVES):
        a, b = shards * w // WAVES, shards * (w + 1) // WAVES
        if a == b and (w or shards):
            continue
        placed = rows.mapInArrow(place(a, b), f"slot bigint, shard bigint, id {kind_of}, seq bigint, ids binary")
        dealt = placed.repartitionById(max(1, b - a), (F.col("shard") - a).cast("int")).sortWithinPartitions("slot")
        done.append(stored(dealt.mapInArrow(write, f"slot bigint, shard bigint, offset bigint, id {kind_of}, seq bigint, n_tokens bigint, crc32 bigint")))
    drop(spark, kept)
    return reduce(DataFrame.union, done).withColumnRenamed("id", id_col)


def _binary(column: pa.BinaryArray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's ids start in a column of bytes (with the end), and all ids."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // kind.itemsize if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    return at, np.frombuffer(raw, kind, at[-1]) if raw is not None and raw.size else np.zeros(0, kind)


def read_sequences(uri: str, start: int, count: int, end_id: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """The sequences of slots start .. start + count - 1, in order, from the shards; fewer where they end."""
    store, folder = _store(uri)
    kind, at, stop = width(end_id), start, start + count
    while at < stop:
        name = f"{folder}/{shard_name(at // per_shard)}"
        if store.get_file_info(name).size in (None, 0):
            return
        with store.open_input_file(name) as file:
            stride = length * kind.itemsize
            here = min(stop, (at // per_shard + 1) * per_shard) - at
            file.seek(at % per_shard * stride)
            for _ in range(here):
                raw = file.read(stride)
                if len(raw) < stride:
                    return
                yield np.frombuffer(raw, kind)
                at += 1
