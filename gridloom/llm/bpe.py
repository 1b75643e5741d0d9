"""Byte-level BPE with a sentencepiece model written straight from a rank vocabulary.

``model_proto`` serialises the vocabulary as a sentencepiece BPE model without any
training: each byte string becomes a piece of one printable character a byte, its score
the negative rank, with an identity normaliser and no added or removed spaces.  Merging
the best-scored pair first, leftmost on ties, is then merging the lowest rank first, and
the piece numbers are the ranks.

A text is cut into pre-tokens by PATTERN.  A pre-token that is itself in the vocabulary
is one token; any other is encoded by sentencepiece.  Pre-tokens repeat, so a worker keeps
those it has met, by their bytes (up to CACHED, then it starts anew).  Decoding is by
inverse mapping: the ids' bytes, one after the other.

Defined results: a null text counts as empty, which has no tokens and decodes to no
bytes; rows are encoded as often as they occur; texts are encoded whole, whatever their
length; other columns of the input are passed by, whatever their names; an empty table
gives an empty one.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import textvec as V
from gridloom.llm.common import frugal
from gridloom.llm.pretoken import pre_tokens

#: Bytes of pre-tokens and their ids that a worker keeps, beside its last block's, and bytes of text worked on at once.
CACHED, TEXT = 16 << 20, 1 << 20


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank.  Read on the driver; executors get the model."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    by_rank = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(by_rank) != list(range(len(by_rank))):
        raise ValueError("ranks are not 0, 1, 2, ...")
    return [by_rank[k] for k in range(len(by_rank))]


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


_CHARS = "".join(byte_characters())


def as_piece(raw: bytes) -> str:
    return codecs.charmap_decode(raw, "strict", _CHARS)[0]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protobuf field: an int as varint, a float as fixed 32 bits, bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece model in which piece k is the byte string of rank k; the last is <unk>."""
    pieces = [_field(1, as_piece(token).encode()) + _field(2, -float(rank)) + _field(3, 1) for rank, token in enumerate(vocabulary)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    off = (1 << 64) - 1  # -1: there is no such piece
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(vocabulary)) + b"".join(_field(n, off) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


def _strings(parts: list[bytes]) -> pa.LargeBinaryArray:
    return pa.array(parts, pa.large_binary())


def _taken(table: pa.LargeBinaryArray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a table, one after the other, and where each starts among them (with the end)."""
    got = table.take(pa.array(which))
    at = np.frombuffer(got.buffers()[1], np.int64)[: len(which) + 1] if len(which) else np.zeros(1, np.int64)
    raw = got.buffers()[2]
    return np.frombuffer(raw, np.uint8)[: at[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8), at


class Codec:
    """Encoder and decoder of one Python worker."""

    def __init__(self, model: bytes, pattern: str) -> None:
        import sentencepiece

        self.pattern = pattern
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        back = {c: b for b, c in enumerate(_CHARS)}
        n = self.pieces.vocab_size() - 1
        self.bytes = _strings([bytes(back[c] for c in self.pieces.id_to_piece(k)) for k in range(n)])
        self.decimals = _strings([b"%d " % k for k in range(n)])
        # what has been met: the vocabulary itself comes first and stays
        self.met = self.bytes
        self.ids = self._as_bytes(np.arange(n, dtype=np.int32), np.ones(n, np.int64))

    @staticmethod
    def _as_bytes(ids: np.ndarray, size: np.ndarray) -> pa.LargeBinaryArray:
        at = np.concatenate([[0], np.cumsum(4 * size)])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(ids)])

    def _forget(self) -> None:
        """Drop the older half of what has been met, but for the vocabulary."""
        n = len(self.bytes)
        half = n + (len(self.met) - n) // 2
        self.met, self.ids = (pa.concat_arrays([x.slice(0, n), x.slice(half)]) for x in (self.met, self.ids))

    def _learn(self, new: pa.LargeBinaryArray) -> None:
        """Add pre-tokens that haven't been met."""
        found = self.pieces.encode([as_piece(raw) for raw in new.to_pylist()], num_threads=1)
        size = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))
        self.met = pa.concat_arrays([self.met, new])
        self.ids = pa.concat_arrays([self.ids, self._as_bytes(ids, size)])

    def encode(self, block: V.Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block's texts, and where each text's start among them (with the end)."""
        spans = pre_tokens(block, self.pattern)
        which, some = V.codes(block.data, spans.start, spans.end)
        if self.met.nbytes + self.ids.nbytes > self.bytes.nbytes + CACHED:
            self._forget()
        found = pc.index_in(some, value_set=self.met)
        at, fresh = found.fill_null(0).to_numpy().astype(np.int64), found.is_null().to_numpy(zero_copy_only=False)
        if fresh.any():
            at[fresh] = np.arange(len(self.met), len(self.met) + fresh.sum())
            self._learn(some.filter(pa.array(fresh)))
        at = at[which]
        raw, start = _taken(self.ids, at)
        n = np.zeros(block.rows + 1, np.int64)
        n[1:] = start[np.searchsorted(spans.doc, np.arange(block.rows), side="right")] // 4
        return raw.view(np.int32), n

    def decode(self, ids: np.ndarray) -> bytes:
        return _taken(self.bytes, ids)[0].tobytes()

    def digests(self, ids: np.ndarray, cut: np.ndarray) -> tuple[list[str], list[str]]:
        """For each text, the SHA-256 of its ids as decimals with blanks between, and of its decoded bytes."""
        out = []
        for table, tail in ((self.decimals, 1), (self.bytes, 0)):
            raw, at = _taken(table, ids)
            ends, raw = at[cut].tolist(), memoryview(raw)
            out.append([hashlib.sha256(raw[a : max(a, b - tail)]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)])
        return out[0], out[1]


_codecs: dict[int, Codec] = {}


def codec(model: bytes, pattern: str) -> Codec:
    """This worker's codec for a model and a pattern; one is kept from task to task."""
    if (key := hash((model, pattern))) not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model, pattern)
    return _codecs[key]


def shared_model(df: DataFrame, path: str):
    """The model, broadcast: it is as large as its vocabulary file, whatever the input."""
    return df.sparkSession.sparkContext.broadcast(model_proto(read_ranks(path)))


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, passed: tuple[str, ...] = ()) -> DataFrame:
    """For each row its id, the columns named in passed, its number of tokens, digests of the ids and of the decoded bytes, and on request the ids."""
    model = shared_model(docs, path)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value, pattern)
        for batch in batches:
            for block in V.blocks(batch.column(0), TEXT):
                ids, cut = own.encode(block)
                columns = [c.slice(block.first, block.rows) for c in batch.columns[1:]]
                columns += [pa.array(np.diff(cut)), *map(pa.array, own.digests(ids, cut))]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(columns, names=out.fieldNames())

    made = {"n_tokens", "ids_sha256", "decoded_sha256", "ids"}  # columns of the input with such names give way
    own = [c for c in dict.fromkeys([id_col, *passed]) if c not in made]
    source = docs.select(F.col(text_col).cast("string").alias("__text"), *(F.col(f"`{c}`") for c in own))
    out = T.StructType(source.schema.fields[1:])
    for name, kind in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())):
        out = out.add(name, kind)
    if keep_ids:
        out = out.add("ids", T.ArrayType(T.IntegerType()))
    return source.mapInArrow(run, out)
