"""Vectorised kernels over the bytes of Arrow string columns.

A batch is worked through in blocks of about half a megabyte of text, so the memory a
task takes does not depend on the batch size.  A single longer text makes a block
of its own and takes about 60 bytes of memory for each of its bytes.  Words are
maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``.  Hashes are 64 bits
wide and depend on content only, never on where a text lies in its block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: First bytes of UTF-8 sequences, that is, one mark for each code point.
LEAD = (np.arange(256) & 0xC0) != 0x80

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA3B195354A39B70D)
    return h ^ (h >> np.uint64(32))


_SEED = np.uint64(0x2545F4914F6CDD1D)
#: Masks that keep the first k bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans in pieces of eight bytes, the last of each filled up with zeros; how many each span has, and its first."""
    n = (ends - starts + 7) >> 3
    first = np.cumsum(n) - n
    at = np.repeat(starts - 8 * first, n) + 8 * np.arange(int(n.sum()))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.ndarray(len(data) + 1, "<u8", buffer=padded, strides=(1,))[at]
    out &= _FIRST[np.minimum(np.repeat(ends, n) - at, 8)]
    return out, n, first


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each span.

    Every piece of eight bytes is mixed, once by itself and once with its place, before the
    pieces are added, so texts that are built alike don't have sums alike.
    """
    part, n, first = pieces(data, starts, ends)
    part += _SEED
    part = mix(part)
    if len(part) > len(n) or not n.all():
        nth = np.arange(len(part)) - np.repeat(first, n)
        part = mix(part + nth.astype(np.uint64) * _BASE)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        part = sums[first + n] - sums[first]
    else:
        part = mix(part)
    return mix(part + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For each span the number of its byte string among the distinct ones, and these: no hashes, so never two in one."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    if len(starts) and not (starts[1:] == ends[:-1]).all():
        data = data[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
    elif len(starts):
        offsets = offsets + starts[0]
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    found = raw.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def prefix_count(marks: np.ndarray) -> np.ndarray:
    """Running count of marks, with a leading 0."""
    out = np.zeros(len(marks) + 1, dtype=np.int64)
    np.cumsum(marks, out=out[1:])
    return out


@dataclass
class Spans:
    """Parts of texts, in order: where each starts and ends, and its document's number within the block."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


@dataclass
class Block:
    """Rows first..last of a batch: their texts' bytes and where each text starts in them."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first

    def words(self) -> Spans:
        inside = ~SPACE[self.data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = self.offsets[1:] > self.offsets[:-1]
        before[self.offsets[:-1][full]] = False
        after[self.offsets[1:][full] - 1] = False
        start = np.flatnonzero(inside & ~before)
        return Spans(start, np.flatnonzero(inside & ~after) + 1, self.doc_of(start))

    def lines(self) -> Spans:
        """Parts between newlines; a text without any has one, be it empty."""
        cuts = np.flatnonzero(self.data == 10)
        start = np.concatenate([self.offsets[:-1], cuts + 1])
        end = np.concatenate([cuts, self.offsets[1:]])
        doc = np.concatenate([np.arange(self.rows), self.doc_of(cuts)])
        end_doc = np.concatenate([self.doc_of(cuts), np.arange(self.rows)])
        a, b = np.lexsort((start, doc)), np.lexsort((end, end_doc))
        return Spans(start[a], end[b], doc[a])

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, side="right") - 1

    def per_doc(self, spans: Spans, weights: np.ndarray | None = None) -> np.ndarray:
        got = np.bincount(spans.doc, weights=weights, minlength=self.rows)
        return got.astype(np.int64) if weights is None or weights.dtype.kind in "iub" else got


def blocks(column: pa.Array, max_bytes: int = 1 << 19) -> Iterator[Block]:
    """The rows of a string column, a null as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1)
        yield Block(at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def windows(words: Spans, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of k words of one text: the place of its first word, and its hash."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.doc[:n] == words.doc[k - 1 :])
    total = np.full(n, _SEED)
    for j in range(k):  # not a polynomial: what is carried on is shifted into itself each time
        total ^= hashes[j : j + n]
        total *= _BASE
        total ^= total >> np.uint64(29)
    return at, mix(total[at])


def text_of(column: pa.Array, name: str) -> pa.Array:
    """A text column by itself, or the named field of a column of whole rows: texts then come once."""
    return column.field(name).cast(pa.string()) if pa.types.is_struct(column.type) else column
