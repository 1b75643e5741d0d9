"""Periodic runs in texts: stretches of words that repeat with a period.

A run is a stretch of consecutive words with smallest period q whose length is at least
SHORTEST and at least 2 q, and which no neighbouring word extends with period q.

Masking.  A run of length n and period q matches itself q words on over n - q words, which
is at least max(SHORTEST - q, q), so at least k = SHORTEST / 2 whatever q is.  So each of its
words lies in a k-gram that occurs twice in the text; words outside such k-grams can't join
a run, and only the stretches in between, of SHORTEST words or more, are searched.  k-grams
are held against each other by hashes; a collision only leaves a word unmasked.

Search.  Main and Lorentz' division: a run lies in one half of a stretch or holds its two
middle words, and then one half holds a whole period of it: for each period, how far the
middle and the word a period away agree, ahead and behind, gives the run, maximal at once.
All stretches of a block and all periods are worked through together, level by level.  How
far two places agree is found from the names of the blocks of 1, 2, 4, ... words at every
place, so words are compared by themselves, never by hashes: n log n names, and at most
log n steps for each of n log n places.  Of runs that are equal the smallest period stays.

Defined results: a null or wordless text has no runs, all of its (no) words are kept; rows
are worked on as often as they occur, whole, whatever their length; other columns are passed
by, whatever their names; an empty table gives an empty one.  Of equally long runs the
first is reported.  A text of n words is held in one task, at some 100 bytes a word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import textvec as V
from gridloom.llm.common import frugal

SHORTEST = 12
#: Bytes of text that are worked on at once.
TEXT = 1 << 20

#: From a block's words, the row each is of and the ids of rows: the word that stands in each one's place.
Rewriting = Callable[[np.ndarray, pa.Array], np.ndarray]


def planted(doc: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Texts rewritten to hold runs: of the ids whose crc32 is a multiple of 10, from some word on all repeats.  Rows with a null id stay."""
    source = np.arange(len(doc))
    cut = np.searchsorted(doc, np.arange(len(ids) + 1))
    for d, name in enumerate(ids.to_pylist()):
        n = int(cut[d + 1] - cut[d])
        if name is None or not n or (h := zlib.crc32(str(name).encode())) % 10:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[cut[d] + a : cut[d + 1]] = cut[d] + a + np.arange(n - a) % p
    return source


def unmasked(words: V.Spans, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of at least 2 k words, each of which lies in a k-gram that its text holds twice: where they start and end."""
    at, keys = V.windows(words, V.mix(codes.astype(np.uint64) + np.uint64(1)), k)
    keys = keys ^ V.mix(words.doc[at].astype(np.uint64))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covers = np.zeros(len(words) + 1, np.int64)
    np.add.at(covers, at[twice], 1)
    np.add.at(covers, at[twice] + k, -1)
    inside = np.cumsum(covers[:-1]) > 0
    new = np.ones(len(words), bool)
    new[1:] = words.doc[1:] != words.doc[:-1]
    opens = inside.copy()
    opens[1:] &= new[1:] | ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= new[1:] | ~inside[1:]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = end - start >= 2 * k
    return start[long], end[long]


def block_names(x: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each power of two up to longest, a number for the block of so many entries at each place; equal numbers mean equal blocks."""
    _, now = np.unique(x, return_inverse=True)
    out, size = [now.astype(np.int64)], 1
    while 2 * size <= longest:
        pair = out[-1][: len(x) - 2 * size + 1] * len(x) + out[-1][size : len(x) - size + 1]
        out.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        size *= 2
    return out


def agree(names: list[np.ndarray], i: np.ndarray, k: np.ndarray, step: int) -> np.ndarray:
    """How many entries from the places i on are those from the places k > i on; with step -1, how many before i those before k."""
    far = np.zeros(len(i), np.int64)
    for j in range(len(names) - 1, -1, -1):
        size = 1 << j
        a, b = (i + far, k + far) if step > 0 else (i - far - size, k - far - size)
        ok = (a >= 0) & (b < len(names[j]))
        ok[ok] = names[j][a[ok]] == names[j][b[ok]]
        far += ok * size
    return far


def runs(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs in the stretches [lo, hi) of x, none of which any match crosses: where each starts and ends, and its period, by start, then period."""
    found = [np.zeros((0, 3), np.int64)]
    if len(lo):
        names = block_names(x, int((hi - lo).max()))
        names.append(names[-1][:0])  # agreements shorter than twice the longest block
    while len(lo):
        big = hi - lo >= shortest
        lo, hi = lo[big], hi[big]
        middle = (lo + hi) // 2
        for ahead in (True, False):
            most = hi - middle if ahead else middle - lo
            p = 1 + np.arange(int(most.sum())) - np.repeat(np.cumsum(most) - most, most)
            c = np.repeat(middle, most)
            i, k = (c, c + p) if ahead else (c - p, c)
            # a match of shortest / 2 words or more has two words on one side of the middle at least
            near = np.zeros(len(i), bool)
            two = names[1]
            for a, b in ((i, k), (i - 2, k - 2)):
                ok = (a >= 0) & (b < len(two))
                near[ok] |= two[a[ok]] == two[b[ok]]
            i, k, p = i[near], k[near], p[near]
            f, b = agree(names[:-1], i, k, 1), agree(names[:-1], i, k, -1)
            good = (f + b >= p) & (f + b + p >= shortest)
            found.append(np.column_stack([i[good] - b[good], k[good] + f[good], p[good]]))
        lo, hi = np.concatenate([lo, middle]), np.concatenate([middle, hi])
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    first = np.ones(len(every), bool)
    first[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[first]
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    return every[:, 0], every[:, 1], every[:, 2]


def block_runs(words: V.Spans, codes: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a block's texts, in places of its words, by text, start and period."""
    start, end = unmasked(words, codes, shortest // 2)
    size = end - start
    shift = np.cumsum(size + 1) - size - 1  # one entry between stretches, that nothing equals
    x = -1 - np.arange(int((size + 1).sum()))
    back = np.repeat(start - shift, size)
    at = np.arange(int(size.sum())) + np.repeat(shift - (np.cumsum(size) - size), size)
    x[at] = codes[at + back]
    own = np.concatenate([start - shift, [0]])
    s, e, p = runs(x, shift, shift + size, shortest)
    to = own[np.searchsorted(shift, s, side="right") - 1] if len(s) else s
    return s + to, e + to, p


def _joined(table: pa.Array, which: np.ndarray, cut: np.ndarray) -> list[str]:
    """For each row the SHA-256 of its words joined by blanks; which words of a table, and where each row's start."""
    blank = pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary())
    got = pc.binary_join_element_wise(table, *blank).take(pa.array(which))
    ends = np.frombuffer(got.buffers()[1], np.int64)[got.offset : got.offset + len(got) + 1] if len(got) else np.zeros(1, np.int64)
    raw = memoryview(got.buffers()[2]) if len(got) else memoryview(b"")
    return [hashlib.sha256(raw[ends[a] : max(ends[a], ends[b] - 1)]).hexdigest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def block_report(block: V.Block, ids: pa.Array, rewrite: Rewriting | None) -> dict[str, pa.Array]:
    """The columns of periodic_runs() for a block."""
    words = block.words()
    codes, table = V.codes(block.data, words.start, words.end)
    codes = codes.astype(np.int64)
    if rewrite is not None:
        codes = codes[rewrite(words.doc, ids)]
    start, end, period = block_runs(words, codes)
    cut = np.searchsorted(words.doc, np.arange(block.rows + 1))
    doc = words.doc[start] if len(start) else start
    bounds = np.searchsorted(doc, np.arange(block.rows + 1))
    drops = np.zeros(len(words) + 1, np.int64)
    np.add.at(drops, start + period, 1)
    np.add.at(drops, end, -1)
    kept = np.cumsum(drops[:-1]) == 0
    first, length = start - cut[doc], end - start
    lines = [b"%d,%d,%d\n" % r for r in zip(first.tolist(), length.tolist(), period.tolist(), strict=True)]
    order = np.lexsort((period, first, -length, doc))
    has = np.diff(bounds) > 0
    best = order[bounds[:-1][has]]
    at = np.full(block.rows, -1)
    at[has] = best
    of = lambda v: pa.array(np.append(v, 0)[at], pa.int64(), mask=~has)
    return {
        "n_runs": pa.array(np.diff(bounds), pa.int64()),
        "start": of(first),
        "length": of(length),
        "period": of(period),
        "exponent_milli": of(1000 * length // np.maximum(period, 1)),
        "n_words": pa.array(np.diff(cut), pa.int64()),
        "n_kept": pa.array(np.diff(V.prefix_count(kept)[cut]), pa.int64()),
        "runs_sha256": pa.array([hashlib.sha256(b"".join(lines[a:b])).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]),
        "collapsed_sha256": pa.array(_joined(table, codes[kept], V.prefix_count(kept)[cut])),
    }


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewriting | None = None) -> DataFrame:
    """For each row its id, the number of runs, the longest one, numbers of words, and digests of all runs and of the words left when each run keeps one period."""
    longs = ("n_runs", "start", "length", "period", "exponent_milli", "n_words", "n_kept")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = T.StructType([source.schema["id"], *(T.StructField(c, T.LongType()) for c in longs), T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in V.blocks(batch.column(1), TEXT):
                ids = batch.column(0).slice(block.first, block.rows)
                made = block_report(block, ids, rewrite)
                yield pa.RecordBatch.from_arrays([ids, *(made[c] for c in out.fieldNames()[1:])], names=out.fieldNames())

    return source.mapInArrow(run, out).withColumnRenamed("id", id_col)
