"""Token counts of a unigram tokenizer, without its tokens.

The vocabulary's pieces are found by an Aho-Corasick automaton; a Viterbi pass over the
ends of the matches keeps, for each end, the best score and how many pieces lead to it.

Exact rules, as the unigram tokenizers of the ``tokenizers`` library have them: a text is
cut before every space (U+0020 or U+2581), the space becomes U+2581, and one is put in
front of a text that doesn't begin with one.  Each part is segmented on its own.  Scores
are doubles, added from left to right.  Of paths with equal scores the one whose last
piece starts first stays.  A character that isn't a piece by itself can be taken as
unknown, at the vocabulary's lowest score less UNKNOWN_PENALTY; it counts one piece for
each of its UTF-8 bytes if the vocabulary has the 256 byte pieces, and otherwise a run
of unknown characters counts as one.

Parts repeat, so each block's are counted once, and a Python worker keeps those it has
met from task to task, up to CACHED, by their bytes.

Defined results: a null or empty text has no tokens and score 0; rows are counted as often
as they occur, texts whole, whatever their length; other columns of the input are not
looked at; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import textvec as V
from gridloom.llm.common import frugal

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Bytes of parts that a worker keeps, beside its last block's, and bytes of text worked on at once.
CACHED, TEXT = 8 << 20, 1 << 20
#: Longer parts are segmented one by one.
LONG = 256
_STOP = "￿"


def zipf_vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece model, each with the log frequency that its rank has by Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    return [(model.id_to_piece(k), -float(np.log(k + 1.0) + np.log(np.log(n)))) for k in range(n)]


class Counter:
    """Counts pieces of parts; one for each task."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.matches = ahocorasick.Automaton()
        for k, (piece, _) in enumerate(vocabulary):
            if piece and _STOP not in piece:
                self.matches.add_word(piece, k)
        self.matches.make_automaton()
        self.score = np.array([s for _, s in vocabulary], dtype=np.float64)
        self.length = np.array([len(p) for p, _ in vocabulary], dtype=np.int64)
        self.unknown = (min(self.score, default=0.0)) - UNKNOWN_PENALTY
        pieces = {p for p, _ in vocabulary}
        self.by_byte = all(f"<0x{b:02X}>" in pieces for b in range(256))
        #: Parts that have been met, by their bytes; their pieces and scores.
        self.met, self.got = pa.array([], pa.large_binary()), np.zeros((0, 2))

    def _edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and score of all matches in text, and of unknown characters (those with a score of their own)."""
        found = np.fromiter(self.matches.iter(text) if len(self.matches) else (), dtype=[("end", np.int64), ("piece", np.int64)])
        end, piece = found["end"] + 1, found["piece"]
        start = end - self.length[piece]
        alone = np.zeros(len(text), bool)
        alone[start[end - start == 1]] = True
        other = np.flatnonzero(~alone)
        return np.concatenate([start, other]), np.concatenate([end, other + 1]), np.concatenate([self.score[piece], np.full(len(other), np.nan)])

    def _cost(self, text: str, at: np.ndarray) -> np.ndarray:
        """Pieces an unknown character counts."""
        return np.array([len(text[k].encode("utf-8", "surrogatepass")) for k in at], dtype=np.int64) if self.by_byte else np.ones(len(at), np.int64)

    def count_one(self, text: str) -> tuple[int, float]:
        """Pieces and score of one part, end by end."""
        start, end, score = self._edges(text)
        order = np.lexsort((start, end))
        best, count, was = [0.0] + [None] * len(text), [0] * (len(text) + 1), [False] * (len(text) + 1)
        for k in order.tolist():
            a, b, s = int(start[k]), int(end[k]), float(score[k])
            unknown = s != s
            total = best[a] + (self.unknown if unknown else s)
            if best[b] is None or total > best[b]:
                best[b], was[b] = total, unknown
                if unknown and self.by_byte:
                    count[b] = count[a] + len(text[a].encode("utf-8", "surrogatepass"))
                else:
                    count[b] = count[a] + (not (unknown and was[a]))
        return count[-1], best[-1]

    def count(self, parts: list[str]) -> list[tuple[int, float]]:
        """Pieces and score of each part, all parts at once."""
        out: list[tuple[int, float]] = [(0, 0.0)] * len(parts)
        for k in [k for k, p in enumerate(parts) if len(p) > LONG]:
            out[k] = self.count_one(parts[k])
        short = [k for k, p in enumerate(parts) if 0 < len(p) <= LONG]
        if not short:
            return out
        text = _STOP.join(parts[k] for k in short)
        size = np.array([len(parts[k]) for k in short])
        first = np.cumsum(size + 1) - size - 1
        start, end, score = self._edges(text)
        own = np.searchsorted(first, start, side="right") - 1
        inside = start < first[own] + size[own]  # not a stop between parts
        start, end, score, own = start[inside], end[inside], score[inside], own[inside]
        unknown = np.isnan(score)
        cost = np.ones(len(start), np.int64)
        cost[unknown] = self._cost(text, start[unknown])
        score[unknown] = self.unknown
        step = end - first[own]
        order = np.lexsort((start, own, step))
        start, end, score, own, step, unknown, cost = (x[order] for x in (start, end, score, own, step, unknown, cost))
        best, count, was = np.zeros(len(text) + 1), np.zeros(len(text) + 1, np.int64), np.zeros(len(text) + 1, bool)
        cuts = np.searchsorted(step, np.arange(1, step.max() + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            total = best[start[a:b]] + score[a:b]
            new = np.flatnonzero(np.diff(own[a:b], prepend=-1))
            top = np.maximum.reduceat(total, new)
            hit = np.flatnonzero(total == np.repeat(top, np.diff(np.append(new, b - a))))
            k = a + hit[np.flatnonzero(np.diff(own[a:b][hit], prepend=-1))]  # the first of equals
            best[end[k]] = top
            joined = unknown[k] & was[start[k]] & (not self.by_byte)
            count[end[k]] = count[start[k]] + np.where(joined, 0, cost[k])
            was[end[k]] = unknown[k]
        last = first + size
        for k, n, s in zip(short, count[last].tolist(), best[last].tolist(), strict=True):
            out[k] = (n, s)
        return out

    def block(self, block: V.Block) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and score of each text."""
        opens = np.zeros(len(block.data) + 1, bool)
        opens[:-1] = block.data == 32
        opens[block.offsets] = True
        cut = np.flatnonzero(opens)
        start, end = cut[:-1], cut[1:]
        doc = block.doc_of(start)
        which, some = V.codes(block.data, start, end)  # a part has its space in front, but for one that opens a text
        if self.met.nbytes > CACHED:  # the younger half stays
            half = len(self.met) // 2
            self.met, self.got = pa.concat_arrays([self.met.slice(half)]), self.got[half:].copy()
        found = pc.index_in(some, value_set=self.met)
        at, fresh = found.fill_null(0).to_numpy().astype(np.int64), found.is_null().to_numpy(zero_copy_only=False)
        if fresh.any():
            at[fresh] = np.arange(len(self.met), len(self.met) + fresh.sum())
            new = some.filter(pa.array(fresh))
            parts = [SPACE + raw.removeprefix(b" ").decode() for raw in new.to_pylist()]
            self.met = pa.concat_arrays([self.met, new])
            self.got = np.concatenate([self.got, np.array(self.count(parts), dtype=np.float64).reshape(-1, 2)])
        got = self.got[at[which]]
        n = np.bincount(doc, weights=got[:, 0], minlength=block.rows).astype(np.int64)
        return n, np.bincount(doc, weights=got[:, 1], minlength=block.rows).astype(np.float64)


_counters: dict[int, Counter] = {}


def _counter(vocabulary: list[tuple[str, float]]) -> Counter:
    """This worker's counter for a vocabulary; one is kept."""
    if (key := hash(tuple(vocabulary))) not in _counters:
        _counters.clear()
        _counters[key] = Counter(vocabulary)
    return _counters[key]


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id, n_tokens and the score of the best segmentation."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary file

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            for block in V.blocks(batch.column(1), TEXT):
                n, score = counter.block(block)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.array(n), pa.array(score)], names=out.fieldNames())

    text = F.replace(F.col(text_col).cast("string"), F.lit(SPACE), F.lit(" "))
    source = docs.select(F.col(id_col).alias(id_col), text.alias("text"))
    out = T.StructType([source.schema[0]]).add("n_tokens", T.LongType()).add("score", T.DoubleType())
    return source.mapInArrow(run, out)
