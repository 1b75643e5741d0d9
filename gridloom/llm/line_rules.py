"""Quality rules, line first: failing lines go, then documents that lost too much.

Each line of a text that holds a word is held against three rules:

punctuation
    more than 20 % of its non-space characters are ASCII marks, or more than 30 %
    of its words end in two marks or more;
navigation
    at least two words, and more than 20 % of all, are single separators;
boilerplate
    it holds one of PHRASES, whatever the case of its ASCII letters.

A line that fails any of them is removed.  A document is rejected if the removed lines
held more than 30 % of the code points of its words, or if it fails the base rules:
fewer than 10 words, or more than 20 % of words in 5-word windows that occur twice.

Defined results: a null or empty text has zero words and is rejected (base rules); a
repeated row is judged as often as it occurs; other columns of the input are not looked
at, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textvec as V
from gridloom.llm.common import frugal

#: The phrases of the boilerplate rule.
PHRASES = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "sign up for our newsletter",
    "skip to content",
    "subscribe now",
    "terms of service",
    "terms of use",
)
#: Words that only separate entries of a navigation line.
SEPARATORS = "|>/*-+="
SYMBOLS = "#*$%&|<>"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

WINDOW = 5
MARK_SHARE, TAIL_SHARE, NAV_SHARE, LOST_SHARE, REPEAT_SHARE = 20, 30, 20, 30, 20
MIN_WORDS = 10

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bad_lines", "lost_chars")


def _lut(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


_SYMBOL, _MARK, _SEPARATOR = _lut(SYMBOLS), _lut(MARKS), _lut(SEPARATORS)


def _repeated(keys: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Which of the rows of parts occur twice or more; keys are their hashes, and rows of equal hash are compared."""
    order = np.argsort(keys)
    same = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    one, two = order[same], order[same + 1]
    out = np.zeros(len(keys), dtype=bool)
    if (parts[one] == parts[two]).all():
        out[one] = out[two] = True
    else:
        own = np.union1d(one, two)
        _, which, n = np.unique(parts[own], axis=0, return_inverse=True, return_counts=True)
        out[own] = n[which.ravel()] > 1
    return out


def _phrase_lines(block: V.Block, lines: V.Spans) -> np.ndarray:
    text = block.data.tobytes().lower()
    hit = np.zeros(len(lines), dtype=bool)
    for phrase in map(str.encode, PHRASES):
        at = text.find(phrase)
        while at >= 0:
            k = int(np.searchsorted(lines.end, at, side="right"))
            if k < len(lines) and lines.start[k] <= at and at + len(phrase) <= lines.end[k]:
                hit[k] = True
            at = text.find(phrase, at + 1)
    return hit


def judge(block: V.Block) -> tuple[dict[str, np.ndarray], V.Spans, np.ndarray]:
    """The counts of COUNTS for each text, the lines, and which lines fail."""
    data, rows = block.data, block.rows
    words, lines = block.words(), block.lines()
    in_word = V.prefix_count(~V.SPACE[data] & V.LEAD[data])
    marks = V.prefix_count(_MARK[data])
    chars = in_word[lines.end] - in_word[lines.start]

    # words of each line
    last = words.end - 1
    tail = np.zeros(len(words), dtype=bool)
    long = words.end - words.start >= 2
    tail[long] = _MARK[data[last[long]]] & _MARK[data[last[long] - 1]]
    lone = (words.end - words.start == 1) & _SEPARATOR[data[words.start]]
    line_of = np.searchsorted(lines.end, words.start, side="right")
    count = lambda w=None: np.bincount(line_of, weights=w, minlength=len(lines)).astype(np.int64)
    n, n_tail, n_lone = count(), count(tail), count(lone)

    full = n > 0
    bad = 100 * (marks[lines.end] - marks[lines.start]) > MARK_SHARE * chars
    bad |= 100 * n_tail > TAIL_SHARE * n
    bad |= (n_lone >= 2) & (100 * n_lone > NAV_SHARE * n)
    bad |= _phrase_lines(block, lines)
    bad &= full

    same, _ = V.codes(data, lines.start[full], lines.end[full])
    _, first = np.unique(lines.doc[full] * (len(lines) + 1) + same, return_index=True)
    n_full = np.bincount(lines.doc[full], minlength=rows)
    word = V.codes(data, words.start, words.end)[0].astype(np.int64)
    at, keys = V.windows(words, V.mix(word.astype(np.uint64) + np.uint64(1)), WINDOW)
    parts = np.column_stack([words.doc[at], *(word[at + j] for j in range(WINDOW))])
    covers = np.zeros(len(words) + 1, dtype=np.int64)
    twice = at[_repeated(keys ^ V.mix(parts[:, 0].astype(np.uint64)), parts)]
    np.add.at(covers, twice, 1)
    np.add.at(covers, twice + WINDOW, -1)
    symbols = V.prefix_count(_SYMBOL[data])
    ends = block.offsets
    return (
        {
            "n_words": block.per_doc(words),
            "word_chars": in_word[ends[1:]] - in_word[ends[:-1]],
            "n_symbols": symbols[ends[1:]] - symbols[ends[:-1]],
            "n_dup_lines": n_full - np.bincount(lines.doc[full][first], minlength=rows),
            "n_repeat_words": block.per_doc(words, np.cumsum(covers[:-1]) > 0),
            "n_lines": n_full,
            "n_bad_lines": block.per_doc(lines, bad),
            "lost_chars": np.bincount(lines.doc, weights=chars * bad, minlength=rows).astype(np.int64),
        },
        lines,
        bad,
    )


def _without(block: V.Block, lines: V.Spans, bad: np.ndarray) -> list[str]:
    raw, out = block.data.tobytes(), []
    cuts = np.searchsorted(lines.doc, np.arange(block.rows + 1))
    for d in range(block.rows):
        mine = range(cuts[d], cuts[d + 1])
        if bad[cuts[d] : cuts[d + 1]].any():
            out.append(b"\n".join(raw[lines.start[k] : lines.end[k]] for k in mine if not bad[k]).decode())
        else:
            out.append(raw[block.offsets[d] : block.offsets[d + 1]].decode())
    return out


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of docs: its id, COUNTS, base_failed, kept and, on request, the cleaned text."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in V.blocks(batch.column(1)):
                counts, lines, bad = judge(block)
                columns = [batch.column(0).slice(block.first, block.rows), *(pa.array(counts[c], pa.int64()) for c in COUNTS)]
                names = ["id", *COUNTS]
                if with_text:
                    columns.append(pa.array(_without(block, lines, bad), pa.string()))
                    names.append("cleaned")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"{c} bigint" for c in COUNTS) + (", cleaned string" if with_text else "")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, {schema}")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    lost = 100 * F.col("lost_chars") > LOST_SHARE * F.col("word_chars")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~lost).withColumnRenamed("id", id_col)
