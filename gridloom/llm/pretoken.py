"""Cutting texts into pre-tokens, over the bytes of a block at once.

``BYTE_LEVEL`` is the pattern of byte-level BPE vocabularies.  What it does is a rule over
runs of four classes of characters (white space, letters, numbers, others), so its cuts are
found with array operations; any other pattern is applied text by text.
"""

from __future__ import annotations

import sys

import numpy as np

from gridloom.llm import textvec as V

#: Fixed value: the pattern of public byte-level BPE vocabularies.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SPACE, LETTER, NUMBER, OTHER = 1, 2, 3, 4
_tables: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """The class of every code point."""
    if not _tables:
        import regex

        out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        low = "".join(map(chr, range(0xD800)))
        high = "".join(map(chr, range(0xE000, sys.maxunicode + 1)))
        for name, kind in ((r"\s+", SPACE), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
            for text, first in ((low, 0), (high, 0xE000)):
                for m in regex.finditer(name, text):
                    out[m.start() + first : m.end() + first] = kind
        _tables.append(out)
    return _tables[0]


def classes(data: np.ndarray) -> np.ndarray:
    """The class of the character each byte belongs to."""
    table = class_table()
    out = table[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & (0xFF >> (size + 1))
        for k in (1, 2, 3):
            more = size > k
            point[more] = point[more] << 6 | (data[lead[more] + k] & 0x3F)
        kind = table[point]
        out[lead] = kind
        for k in (1, 2, 3):
            more = size > k
            out[lead[more] + k] = kind[more]
    return out


def _rule_starts(block: V.Block) -> np.ndarray:
    data, offsets = block.data, block.offsets
    if not len(data):
        return np.zeros(0, np.int64)
    kind = classes(data)
    edge = np.ones(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(data))
    own = kind[start]
    opens = np.zeros(len(data) + 1, bool)
    opens[offsets] = True  # where a text starts or ends
    inner = ~opens[end]  # another run of the same text follows
    mark = np.zeros(len(data) + 1, bool)

    space = own == SPACE
    mark[start[~space]] = True
    # white space before something else leaves its last character: a blank joins what follows, another stands alone
    follows = np.flatnonzero(space & inner)
    mark[start[space & ~inner]] = True
    last = end[follows] - 1
    for _ in range(2):
        last -= (data[last] & 0xC0) == 0x80
    blank = data[last] == 32
    mark[start[follows][last > start[follows]]] = True
    mark[last] = True
    mark[end[follows][blank]] = False
    # an apostrophe of its own and certain letters after it
    lone = np.flatnonzero((own == OTHER) & inner & (end - start == 1))
    lone = lone[(data[start[lone]] == 39) & mark[start[lone]]]
    lone = lone[own[np.minimum(lone + 1, len(own) - 1)] == LETTER]
    if len(lone):
        at, stop = end[lone], end[lone + 1]
        one, two = data[at], np.where(at + 1 < stop, data[np.minimum(at + 1, len(data) - 1)], 0)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        size = short * 1 + long * 2
        hit = size > 0
        mark[at[hit]] = False
        to = (at + size)[hit]
        mark[to[to < stop[hit]]] = True
    return np.flatnonzero(mark[:-1])


def _other_spans(block: V.Block, pattern: str) -> V.Spans:
    import regex

    find, raw, start, end, doc = regex.compile(pattern).finditer, block.data.tobytes(), [], [], []
    for d in range(block.rows):
        at, text = int(block.offsets[d]), raw[block.offsets[d] : block.offsets[d + 1]].decode()
        done = 0
        for m in find(text):
            at += len(text[done : m.start()].encode())
            start.append(at)
            at += len(m.group().encode())
            done = m.end()
            end.append(at)
            doc.append(d)
    return V.Spans(*(np.array(x, np.int64) for x in (start, end, doc)))


def pre_tokens(block: V.Block, pattern: str) -> V.Spans:
    """The pre-tokens of a block's texts, in order."""
    if pattern != BYTE_LEVEL:
        return _other_spans(block, pattern)
    start = _rule_starts(block)
    doc = block.doc_of(start)
    end = np.append(start[1:], len(block.data)) if len(start) else start
    return V.Spans(start, end, doc)
