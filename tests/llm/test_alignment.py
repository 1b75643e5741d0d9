"""Alignment of two tokenizers against the libraries on whole texts and plain loops."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from gridloom.llm import alignment as A

FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def by_loops(rows):
    """The operator's rows, from the libraries on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer
    left, right = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    left.encode_special_tokens = True
    names = {k: t for t, k in left.get_vocab().items()}
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    made, counts = [], Counter()
    for _, text in rows:
        a = b = []
        if text:
            a = [(k, bytes(back[c] for c in names[k])) for k in left.encode(" " + text, add_special_tokens=False).ids]
            b = [(k, bytes([int(right.id_to_piece(k)[3:5], 16)]) if right.is_byte(k) else right.id_to_piece(k).replace("▁", " ").encode()) for k in right.encode(text)]
            if b"".join(t for _, t in a) != (" " + text).encode() or b"".join(t for _, t in b) != (" " + text).encode():
                a = b = []
        spans = []
        for side in (a, b):
            ends = np.cumsum([len(t) for _, t in side], dtype=int).tolist()
            spans.append([(k, e - len(t), e) for (k, t), e in zip(side, ends, strict=True)])
        links, groups, j = [], [], 0
        for k, s, e in spans[0]:
            while j < len(spans[1]) and spans[1][j][2] <= s:
                j += 1
            i = j
            while i < len(spans[1]) and spans[1][i][1] < e:
                links.append((k, spans[1][i][0]))
                i += 1
        counts.update(links)
        common = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        for lo, hi in zip([0, *common], common, strict=False):
            groups.append("|".join(",".join(str(k) for k, s, e in side if lo <= s and e <= hi) for side in spans))
        made.append((len(a), len(b), len(groups), links, ";".join(groups)))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (i, na, nb, g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(s.encode()).hexdigest() if na else "")
        for (i, _), (na, nb, g, links, s) in zip(rows, made, strict=True)
    ]


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "a \nb", "a\n\n  b\t", "it's we'll 'twas o'clock", "<|endoftext|> <s> </s> <unk> <0x41>", "café naïve 中文 \U0001f600 x", "with ▁ mark", "▁",
    " no break 　wide", "12345 67 890,1", "--- *** ###", "x" * 5000, "the " * 300, "a\u0000b", "﻿bom", "tab\tthe end .  ", "résumé",
]


def run(spark, rows, schema="doc_id long, text string"):
    got = A.align(spark.createDataFrame(rows, schema), *FILES)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_odd_texts_and_repeated_rows(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, ODD[12]), (None, ODD[8]), (None, ODD[8])]
    assert run(spark, rows) == sorted(by_loops(rows), key=str)


def test_given_documents(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.limit(120).collect()]
    expected = sorted(by_loops(rows), key=str)
    assert sum(r[5] for r in expected) > 1000
    monkeypatch.setattr(A, "SHARE", 4096)  # most stripes go to several tasks
    assert run(spark, rows) == expected


def test_matrices_hold_every_pair(spark):
    rows = [(1, "the cat sat on the mat"), (2, "the theory of the cat")]
    kept = A.counted_pairs(spark.createDataFrame(rows, "doc_id long, text string"), *FILES).collect()
    total = sum(int(np.frombuffer(r["sums"], "<i8").sum()) for r in kept)
    assert total == sum(r[4] for r in by_loops(rows)) and len({r["stripe"] for r in kept}) == len(kept)


def test_columns_of_clashing_names_and_no_rows(spark):
    rows = [(1, "the cat", 5, "x"), (2, None, 6, "y")]
    got = run(spark, rows, "doc_id long, text string, n_a int, chunk string")
    assert [r[0] for r in got] == [1, 2] and got == sorted(by_loops([r[:2] for r in rows]), key=str)
    assert run(spark, []) == []


@pytest.mark.parametrize("n", [0, 1, 255, 256, 70_000, 1 << 33])
def test_packed_numbers(n):
    x = np.array([0, n], np.int64)
    assert A.unpacked(A.packed(x), 2).tolist() == [0, n]


def test_other_vocabularies_are_refused():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises((ValueError, KeyError)):
        A.byte_level_side(f.read())
