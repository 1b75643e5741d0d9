"""Runs against every stretch of every text, and the rules for odd rows."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import runs as R
from gridloom.llm import textvec as V


def by_stretch(words):
    """(start, length, period) of every run, by trying all periods at all places."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(12, 2 * q):
                found.setdefault((i, size), q)  # periods rise, the smallest comes first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def report(doc_id, text, plant=False):
    words = [] if text is None else [w for w in text.replace("\n", " ").replace("\t", " ").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = by_stretch(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, milli, n, n - len(gone), sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def block_of(texts):
    return next(V.blocks(pa.array(texts), 1 << 30))


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_words_of_few_kinds(seed):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(40):
        parts = []
        while sum(map(len, parts)) < rng.integers(1, 150):
            unit = [f"w{k}" for k in rng.integers(0, rng.integers(2, 9), rng.integers(1, 15))]
            parts.append((unit * int(rng.integers(1, 6)))[: rng.integers(1, 60)])
        texts.append(" ".join(w for p in parts for w in p))
    block = block_of(texts)
    words = block.words()
    codes = V.codes(block.data, words.start, words.end)[0].astype(np.int64)
    start, end, period = R.block_runs(words, codes)
    cut = np.searchsorted(words.doc, np.arange(block.rows + 1))
    got = [[] for _ in texts]
    for s, e, p in zip(start, end, period, strict=True):
        d = words.doc[s]
        got[d].append((int(s - cut[d]), int(e - s), int(p)))
    expected = [by_stretch(t.split()) for t in texts]
    assert got == expected and sum(map(len, expected)) > 20


def test_masking_keeps_every_word_of_a_run():
    texts = ["a b c d e f g h " * 2 + "x y z", "q " * 12, "one two three four five six seven " * 3, "no run here at all " + "k l m n o p " * 2]
    block = block_of(texts)
    words = block.words()
    codes = V.codes(block.data, words.start, words.end)[0].astype(np.int64)
    start, end = R.unmasked(words, codes, 6)
    masked = {i for s, e in zip(start, end, strict=True) for i in range(s, e)}
    for s, e, _ in zip(*R.block_runs(words, codes), strict=True):
        assert set(range(s, e)) <= masked
    assert len(masked) < len(words)


def test_long_texts_of_one_word_and_of_long_periods():
    rng = np.random.default_rng(1)
    unit = [f"u{k}" for k in rng.integers(0, 10**6, 30_000)]
    block = block_of(["same " * 100_000, " ".join(unit + unit + unit[:7])])
    words = block.words()
    codes = V.codes(block.data, words.start, words.end)[0].astype(np.int64)
    start, end, period = R.block_runs(words, codes)
    assert list(zip(start.tolist(), end.tolist(), period.tolist(), strict=True)) == [(0, 100_000, 1), (100_000, 160_007, 30_000)]


def test_rows_and_planting(spark):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"t{j}" for j in rng.integers(0, 500, rng.integers(1, 300))), "n", 1) for k in range(120)]
    rows += [(None, "a b " * 20, "x", 2), (500, None, None, None), (501, "", "", 3), (502, " \n\t ", "", 3), (3, rows[3][1], "again", 4), (503, "é  ü\té ü\n" * 9, "utf", 5), (504, "x" * 300_000 + " y", "long", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, n_runs int")
    for rewrite, plant in ((R.planted, True), (None, False)):
        got = sorted((tuple(r) for r in R.periodic_runs(docs, rewrite=rewrite).collect()), key=str)
        assert got == sorted((report(r[0], r[1], plant) for r in rows), key=str)
    assert sum(r[1] for r in map(lambda r: report(r[0], r[1], True), rows)) > 8


def test_empty_table(spark):
    assert R.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
