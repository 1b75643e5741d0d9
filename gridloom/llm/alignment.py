"""Alignment of two tokenizers over a corpus.

Side A is a byte-level BPE vocabulary (a ``tokenizers`` file), side B a sentencepiece model
that adds a space.  A text with a space before it is cut by both.  Byte offsets at which
tokens of both sides end cut the tokens into groups; two tokens are linked if their bytes
overlap.  Between two neighbouring ends of tokens, of whichever side, lies exactly one token
of each side, so the links of a text are those intervals.

Counts.  How often a pair of ids is linked corpus-wide is counted in dense matrices, one for
each stripe of STRIPE ids of side B: tasks sum the pairs they have read and send them by
stripe, ``np.add.at`` adds them into the stripe's matrix, and the maximum of a row is the best
count of its id.  A stripe's matrix takes STRIPE x |A| x 8 bytes (103 MB for 50,257) whatever
the input.

Scores.  The links, kept by chunk of texts and stripe, are sent to where their stripe's counts
are, looked up there, and summed by text.  A stripe with many links is dealt out to several
tasks, each with a copy of its counts.  Sums come back as arrays, a row for each chunk and stripe.

Encoding.  Pre-tokens of A and, on side B, spaces with what follows them are encoded each
once for every time a worker meets them anew: no piece of B may hold a space behind another
character, which is checked, so nothing merges across.

Defined results: a text that is null or empty, or whose tokens' bytes of either side differ
from the text with its space (one with U+2581, say), has no tokens, zeros and an empty digest.
Rows count as often as they occur; texts are worked on whole, whatever their length; other
columns are passed by, whatever their names; an empty table gives an empty one.  Counts tie
often: every link whose count is the highest of its B id is a best one.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import textvec as V
from gridloom.llm.bpe import _CHARS, _strings, _taken
from gridloom.llm.common import drop, frugal, new_folder, stored
from gridloom.llm.pretoken import BYTE_LEVEL, pre_tokens

#: Ids of side B in a stripe; bytes of text in a chunk; parts of texts that a worker remembers; pairs a task gathers before it sends them.
STRIPE, TEXT, KNOWN, GATHERED = 256, 2 << 20, 200_000, 1 << 21
#: Bytes of a stripe's links that are worth a task of their own, and counts in a row.
SHARE, COUNTS = 64 << 20, 1 << 20

MARK = "▁"


class Side:
    """One tokenizer in a worker: parts of texts to ids, ids to bytes."""

    def __init__(self, cut: Callable[[V.Block], V.Spans], learn: Callable[[list[bytes]], list[list[int]]], tokens: list[bytes]) -> None:
        self.cut, self.learn, self.known = cut, learn, {}
        self.bytes = _strings(tokens)
        self.size = np.array([len(t) for t in tokens], np.int64)

    def encode(self, block: V.Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block's texts, and the text each is of."""
        spans = self.cut(block)
        which, some = V.codes(block.data, spans.start, spans.end)
        parts = some.to_pylist()
        new = [p for p in parts if p not in self.known]
        if new:
            self.known.update((p, array("i", ids).tobytes()) for p, ids in zip(new, self.learn(new), strict=True))
        raw, at = _taken(_strings([self.known[p] for p in parts]), which)
        if len(self.known) > KNOWN:
            self.known.clear()
        return raw.view(np.int32), np.repeat(spans.doc, np.diff(at) // 4)


def byte_level_side(file: str) -> Side:
    """Side A, from the content of a tokenizers file whose pre-tokens are those of byte-level BPE."""
    from tokenizers import Tokenizer

    cutter = json.loads(file)["pre_tokenizer"]
    if cutter["type"] != "ByteLevel" or not cutter.get("use_regex", True) or cutter["add_prefix_space"]:
        raise ValueError("not a byte-level vocabulary without a space of its own")
    tokenizer = Tokenizer.from_str(file)
    tokenizer.encode_special_tokens = True
    tokenizer.no_padding()
    tokenizer.no_truncation()
    back = {c: b for b, c in enumerate(_CHARS)}
    ids = tokenizer.get_vocab(with_added_tokens=False)
    tokens = [b""] * (1 + max(ids.values()))
    for token, k in ids.items():
        tokens[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()

    def learn(parts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch([p.decode() for p in parts], add_special_tokens=False)]

    return Side(lambda block: pre_tokens(block, BYTE_LEVEL), learn, tokens)


def _spaced(block: V.Block) -> V.Spans:
    """Spaces with what follows up to the next space: all of a text that starts with one."""
    space = block.data == 32
    opens = space.copy()
    opens[1:] &= ~space[:-1]
    opens[block.offsets[:-1][np.diff(block.offsets) > 0]] = True
    start = np.flatnonzero(opens)
    return V.Spans(start, np.append(start[1:], len(block.data)) if len(start) else start, block.doc_of(start))


def piece_side(model: bytes) -> Side:
    """Side B, from the content of a sentencepiece file that adds a space before a text and keeps all others."""
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_proto=model)
    n = own.vocab_size()
    pieces = [own.id_to_piece(k) for k in range(n)]
    if any(MARK in p.lstrip(MARK) for p in pieces) or own.encode("  a  b ", out_type=str) != own.encode("  a", out_type=str) + own.encode(" b", out_type=str) + [MARK]:
        raise ValueError("pieces of this model may cross a space")
    tokens = [bytes([int(p[3:5], 16)]) if own.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)]
    lone = [own.piece_to_id(MARK)]

    def learn(parts: list[bytes]) -> list[list[int]]:
        found = own.encode([p[1:].decode() for p in parts], num_threads=1)
        return [ids if len(p) > 1 else lone for p, ids in zip(parts, found, strict=True)]

    return Side(_spaced, learn, tokens)


_sides: dict[int, tuple[Side, Side]] = {}


def sides(file: str, model: bytes) -> tuple[Side, Side]:
    """This worker's pair of tokenizers; one is kept from task to task."""
    if (key := hash((file, model))) not in _sides:
        _sides.clear()
        _sides[key] = byte_level_side(file), piece_side(model)
    return _sides[key]


def with_space(block: V.Block) -> V.Block:
    """The same texts, each that isn't empty after a space."""
    full = np.diff(block.offsets) > 0
    data = np.insert(block.data, block.offsets[:-1][full], 32)
    return V.Block(block.first, block.last, data, block.offsets + V.prefix_count(full))


def _whole(side: Side, ids: np.ndarray, doc: np.ndarray, block: V.Block) -> np.ndarray:
    """Which texts their tokens' bytes make up again."""
    raw, at = _taken(side.bytes, ids)
    if len(raw) == len(block.data) and (raw == block.data).all():
        return np.ones(block.rows, bool)
    ends = at[np.searchsorted(doc, np.arange(block.rows + 1))]
    return np.array([np.array_equal(raw[ends[d] : ends[d + 1]], block.data[block.offsets[d] : block.offsets[d + 1]]) for d in range(block.rows)], bool)


class Aligned:
    """The tokens of a block's texts on both sides, and their links."""

    def __init__(self, a: Side, b: Side, block: V.Block) -> None:
        block = with_space(block)
        (self.a, doc_a), (self.b, doc_b) = a.encode(block), b.encode(block)
        good = _whole(a, self.a, doc_a, block) & _whole(b, self.b, doc_b, block)
        if not good.all():
            self.a, doc_a, self.b, doc_b = self.a[good[doc_a]], doc_a[good[doc_a]], self.b[good[doc_b]], doc_b[good[doc_b]]
        self.rows, self.doc_a, self.doc_b = block.rows, doc_a, doc_b
        self.end_a, self.end_b = np.cumsum(a.size[self.a]), np.cumsum(b.size[self.b])
        is_a, is_b = (np.zeros(int(self.end_a[-1]) + 1 if len(self.a) else 1, bool) for _ in range(2))
        is_a[self.end_a] = is_b[self.end_b] = True
        ends = np.flatnonzero(is_a | is_b)
        #: of each link the token of either side; of each token its group; where groups end
        self.link_a, self.link_b = (V.prefix_count(x)[ends] for x in (is_a, is_b))
        groups = V.prefix_count(is_a & is_b)
        self.group_a, self.group_b = groups[self.end_a], groups[self.end_b]
        self.both = np.flatnonzero(is_a & is_b)

    def digests(self, decimals: pa.LargeBinaryArray) -> list[str]:
        """SHA-256 of each text's groups; decimals has every id before a comma, then before a bar, then before a semicolon."""
        n = len(decimals) // 3
        last_a, last_b = (self.both[g] == e for g, e in ((self.group_a, self.end_a), (self.group_b, self.end_b)))
        order = np.argsort(np.concatenate([2 * self.group_a, 2 * self.group_b + 1]), kind="stable")
        raw, at = _taken(decimals, np.concatenate([self.a + n * last_a, self.b + 2 * n * last_b])[order])
        k = np.searchsorted(self.doc_a, np.arange(self.rows + 1)) + np.searchsorted(self.doc_b, np.arange(self.rows + 1))
        ends, raw = at[k].tolist(), memoryview(raw)
        return [hashlib.sha256(raw[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(ends[:-1], ends[1:], strict=True)]

    def counts(self) -> dict[str, np.ndarray]:
        per = lambda doc: np.bincount(doc, minlength=self.rows).astype(np.int64)
        closing = self.doc_a[np.searchsorted(self.end_a, self.both)]
        return {"n_a": per(self.doc_a), "n_b": per(self.doc_b), "n_groups": per(closing), "n_links": per(self.doc_a[self.link_a])}


def packed(values: np.ndarray) -> bytes:
    """Numbers from 0 on, in as few bytes each as the largest needs."""
    top = int(values.max()) if len(values) else 0
    return values.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _by_stripe(found: Aligned, width: int) -> list[tuple[int, int, bytes, bytes, bytes, bytes, bytes]]:
    """Of each stripe its number, the number of pairs, and of each pair A's id, B's id within the stripe, in how many texts it is, in which, and how often in each."""
    a, b, doc = found.a[found.link_a].astype(np.int64), found.b[found.link_b].astype(np.int64), found.doc_a[found.link_a]
    key, n = np.unique((b * width + a) * found.rows + doc, return_counts=True)
    if not len(key):
        return []
    pair, doc = key // found.rows, key % found.rows
    cut = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    pair, size = pair[cut], np.diff(np.append(cut, len(doc)))
    a, b = pair % width, pair // width
    out, bounds = [], np.flatnonzero(np.concatenate([[True], b[1:] // STRIPE != b[:-1] // STRIPE]))
    for lo, hi in zip(bounds, [*bounds[1:], len(b)], strict=True):
        at = slice(cut[lo], cut[hi] if hi < len(cut) else len(doc))
        out.append((int(b[lo]) // STRIPE, int(hi - lo), *map(packed, (a[lo:hi], b[lo:hi] % STRIPE, size[lo:hi], doc[at], n[at]))))
    return out


LINKS = ("pair_a", "pair_b", "size", "pos", "times")
MEASURES = ("n_a", "n_b", "n_groups", "n_links")


def _encoded(docs: DataFrame, files, id_col: str, text_col: str) -> DataFrame:
    """Rows of texts (stripe is null) and of links, by chunk."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("stripe", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("id", source.schema["id"].dataType)])
    for name in MEASURES:
        out = out.add(name, T.LongType())
    out = out.add("groups_sha256", T.StringType())
    for name in LINKS:
        out = out.add(name, T.BinaryType())

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(*files.value)
        n = max(len(a.size), len(b.size))
        decimals = _strings([b"%d%s" % (k, mark) for mark in (b",", b"|", b";") for k in range(n)])
        chunk = TaskContext.get().partitionId() << 33
        for batch in batches:
            for block in V.blocks(batch.column(1), TEXT):
                found = Aligned(a, b, block)
                stripes, counts, rows = _by_stripe(found, len(a.size)), found.counts(), block.rows
                empty = lambda kind, m: pa.nulls(m, kind)
                texts = [pa.array(np.full(rows, chunk)), empty(pa.int32(), rows), pa.array(np.arange(rows, dtype=np.int32)), batch.column(0).slice(block.first, rows)]
                texts += [*(pa.array(counts[c]) for c in MEASURES), pa.array(found.digests(decimals), pa.string()), *(empty(pa.binary(), rows) for _ in LINKS)]
                yield pa.RecordBatch.from_arrays(texts, names=out.fieldNames())
                if stripes:
                    columns = list(zip(*stripes, strict=True))
                    m = len(stripes)
                    links = [pa.array(np.full(m, chunk)), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), empty(batch.schema.field(0).type, m)]
                    links += [*(empty(pa.int64(), m) for _ in MEASURES), empty(pa.string(), m), *(pa.array(c, pa.binary()) for c in columns[2:])]
                    yield pa.RecordBatch.from_arrays(links, names=out.fieldNames())
                chunk += 1

    return source.mapInArrow(run, out)


def _sums(links: DataFrame, width: int) -> DataFrame:
    """(stripe, keys, sums): the pairs that a task has read and how often they are linked."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = {}, 0

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, which, np.concatenate([s for _, s in parts]))
            return keys, sums

        def sent() -> pa.RecordBatch:
            rows = [(stripe, *merged(parts)) for stripe, parts in held.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].astype("<i4").tobytes() for r in rows], pa.binary()), pa.array([r[2].tobytes() for r in rows], pa.binary())], names=["stripe", "keys", "sums"])

        for batch in batches:
            for row in batch.to_pylist():
                k = row["k"]
                size = unpacked(row["size"], k)
                times = unpacked(row["times"], int(size.sum()))
                part = unpacked(row["pair_b"], k) * width + unpacked(row["pair_a"], k), np.add.reduceat(times, np.cumsum(size) - size)
                held.setdefault(row["stripe"], []).append(part)
                many += k
            if many > GATHERED:
                held = {stripe: [merged(parts)] for stripe, parts in held.items()}
                many = sum(len(p[0][0]) for p in held.values())
                if many > GATHERED // 2:
                    yield sent()
                    held, many = {}, 0
        if held:
            yield sent()

    return links.select("stripe", "k", "pair_a", "pair_b", "size", "times").mapInArrow(run, "stripe int, keys binary, sums binary")


def _matrices(sums: DataFrame, width: int) -> DataFrame:
    """(stripe, keys, sums): the entries of each stripe's matrix that aren't 0."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, own = np.zeros(STRIPE * width, np.int64), None

        def sent() -> Iterator[pa.RecordBatch]:
            keys = np.flatnonzero(matrix)
            for lo in range(0, len(keys), COUNTS):
                part = keys[lo : lo + COUNTS]
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([part.astype("<i4").tobytes()], pa.binary()), pa.array([matrix[part].tobytes()], pa.binary())], names=["stripe", "keys", "sums"])
            matrix[keys] = 0

        for batch in batches:
            for stripe, keys, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is not None and stripe != own:
                    yield from sent()
                own = stripe
                np.add.at(matrix, np.frombuffer(keys, "<i4"), np.frombuffer(more, "<i8"))
        if own is not None:
            yield from sent()

    return sums.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(run, "stripe int, keys binary, sums binary")


def _scores(links: DataFrame, counts: DataFrame, shares: DataFrame, width: int) -> DataFrame:
    """(chunk, m, pos, n_best, count_sum): of each stripe's links in a chunk, the sums of the m texts that have any."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, best, own = np.zeros(STRIPE * width, np.int64), None, None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if row["stripe"] != own:
                    own = row["stripe"]
                    matrix[:] = 0
                if row["chunk"] is None:
                    matrix[np.frombuffer(row["keys"], "<i4")] = np.frombuffer(row["sums"], "<i8")
                    best = None
                    continue
                if best is None:
                    best = matrix.reshape(STRIPE, width).max(axis=1)
                k = row["k"]
                b, size = unpacked(row["pair_b"], k), unpacked(row["size"], k)
                n = int(size.sum())
                pos, times = unpacked(row["pos"], n), unpacked(row["times"], n)
                count = matrix[b * width + unpacked(row["pair_a"], k)]
                texts, which = np.unique(pos, return_inverse=True)
                n_best, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                np.add.at(n_best, which, times * np.repeat(count == best[b], size))
                np.add.at(total, which, times * np.repeat(count, size))
                made.append((row["chunk"], len(texts), packed(texts), packed(n_best), packed(total)))
            if made:
                columns = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=["chunk", "m", "pos", "n_best", "count_sum"])

    shares = F.broadcast(shares)  # a row for each stripe
    dealt = links.select("stripe", "chunk", "k", *LINKS).join(shares, "stripe").withColumn("share", F.pmod(F.xxhash64("chunk"), "shares").cast("int"))
    copied = counts.join(shares, "stripe").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    every = dealt.drop("shares").unionByName(copied.drop("shares"), allowMissingColumns=True)
    every = every.repartition("stripe", "share").sortWithinPartitions("stripe", "share", F.col("chunk").asc_nulls_first())
    return every.mapInArrow(run, "chunk long, m int, pos binary, n_best binary, count_sum binary")


def _gathered(texts: DataFrame, scores: DataFrame, id_col: str) -> DataFrame:
    """The rows of texts with their sums over all stripes."""
    columns = [id_col, *MEASURES, "n_best", "count_sum", "groups_sha256"]
    out = T.StructType([T.StructField(id_col, texts.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in columns[1:-1]), T.StructField("groups_sha256", T.StringType())])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 0), np.int64)
        own = None
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk, m = batch.column("chunk").to_numpy(), batch.column("m").to_numpy(zero_copy_only=False)
            raw = [batch.column(c) for c in ("pos", "n_best", "count_sum")]
            is_text = np.isnan(m) if m.dtype.kind == "f" else np.zeros(len(m), bool)
            cuts = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (is_text[1:] != is_text[:-1])]))
            for lo, hi in zip(cuts, [*cuts[1:], len(chunk)], strict=True):
                if chunk[lo] != own:
                    own, sums = chunk[lo], np.zeros((2, 0), np.int64)
                if not is_text[lo]:
                    for r in range(lo, hi):
                        pos, *both = (unpacked(c[r].as_py(), int(m[r])) for c in raw)
                        if pos[-1] >= sums.shape[1]:
                            sums = np.pad(sums, ((0, 0), (0, int(pos[-1]) + 1 - sums.shape[1])))
                        for s, v in zip(sums, both, strict=True):
                            s[pos] += v  # places are distinct within a row
                    continue
                rows = batch.slice(lo, hi - lo)
                k = rows.column("k").to_numpy()
                padded = np.pad(sums, ((0, 0), (0, max(0, int(k.max()) + 1 - sums.shape[1]))))
                yield pa.RecordBatch.from_arrays([rows.column("id"), *(rows.column(c) for c in MEASURES), pa.array(padded[0][k]), pa.array(padded[1][k]), rows.column("groups_sha256")], names=columns)

    every = texts.select("chunk", "k", "id", *MEASURES, "groups_sha256").unionByName(scores, allowMissingColumns=True)
    every = every.repartition("chunk").sortWithinPartitions("chunk", F.col("m").isNull(), "k")
    return every.mapInArrow(run, out)


def align(docs: DataFrame, file: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id, MEASURES, n_best, count_sum and groups_sha256; file and model are paths of side A's and side B's vocabulary on the driver."""
    spark = docs.sparkSession
    with open(file, encoding="utf-8") as a, open(model, "rb") as b:
        content = a.read(), b.read()
    width = len(byte_level_side(content[0]).size)
    files = spark.sparkContext.broadcast(content)  # as large as the vocabularies, whatever the input
    folders = [new_folder(spark, "aligned") for _ in range(3)]
    both = stored(_encoded(docs, files, id_col, text_col), "zstd", folders[0])
    texts, links = both.where("stripe is null"), both.where("stripe is not null")
    counts = stored(_matrices(_sums(links, width), width), "zstd", folders[1])
    size = sum(F.octet_length(c) for c in LINKS)
    shares = links.groupBy("stripe").agg(F.ceil(F.sum(size) / SHARE).cast("int").alias("shares"))
    scores = stored(_scores(links, counts, shares, width), "zstd", folders[2])
    drop(spark, folders[1])
    return _gathered(texts, scores, id_col)


def counted_pairs(docs: DataFrame, file: str, model: str, text_col: str = "text") -> DataFrame:
    """(stripe, keys, sums): the corpus's counts themselves, as arrays of B's id in its stripe times |A| plus A's id, and of longs."""
    with open(file, encoding="utf-8") as a, open(model, "rb") as b:
        content = a.read(), b.read()
    width = len(byte_level_side(content[0]).size)
    files = docs.sparkSession.sparkContext.broadcast(content)
    links = _encoded(docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), files, "id", "text").where("stripe is not null")
    return _matrices(_sums(links, width), width)
