"""Near-duplicates by BagMinHash over multisets of 5-word shingles.

Signatures.  A shingle that occurs w times has weight w, in unit steps.  Its weight axis
is cut into dyadic levels [0, 1), [1, 2), [2, 4), [4, 8), ...; each level has a Poisson
process of points in time whose rate is the level's width times the number of registers.
A point belongs to one register and to one unit step of its level, drawn from a hash, and
counts only if that step lies below w.  A register keeps its earliest point.  Two texts
agree in a register with a probability equal to their weighted Jaccard similarity.
Points come in order of time, so a text needs only those up to the time at which all its
registers are filled: about REGISTERS * log REGISTERS whatever its length.

Search.  Texts with equal multisets are one node.  Signatures are cut into BANDS bands of
ROWS registers; nodes that agree in a band share a bucket (at similarity 0.8 a pair
shares none with probability 3e-6).  Candidates are verified by the exact multiset
overlap of their shingles, min over max of counts, from their whole texts.

Classes are the connected components of the verified links.  A node is first compared with
the least node it shares a bucket with, so a group of n copies costs n comparisons;
buckets whose nodes are all in one component are then done.  Of the others, those of up to
LARGE nodes have their pairs across components verified one by one.  The nodes of larger
ones are held against HEADS more leaders, LEADERS times, by their parities (bits that bound
an overlap), and verified against the nearest; what is left is searched by prefixes: of
two similar texts each holds one of the other's shingles among its own rarest fifth, so
only pairs that share a rare shingle are verified.  So every link between candidates either
is verified, or joins nodes that are already in one class.  Results don't depend on LARGE,
LEADERS and CELL, only the way to them.

Defined results: a null text is a class of its own; texts without a word are copies of one
another; a text of one to four words has one shingle, all its words, so only equal ones are
similar.  Repeated rows are copies.  A class is named by its smallest id.  An empty table
gives an empty one, and other columns are passed by, whatever their names.  Multisets are
told apart by two digests, 128 bits; only nodes whose 128 bits are equal are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import textvec as V
from gridloom.llm.common import PER_TASK, frugal, narrow, settle
from gridloom.llm.components import join_unique, stars

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Nodes of a bucket beyond which its pairs aren't enumerated; how often and against how many leaders a bucket
#: its nodes are then held; and how many nodes that share a rare shingle are joined at once.
LARGE, LEADERS, HEADS, CELL = 32, 3, 8, 512
#: Counters of how often shingles occur and in which classes (24 MB, whatever the input), and those that are sent in one row.
COUNTERS, PART = 1 << 20, 1 << 12
#: Texts that are worth a task of their own.
TEXTS = 1 << 12
#: Bits of a text that bound an overlap.
PARITIES = 1024
#: Bits of the filter that keeps texts without candidates out of the shuffle (2 MB, whatever the input).
SIEVE = 1 << 24

_ONE = np.uint64(1)


def shingles(block: V.Block, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted by document and hash: document, hash, count."""
    words = block.words()
    hashes = V.span_hashes(block.data, words.start, words.end)
    at, keys = V.windows(words, hashes, k)
    doc = words.doc[at]
    n = block.per_doc(words)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        first = np.searchsorted(words.doc, short)
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            more = n[short] > j
            whole[more] = V.mix(whole[more] * np.uint64(3) + hashes[first[more] + j] + np.uint64(j))
        doc, keys = np.concatenate([doc, short]), np.concatenate([keys, whole])
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    return doc[start], keys[start], np.diff(np.append(start, len(keys)))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def signatures(doc: np.ndarray, keys: np.ndarray, counts: np.ndarray, rows: int, registers: int = REGISTERS) -> np.ndarray:
    """Times of the earliest points, rows x registers; inf where a document has no shingle."""
    out = np.full(rows * registers, np.inf)
    total = np.bincount(doc, weights=counts, minlength=rows)
    open_ = total > 0
    until = np.zeros(rows)
    until[open_] = (np.log(registers) + 3) / total[open_]
    while open_.any():
        own = open_[doc]
        d, h, c = doc[own], keys[own], counts[own]
        level = 0
        while len(d):
            low = 0 if level == 0 else 1 << (level - 1)
            width = max(1, low)
            state = V.mix(h + np.uint64(level * 0xD1B54A32D192ED03 % (1 << 64)))
            time, who = np.zeros(len(d)), np.arange(len(d))
            limit = until[d]
            while len(who):
                state = V.mix(state + _ONE)
                time = time - np.log(_uniform(state)) / (registers * width)
                alive = time <= limit[who]
                state, time, who = state[alive], time[alive], who[alive]
                place = V.mix(state ^ np.uint64(0xA0761D6478BD642F))
                hit = np.ones(len(who), bool) if width == 1 else low + (place >> np.uint64(32)).astype(np.int64) % width < c[who]
                np.minimum.at(out, d[who[hit]] * registers + ((place[hit] & np.uint64(0xFFFFFFFF)) % np.uint64(registers)).astype(np.int64), time[hit])
            level += 1
            more = c > (1 << (level - 1))
            d, h, c = d[more], h[more], c[more]
        open_ &= ~np.isfinite(out.reshape(rows, registers)).all(axis=1)
        until[open_] *= 2
    return out.reshape(rows, registers)


def bands(signature: np.ndarray) -> np.ndarray:
    """One hash for each band of each row."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bits.shape[:2]).copy()
    for k in range(ROWS):
        h = V.mix(h * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, k])
    return h


def digests(doc: np.ndarray, keys: np.ndarray, counts: np.ndarray, rows: int) -> tuple[pa.Array, pa.Array]:
    """Two independent digests of each document's multiset of shingles, 128 bits together."""
    out = []
    for seed in (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3):
        each = V.mix(V.mix(keys ^ np.uint64(seed)) + counts.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        sums = np.zeros(rows, np.uint64)
        np.add.at(sums, doc, each)
        out.append(pa.array(V.mix(sums).view(np.int64)))
    return out[0], out[1]


def _sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in V.blocks(batch.column(1)):
                parts = shingles(block)
                some = np.zeros(block.rows, bool)
                some[parts[0]] = True
                h = bands(signatures(*parts, block.rows)).view(np.int64)
                cut = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.rows), *digests(*parts, block.rows),
                        pa.array(np.bincount(parts[0], weights=parts[2], minlength=block.rows).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut), pa.array(h[some].ravel())),
                    ],
                    names=["id", "node", "check", "n", "bands"],
                )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return source.mapInArrow(run, T.StructType([source.schema["id"], T.StructField("node", T.LongType()), T.StructField("check", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]))


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets, each as sorted hashes and counts."""
    (ka, ca), (kb, cb) = a, b
    at = np.searchsorted(kb, ka)
    at[at == len(kb)] = 0
    same = kb[at] == ka if len(kb) else np.zeros(len(ka), bool)
    both = np.minimum(ca[same], cb[at[same]]).sum()
    return both / max(1, ca.sum() + cb.sum() - both)


def _multisets(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for block in V.blocks(texts):
        doc, keys, counts = shingles(block)
        cut = np.searchsorted(doc, np.arange(block.rows + 1))
        out += [(keys[cut[k] : cut[k + 1]], counts[cut[k] : cut[k + 1]]) for k in range(block.rows)]
    return out


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are similar.  b may be a leader of very many; its partition is split by AQE."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column(1).to_numpy()
            names, first, which = np.unique(b, return_index=True, return_inverse=True)
            leaders = _multisets(batch.column(3).take(pa.array(first)))
            own = _multisets(batch.column(2))
            good = np.array([overlap(own[k], leaders[which[k]]) >= SIMILAR for k in range(len(b))], dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _contested(member: DataFrame, found: DataFrame) -> DataFrame:
    """Memberships of the buckets whose nodes aren't all in one class: bucket, node, class, n (the bucket's nodes)."""
    known, n = found.select(F.col("a").alias("node"), F.col("b").alias("class")), member.count()
    named = settle(narrow(member.select("bucket", "node").join(known, "node", "left").select("bucket", "node", F.coalesce("class", "node").alias("class")), n))
    mixed = named.groupBy("bucket").agg(F.min("class").alias("c1"), F.max("class").alias("c2"), F.count("*").alias("n")).where("c1 <> c2").select("bucket", "n")
    return narrow(settle(narrow(join_unique(named, mixed, "bucket").select("bucket", "node", "class", "n"), n)))


def _led(hot: DataFrame, bits: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): each node of large buckets with the leader, of another class, that it differs from the least and may be similar to.

    A bucket's classes are dealt to HEADS slots, and a leader is drawn from each, anew each turn.
    """
    slot = F.pmod(F.xxhash64(F.lit(turn), "class"), F.lit(HEADS))
    heads = hot.groupBy("bucket", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), "node", "class")).alias("x")).select("bucket", F.col("x.node").alias("head"), F.col("x.class").alias("class"))
    heads = heads.join(bits.withColumnRenamed("node", "head"), "head").groupBy("bucket").agg(F.collect_list(F.struct("head", "class", "size", "bits")).alias("heads"))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = PARITIES // 64
        for batch in batches:
            node, class_, size = (batch.column(k).to_numpy() for k in range(3))
            own = batch.column(3).flatten().to_numpy().reshape(-1, words)
            who = np.repeat(np.arange(len(node)), batch.column(4).value_lengths().to_numpy())
            head, its_class, its_size, its_bits = (batch.column(4).flatten().field(k) for k in range(4))
            differ = differing(own[who], its_bits.flatten().to_numpy().reshape(-1, words))
            fine = np.flatnonzero((class_[who] != its_class.to_numpy()) & (9 * differ <= size[who] + its_size.to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(node[who[fine]]), head.take(pa.array(fine)), pa.array(differ[fine])], names=["a", "b", "differ"])

    rows = join_unique(narrow(settle(join_unique(hot.select("bucket", "node", "class"), bits, "node")), each=PER_TASK // 8), heads, "bucket")
    near = rows.select("node", "class", "size", "bits", "heads").mapInArrow(run, "a bigint, b bigint, differ bigint")
    return near.groupBy("a").agg(F.min_by("b", F.struct("differ", "b")).alias("b"))


def _elements(block: V.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's shingles, the k-th occurrence of one as an element of its own: document, hash; and the number of each text."""
    doc, keys, counts = shingles(block)
    nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    doc, keys = np.repeat(doc, counts), np.repeat(keys, counts)
    return doc, V.mix(keys ^ V.mix(nth.astype(np.uint64))), np.bincount(doc, minlength=block.rows)


class Counters:
    """COUNTERS cells of elements' hashes: how often elements fall there, and the least and greatest class of the texts they are of."""

    FIELDS = ("n", "low", "high")

    def __init__(self) -> None:
        top = np.iinfo(np.int64)
        self.n, self.low, self.high = np.zeros(COUNTERS, np.int64), np.full(COUNTERS, top.max), np.full(COUNTERS, top.min)

    def add(self, keys: np.ndarray, classes: np.ndarray) -> None:
        cell = (keys % np.uint64(COUNTERS)).astype(np.int64)
        self.n += np.bincount(cell, minlength=COUNTERS)
        np.minimum.at(self.low, cell, classes)
        np.maximum.at(self.high, cell, classes)

    def merge(self, part: int, parts: tuple[bytes, ...]) -> None:
        """Take in a part of other counters."""
        at = slice(part * PART, (part + 1) * PART)
        n, low, high = (np.frombuffer(p, np.int64) for p in parts)
        self.n[at] += n
        self.low[at] = np.minimum(self.low[at], low)
        self.high[at] = np.maximum(self.high[at], high)

    def batch(self) -> pa.RecordBatch:
        """A row for each part in which something was counted."""
        some = [k for k in range(COUNTERS // PART) if self.n[k * PART : (k + 1) * PART].any()]
        columns = ([getattr(self, f)[k * PART : (k + 1) * PART].tobytes() for k in some] for f in self.FIELDS)
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["part", *self.FIELDS])


def _counted(texts: DataFrame, often=None) -> Counters:
    """The counters of the elements of texts (class, text), a table of fixed size that tasks send in parts of PART cells.

    With the counts of all elements (broadcast), of each text only its prefix.
    """
    kind = "part int, n binary, low binary, high binary"

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counters()
        for batch in batches:
            for block in V.blocks(batch.column(1)):
                doc, keys, size = _elements(block)
                if often is not None:
                    first = _prefix(doc, keys, size, often.value)
                    doc, keys = doc[first], keys[first]
                own.add(keys, batch.column(0).slice(block.first, block.rows).to_numpy()[doc])
        yield own.batch()

    @frugal
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counters()
        for batch in batches:
            for part, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own.merge(part, tuple(parts))
        yield own.batch()

    out = Counters()
    for r in texts.select("class", "text").mapInArrow(run, kind).repartition("part").mapInArrow(merged, kind).toLocalIterator():
        out.merge(r["part"], (r["n"], r["low"], r["high"]))
    return out


def _prefix(doc: np.ndarray, keys: np.ndarray, size: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Places of each text's rarest elements: as many as must hold one that it shares with any similar text."""
    order = np.lexsort((keys, often[(keys % np.uint64(COUNTERS)).astype(np.int64)], doc))
    place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    return order[place < (size - np.ceil(SIMILAR * size - 1e-9).astype(np.int64) + 1)[doc]]


def parities(doc: np.ndarray, keys: np.ndarray, rows: int) -> np.ndarray:
    """For each text PARITIES bits, each saying whether the number of its elements that fall there is odd; as 64-bit integers.

    Two texts differ in at least as many elements as bits.
    """
    at = doc * PARITIES + (keys >> np.uint64(40)).astype(np.int64) % PARITIES
    odd = (np.bincount(at, minlength=rows * PARITIES) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(rows, PARITIES // 64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits differ in each row; unsigned, as signed numbers are counted by their absolute values."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=1, dtype=np.int64)


def _parities(texts: DataFrame) -> DataFrame:
    """node, its number of elements and its parities."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in V.blocks(batch.column(1)):
                doc, keys, size = _elements(block)
                bits = parities(doc, keys, block.rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(block.rows + 1, dtype=np.int32) * bits.shape[1]), pa.array(bits.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.array(size), lists], names=["node", "size", "bits"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, size bigint, bits array<bigint>")


def _rare(texts: DataFrame) -> DataFrame:
    """node, class, size, bits (its parities) and, a row each, the elements of each text's prefix.

    Elements that texts of one class only have in their prefixes can't link classes and are
    left out, but for some whose counter others fall into.
    """
    spark = texts.sparkSession.sparkContext
    often = spark.broadcast(_counted(texts).n)  # COUNTERS numbers
    found = _counted(texts, often)
    mixed = spark.broadcast(found.low < found.high)  # and marks

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in V.blocks(batch.column(2)):
                doc, keys, size = _elements(block)
                own = _prefix(doc, keys, size, often.value)
                own = own[mixed.value[(keys[own] % np.uint64(COUNTERS)).astype(np.int64)]]
                bits = parities(doc, keys, block.rows)[doc[own]]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * bits.shape[1]), pa.array(bits.ravel()))
                part = batch.select([0, 1]).slice(block.first, block.rows).take(pa.array(doc[own]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(size[doc[own]]), lists, pa.array(keys[own].view(np.int64))], names=["node", "class", "size", "bits", "element"])

    return texts.select("node", "class", "text").mapInArrow(run, "node bigint, class bigint, size bigint, bits array<bigint>, element bigint")


def _rare_pairs(hot: DataFrame, own: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of large buckets, of different classes, that can be similar.

    Two similar texts share one of the rarest elements of each (whatever order says what is
    rare, as long as it is the same for all).  Nodes that share one are a group; groups of
    more than CELL nodes are dealt to cells, and every two cells are joined apart.  Of the
    pairs only those stay whose sizes and parities allow the similarity: h bits that differ
    leave an overlap of at most (size a + size b - h) / 2.
    """
    own = narrow(settle(own.join(hot.select("node", "class").distinct(), "node")), each=TEXTS)
    rows = narrow(settle(_rare(own)), each=PER_TASK // 8)
    mixed = rows.groupBy("element").agg(F.count("*").alias("n"), F.min("class").alias("c1"), F.max("class").alias("c2")).where("c1 <> c2").select("element", F.ceil(F.col("n") / CELL).cast("int").alias("k"))
    dealt = join_unique(rows, mixed, "element").withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("lo", F.least("i", "j")).withColumn("hi", F.greatest("i", "j"))
    return dealt.select("element", "lo", "hi", "i", "node", "class", "size", "bits").groupBy("element", "lo", "hi").applyInArrow(_near_pairs, "a bigint, b bigint").distinct()


def _near_pairs(table: pa.Table) -> pa.Table:
    """Pairs (a, b) of one group, a > b: those across two cells, or all of one, that may be similar by size and parities."""
    table = table.combine_chunks()
    i, node, class_, size = (table.column(c).to_numpy() for c in ("i", "node", "class", "size"))
    bits = table.column("bits").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    one, two = np.flatnonzero(i == lo), np.flatnonzero(i == hi)
    out = [np.zeros((0, 2), np.int64)]
    for k in range(0, len(one), 64):
        rows = one[k : k + 64]
        both = size[rows, None] + size[two]
        fine = (class_[rows, None] != class_[two]) & (np.minimum(size[rows, None], size[two]) >= SIMILAR * np.maximum(size[rows, None], size[two]) - 1e-9)
        if lo == hi:
            fine &= node[rows, None] > node[two]
        x, y = np.nonzero(fine)
        near = 9 * differing(bits[rows[x]], bits[two[y]]) <= both[x, y]  # as an overlap of 0.8 takes 4 / 9 of both sizes
        pair = np.column_stack([node[rows[x[near]]], node[two[y[near]]]])
        out.append(np.sort(pair, axis=1)[:, ::-1])
    found = np.concatenate(out)
    return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (id, node) of all texts that aren't null, and stars (a, b) that give each linked node's class."""
    rows = _told_apart(settle(_sketch(docs, id_col, text_col)))
    nodes = rows.groupBy("node").agg(F.min("id").alias("id"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("digest").alias("digest"), F.any_value("check").alias("check"))
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1")
    member = narrow(settle(buckets.join(shared, "bucket").select("bucket", "node", "leader")))
    chosen = narrow(settle(nodes.join(member.select("node").distinct(), "node", "left_semi").select("node", "id", "n", "digest", "check")))
    texts = narrow(settle(_texts(docs, chosen, id_col, text_col)), each=TEXTS)

    # each node with the least leader of its buckets
    pairs = member.where("node <> leader").groupBy(F.col("node").alias("a")).agg(F.min("leader").alias("b"))
    found = stars(_verified(pairs, texts))
    left = _contested(member, found)
    # large buckets that are left: other leaders, then pairs that share a rare shingle
    own = bits = None
    for turn in range(LEADERS + 1):
        hot = left.where(F.col("n") > LARGE)
        if not hot.take(1):
            break
        if own is None:
            own = narrow(settle(texts.join(hot.select("node").distinct(), "node", "left_semi")), each=TEXTS)
            bits = settle(_parities(own))
        pairs = _led(hot, bits, turn) if turn < LEADERS else _rare_pairs(hot, own)
        found = stars(found.union(_verified(pairs, own)))
        left = _contested(left, found)
    # small ones pair by pair
    small = left.where(F.col("n") <= LARGE).join(chosen.select("node", F.col("n").alias("size")), "node")
    own = small.select("bucket", F.col("node").alias("a"), F.col("class").alias("ca"), F.col("size").alias("sa"))
    other = small.select("bucket", F.col("node").alias("b"), F.col("class").alias("cb"), F.col("size").alias("sb"))
    near = own.join(other, "bucket").where((F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & (F.least("sa", "sb") >= SIMILAR * F.greatest("sa", "sb")))
    found = stars(found.union(_verified(near.select("a", "b").distinct(), texts)))
    return rows.select("id", "node", "digest", "check"), found


def _told_apart(rows: DataFrame) -> DataFrame:
    """rows with their digest kept as such, and a node of its own for each pair (digest, check) even where digests are equal."""
    rows = rows.withColumn("digest", F.col("node"))
    while True:
        both = rows.groupBy("node").agg(F.min("check").alias("c1"), F.max("check").alias("c2")).where("c1 <> c2").select("node")
        twice = [r[0] for r in both.toLocalIterator()]  # about one in 2 ** 64 of the pairs of different texts
        if not twice:
            return rows
        rows = settle(rows.withColumn("node", F.when(F.col("node").isin(twice), F.xxhash64("node", "check")).otherwise(F.col("node"))))


def _sieve(ids: DataFrame) -> np.ndarray:
    """SIEVE bits, those of the ids' hashes set: a filter of fixed size that may let others pass."""
    at = F.pmod(F.xxhash64(F.lit(41), "id"), F.lit(SIEVE))
    parts = ids.groupBy((at / F.lit(1 << 15)).cast("int").alias("part")).agg(F.bitmap_construct_agg(at % (1 << 15)).alias("bits")).collect()
    out = np.zeros(SIEVE // 8, np.uint8)
    for r in parts:
        out[r["part"] << 12 : (r["part"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


def _texts(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A text of each node in chosen (node, id, digest, check).  Only rows that pass the sieve, or have no id, are shuffled."""
    bits = docs.sparkSession.sparkContext.broadcast(_sieve(chosen))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array(bits.value[at >> 3] >> (at & 7) & 1 == 1))
            for block in V.blocks(batch.column(1)):
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *digests(*shingles(block), block.rows)], names=["id", "text", "digest", "check"])

    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    text = text.withColumn("at", F.pmod(F.xxhash64(F.lit(41), "id"), F.lit(SIEVE)))
    text = text.mapInArrow(run, T.StructType([*text.schema.fields[:2], *(T.StructField(c, T.LongType()) for c in ("digest", "check"))]))
    match = [text["digest"] == chosen["digest"], text["check"] == chosen["check"], text["id"].eqNullSafe(chosen["id"])]
    return text.join(chosen, match).groupBy("node").agg(F.min("text").alias("text"))


def _with_node(rows: DataFrame, text_col: str) -> DataFrame:
    """row (a whole row with its text in the field text_col), its id, and the digests of its shingles."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in V.blocks(V.text_of(batch.column(0), text_col)):
                columns = [c.slice(block.first, block.rows) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, *digests(*shingles(block), block.rows)], names=["row", "id", "digest", "check"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in ("digest", "check"))]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, the class (its smallest id), and whether it is that one."""
    rows, found = links(docs, id_col, text_col)
    named = rows.join(found.withColumnRenamed("a", "node"), "node", "left").select("id", F.coalesce("b", "node").alias("class"))
    least = named.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    out = named.join(least, "class").select("id", "class_id", "class_size")
    alone = docs.where(F.col(text_col).isNull()).select(F.col(id_col).alias("id"), F.col(id_col).alias("class_id"), F.lit(1).cast("bigint").alias("class_size"))
    return out.union(alone).withColumnRenamed("id", id_col).withColumn("representative", F.col(id_col).eqNullSafe(F.col("class_id")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class, the one with the smallest id, and all rows without a text.

    A null id comes last; of rows that are repeated with their id one stays; columns of any name are kept.
    """
    rows, found = links(docs, id_col, text_col)
    named = rows.join(found.withColumnRenamed("a", "node"), "node", "left").select("id", "digest", "check", F.coalesce("b", "node").alias("class"))
    counted = named.groupBy("class", "id", "digest", "check").count()
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "digest", "check", "count")).alias("k")
    kept = settle(counted.groupBy("class").agg(first).select("k.id", "k.digest", "k.check", "k.count"))
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).isNull().alias("empty"))
    there = _with_node(whole.where("not empty").select("row", "id"), text_col)
    match = [there["id"].eqNullSafe(kept["id"]), there["digest"] == kept["digest"], there["check"] == kept["check"]]
    out = there.join(kept.where("count = 1"), match, "left_semi").select("row")
    if kept.where("count > 1").limit(1).count():  # rows that are repeated with their id: one of them stays
        more = there.join(kept.where("count > 1"), match, "left_semi").groupBy("id", "digest", "check").agg(F.min("row").alias("row"))
        out = out.union(more.select("row"))
    return out.union(whole.where("empty").select("row")).select("row.*")
