"""Mixing overlapping sources to target weights by min-cost flow.

1. Rows are summed by membership pattern, the set of sources a document belongs to.
2. Every source gets a target: its share, by weight, of all words, at most ``max_repeat``
   times its own words; what exceeds that is shared again by weight.
3. A min-cost flow routes words from patterns to the sources' quotas.  A pattern offers
   its words ``max_repeat`` times; the n-th repetition costs n - 1 a word, so repetition
   is spread before it is deepened (a convex cost, as parallel arcs).
4. A pattern that has to give F words with n whole copies in F gives every document n
   times; the rest are seeded documents: the first by a keyed hash, and of those around
   the last (CANDIDATES or more on either side) the ones that come nearest to the sum.

Only sums by pattern, histograms of the hash and at most a few thousand candidate rows
for the last choice come to the driver; their number is bounded by MAX_PATTERNS and
HISTOGRAM, not by the documents.  Texts are never shuffled.

Defined results: a null or empty text has size 0 and is never taken; a null source is a
source of its own, last in order; rows with equal id, source and text stand or fall
together; an empty table gives an empty one; columns of any name may be present, as the
decision is made from expressions over id, source and text alone.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import settle

#: More membership patterns than this are an error, not a silent cut: the flow is solved on the driver.
MAX_PATTERNS = 100_000
#: Cells of the hash histograms, over all patterns.
HISTOGRAM = 1 << 17
#: Documents on either side of the last that its pattern's final choice is made from.
CANDIDATES = 64

WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    """What was decided: for each pattern its copies and, for the rest, hashes that get one more."""

    source_size: dict[str | None, int]
    target: dict[str | None, float]
    copies: dict[str, int] = field(default_factory=dict)
    below: dict[str, int] = field(default_factory=dict)
    chosen: dict[str, list[int]] = field(default_factory=dict)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], max_repeat: int) -> dict[str | None, float]:
    """Shares of the total by weight, none above max_repeat times its source's size."""
    left, open_, out = float(sum(sizes.values())), [s for s in sizes if sizes[s] > 0], dict.fromkeys(sizes, 0.0)
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if unit * weights[s] > max_repeat * sizes[s]]
        if not full:
            return out | {s: unit * weights[s] for s in open_}
        for s in full:
            out[s] = float(max_repeat * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in full]
    return out


def repeating_weights(sources: list[str | None], cycle: tuple[float, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Sources by code point, null last, weigh as the cycle says, over and over."""
    ordered = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    return {s: cycle[k % len(cycle)] for k, s in enumerate(ordered)}


def route(sizes: dict[str, int], members: dict[str, list[str | None]], quotas: dict[str | None, int], max_repeat: int) -> dict[str, int]:
    """Words each pattern gives: a min-cost flow by successive shortest paths with potentials."""
    patterns, sources = list(sizes), list(quotas)
    start, end = 0, 1 + len(patterns) + len(sources)
    place = {s: 1 + len(patterns) + k for k, s in enumerate(sources)}
    arcs: list[list[int]] = []  # to, capacity left, cost; the reverse arc is the number xor 1
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, capacity: int, cost: int) -> None:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            out[x].append(len(arcs))
            arcs.append([y, c, w])

    for k, p in enumerate(patterns):
        for n in range(max_repeat):
            arc(start, 1 + k, sizes[p], n)
        for s in members[p]:
            arc(1 + k, place[s], max_repeat * sizes[p], 0)
    for s in sources:
        arc(place[s], end, quotas[s], 0)

    potential, far = [0] * (end + 1), 1 << 60
    while True:
        dist, via, queue = [far] * (end + 1), [-1] * (end + 1), [(0, start)]
        dist[start] = 0
        while queue:
            d, a = heapq.heappop(queue)
            if d > dist[a]:
                continue
            for i in out[a]:
                b, capacity, cost = arcs[i]
                if capacity > 0 and (to := d + cost + potential[a] - potential[b]) < dist[b]:
                    dist[b], via[b] = to, i
                    heapq.heappush(queue, (to, b))
        if dist[end] == far:
            break
        potential = [p + (d if d < far else 0) for p, d in zip(potential, dist, strict=True)]
        # push along every shortest path while there is one: depth-first over arcs of reduced cost 0
        seen: set[int] = set()
        while True:
            path, at, seen = [], start, {start}
            spent = [0] * (end + 1)
            while at != end:
                while spent[at] < len(out[at]):
                    i = out[at][spent[at]]
                    b, capacity, cost = arcs[i]
                    if capacity > 0 and b not in seen and cost + potential[at] - potential[b] == 0:
                        break
                    spent[at] += 1
                if spent[at] < len(out[at]):
                    path.append(i)
                    seen.add(b)
                    at = b
                elif path:
                    at = arcs[path.pop() ^ 1][0]
                    spent[at] += 1
                else:
                    break
            if at != end:
                break
            least = min(arcs[i][1] for i in path)
            for i in path:
                arcs[i][1] -= least
                arcs[i ^ 1][1] += least
    return {p: sum(arcs[i ^ 1][1] for i in out[0] if arcs[i][0] == 1 + k) for k, p in enumerate(patterns)}


def _pattern(sources: Column, many: bool) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string"))))) if many else F.array(sources.cast("string")))


def _key(id_: Column, sources: Column, text: Column, seed: int) -> Column:
    """A keyed 63-bit hash of a row: which documents are taken first."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_, sources, F.xxhash64(text)), 1)


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, max_repeat: int = 3, weights: dict[str | None, float] | None = None) -> tuple[DataFrame, Mix]:
    """The rows' ids, patterns, sizes and hashes, and what the mix takes of them."""
    many = dict(docs.dtypes)[source_col].startswith("array")
    rows = settle(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), _pattern(F.col(source_col), many).alias("pattern"),
        word_count(F.col(text_col)).alias("size"), _key(F.col(id_col), F.col(source_col), F.col(text_col), seed).alias("key"),
    ))
    sums = rows.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    sizes = {r["pattern"]: int(r["size"]) for r in sorted(sums, key=lambda r: r["pattern"])}
    members = {p: json.loads(p) for p in sizes}
    source_size: dict[str | None, int] = {}
    for p, n in sizes.items():
        for s in members[p]:
            source_size[s] = source_size.get(s, 0) + n
    weights = weights or repeating_weights(list(source_size))
    total = sum(sizes.values())
    wanted = targets(source_size, weights, max_repeat)
    scale = total / t if (t := sum(wanted.values())) > total else 1.0  # overlapping sources count shared words more than once
    mix = Mix(source_size, {s: t * scale for s, t in wanted.items()})
    flow = route(sizes, members, {s: round(t) for s, t in mix.target.items()}, max_repeat)
    rest = {}
    for p, n in sizes.items():
        mix.copies[p], r = divmod(flow[p], n) if n else (0, 0)
        if r:
            rest[p] = r
    _choose(rows, rest, mix)
    return rows, mix


def _choose(rows: DataFrame, rest: dict[str, int], mix: Mix) -> None:
    """Narrow the hash range in which each pattern's last words lie, then pick documents there."""
    mix.below = dict.fromkeys(rest, 0)
    missing, base = dict(rest), dict.fromkeys(rest, 0)  # words still to find from hash base[p] on
    spans, bits = {}, 63  # what is left open: pattern -> (first hash, past the last)
    open_ = list(rest)
    while open_ and bits:
        step = min(bits, max(4, (HISTOGRAM // len(open_)).bit_length() - 1))
        bits -= step
        here = _only(rows, {p: (base[p], base[p] + (1 << (bits + step))) for p in open_})
        cells = here.groupBy("pattern", F.shiftright(F.col("key"), bits).alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        by: dict[str, list[tuple[int, int, int]]] = {p: [] for p in open_}
        for c in cells:
            by[c["pattern"]].append((int(c["cell"]), int(c["size"]), int(c["n"])))
        still = []
        for p in open_:
            cut = sorted(by[p])
            k = 0
            while k < len(cut) and cut[k][1] <= missing[p]:
                missing[p] -= cut[k][1]
                k += 1
            if k == len(cut):
                mix.below[p] = (cut[-1][0] + 1) << bits if cut else base[p]
                continue
            mix.below[p] = base[p] = cut[k][0] << bits
            if cut[k][2] > CANDIDATES and bits:
                still.append(p)
                continue
            n, to = 0, k
            while to < len(cut) and n < CANDIDATES:
                n += cut[to][2]
                to += 1
            n = 0
            while k and n < CANDIDATES:  # the last that fit may be chosen differently
                k -= 1
                n += cut[k][2]
                missing[p] += cut[k][1]
            mix.below[p] = base[p] = cut[k][0] << bits
            spans[p] = (base[p], (cut[to - 1][0] + 1) << bits)
        open_ = still
    picked = _only(rows, spans).groupBy("pattern", "key").agg(F.sum("size").alias("size")).collect() if spans else []
    last: dict[str, list[tuple[int, int]]] = {}
    for r in sorted(picked, key=lambda r: (r["pattern"], r["key"])):
        if r["size"]:
            last.setdefault(r["pattern"], []).append((int(r["key"]), int(r["size"])))
    mix.chosen = {p: nearest_sum(own, missing[p]) for p, own in last.items()}


#: Words up to which the last documents are chosen by all their sums.
EXACT = 1 << 20


def nearest_sum(candidates: list[tuple[int, int]], missing: int) -> list[int]:
    """Keys of candidates (key, size) whose sizes sum to as near to missing as any do; by first fit while more than EXACT words are missing."""
    out = []
    while candidates and missing > EXACT:
        (key, size), *candidates = candidates
        if size <= missing:
            out.append(key)
            missing -= size
    reach, mask = [1], (1 << (2 * missing + 1)) - 1  # bit s: some of the first k candidates sum to s
    for _, size in candidates:
        reach.append((reach[-1] | reach[-1] << size) & mask if size <= 2 * missing else reach[-1])
    below = (reach[-1] & ((1 << (missing + 1)) - 1)).bit_length() - 1
    above = reach[-1] >> missing
    above = missing + (above & -above).bit_length() - 1 if above else below
    s = below if missing - below <= above - missing or above < missing else above
    for k in range(len(candidates), 0, -1):
        if not reach[k - 1] >> s & 1:
            out.append(candidates[k - 1][0])
            s -= candidates[k - 1][1]
    return out


def _lookup(rows: DataFrame, values: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(rows.sparkSession.createDataFrame(values, schema))


def _only(rows: DataFrame, spans: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows whose hash lies in their pattern's span; at most MAX_PATTERNS spans are broadcast."""
    known = _lookup(rows, [(p, a, b - 1) for p, (a, b) in spans.items()], "pattern string, a bigint, b bigint")
    return rows.join(known, "pattern").where(F.col("key").between(F.col("a"), F.col("b"))).drop("a", "b")


def _times(rows: DataFrame, mix: Mix) -> DataFrame:
    """rows(pattern, key, ...) with how often each is taken."""
    plan = _lookup(rows, [(p, n, mix.below.get(p, 0), mix.chosen.get(p, [])) for p, n in mix.copies.items()], "pattern string, copies bigint, below bigint, chosen array<bigint>")
    extra = (F.col("key") < F.col("below")) | F.array_contains("chosen", F.col("key"))
    return rows.join(plan, "pattern").withColumn("times", F.col("copies") + extra.cast("bigint")).drop("copies", "below", "chosen")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per row of docs: id, source, size, its source's size and target, and the words taken.

    With a column of several sources (an array), source_size and target are sums over them.
    """
    rows, mix = decide(docs, id_col, text_col, source_col, **options)
    sums = [(p, sum(mix.source_size[s] for s in json.loads(p)), float(sum(mix.target[s] for s in json.loads(p)))) for p in mix.copies]
    known = _lookup(rows, sums, "pattern string, source_size bigint, target double")
    return _times(rows, mix).join(known, "pattern").select(
        F.col("id").alias(id_col), F.col("source").alias("source"), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), F.col("times").alias("copies"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them.  Texts stay where they are read."""
    _, mix = decide(docs, id_col, text_col, source_col, seed, **options)
    many = dict(docs.dtypes)[source_col].startswith("array")
    whole = docs.select(F.struct("*").alias("row"), _pattern(F.col(source_col), many).alias("pattern"), _key(F.col(id_col), F.col(source_col), F.col(text_col), seed).alias("key"), word_count(F.col(text_col)).alias("size"))
    taken = _times(whole, mix).where((F.col("times") > 0) & (F.col("size") > 0))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
