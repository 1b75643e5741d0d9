"""Exact top-k by inner product with cover trees.

Vectors are turned into integers, floor(SCALE * x).  A node of a tree has one of its points
as centre and the largest distance to any of its points as covering radius; its children
are a net of points more than radius / BASE apart (separation) within radius / BASE of
every point (covering), the first of them the node's own centre (nesting).

The upper levels are shared: a tree over a bounded sample (SAMPLE rows, whatever the
input) is cut at up to CELLS nodes, and every row, query or not, goes to the nearest of
their centres.  So the rows of a cell lie together, and its radius is that of all its rows.
Below, each block of at most BLOCK rows of a cell has a tree of its own.

A node can't hold a score above

    <q, c> + |q| r

for a query q, its centre c and radius r.  It is passed over by the queries whose worst k-th
score is above that.  First the queries meet one part of their own cell, which gives each a
floor; then each goes only to those cells whose bound reaches its floor.  Data stay where
they are: a task holds a part of a cell, builds its trees once, and the queries, a fiftieth
of the rows or fewer, come by in blocks.  Bounds of a net's centres and products of leaves
are matrices of many queries, nodes from the highest bound down, against floors and
scores found so far.  The parts' best are merged, k a query from each.

Defined results: vectors that are null, or hold a null, NaN or infinite component, take no
part, neither do rows without an id; vectors of different lengths aren't compared; a
row's own are all rows with its id; a row that is repeated is found as often as it
occurs, and asked once for each of its distinct vectors; ties go to the smaller id;
scores beyond 64 bits are held at their limits; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import frugal, settle
from gridloom.llm.components import join_unique

SCALE, K = 256, 5
BLOCK, BASE = 4096, 1.25
#: Points of a leaf; of one in a search, where products of matrices cost less than bounds.
LEAF, WIDE = 64, 512
#: Rows that the upper levels are made of, and cells they are cut into at most, for each vector length in the sample.
SAMPLE, CELLS = 8192, 256
#: A task holds the rows of a cell up to a SHARE of all, but never more than HELD; cells grow with the square root of the rows, over SPREAD.
SHARE, HELD, SPREAD = 32, 1 << 17, 16
#: Queries that are searched at a time, and rows of data multiplied at a time, about.
ASKED, AT_ONCE = 2048, 1024
#: Tasks of a search, at most.
TASKS = 1 << 14
_NONE = np.iinfo(np.int64).min


@dataclass
class Node:
    """rows: the numbers of the points below, that of the centre first; children, their centres, norms and radii."""

    rows: np.ndarray
    centre: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)

    def net(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not hasattr(self, "_net"):
            m = np.array([c.centre for c in self.children])
            self._net = m, np.linalg.norm(m, axis=1), np.array([c.radius for c in self.children])
        return self._net


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None, leaf: int | None = None) -> Node:
    """A tree over points[rows]; nodes of more than ``leaf`` points that aren't all one have children."""
    rows = np.arange(len(points)) if rows is None else rows
    own = points[rows].astype(np.float64)
    far = np.sqrt(((own - own[0]) ** 2).sum(axis=1))
    node = Node(rows, own[0], float(far.max()))
    if len(rows) <= (LEAF if leaf is None else leaf) or node.radius == 0:
        return node
    nearest, label, centres = far, np.zeros(len(rows), np.int64), [0]
    while nearest[next_ := int(nearest.argmax())] > node.radius / BASE:
        d = np.sqrt(((own - own[next_]) ** 2).sum(axis=1))
        closer = d < nearest
        closer[next_] = True
        nearest, label = np.where(closer, d, nearest), np.where(closer, len(centres), label)
        centres.append(next_)
    order = np.lexsort((np.arange(len(rows)) != np.array(centres)[label], label))
    cut = np.searchsorted(label[order], np.arange(len(centres) + 1))
    node.children = [cover_tree(points, rows[order[a:b]], leaf) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return node


def upper_levels(sample: np.ndarray, cells: int) -> np.ndarray:
    """The centres of the nodes at which a tree over the sample is cut, the widest node first, until there are ``cells``; never more than CELLS."""
    tree, turn = cover_tree(sample, leaf=1), 0
    open_, done = [(-tree.radius, 0, tree)], []
    while open_ and len(open_) + len(done) < cells:
        _, _, node = heapq.heappop(open_)
        if not node.children or len(open_) + len(done) + len(node.children) > CELLS:
            done.append(node)
            continue
        for c in node.children:
            turn += 1
            heapq.heappush(open_, (-c.radius, turn, c))
    return np.array([n.centre for *_, n in open_] + [n.centre for n in done])


def _exact(q: np.ndarray, d: np.ndarray) -> type:
    """The numbers in which inner products of integers are exact: floats, doubles, or else integers."""
    high = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * q.shape[1]
    return np.float32 if high < 2**24 else np.float64 if high < 2**53 else np.int64


def _products(q: np.ndarray, d: np.ndarray, kind: type) -> np.ndarray:
    """Exact inner products; integers are 64-bit, held at the limits beyond."""
    if kind is not np.int64:
        return q @ d.T
    as_int = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    exact = as_int(q) @ as_int(d).T if q.shape[1] else np.zeros((len(q), len(d)), object)
    return np.clip(exact, _NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


def _bounds(points: np.ndarray, m: np.ndarray, norms: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """What each node, by its centre, the centre's norm and its radius, can give to each query."""
    own = np.linalg.norm(points, axis=1)[:, None]
    most = points @ m.T + own * radii
    return np.maximum(most + 1e-9 * (np.abs(most) + own * norms + 1), float(_NONE))


class Search:
    """The best scores so far of a block of queries; floors are scores that the k-th of each query is known to reach."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int, floors: np.ndarray | None = None) -> None:
        self.ids, self.points, self.k = ids, points, k
        self.floors = np.full(len(ids), _NONE) if floors is None else floors
        self.score = np.full((len(ids), k), _NONE)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        #: Queries and nodes looked at, and query-data pairs multiplied.
        self.visited = self.multiplied = 0

    def worst(self) -> np.ndarray:
        """What a score has to reach, for each query."""
        return np.maximum(self.score[:, -1], self.floors)

    def _leaves(self, rows: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Take in the scores of some queries and some data, given in the order of ids."""
        self.multiplied += score.size
        none = _NONE if score.dtype == np.int64 else -np.inf
        first, last = (np.searchsorted(ids, self.ids[rows], side) for side in ("left", "right"))
        for r in np.flatnonzero(last > first).tolist():
            score[r, first[r] : last[r]] = none
        worst, n = self.worst()[rows], len(ids)
        low = worst if score.dtype == np.int64 else np.where(worst == _NONE, none, worst).astype(score.dtype)
        keep = score >= low[:, None]
        many = np.flatnonzero(np.count_nonzero(keep, axis=1) > 4 * self.k)
        if len(many):  # the k best of each, ties to the first
            some = score[many]
            line = np.maximum(low[many], np.partition(some, n - self.k, axis=1)[:, n - self.k])[:, None]
            tie = some == line
            keep[many] = (some > line) | (tie & (np.cumsum(tie, axis=1) <= self.k))
        flat = np.flatnonzero(keep)
        flat = flat[score.ravel()[flat] != none]
        if not len(flat):
            return
        r, c = np.divmod(flat, n)
        hit = np.unique(r)
        q = np.concatenate([hit.repeat(self.k), r])
        s = np.concatenate([self.score[rows[hit]].ravel(), score.ravel()[flat].astype(np.int64)])
        i = np.concatenate([self.found[rows[hit]].ravel(), ids[c]])
        order = np.lexsort((i, ~s, q))
        start = np.searchsorted(q[order], hit)
        take = order[start[:, None] + np.arange(self.k)]
        self.score[rows[hit]], self.found[rows[hit]] = s[take], i[take]

    def meet(self, ids: np.ndarray, points: np.ndarray, tree: Node) -> None:
        """Search a data block, whose rows are in the order of ids, for every query."""
        kind = _exact(self.points, points)
        mine, theirs = (m if kind is np.int64 else m.astype(kind) for m in (self.points, points))
        held: list[np.ndarray] = []  # leaves that are multiplied together, the queries that ask for any of them, and pairs asked for
        asking, useful = np.zeros(len(self.ids), bool), 0

        def multiply() -> None:
            nonlocal useful
            if held:
                q, d = np.flatnonzero(asking), np.sort(np.concatenate(held))
                self._leaves(q, ids[d], _products(mine[q], theirs[d], kind))
            held.clear()
            asking[:] = False
            useful = 0

        def hold(rows: np.ndarray, data: np.ndarray) -> None:
            nonlocal useful
            n, pairs = sum(map(len, held)) + len(data), useful + len(rows) * len(data)
            if held and (n > AT_ONCE or n * (np.count_nonzero(asking) + np.count_nonzero(~asking[rows])) > 1.5 * pairs):
                multiply()
                pairs = len(rows) * len(data)
            held.append(data)
            asking[rows] = True
            useful = pairs

        queue, turn = [(-np.inf, 0, tree, np.arange(len(self.ids)), None)], 0
        while queue:
            _, _, node, rows, most = heapq.heappop(queue)
            if most is not None:
                rows = rows[~(most < self.worst()[rows])]
            if not len(rows):
                continue
            if not node.children:
                hold(rows, node.rows)
                continue
            bounds = _bounds(self.points[rows], *node.net())
            self.visited += bounds.size
            small = np.array([not c.children and len(c.rows) < LEAF for c in node.children])
            for nth in np.flatnonzero(~small).tolist():
                turn += 1
                heapq.heappush(queue, (-float(bounds[:, nth].max()), turn, node.children[nth], rows, bounds[:, nth]))
            if small.any():  # small leaves of a node go together
                go = ~(bounds[:, small] < self.worst()[rows][:, None])
                data = [node.children[nth].rows for nth in np.flatnonzero(small)[go.any(axis=0)].tolist()]
                if data:
                    hold(rows[go.any(axis=1)], np.concatenate(data))
        multiply()


def _pivots(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Centres of the upper levels for each vector length in a sample of about SAMPLE rows (length, centres)."""
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(23), "id"), F.lit(1 << 30)) < min(1.0, SAMPLE / max(1, n)) * (1 << 30)).select("v").limit(2 * SAMPLE)
    by: dict[int, list] = {}
    for r in drawn.collect():
        by.setdefault(len(r["v"]), []).append(r["v"])
    cells = max(1, min(CELLS, -(-2 * n // BLOCK), round(n**0.5 / SPREAD)))
    return {dim: upper_levels(np.array(sorted(own), np.float64), cells) for dim, own in by.items() if dim}


def _assigned(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """id, v, query and cell (length * CELLS + number of the nearest centre), with the distance to that centre; lengths without centres have one cell, around 0."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # at most CELLS vectors of each length in the sample

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            length, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
            start = np.cumsum(length) - length
            cell, away = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for dim in np.unique(length).tolist():
                own = np.flatnonzero(length == dim)
                m = flat[start[own][:, None] + np.arange(dim)].astype(np.float64)
                centres = shared.value.get(dim, np.zeros((1, dim)))
                gap = (centres**2).sum(axis=1) - 2 * (m @ centres.T)
                nearest = gap.argmin(axis=1)
                cell[own] = dim * CELLS + nearest
                away[own] = np.sqrt(((m - centres[nearest]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2), pa.array(cell), pa.array(away)], names=["id", "v", "query", "cell", "away"])

    return rows.mapInArrow(run, "id bigint, v array<double>, query boolean, cell bigint, away double")


def _pack(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (id, v, cell) as blocks of one part of a cell: cell, part, dim, ids and components as bytes.

    A cell is dealt by hash to as many parts as sizes (cell, parts) say, so a hot one is many tasks' work.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = (-1, -1)

        def block() -> pa.RecordBatch:
            ids, m = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(ids, kind="stable")
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]]), pa.array([now[1]]), pa.array([now[0] // CELLS]), pa.array([ids[order].tobytes()]), pa.array([_written(m[order])])], names=["cell", "part", "dim", "ids", "m"])

        for batch in batches:
            ids, lists, cell, part = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            start = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            cuts = np.flatnonzero((np.diff(cell, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True):
                if held and now != (cell[a], part[a]):
                    yield block()
                now = (int(cell[a]), int(part[a]))
                for k in range(a, b, BLOCK):
                    stop = min(b, k + BLOCK)
                    held.append((ids[k:stop], flat[start[k] : start[stop]].reshape(stop - k, now[0] // CELLS)))
                    if sum(len(i) for i, _ in held) >= BLOCK:
                        yield block()
        if held:
            yield block()

    dealt = join_unique(rows, sizes, "cell").withColumn("part", F.pmod(F.xxhash64(F.lit(7), "id", "v"), F.col("parts")))
    return dealt.select("id", "v", "cell", "part").repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(run, "cell bigint, part bigint, dim bigint, ids binary, m binary")


def _written(m: np.ndarray) -> bytes:
    """Components as two bytes each if all fit, or as doubles."""
    return m.astype(np.int16 if np.abs(m).max(initial=0) < 2**15 else np.float64).tobytes()


def _read(dim: int, ids: bytes, m: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(m, np.int16 if len(m) == 2 * dim * len(own) else np.float64).reshape(len(own), dim).astype(np.float64)


ASK = "cell bigint, dim bigint, ids binary, m binary, floors binary"


def _meeting(data: DataFrame, asked: DataFrame, tasks: int, k: int, found: Callable[[int, int, Search], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``found`` says of searches of blocks of queries in all data of their (cell, part).

    A part's data come to its task first and are held, with trees that are built once; the queries
    follow, with their floors, and are searched ASKED at a time.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, trees, waiting = None, [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if waiting:
                trees.extend((ids, points, cover_tree(points, leaf=WIDE)) for ids, points in held)
                held.clear()
                ids, points, low = (np.concatenate(x) for x in zip(*waiting, strict=True))
                waiting.clear()
                search = Search(ids, points, k, low)
                for block in trees:
                    search.meet(*block)
                yield from found(now[0], now[2], search)

        for batch in batches:
            for cell, part, dim, ids, m, low in zip(*(batch.column(i) for i in range(6)), strict=True):
                key = cell.as_py(), part.as_py(), dim.as_py()
                if key != now:
                    yield from flush()
                    now, held, trees = key, [], []
                own = _read(key[2], ids.as_py(), m.as_py())
                if low.is_valid:
                    waiting.append((*own, np.frombuffer(low.as_py(), np.int64) if len(low.as_py()) else np.full(len(own[0]), _NONE)))
                    if sum(len(w[0]) for w in waiting) >= ASKED:
                        yield from flush()
                else:
                    held.append(own)
        yield from flush()

    columns = ["cell", "part", "dim", "ids", "m"]
    both = data.select(*columns, F.lit(None).cast("binary").alias("floors")).unionByName(asked.select(*columns, "floors"))
    return both.repartition(tasks, "cell", "part").sortWithinPartitions("cell", "part", F.col("floors").isNotNull()).mapInArrow(run, schema)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k rows with the highest integer inner product, for each row for which is_query holds."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(
        F.col(id_col).cast("bigint").alias("id"), F.transform(v, lambda x: _floor(x.cast("double") * SCALE)).alias("v"), is_query.alias("query"))
    rows = settle(rows)
    n = rows.count()
    pivots = _pivots(rows, n)
    placed = settle(_assigned(rows, pivots))
    own = max(BLOCK, min(HELD, -(-n // SHARE)))
    cells = settle(placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).withColumn("parts", F.ceil(F.col("n") / own)))
    tasks = max(1, min(TASKS, 2 * (cells.agg(F.sum("parts")).collect()[0][0] or 0)))
    data = settle(_pack(placed.select("id", "v", "cell"), cells.select("cell", "parts")))
    asked = settle(placed.where("query").select("id", "v", "cell").distinct())
    queries = settle(_pack(asked, asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))))
    # cells of the lengths in the sample, at most CELLS each: what prunes whole cells
    around = {dim: (m, np.linalg.norm(m, axis=1), np.zeros(len(m)), np.full(len(m), -1, np.int64)) for dim, m in pivots.items()}
    known = placed.sparkSession.createDataFrame([(int(dim),) for dim in pivots], "dim bigint")
    for r in cells.join(F.broadcast(known), F.floor(F.col("cell") / CELLS) == F.col("dim"), "left_semi").collect():
        dim, nth = divmod(r["cell"], CELLS)
        around[dim][2][nth], around[dim][3][nth] = r["radius"], r["cell"]
    plan = data.sparkSession.sparkContext.broadcast(around)

    def floors(cell: int, dim: int, search: Search) -> Iterator[pa.RecordBatch]:
        """The queries again, for each cell those that its bound doesn't rule out, with what they have reached."""
        low = search.worst()
        names, reached = [cell], np.ones((len(low), 1), bool)  # lengths without centres have one cell
        if dim in plan.value:
            m, norms, radii, names = (x[plan.value[dim][3] >= 0] for x in plan.value[dim])
            reached = ~(_bounds(search.points, m, norms, radii) < low[:, None])
        for name, go in zip(names, reached.T, strict=True):
            if go.any():
                yield pa.RecordBatch.from_arrays([pa.array([int(name)]), pa.array([dim]), pa.array([search.ids[go].tobytes()]), pa.array([_written(search.points[go])]), pa.array([low[go].tobytes()])], names=["cell", "dim", "ids", "m", "floors"])

    parts = cells.select("cell", "parts")
    first = queries.join(parts, "cell").withColumn("part", F.col("part") % F.col("parts")).withColumn("floors", F.lit(bytearray()))
    met = data.join(first.select("cell", "part").distinct(), ["cell", "part"], "left_semi")
    going = _meeting(met, first, tasks, k, floors, ASK).join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    found = _meeting(data, going, tasks, k, lambda cell, dim, search: iter([_best(search)]), "query_id bigint, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _floor(x: Column) -> Column:
    """floor as a double, also where the result is beyond a bigint."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def _best(search: Search) -> pa.RecordBatch:
    full = search.score != _NONE
    ids = np.broadcast_to(search.ids[:, None], full.shape)
    return pa.RecordBatch.from_arrays([pa.array(ids[full]), pa.array(search.found[full]), pa.array(search.score[full])], names=["query_id", "vec_id", "score"])
