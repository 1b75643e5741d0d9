"""Connected components of an edge table by alternating large and small stars, and joins that no hot key holds up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import narrow, settle

#: A key is hot if it has more rows than this and more than 1 / SHARE of all.
FLOOR, SHARE = 1000, 1024


def join_unique(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """many joined with one, which has at most one row of fixed width for each key; many should be settled.

    Hot keys of many, fewer than SHARE of them, meet their row of one in a broadcast join and so stay
    where they are; the others are shuffled.  A null key matches nothing.
    """
    n = many.count()
    hot = []
    if n > FLOOR:
        most = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > max(FLOOR, n // SHARE))
        hot = [r[0] for r in most.select(key).collect()]
    if not hot:
        return many.join(one, key, how)
    kind = dict(many.dtypes)[key]
    names = many.sparkSession.createDataFrame([(k,) for k in hot], f"`{key}` {kind}")
    warm = F.broadcast(one.join(F.broadcast(names), key, "left_semi"))
    here = many.join(F.broadcast(names), key, "left_semi").join(warm, key, how)
    return here.unionByName(many.join(F.broadcast(names), key, "left_anti").join(one, key, how))


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 30))).collect()[0])


def stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of bigint nodes to (a, b) with b the least node of a's component, a over every other node of it.

    Each round takes minima by node, aggregated before the shuffle, and joins them back; nodes
    with very many neighbours are joined where their edges lie.  The number of rounds grows
    with the logarithm of a component's size.  Only the edge table is kept between rounds, in
    the checkpoint folder.  Loops and repeated edges, either way round, count once; a null end
    drops the edge; no edges give no rows.
    """
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, now = None, _print(edges)
    edges = narrow(edges, now[0])
    while before != now and now[0]:
        n = 2 * now[0]
        both = settle(narrow(edges.union(edges.select("b", "a")), n))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = settle(narrow(join_unique(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), n))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_unique(large, least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        edges = settle(narrow(small.distinct(), n))
        before, now = now, _print(edges)
    return edges
