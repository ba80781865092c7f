"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import cut

#: Pairs of nodes that a task takes, about.
TASK_PAIRS = 100_000
#: Up to so many pairs, their least neighbours of 16 bytes, no more than pairs, are broadcast.
BROADCAST_PAIRS = 100_000


def least_below(pairs: DataFrame) -> DataFrame:
    """(x, m): for each node that has smaller neighbours the least of them."""
    return pairs.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root) for each node of an edge; root is the component's least node.

    A pair is (larger node u, smaller node v). A large star moves v to the least
    neighbour of v, a small star links the smaller neighbours of u with the least
    of them; about log(n) rounds leave stars. Least neighbours are summed before
    the shuffle; beyond BROADCAST_PAIRS pairs they are cut, so that both sides of a
    join have a shuffle of their own and Spark splits the pairs of a hot node.
    Only two numbers a round reach the driver. Null ends and loops are dropped;
    no edges give no rows.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").filter("a IS NOT NULL AND b IS NOT NULL")
    pairs = cut(pairs.distinct())
    now, before = _digest(pairs), None
    while now != before:
        parts = 1 + now[0] // TASK_PAIRS  # pairs never get more; few tasks write few shuffle files
        sent = F.broadcast if now[0] <= BROADCAST_PAIRS else cut
        pairs = pairs.coalesce(parts)
        large = pairs.join(sent(least_below(pairs)), F.col("v") == F.col("x"), "left")
        large = cut(large.select("u", F.coalesce("m", "v").alias("v")).coalesce(parts))
        least = sent(least_below(large))
        small = large.join(least, F.col("u") == F.col("x")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(small.unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct().coalesce(parts))
        now, before = _digest(pairs), now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _digest(pairs: DataFrame) -> tuple:
    """The number of pairs and the exclusive or of their hashes: pairs are distinct, and neither number overflows."""
    return tuple(pairs.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first())
