"""Sharding by a hierarchical weighted hash tree, in DataFrame operations alone.

The tree has regions, racks in them and shards in these; a node weighs what the
shards below it weigh. A key descends from level to level: each child draws a
uniform number from a hash of the key and the child's path, and the one with the
least -ln(draw) / weight gets the key. Children win in proportion to weight, and
a child's draw knows nothing of its siblings. So a weight that grows takes keys
only into the child that grew, at every level, and one that shrinks gives keys
only away from it: no key moves between two subtrees whose weights stay.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import cut, free_name

#: Hexadecimal digits of a hash that make a draw: 52 bits, exact in a double.
DRAW_DIGITS = 13
#: Most leaves of a tree: it travels in the plan, some 60 bytes a leaf.
MOST_LEAVES = 20_000
#: Rows of a shard that one task numbers, on average, and rows alike in every column that stay together.
BUCKET_ROWS, ALIKE_ROWS = 2_000, 10_000


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree_of(count: int) -> tuple[Leaf, ...]:
    """The tree of so many shards of equal weight: up to eight fill two regions of two racks of two; each further one is a region of its own.

    So one more shard beyond eight changes the weight of no old subtree and takes
    keys only into itself. A shard that joins an old rack, in a tree of one's own,
    takes keys into its region, whose racks and shards share them by their draws.
    """
    inner = [Leaf(f"r{i // 4}", f"k{i // 2 % 2}", i) for i in range(min(count, 8))]
    return (*inner, *(Leaf(f"r{i - 6}", "k0", i) for i in range(8, count)))


def checked(leaves: tuple[Leaf, ...]) -> list[Leaf]:
    """The leaves that have a weight; an error for none, for too many, for repeated shards and for weights that are negative or not finite."""
    there = [x for x in leaves if x.weight > 0]
    if not there or len(leaves) > MOST_LEAVES:
        raise ValueError(f"a tree has 1 to {MOST_LEAVES} leaves, and one with a weight at least")
    if len({x.shard for x in leaves}) < len(leaves):
        raise ValueError("a shard stands twice in the tree")
    if any(not 0 <= x.weight < float("inf") for x in leaves):
        raise ValueError("weights are finite and not negative")
    return there


def levels(leaves: tuple[Leaf, ...]) -> list[dict[str, dict[str, float]]]:
    """For each level the children of each path, by path, with their weights; the root's path is empty."""
    made: list[dict[str, dict[str, float]]] = [defaultdict(lambda: defaultdict(float)) for _ in range(3)]
    for x in checked(leaves):
        paths = ["", x.region, f"{x.region}/{x.rack}", f"{x.region}/{x.rack}/{x.shard}"]
        for level, (parent, child) in enumerate(zip(paths, paths[1:])):
            made[level][parent][child] += x.weight
    return made


def draw(key: Column, path: Column) -> Column:
    """The uniform number in (0, 1) of a key at a node."""
    digits = F.substring(F.md5(F.concat(key, F.lit("@"), path)), 1, DRAW_DIGITS)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**DRAW_DIGITS))


def leaf_of(doc_id: Column, leaves: tuple[Leaf, ...]) -> Column:
    """The path region/rack/shard that a key descends to; a null id is the empty text's key."""
    key = F.coalesce(doc_id.cast("string"), F.lit(""))
    path = F.lit("")
    for level in levels(leaves):
        entries = []
        for parent, children in level.items():
            nodes = [F.struct(F.lit(c).alias("path"), F.lit(w).alias("weight")) for c, w in children.items()]
            entries += [F.lit(parent), F.array(*nodes)]
        nodes = F.element_at(F.create_map(*entries), path)
        scored = F.transform(nodes, lambda n: F.struct((-F.log(draw(key, n["path"])) / n["weight"]).alias("score"), n["path"].alias("path")))
        path = F.array_min(scored)["path"]
    return path


def shard_of(doc_id: Column, leaves: tuple[Leaf, ...]) -> Column:
    return F.substring_index(leaf_of(doc_id, leaves), "/", -1).cast("int")


def assign(docs: DataFrame, leaves: tuple[Leaf, ...], grown: tuple[Leaf, ...], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, size, text_crc32, law, shard, grown_shard; no shuffle.

    size is the text's UTF-8 bytes plus 1; a null text has size 1 and the check
    sum 0, as an empty one. The law is `key`: doc_id and the tree decide, so rows
    of one id share a shard, null ids one of their own. Other columns do not
    matter; an empty table gives an empty result.
    """
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1
    crc = F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long")
    return docs.select(
        F.col(doc_id).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(F.col(doc_id), leaves).alias("shard"), shard_of(F.col(doc_id), grown).alias("grown_shard"),
    )


def with_slots(rows: DataFrame) -> DataFrame:
    """rows of assign() with slot: their place in the shard, gapless from 0, in the order of a hash of id, check sum and size.

    Rows alike in every column are counted first and numbered in lots of
    ALIKE_ROWS, so many copies of one row are no hot group. Lots are numbered
    within buckets of the order, these by sums over a row for each bucket.
    """
    same = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    lots = same.select(*rows.columns, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(ALIKE_ROWS).cast("long"))).alias("first"))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text_crc32", "size")]
    lot = F.floor(F.col("first") / ALIKE_ROWS).cast("string")
    lots = lots.withColumn("m", F.least(F.col("n") - F.col("first"), F.lit(ALIKE_ROWS).cast("long"))).withColumn("order", F.md5(F.concat_ws(":", *parts, lot)))
    lots = cut(lots.drop("n"))
    buckets = lots.groupBy(F.col("shard").alias("of")).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / BUCKET_ROWS)).alias("buckets"))
    # One row for each shard, MOST_LEAVES at most.
    lots = lots.join(F.broadcast(buckets), F.col("shard") == F.col("of"))
    lots = lots.withColumn("bucket", F.floor(F.conv(F.substring("order", 1, 7), 16, 10).cast("long") * F.col("buckets") / (1 << 28)))
    before = Window.unboundedPreceding, -1
    sums = lots.groupBy("shard", "bucket").agg(F.sum("m").alias("rows"))
    earlier = F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(*before))
    sums = sums.select(F.col("shard").alias("s"), F.col("bucket").alias("b"), F.coalesce(earlier, F.lit(0)).alias("earlier"))
    inside = F.sum("m").over(Window.partitionBy("shard", "bucket").orderBy("order", "doc_id", "text_crc32", "size", "first").rowsBetween(*before))
    placed = lots.withColumn("inside", F.coalesce(inside, F.lit(0))).join(sums, (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b")))
    start = F.col("earlier") + F.col("inside")
    return placed.select(*rows.columns, F.explode(F.sequence(start, start + F.col("m") - 1)).alias("slot"))


def write_shards(docs: DataFrame, path: str, leaves: tuple[Leaf, ...], doc_id: str = "doc_id") -> tuple[str, str, str]:
    """Writes all columns of docs as Parquet, a folder for each region, rack and shard; the names of the three folder columns.

    The names are region, rack and shard, with `_` behind one that docs has. A
    task writes its rows' shards without a shuffle. Rows of repeated or null ids
    are all written; an empty table writes no shard.
    """
    name = free_name(docs)
    names = name("region"), name("rack"), name("shard")
    path_of = F.split(leaf_of(F.col(doc_id), leaves), "/")
    docs.withColumns({n: path_of[i] for i, n in enumerate(names)}).write.partitionBy(*names).parquet(path)
    return names
