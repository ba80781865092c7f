"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations alone.

Each source's documents queue in shuffled order, once for each epoch. A queued
document's virtual finish time is the source's tokens up to it divided by the
source's target; the global order is that of finish times, cut where the total
budget is spent. Running sums go in two levels, over buckets of the shuffled
order and within them, so that a hot source is spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import cut, free_name

#: Source tables up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 10_000


@dataclass(frozen=True)
class Mix:
    """weights: by the source's rank, repeating. budget: share of all words. epochs: most passes over a document.

    bucket_rows: rows that one task sums in order, on average.
    """

    weights: tuple[int, ...] = (3, 1, 2)
    budget: float = 1.5
    epochs: int = 2
    seed: str = "mix"
    bucket_rows: int = 2_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """A row per source: source_size, source_rows, target. Sources rank by code point, null last.

    Targets share the budget by weight; none is above epochs x its source's
    size: with sources in order of cap / weight, those before some place get
    their cap and the rest share what is left by weight.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (rank % len(mix.weights) + 1).cast("int"))
    caps = total.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", mix.epochs * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = (Window.unboundedPreceding, -1), (0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = mix.budget * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(order.rowsBetween(*before)), F.lit(0))
    caps = caps.withColumn("rate", left / F.sum("weight").over(order.rowsBetween(*after)))
    over = F.col("cap") < F.col("weight") * F.col("rate")
    caps = caps.withColumn("over", over)
    # The first source that is not over its cap sets the rate of all later ones.
    rate = F.min(F.when(~F.col("over"), F.struct(F.col("cap") / F.col("weight"), "rank", "rate"))).over(everything)["rate"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * rate, F.col("cap").cast("double")))
    return caps.select("source", "source_size", "source_rows", target.alias("target"))


def shuffled(doc_id: Column, mix: Mix) -> Column:
    """The key of the shuffled order."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{mix.seed}")))


def queued(docs: DataFrame, mix: Mix, doc_id: str, source: str, text: str) -> tuple[DataFrame, int]:
    """All documents with size, source_size, target and reached (the source's words up to and with it); their number.

    Rows of one id in a source stand at one place of its queue: they are summed
    before the queue is dealt to tasks, so that many null or repeated ids are no
    hot group, and get their place by a join, whose hot keys Spark splits.
    """
    columns = F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")
    rows = cut(docs.select(*columns, shuffled(F.col(doc_id), mix).alias("order")))
    n = rows.count()
    sources = cut(source_targets(rows, mix))
    few = sources.count() <= BROADCAST_SOURCES
    sources = sources.withColumnRenamed("source", "of")
    places = rows.groupBy("source", "order", "doc_id").agg(F.sum("size").alias("size"))
    places = places.join(F.broadcast(sources) if few else sources, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    buckets = F.greatest(F.lit(1), F.floor(F.col("source_rows") / mix.bucket_rows))
    places = places.withColumn("bucket", F.floor(F.conv(F.substring("order", 1, 7), 16, 10).cast("long") * buckets / (1 << 28)))
    sums = places.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(earlier, F.lit(0)).alias("earlier"))
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    places = places.withColumn("inside", inside).join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    reached = (F.col("earlier") + F.col("inside")).alias("reached")
    places = places.select(F.col("doc_id").alias("of_id"), F.col("source").alias("of"), "source_size", "target", reached)
    rows = rows.join(places, F.col("doc_id").eqNullSafe(F.col("of_id")) & F.col("source").eqNullSafe(F.col("of")))
    return rows.select("doc_id", "source", "size", "source_size", "target", "reached"), n


def finish(epoch: int) -> Column:
    """Virtual finish time of the document's pass: the source's words up to it over the source's target."""
    return (F.col("reached") + epoch * F.col("source_size")) / F.when(F.col("target") > 0, F.col("target"))


def fitting(sums: DataFrame, key: str, budget: float, spent: int) -> tuple[int, float | None, float | None]:
    """Of few rows (key, words, last) in order of key: the words spent with all that fit in the budget, their last finish time, the first key that does not fit."""
    upto = F.sum("words").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) + spent
    fits = F.col("upto") <= budget
    found = sums.withColumn("upto", upto).agg(F.max(F.when(fits, F.col("upto"))), F.max(F.when(fits, F.col("last"))), F.min(F.when(~fits, F.col(key)))).first()
    return spent if found[0] is None else found[0], found[1], found[2]


def last_finish(rows: DataFrame, n: int, mix: Mix) -> float:
    """The finish time up to which all passes together fit in the budget.

    Finish times run evenly, so equal ranges of them hold about equal rows.
    First the sums of a thousand ranges each are added up in order, then those
    of the thousand in which the budget ends, then that range's finish times.
    """
    passes = rows.filter("size > 0").select("size", F.explode(F.array(*[finish(e) for e in range(mix.epochs)])).alias("at")).filter("at IS NOT NULL")
    ranges = max(1, mix.epochs * n // mix.bucket_rows)
    passes = passes.withColumn("range", F.least(F.floor(F.col("at") * ranges), F.lit(4 * ranges)))
    budget = mix.budget * rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()["total"]
    sums = cut(passes.groupBy("range").agg(F.sum("size").alias("words"), F.max("at").alias("last"))).withColumn("ranges", F.floor(F.col("range") / 1_000))
    steps = (
        ("ranges", lambda _: sums.groupBy("ranges").agg(F.sum("words").alias("words"), F.max("last").alias("last"))),
        ("range", lambda split: sums.filter(F.col("ranges") == split)),
        ("last", lambda split: passes.filter(F.col("range") == split).groupBy(F.col("at").alias("last")).agg(F.sum("size").alias("words"))),
    )
    spent, last, split = 0, -1.0, None
    for key, part in steps:
        spent, found, split = fitting(part(split), key, budget, spent)
        last = last if found is None else found
        if split is None:
            break
    return last


def times_taken(last: float, mix: Mix) -> Column:
    return sum((F.coalesce((finish(e) <= last).cast("long"), F.lit(0).cast("long")) for e in range(mix.epochs)), F.lit(0).cast("long"))


def mix_documents(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, float]:
    """A row per document: doc_id, source, size, source_size, target, reached, taken; and the last finish time taken.

    taken: the words that the mix takes from the document, repeats counted. A
    null text has size 0 and nothing is taken of it; null sources are one source,
    ranked last. Rows that repeat an id within a source, null ids too, stand at
    one place of its queue and are taken together, as are passes of one finish
    time. An empty table gives an empty result; other columns do not matter.
    """
    rows, n = queued(docs, mix, doc_id, source, text)
    rows = cut(rows)
    last = last_finish(rows, n, mix)
    return rows.withColumn("taken", F.col("size") * times_taken(last, mix)), last


def mixed_rows(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: the rows of docs, once for each pass taken, sorted by finish time over all partitions.

    Rows of one finish time come in the order of a hash of their text. Wordless
    and null texts are not in the mix; other rows as in mix_documents. All
    columns stay, of any type and name; an empty table gives an empty result.
    """
    placed, last = mix_documents(docs, mix, doc_id, source, text)
    name = free_name(docs)
    of_id, of_source, at, tie = name("of_id"), name("of_source"), name("at"), name("tie")
    passes = F.explode(F.filter(F.array(*[finish(e) for e in range(mix.epochs)]), lambda x: x <= last)).alias(at)
    placed = placed.filter("taken > 0").dropDuplicates(["doc_id", "source"]).select(F.col("doc_id").alias(of_id), F.col("source").alias(of_source), passes)
    same = F.col(doc_id).eqNullSafe(F.col(of_id)) & F.col(source).eqNullSafe(F.col(of_source))
    taken = docs.filter(word_count(F.col(text)) > 0).join(placed, same).withColumn(tie, F.xxhash64(F.col(text)))
    return taken.repartitionByRange(at, tie).sortWithinPartitions(at, tie).drop(of_id, of_source, at, tie)
