"""Quota sampling: quota tables, and which respondents fill them.

The greedy rule: respondents come in descending order of score; one is accepted
if the main quota of its key has room and no known sub-quota key of it is used
up; then each of them loses one for every time the respondent has the key. With
a main quota alone this is a rank within each key (`allocate_main`). With
sub-quotas `allocate` looks for the place in the order at which each quota is used up, since
a respondent is accepted if no quota of theirs is used up ahead. If no quota ever
were, each would be used up too early; from places that are too early follow ones
that are too late, and from these again early ones, until both agree: from the
first place on, each round settles at least the next one. Respondents with equal
keys are a profile, and of a profile only the first can be accepted, as many as
its least quota has room for. The result is that of the rule itself.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.shared import cut, written

COLUMNS = ("qt1", "qt2", "qt3", "target")
#: Quota tables up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Profiles of which at most so many can be accepted keep that many rows of a start.
HEAD_ROWS = 1_000
#: Chunks of a band of the order by which a round counts.
CHUNKS = 40
#: A place behind all others.
NEVER = (1 << 63) - 1


def normalize_quota(sheet: DataFrame, fill_down: bool = False, order: str | None = None, strict: bool = False) -> DataFrame:
    """The first four columns of a quota sheet as qt1, qt2, qt3, target, whatever their names.

    Fewer columns give an empty table without columns, or an error if strict.
    fill_down takes missing dimension cells from the row above, in the order of
    the column `order`, one of those behind the fourth; a sheet is small.
    """
    if len(sheet.columns) < len(COLUMNS):
        if strict:
            raise ValueError(f"a quota sheet has {len(COLUMNS)} columns at least, this one {len(sheet.columns)}")
        return sheet.sparkSession.createDataFrame([], "struct<>")
    tail = [f"_{i}" for i in range(len(sheet.columns) - len(COLUMNS))]
    named = sheet.toDF(*COLUMNS, *tail)
    if not fill_down:
        return named.select(*COLUMNS)
    if order is None:
        raise ValueError("fill_down needs a column that orders the rows")
    place = named.columns[sheet.columns.index(order)]
    above = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return named.select(*[F.last(c, ignorenulls=True).over(above).alias(c) for c in COLUMNS])


def room(target: Column) -> Column:
    """How many a main quota accepts: the target rounded up; none for NaN, null or less."""
    target = target.cast("double")
    return F.when(F.isnan(target) | target.isNull(), F.lit(0)).otherwise(F.greatest(F.ceil(target), F.lit(0))).cast("long")


def small(df: DataFrame) -> DataFrame:
    """Broadcast if it is within the bound, which is counted; else joined by shuffle, even where files are so small for their rows that Spark would broadcast them."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


def one_target(quota: DataFrame, *keys: str) -> DataFrame:
    """A row per key: of repeated keys the last wins in no defined order, so the largest target does here."""
    return quota.groupBy(*keys).agg(F.max(F.col("target").cast("double")).alias("target"))


def allocate_main(people: DataFrame, quota: DataFrame, key: str, score: str, ident: str) -> DataFrame:
    """Rows (m_key, rank, respondent_id): for each key of quota (m_key, target) the best by score, ties by id.

    Keys that the quota does not have get nobody; a null key matches a null
    one. The order is Spark's for descending numbers: NaN first, null last.
    """
    rooms = one_target(quota, "m_key").select(F.col("m_key").alias("_key"), room(F.col("target")).alias("_room")).filter("_room > 0")
    most = rooms.agg(F.max("_room")).first()[0] or 0
    asked = people.select(F.col(key).alias("m_key"), F.col(score).alias("_score"), F.col(ident).alias("respondent_id"))
    matched = asked.join(small(rooms), F.col("m_key").eqNullSafe(F.col("_key")))
    order = Window.partitionBy("m_key").orderBy(F.col("_score").desc_nulls_last(), "respondent_id")
    ranked = matched.withColumn("rank", F.row_number().over(order))
    # The literal bound lets Spark cut each key's rows before the shuffle.
    return ranked.filter((F.col("rank") <= F.lit(most)) & (F.col("rank") <= F.col("_room"))).select("m_key", "rank", "respondent_id")


def bound(people: DataFrame, quota: DataFrame, key: str) -> DataFrame:
    """Rows (m_key, available, wanted, most): no allocation accepts more than `most` of a key."""
    rooms = one_target(quota, "m_key").select("m_key", room(F.col("target")).alias("wanted"))
    there = people.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("available"))
    both = rooms.join(there, F.col("m_key").eqNullSafe(F.col("_key")), "left")
    available = F.coalesce("available", F.lit(0).cast("long"))
    return both.select("m_key", available.alias("available"), "wanted", F.least(available, "wanted").alias("most"))


def with_key(chosen: DataFrame, people: DataFrame, ident: str = "respondent_id", key: str = "m_key") -> DataFrame:
    """Rows of an allocation with m_key, their respondents' key.

    Only the chosen are ever broadcast: left to itself, Spark planned anew as it ran, took them
    for larger than everyone's ids and keys, and passed these through the driver.
    """
    asked = people.select(F.col(ident).alias("respondent_id"), F.col(key).alias("m_key"))
    return asked.join(small(chosen), "respondent_id")


def shortfall(chosen: DataFrame, quota: DataFrame, key: str = "m_key") -> DataFrame:
    """Rows (m_key, wanted, filled, missing) of an allocation."""
    rooms = one_target(quota, "m_key").select("m_key", room(F.col("target")).alias("wanted"))
    filled = chosen.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("filled"))
    both = rooms.join(filled, F.col("m_key").eqNullSafe(F.col("_key")), "left")
    have = F.coalesce("filled", F.lit(0).cast("long"))
    return both.select("m_key", "wanted", have.alias("filled"), F.greatest(F.col("wanted") - have, F.lit(0)).alias("missing"))


def noise(seed: int, start: Column, ident: Column, deviation: float = 0.5) -> Column:
    """Gaussian noise that seed, start and id determine: Box-Muller over two parts of their MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), start.cast("string"), ident.cast("string")))
    part = lambda a: F.conv(F.substring(digest, a, 12), 16, 10).cast("long").cast("double")
    first, second = (part(1) + 1) / F.lit(float(1 << 48)), part(13) / F.lit(float(1 << 48))
    return F.lit(deviation) * F.sqrt(F.lit(-2.0) * F.ln(first)) * F.cos(F.lit(2.0) * F.pi() * second)


@dataclass(frozen=True)
class Starts:
    """count: of starts, numbered from `first`. seed: of their noise; deviation 0 gives the plain order of scores.

    threshold: accepted respondents that are enough. wave: starts that run at
    once before it is looked at. band_rows: respondents of a part of the order that
    is one task. front_rows: where no start has more rows, a row being a respondent's
    meeting with a quota, each goes by the rule itself, in a task; 0 for rounds alone.
    """

    count: int = 1
    first: int = 0
    wave: int = 16
    seed: int = 42
    deviation: float = 0.5
    threshold: float = float("inf")
    band_rows: int = 200_000
    front_rows: int = 20_000


def _begun(df: DataFrame, starts: Starts) -> DataFrame:
    return df.sparkSession.range(starts.first, starts.first + max(0, starts.count)).select(F.col("id").cast("int").alias("start_id"))


def start_orders(people: DataFrame, starts: Starts, score: str, ident: str, *more: str) -> DataFrame:
    """Rows (start_id, respondent_id, noisy) and the columns `more`: everyone in every start, noisy rounded to 9 decimals; a null score counts as NaN."""
    begun = _begun(people, starts)
    rows = people.select(F.col(ident).alias("respondent_id"), F.coalesce(F.col(score).cast("double"), F.lit(float("nan"))).alias("_score"), *more)
    rows = rows.crossJoin(F.broadcast(begun) if starts.count <= BROADCAST_ROWS else begun)  # a row per start asked for
    added = noise(starts.seed, F.col("start_id"), F.col("respondent_id"), starts.deviation) if starts.deviation else F.lit(0.0)
    return rows.select("start_id", "respondent_id", F.round(F.col("_score") + added, 9).alias("noisy"), *more)


def cells_of(people: DataFrame, main: DataFrame, subs: DataFrame, ident: str, key: str, sub_keys: str) -> DataFrame:
    """Rows (respondent_id, cell, weight, target): the quotas that a respondent meets, the main one and each known sub-quota key.

    Respondents without a main target over 0 are left out, as nothing accepts
    them. weight: how often the respondent has the key. A NaN sub-target never blocks.
    """
    rooms = one_target(main, "m_key").filter((F.col("target") > 0) & ~F.isnan("target")).select(F.col("m_key").alias("_key"), "target")
    asked = people.select(F.col(ident).alias("respondent_id"), F.col(key).alias("m_key"), F.col(sub_keys).alias("_subs"))
    asked = asked.join(small(rooms), F.col("m_key").eqNullSafe(F.col("_key")))
    own = asked.select("respondent_id", F.concat(F.lit("m:"), F.coalesce(F.col("m_key").cast("string"), F.lit("\0"))).alias("cell"), F.lit(1).alias("weight"), "target")
    known = one_target(subs, "sub_id", "key").filter(~F.isnan("target"))
    times = lambda keys: F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("_sub_key"), F.size(F.filter(keys, lambda x: x.eqNullSafe(k))).alias("weight")))
    flat = asked.select("respondent_id", F.posexplode("_subs").alias("_sub", "_keys")).select("respondent_id", "_sub", F.inline(times(F.col("_keys"))))
    met = flat.join(small(known), (F.col("_sub") == F.col("sub_id")) & F.col("_sub_key").eqNullSafe(F.col("key")))
    sub = met.select("respondent_id", F.concat_ws(":", F.lit("s"), F.col("sub_id").cast("string"), F.coalesce("key", F.lit("\0"))).alias("cell"), "weight", "target")
    return own.unionByName(sub)


def _placed(orders: DataFrame, part_rows: int) -> DataFrame:
    """orders with `pos`, a row's place in the order of all starts, from 0 on; the order is sorted in ranges, so no start is one task."""
    parts = int(orders.count() // part_rows) + 1
    order = ("start_id", F.desc("noisy"), "respondent_id")
    # The ranges come from samples, so the part that a row is in is stored.
    ranged = written(orders.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    sizes = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("pos", inside.cast("long")).join(F.broadcast(sizes), "part").withColumn("pos", F.col("pos") - 1 + F.col("ahead")).drop("part", "ahead")


def _profiles(asked: DataFrame, main: DataFrame, subs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (profile, m_key, sub_keys, n, most), and (profile, cells): respondents with the same keys, who meet the same quotas, how many they are and how many of them can be accepted at most."""
    alike = written(asked.groupBy("m_key", "sub_keys").agg(F.count(F.lit(1)).alias("n")).withColumn("profile", F.monotonically_increasing_id()), "alike")
    met = cells_of(alike, main, subs, "profile", "m_key", "sub_keys").groupBy(F.col("respondent_id").alias("profile")).agg(F.collect_list(F.struct("cell", "weight", "target")).alias("cells"))
    most = F.array_min(F.transform("cells", lambda c: F.ceil(c["target"] / c["weight"])))
    met = written(met.withColumn("most", most).filter("most > 0"), "met")
    return alike.join(small(met.select("profile", "most")), "profile"), met.select("profile", "cells")


def _heads(people: DataFrame, profiles: DataFrame, starts: Starts) -> DataFrame:
    """Rows (start_id, respondent_id, noisy, profile) of all who can be accepted: of a profile that few can be accepted of, those alone.

    Accepted ones of a profile are the first of it in a start's order, since the first who is rejected meets a quota
    that stays used up. Where the bound is over HEAD_ROWS all stay, so that no task sorts a large profile.
    """
    few = (F.col("most") <= HEAD_ROWS) & (F.col("most") < F.col("n"))
    keys = profiles.select(F.col("m_key").alias("_key"), F.col("sub_keys").alias("_subs"), "profile", "most", few.alias("few"))
    of = small(keys)
    found = people.join(of, F.col("m_key").eqNullSafe(F.col("_key")) & F.col("sub_keys").eqNullSafe(F.col("_subs")))
    all_, most = keys.agg(F.bool_or(~F.col("few")), F.max(F.when(F.col("few"), F.col("most")))).first()
    orders = lambda rows: start_orders(rows, starts, "_score", "respondent_id", "profile", "most")
    parts = [orders(found.filter("NOT few"))] if all_ or most is None else []
    if most is not None:
        place = F.row_number().over(Window.partitionBy("start_id", "profile").orderBy(F.desc("noisy"), "respondent_id"))
        # The literal bound lets Spark cut each task's rows before the shuffle.
        parts.append(orders(found.filter("few")).withColumn("place", place).filter((F.col("place") <= F.lit(most)) & (F.col("place") <= F.col("most"))))
    return reduce(DataFrame.unionByName, [p.select("start_id", "respondent_id", "noisy", "profile") for p in parts])


def _limits(cells: DataFrame, fills: DataFrame | None, starts: Starts) -> DataFrame:
    """Rows (start_id, profile, asks, last): for each cell of a profile the place up to which its other cells have room, and the place up to which all have, by fills (start_id, cell, fill)."""
    rows = cells.crossJoin(F.broadcast(_begun(cells, starts))).select("start_id", "profile", F.inline("cells"))
    rows = rows.withColumn("fill", F.lit(None).cast("long")) if fills is None else rows.join(small(fills), ["start_id", "cell"], "left")
    rows = rows.groupBy("start_id", "profile").agg(F.collect_list(F.struct("cell", "weight", "target", F.coalesce("fill", F.lit(NEVER)).alias("fill"))).alias("asks"))
    least = F.array_sort(F.transform("asks", lambda c: c["fill"]))
    rows = rows.withColumn("last", least[0]).withColumn("next", F.coalesce(F.get(least, F.lit(1)), F.lit(NEVER)))
    others = lambda c: F.when(c["fill"] == F.col("last"), F.col("next")).otherwise(F.col("last"))
    return written(rows.select("start_id", "profile", F.transform("asks", lambda c: F.struct(c["cell"].alias("cell"), c["weight"].alias("weight"), c["target"].alias("target"), others(c).alias("limit"))).alias("asks"), "last"), "limits")


def _filled(rows: DataFrame, cells: DataFrame, fills: DataFrame | None, starts: Starts) -> DataFrame:
    """Rows (start_id, cell, fill): where each cell is used up if the others are at `fills`, none if they never are; cells that are never used up have no row.

    Weights are summed within chunks of the order first; the rows of the one chunk in which a cell is used up follow.
    """
    limits = small(_limits(cells, fills, starts).select("start_id", "profile", "asks"))
    there = lambda r: r.join(limits, ["start_id", "profile"]).select("start_id", "pos", "chunk", F.inline("asks")).filter("pos <= limit")
    sums = there(rows).groupBy("start_id", "cell", "chunk").agg(F.sum("weight").alias("n"), F.first("target").alias("target"))
    before = Window.partitionBy("start_id", "cell").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    edges = small(written(sums.filter("ahead < target AND ahead + n >= target").select("start_id", "cell", "chunk", "ahead"), "edges"))
    near = rows.join(edges.select("start_id", "chunk").distinct(), ["start_id", "chunk"], "left_semi")
    run = Window.partitionBy("start_id", "cell").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = there(near).join(edges, ["start_id", "cell", "chunk"]).withColumn("taken", F.col("ahead") + F.sum("weight").over(run)).filter("taken >= target")
    return written(last.groupBy("start_id", "cell").agg(F.min("pos").alias("fill")), "fills")


def _round(rows: DataFrame, cells: DataFrame, fills: DataFrame | None, starts: Starts) -> tuple[DataFrame, DataFrame]:
    """Where each cell is used up at the earliest and at the latest, from fills that are not early (none: never)."""
    early = _filled(rows, cells, fills, starts)
    return early, _filled(rows, cells, early, starts)


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """The rule as it stands over one start: the places of the accepted."""
    rows = rows.sort_values("pos", kind="stable")
    taken: dict[str, int] = {}
    places = []
    columns = zip(*(rows[c].tolist() for c in ("pos", "cell", "weight", "target")), strict=True)
    for pos, met in itertools.groupby(columns, key=lambda r: r[0]):
        met = list(met)
        if all(taken.get(cell, 0) < target for _, cell, _, target in met):
            for _, cell, weight, _ in met:
                taken[cell] = taken.get(cell, 0) + weight
            places.append(pos)
    return pd.DataFrame({"pos": pd.Series(places, dtype="int64")})


def allocate(people: DataFrame, main: DataFrame, subs: DataFrame, starts: Starts = Starts(), ident: str = "respondent_id", key: str = "m_key", score: str = "score", sub_keys: str = "sub_keys") -> DataFrame:
    """Rows (start_id, rank, respondent_id) of every start, rank being the order of acceptance.

    people: an id, a key, a score, and for each sub-quota the list of the
    respondent's keys (null: no constraint). main: (m_key, target). subs:
    (sub_id, key, target). Ties in the order go to the lower id; NaN or null
    scores come first. Ids must differ. A round writes tables with a row per start
    and cell or profile, and one number reaches the driver.
    """
    main, subs = written(one_target(main, "m_key"), "main"), written(one_target(subs, "sub_id", "key"), "subs")
    asked = people.select(F.col(ident).alias("respondent_id"), F.col(key).alias("m_key"), F.col(score).alias("_score"), F.col(sub_keys).alias("sub_keys"))
    # Each of few large splits would be one task's orders of all starts.
    asked = written(asked.repartition(people.sparkSession.sparkContext.defaultParallelism), "asked")
    profiles, cells = _profiles(asked, main, subs)
    orders = written(_heads(asked, profiles, starts), "orders")
    placed = _placed(orders, max(1, starts.band_rows // 4))
    chunk = F.floor(F.col("pos") / max(1, starts.band_rows // CHUNKS))
    rows = written(placed.select("start_id", "pos", "respondent_id", "profile", chunk.alias("chunk")), "rows")
    flat = rows.join(small(cells), "profile")
    if (flat.groupBy("start_id").agg(F.sum(F.size("cells")).alias("n")).agg(F.max("n")).first()[0] or 0) <= starts.front_rows:
        settled = flat.select("start_id", "pos", F.inline("cells")).groupBy("start_id").applyInPandas(_in_order, "pos long")
        accepted = rows.join(written(settled, "settled"), "pos")
    else:
        late, differ = None, 1
        while differ:
            early, late = _round(rows, cells, late, starts)
            differ = late.join(early.withColumnRenamed("fill", "other"), ["start_id", "cell"], "full").filter("NOT fill <=> other").count()
        accepted = rows.join(small(_limits(cells, late, starts).select("start_id", "profile", "last")), ["start_id", "profile"]).filter("pos <= last")
    return _ranked(written(accepted.select("start_id", "pos", "respondent_id"), "accepted"), starts.band_rows)


def _ranked(accepted: DataFrame, band_rows: int) -> DataFrame:
    """Ranks in each start, within bands of the order and over their counts."""
    accepted = accepted.withColumn("band", F.floor(F.col("pos") / band_rows))
    ranked = accepted.withColumn("rank", F.row_number().over(Window.partitionBy("start_id", "band").orderBy("pos")))
    before = Window.partitionBy("start_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    counts = accepted.groupBy("start_id", "band").count()
    counts = counts.select("start_id", "band", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    ranked = ranked.join(counts, ["start_id", "band"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    return ranked.select("start_id", F.col("rank").cast("int").alias("rank"), "respondent_id")


def best_start(allocations: DataFrame, starts: Starts) -> int | None:
    """The start to take: the first that reaches the threshold, else the first of those with most accepted; none without starts."""
    if starts.count <= 0:
        return None
    counts = {r["start_id"]: r["n"] for r in allocations.groupBy("start_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    all_ = range(starts.first, starts.first + starts.count)
    reached = [i for i in all_ if counts.get(i, 0) >= starts.threshold]
    return reached[0] if reached else min(all_, key=lambda i: (-counts.get(i, 0), i))


def allocate_best(people: DataFrame, main: DataFrame, subs: DataFrame, starts: Starts = Starts(), **columns: str) -> tuple[int, DataFrame]:
    """Accepted respondents of the best start: their number (-1 without starts) and rows (start_id, rank, respondent_id).

    Starts run in waves; once one has reached the threshold, later waves do not run.
    """
    if starts.count <= 0:
        return -1, allocate(people, main, subs, replace(starts, count=0), **columns)
    best: tuple[int, DataFrame] | None = None
    for first in range(starts.first, starts.first + starts.count, starts.wave):
        wave = replace(starts, first=first, count=min(starts.wave, starts.first + starts.count - first))
        rows = cut(allocate(people, main, subs, wave, **columns))
        chosen = rows.filter(F.col("start_id") == best_start(rows, wave))
        n = chosen.count()
        if best is None or n > best[0]:
            best = n, chosen
        if n >= starts.threshold:
            break
    return best
