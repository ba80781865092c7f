"""Near-duplicates by circulant MinHash and exact Jaccard verification.

Two permutations give all signature coordinates: the first scatters a
document's shingles, and coordinate k is the least value of the second one
circularly shifted by k. Bands of coordinates give candidate buckets.

Documents with one shingle set are one class from the start. Candidate groups,
the components of shared buckets, are small as a rule: each is verified whole,
all pairs, in one place. A group over `group_rows` is dealt out: its buckets are
cut into blocks of bounded size and verified block by block. In buckets that
still hold several components, the members outside of the largest one are
compared with all that they can still be linked with: those that share one of
their rarest shingles, as many as a link leaves room for (an exact prefix
filter), again block by block, so no linked pair of a bucket is left out however
large the bucket is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm import graph
from panelspark.llm.common import Memo, cut, free_name, keyed_join, map_batches, prepare, written


@dataclass(frozen=True)
class NearSettings:
    """words: of a shingle. percent: least 100 * intersection / union of a link. bands x rows: signature coordinates.

    group_rows: most documents that are compared in one place.
    """

    words: int = 5
    percent: int = 80
    bands: int = 28
    rows: int = 5
    group_rows: int = 128


U64 = np.uint64
#: Multipliers of the word hash's polynomial and of the two permutations, odd numbers.
STEP, SCATTER = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9)
PI_A, PI_B = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
WORDS = 500_000
_WORDS = Memo(xxhash.xxh3_64_intdigest, WORDS)


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; with fewer words, of the whole sequence; none without words."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=size)], U64) if words else np.empty(0, U64)
    ids = np.fromiter(map(_WORDS.__getitem__, words), U64, len(words))
    n = len(ids) - size + 1
    total = ids[:n].copy()
    for k in range(1, size):
        total *= STEP
        total += ids[k : k + n]
    total ^= total >> U64(32)
    return np.unique(total)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """A row of coordinates for each non-empty set."""
    offsets = np.cumsum([0, *map(len, sets[:-1])])
    scattered = np.concatenate(sets) * SCATTER
    scattered = (scattered ^ (scattered >> U64(29))) * STEP >> U64(32)
    place = scattered.astype(np.uint32)
    out = np.empty((len(sets), coordinates), np.uint32)
    value, high = np.empty_like(place), np.empty_like(place)
    for k in range(coordinates):  # the second permutation, shifted by k
        np.subtract(place, np.uint32(k), out=value)
        value *= PI_A
        np.right_shift(value, 15, out=high)
        value ^= high
        value *= PI_B
        out[:, k] = np.minimum.reduceat(value, offsets)
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """64-bit keys, one a band; the band's number enters."""
    parts = signature.reshape(len(signature), bands, -1).astype(U64)
    key = np.arange(1, bands + 1, dtype=U64) * SCATTER
    for k in range(parts.shape[2]):
        key = (key ^ parts[:, :, k]) * STEP
        key ^= key >> U64(31)
    return key.astype(np.int64)


def set_class(shingle_set: np.ndarray) -> int | None:
    return int(np.int64(xxhash.xxh3_64_intdigest(shingle_set.tobytes()) - (1 << 63))) if len(shingle_set) else None


def linked(sets: list[np.ndarray], others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets are linked with which of the others: 100 * intersection >= percent * union, exactly."""
    lengths, first = np.array([len(s) for s in sets + others]), len(sets)
    everything = np.concatenate(sets + others)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(everything, kind="stable")
    everything, owner = everything[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], everything[1:] != everything[:-1]]))
    counts = np.diff(np.append(start, len(everything)))
    shared = np.repeat(counts > 1, counts)
    column = np.repeat(np.cumsum(counts > 1) - 1, counts)[shared]
    owner = owner[shared]
    common = np.zeros((first, len(others)), np.float32)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + 8192, 8192))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            held = np.zeros((len(lengths), 8192), np.float32)
            held[owner[a:b], column[a:b] % 8192] = 1
            common += held[:first] @ held[first:].T
    exact = common.astype(np.int64)
    return 100 * exact >= percent * (lengths[:first, None] + lengths[None, first:] - exact)


def roots(links: np.ndarray) -> np.ndarray:
    """The least place reachable from each, over a symmetric matrix of links."""
    label = np.arange(len(links))
    links = links | np.eye(len(links), dtype=bool)
    while True:
        new = np.where(links, label[None, :], len(links)).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches by their first `keys` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])


def sketches(docs: DataFrame, doc_id: str, text: str, s: NearSettings) -> DataFrame:
    """A row per document: doc_id, body (hash of the text), cls (of its shingle set; null without words), n_shingles, bands (keys)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def start():
        _WORDS.use()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(x or b"", s.words) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            keys: list = [[] for _ in sets]
            full = [i for i, x in enumerate(sets) if len(x)]
            while full:  # as many documents at once as make about 65,536 shingles
                many = int(np.searchsorted(np.cumsum([len(sets[i]) for i in full]), 65_536)) + 1
                part, full = full[:many], full[many:]
                for i, k in zip(part, band_keys(signatures([sets[i] for i in part], s.bands * s.rows), s.bands), strict=True):
                    keys[i] = k
            columns = [batch.column(0), batch.column(2), pa.array(map(set_class, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "body", "cls", "n_shingles", "bands"])

        return each

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("body"))
    return map_batches(rows, start, f"doc_id {kind}, body long, cls long, n_shingles long, bands array<long>")


def verified_groups(rows: DataFrame, s: NearSettings) -> DataFrame:
    """rows (grp, cls, text), each group small -> (a, b): class and the least class linked with it, through others or not."""

    def run(batches):
        _WORDS.use()
        for group in runs(batches, 1):
            sets = {set_class(x): x for x in (shingles((t or "").encode(), s.words) for _, _, t in group)}
            classes = sorted({c for _, c, _ in group} & sets.keys())  # rows that repeat an id with another text drop out
            if len(classes) > 1:
                held = [sets[c] for c in classes]
                root = roots(linked(held, held, s.percent))
                yield edge_batch([(classes[i], classes[r]) for i, r in enumerate(root) if i != r])

    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "a long, b long")


def class_sets(rows: DataFrame, s: NearSettings) -> DataFrame:
    """rows (cls, text) -> (cls, shingles): the classes' sets as bytes."""

    def start():
        _WORDS.use()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(x or b"", s.words) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            same = pa.array([set_class(x) == c for x, c in zip(sets, batch.column(0).to_pylist(), strict=True)])
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], ["cls", "shingles"])
            return out.filter(same)

        return each

    return map_batches(rows.select("cls", "text"), start, "cls long, shingles binary").dropDuplicates(["cls"])


def block_links(rows: DataFrame, s: NearSettings) -> DataFrame:
    """rows (key, block, asked, cls, root, shingles) -> edges (a, b).

    asked false: the block's members, no more than about group_rows. asked true:
    members from anywhere in the bucket, compared with those of another root in
    runs of bounded length. Without any asked row the members are compared with
    each other.
    """

    def run(batches):
        for members, more in blocks(batches):
            classes, marks, sets = members
            if more is None:
                root = roots(linked(sets, sets, s.percent))
                edges = [(classes[i], classes[r]) for i, r in enumerate(root) if i != r]
            else:
                links = linked(more[2], sets, s.percent) & (np.array(more[1])[:, None] != np.array(marks)[None, :])
                edges = sorted({(more[1][i], marks[j]) for i, j in np.argwhere(links)})
            if edges:
                yield edge_batch(edges)

    def blocks(batches):
        """The members of each block alone, if none asks, else with up to group_rows asking at a time."""
        key, members, more = None, None, None
        fresh = lambda: ([], [], [])
        asked_any = False
        for batch in batches:
            for *at, asked, cls, root, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != key:
                    if members and members[0]:
                        if more[0]:
                            yield members, more
                        elif not asked_any:
                            yield members, None
                    key, members, more, asked_any = at, fresh(), fresh(), False
                into = more if asked else members
                asked_any |= asked
                for column, value in zip(into, (cls, root, np.frombuffer(held, U64)), strict=True):
                    column.append(value)
                if len(more[0]) >= s.group_rows and members[0]:
                    yield members, more
                    more = fresh()
        if members and members[0]:
            if more[0]:
                yield members, more
            elif not asked_any:
                yield members, None

    dealt = rows.select("key", "block", "asked", "cls", "root", "shingles")
    return dealt.repartition("key", "block").sortWithinPartitions("key", "block", "asked").mapInArrow(run, "a long, b long")


#: Counters of shingles, and the parts that they are summed in: 4 MB in all, whatever the input.
SLOTS, PARTS = 1 << 19, 64


def slots_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens * SCATTER >> U64(64 - 19)).astype(np.int64)


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """sets (shingles) -> how many sets' shingles fall on each of SLOTS counters; each task sends its counters that are not 0."""

    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for held in batch.column(0).to_pylist():
                np.add.at(total, slots_of(np.frombuffer(held, U64)), 1)
        for part, counts in enumerate(np.split(total, PARTS)):
            at = np.flatnonzero(counts)
            if len(at):
                yield counters(part, at, counts[at])

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, at, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                totals.setdefault(part, np.zeros(SLOTS // PARTS, np.int64))[np.frombuffer(at, np.int64)] += np.frombuffer(counts, np.int64)
        for part, counts in totals.items():
            yield counters(part, np.arange(len(counts)), counts)

    def counters(part: int, at: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([part]), pa.array([at.tobytes()]), pa.array([counts.tobytes()])]
        return pa.RecordBatch.from_arrays(columns, ["part", "at", "counts"])

    schema = "part long, at binary, counts binary"
    summed = sets.select("shingles").mapInArrow(count, schema).repartition("part").mapInArrow(add, schema)
    out = np.zeros((PARTS, SLOTS // PARTS), np.int64)
    for row in summed.select("part", "counts").collect():  # PARTS rows at most
        out[row.part] = np.frombuffer(row.counts, np.int64)
    return out.ravel()


def rare_shingles(there: DataFrame, sets: DataFrame, s: NearSettings) -> DataFrame:
    """there (cls, root, asker), sets (cls, shingles) -> (key, cls, root, asker, size, here, indexed): each class's rarest shingles, as far as others have them.

    Shingles are in order of their counters over these classes, the rarest
    first. Linked sets x and y, x no larger, share at least percent / (100 + percent)
    of their sizes' sum, so the rarest one they share has at least 2 * percent / (100 + percent)
    of x's shingles from it on (indexed) and at least percent / 100 of y's. Two
    sets that meet in no shingle that one of them has indexed are not linked, in
    whatever order, so counters that several shingles share cost work alone.
    here is the number of the class's shingles from this one on. Shingles of a
    counter of 1, of a single class or of no asker give no rows in the end.
    """
    held = keyed_join(sets, there, "cls").select("cls", "root", "asker", "shingles")
    counts = there.sparkSession.sparkContext.broadcast(shingle_counts(held))

    def run(batches):
        for batch in batches:
            for cls, root, asker, shingle_bytes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = np.frombuffer(shingle_bytes, U64)
                n = len(tokens)
                of = counts.value[slots_of(tokens)]
                order = np.lexsort((tokens, of))[: n - (n * s.percent + 99) // 100 + 1]
                here = n - np.arange(len(order))
                order, here = order[of[order] > 1], here[of[order] > 1]
                for at in range(0, len(order), 65_536):
                    part, left = order[at : at + 65_536], here[at : at + 65_536]
                    same = [pa.repeat(v, len(part)) for v in (pa.scalar(cls, pa.int64()), pa.scalar(root, pa.int64()), pa.scalar(asker), pa.scalar(n, pa.int64()))]
                    indexed = pa.array(left * (100 + s.percent) >= n * 2 * s.percent)
                    yield pa.RecordBatch.from_arrays([pa.array(tokens[part].view(np.int64)), *same, pa.array(left), indexed], names)

    names = ["key", "cls", "root", "asker", "size", "here", "indexed"]
    rare = cut(held.mapInArrow(run, "key long, cls long, root long, asker boolean, size long, here long, indexed boolean"))
    met = rare.groupBy("key").agg(F.count("cls").alias("n"), F.max("asker").alias("some")).filter("n > 1 AND some").select("key")
    return keyed_join(rare, cut(met), "key")


def dealt_by_shingles(rare: DataFrame, s: NearSettings) -> DataFrame:
    """Rows of rare_shingles -> (key, block, asked, cls, root) for block_links.

    Askers meet the sets no larger that have a shingle indexed, and askers that
    have it indexed meet the others' sets no smaller, in blocks of about group_rows.
    A set is asked only if of its size (to about 5 percent) it can be linked with the
    asker when they share but the `here` shingles from this one on.
    """
    p, size, here = s.percent, F.col("size"), F.col("here")
    most = F.floor(here * (100 + p) / p) - size
    asker, indexed = F.col("asker"), F.col("indexed")
    smaller = _dealt(rare, indexed, asker, F.ceil(size * p / 100), F.least(size, most), 1, s)
    return smaller.unionByName(_dealt(rare, ~asker, asker & indexed, size, F.least(F.floor(size * 100 / p), most), -1, s))


def _dealt(rare: DataFrame, held: Column, asks: Column, low: Column, high: Column, sign: int, s: NearSettings) -> DataFrame:
    """Members where held, in blocks numbered from 1 with the sign, and the rows that ask those of sizes low to high.

    Where the same members hold several shingles, a class asks them once.
    """

    def bin_of(size: Column) -> Column:
        return F.floor(F.log(size) * 20)

    members = rare.filter(held).select("key", "cls", "root", bin_of(F.col("size")).alias("bin"))
    hashes = [F.bit_xor(F.xxhash64("cls")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("h2")]
    facts = cut(members.groupBy("key", "bin").agg(F.count("cls").alias("n"), *hashes))
    alike = cut(facts.groupBy("n", "h1", "h2").agg(F.min(F.struct("key", "bin")).alias("one")))
    facts = cut(keyed_join(facts, alike, ["n", "h1", "h2"]).select("key", "bin", "n", F.xxhash64("one", F.lit(sign)).alias("group"), (F.struct("key", "bin") == F.col("one")).alias("first")))
    many = F.ceil(F.col("n") / s.group_rows)
    bins = F.explode(F.sequence(bin_of(low), bin_of(high))).alias("bin")
    asking = keyed_join(rare.filter(asks & (low <= high)).select("key", "cls", "root", bins), facts, ["key", "bin"])
    asking = cut(asking.select("group", "n", "cls", "root").distinct())
    asked = cut(asking.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high")))
    members = keyed_join(members, facts.filter("first"), ["key", "bin"])
    members = keyed_join(members, asked, "group").filter("low <> high OR low <> root")
    members = members.select(F.col("group").alias("key"), (sign * (1 + F.pmod(F.xxhash64("cls", "group"), many))).alias("block"), F.lit(False).alias("asked"), "cls", "root")
    blocks = F.explode(F.sequence(F.lit(1).cast("long"), many)).alias("at")
    asking = asking.select("group", "cls", "root", blocks).select(F.col("group").alias("key"), (sign * F.col("at")).alias("block"), F.lit(True).alias("asked"), "cls", "root")
    met = cut(members.select("key", "block").distinct())
    return members.unionByName(keyed_join(asking, met, ["key", "block"]))


def hot_components(buckets: DataFrame, sets: DataFrame, s: NearSettings) -> DataFrame:
    """buckets (key, n, cls) of large groups, with their classes' sets -> (node, root)."""
    block = F.pmod(F.xxhash64("cls", "key"), F.ceil(F.col("n") / s.group_rows)).alias("block")
    members = cut(buckets.select("key", "n", "cls", block))
    first = members.join(sets, "cls").select("key", "block", F.lit(False).alias("asked"), "cls", F.col("cls").alias("root"), "shingles")
    edges = cut(block_links(first, s).distinct())
    found = graph.components(edges)
    marked = members.join(found, members["cls"] == found["node"], "left")
    marked = cut(marked.select("key", "cls", F.coalesce("root", "cls").alias("root")))
    counts = marked.groupBy("key", "root").count()
    largest = counts.groupBy("key").agg(F.max(F.struct("count", "root"))["root"].alias("main"), F.count("root").alias("roots"))
    open_keys = cut(largest.filter("roots > 1").select("key", "main"))
    left = keyed_join(marked, open_keys, "key")
    there = cut(left.groupBy("cls", "root").agg(F.max(F.col("root") != F.col("main")).alias("asker")))
    if not there.take(1):
        return found
    dealt = cut(dealt_by_shingles(cut(rare_shingles(there, sets, s)), s))
    second = block_links(dealt.join(sets, "cls"), s).distinct()
    return graph.components(edges.unionByName(second))


def near_components(docs: DataFrame, s: NearSettings = NearSettings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, body, n_shingles, component_id (least id reachable over links), kept (doc_id = component_id).

    A null or wordless text has no shingles and links with nothing; whole texts
    are read. Rows of one shingle set are one class, so repeated rows share a
    component. A null id counts only where no id is reachable: component_id is
    null then and the row is kept. An empty table gives an empty result; other
    columns do not matter, whatever their names.
    """
    prepare(docs.sparkSession)
    sketched = written(sketches(docs, doc_id, text, s), "sketches")
    some = sketched.filter("cls IS NOT NULL")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "body"))
    classes = some.groupBy("cls").agg(least.alias("least"), F.count("cls").alias("copies"))
    classes = cut(classes.select("cls", F.col("least.doc_id").alias("id"), F.col("least.body").alias("id_body"), "copies"))
    keyed = some.select("cls", "bands").dropDuplicates(["cls"]).select("cls", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("cls").alias("n"), F.min("cls").alias("leader")).filter("n > 1")
    shared = cut(keyed_join(keyed, cut(buckets), "key"))
    groups = cut(graph.components(shared.select(F.col("cls").alias("a"), F.col("leader").alias("b"))))
    large = cut(groups.groupBy(F.col("root").alias("big")).count().filter(F.col("count") > s.group_rows).select("big"))
    groups = keyed_join(groups, large, F.col("root") == F.col("big"), "left")
    groups = cut(groups.select(F.col("node").alias("cls"), F.col("root").alias("grp"), F.col("big").isNotNull().alias("hot")))
    wanted = groups.join(classes.select("cls", "id", "id_body"), "cls")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("own_body"))
    # By id and text: many rows may have a null or repeated id.
    texts = written(own.join(wanted, own["doc_id"].eqNullSafe(wanted["id"]) & (own["own_body"] == wanted["id_body"])).select("grp", "hot", "cls", "text"), "near-texts")
    edges = cut(verified_groups(texts.filter("NOT hot").select("grp", "cls", "text"), s))
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    hot = groups.filter("hot").select("cls")
    if hot.take(1):
        sets = written(class_sets(texts.filter("hot"), s), "sets")
        found = found.unionByName(hot_components(shared.join(hot, "cls").select("key", "n", "cls"), sets, s))
    found = cut(found.filter("node <> root"))
    found = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    of = cut(classes.select("cls", "id").join(found, F.col("cls") == F.col("node")).select("cls", "id", "root"))
    least = cut(of.groupBy("root").agg(F.min("id").alias("least_id")))
    linked_ = keyed_join(of, least, "root").select(F.col("cls").alias("linked_cls"), "least_id")
    labels = classes.select("cls", "id").join(linked_, F.col("cls") == F.col("linked_cls"), "left")
    own = F.when(F.col("linked_cls").isNull(), F.col("id")).otherwise(F.col("least_id"))
    labels = cut(labels.select(F.col("cls").alias("of_cls"), own.alias("component_id")))
    rows = sketched.select("doc_id", "body", "cls", "n_shingles").join(labels, F.col("cls") == F.col("of_cls"), "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    rows = rows.select("doc_id", "body", "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, s: NearSettings = NearSettings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, but for all of a component that are not its least id.

    Rows that repeat the kept id stay, as far as they repeat.
    """
    name = free_name(docs)
    gone_id, gone_body = name("gone"), name("body")
    gone = near_components(docs, s, doc_id, text).filter("NOT kept").select(F.col("doc_id").alias(gone_id), F.col("body").alias(gone_body)).distinct()
    return docs.join(gone, docs[doc_id].eqNullSafe(F.col(gone_id)) & (F.xxhash64(docs[text]) == F.col(gone_body)), "left_anti")
