"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, runs of one kind a single
one. Capitalised words where a sentence starts may be names or not, so a text is
read twice: there as words, and as names. Windows of template tokens are hashed;
the benchmark's windows are joined with the documents' of the same reading by
hash. Matches of an item along one diagonal of a document must be
slot-consistent: each value in the item's slots goes with the value that stands
for it most often in the document, so that a question with other numbers or
names still matches, but not a text that mixes them at will. Windows that
contradict this do not count, unless their slots are the item's own. A document
is contaminated by an item of which it holds at least the given share of
windows, or an unbroken run of the given length.

A hit holds one at least of any windows of the item that are more than it may
miss. So documents and items meet by the item's windows that are rarest in the
documents alone; common windows are joined for those pairs only.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.common import Memo, cut, free_name, keyed_join, map_batches, prepare

#: Unit words, fixed values.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years hz khz mhz ghz w kw v a ohm j kj n pa kpa "
    "c f k celsius fahrenheit kelvin degrees percent dollar dollars cent cents euro euros pound pounds usd eur gbp kmh mph".split()
)


#: Number words, fixed values.
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice".split()
)

#: Signs that are no part of a word at its ends, fixed values.
STRIPPED = ".,;:!?\"'()[]{}<>«»“”‘’…*_#$€£%&"


@dataclass(frozen=True)
class TemplateSettings:
    """words: template tokens of a window. share: of an item's windows that make a hit. literals: least literal tokens of a window.

    run: template tokens in a row, all in matching windows, that make a hit whatever the share.

    broadcast_windows: rows of benchmark windows up to so many go to every task; beyond, documents' windows are joined by shuffle.
    """

    words: int = 5
    share: float = 0.8
    run: int = 30
    literals: int = 2
    broadcast_windows: int = 500_000


U64 = np.uint64
STEP = U64(0x9E3779B97F4A7C15)
#: Low bits of a coded chunk: its kind, whether it is capitalised, whether a sentence ends with it.
NUMBER, UNIT, NAME = 1, 2, 3
CAPITAL, END, FLAGS = U64(4), U64(8), U64(15)
#: How capitalised words are read where a sentence starts: as words, or as names.
READINGS = (0, 1)


def coded(chunk: bytes) -> int:
    """A chunk between white space as 64 bits: hash of the lower-case core, and in the low bits what it is."""
    word = chunk.decode("utf-8", "replace")
    core = word.strip(STRIPPED)
    low = core.lower()
    kind = 0
    if core.lstrip("-+")[:1].isdigit() or low in NUMBERS:
        kind = NUMBER
    elif low in UNITS:
        kind = UNIT
    flags = kind | (4 if core[:1].isupper() and not core.isupper() else 0) | (8 if word.rstrip("\"'”’)]").endswith((".", "!", "?", ":")) else 0)
    return (xxhash.xxh3_64_intdigest(low.encode()) & ~15) | flags


_CODES = Memo(coded, 500_000)


class Coded:
    """The chunks of some texts, coded, in one array. owner: place of each one's text; first: whether it is the first there."""

    def __init__(self, texts: list[bytes]):
        words = [x.split() for x in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.codes = np.fromiter((c for w in words for c in map(_CODES.__getitem__, w)), U64, int(lengths.sum()))
        self.owner = np.repeat(np.arange(len(words)), lengths)
        self.first = np.ones(len(self.codes), bool)
        self.first[1:] = self.owner[1:] != self.owner[:-1]


def shifted(x: np.ndarray) -> np.ndarray:
    """Each place has what stands before it; the first one has nothing."""
    return np.concatenate([np.zeros(1, x.dtype), x[:-1]])[: len(x)]


class Template:
    """Template tokens of coded texts: kinds (0 for a literal), values and tokens, a run of one placeholder being one token; start: of each one's text."""

    def __init__(self, texts: Coded, reading: int):
        codes, first = texts.codes, texts.first
        kind = (codes & U64(3)).astype(np.int8)
        name = (kind == 0) & ((codes & CAPITAL) > 0)
        if reading == 0:
            name &= ~first & (shifted(codes & END) == 0)
        kind[name] = NAME
        # A unit word counts as one only behind a number.
        kind[(kind == UNIT) & (first | (shifted(kind) != NUMBER))] = 0
        keep = (kind == 0) | first | (kind != shifted(kind))
        self.kind, self.value, self.owner = kind[keep], (codes & ~FLAGS)[keep], texts.owner[keep]
        self.token = np.where(self.kind > 0, self.kind.astype(U64), self.value)
        self.start = np.maximum.accumulate(np.where(first[keep], np.arange(len(self.kind)), 0))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a window starts that ends within the text, and the windows' hashes."""
        n = len(self.token) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, U64)
        total = np.full(n, size, U64)
        for k in range(size):
            total += self.token[k : k + n]
            total *= STEP
            total ^= total >> U64(32)
        at = np.flatnonzero(self.owner[:n] == self.owner[size - 1 :])
        return at, total[at]

    def slots(self, at: int, size: int) -> list[int]:
        part = slice(at, at + size)
        return self.value[part][self.kind[part] > 0].astype(np.int64).tolist()

    def spots(self, at: int, size: int) -> list[int]:
        """Places of the slots of a window in the text."""
        return (np.flatnonzero(self.kind[at : at + size] > 0) + (at - self.start[at])).tolist()


ITEM_SCHEMA = "item_id long, reading int, window long, item_at long, item_slots array<long>, item_spots array<long>, width long"


def item_windows(items: DataFrame, s: TemplateSettings, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (item_id, reading, window, item_at, item_slots, item_spots, width) of the benchmark's usable windows: with enough literal tokens, or all where none has.

    An item of fewer tokens than a window is one window. Items without words have none.
    """

    def rows_of(item: int, text: bytes) -> Iterator[tuple]:
        for reading in READINGS:
            template = Template(Coded([text]), reading)
            size = min(s.words, len(template.token))
            if not size:
                continue
            places, hashes = template.windows(size)
            literals = [int((template.kind[at : at + size] == 0).sum()) for at in places]
            least = min(s.literals, size)
            for at, h, n in zip(places.tolist(), hashes.astype(np.int64).tolist(), literals, strict=True):
                if n >= least or max(literals) < least:
                    yield item, reading, h, at, tuple(template.slots(at, size)), tuple(template.spots(at, size)), size

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            given = zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)
            columns = list(zip(*[r for item, value in given for r in rows_of(item, value or b"")], strict=True)) or [[]] * 7
            types = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in ITEM_SCHEMA.split(", ")])

        return each

    return map_batches(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")), start, ITEM_SCHEMA).distinct()


#: Bytes of texts that are read at once.
TOGETHER = 1 << 20


def document_windows(docs: DataFrame, s: TemplateSettings, doc_id: str, text: str, wanted: np.ndarray | None, widths: tuple[int, ...]) -> DataFrame:
    """Rows (doc_id, body, reading, window, doc_at, doc_slots): all windows of whole texts, or those whose hash is wanted. body names the text."""
    kind = docs.schema[doc_id].dataType.simpleString()
    spark = docs.sparkSession
    wanted_by_task = None if wanted is None else spark.sparkContext.broadcast(wanted)

    def start():
        _CODES.use()
        keep = None if wanted_by_task is None else wanted_by_task.value
        if keep is not None:  # most windows are turned away by their low bits
            mask = U64((1 << max(16, (16 * len(keep)).bit_length())) - 1)
            low = np.zeros(int(mask) + 1, bool)
            low[keep & mask] = True

        def found(texts: list[bytes], first: int) -> Iterator[tuple]:
            coded_ = Coded(texts)
            for reading in READINGS:
                template = Template(coded_, reading)
                for size in widths:
                    at, hashes = template.windows(size)
                    if keep is not None:
                        some = np.flatnonzero(low[hashes & mask])
                        some = some[keep[np.minimum(np.searchsorted(keep, hashes[some]), len(keep) - 1)] == hashes[some]]
                        at, hashes = at[some], hashes[some]
                    for p, h in zip(at.tolist(), hashes.astype(np.int64).tolist(), strict=True):
                        yield first + int(template.owner[p]), reading, h, p - int(template.start[p]), template.slots(p, size)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[tuple] = []
            held, size, first = [], 0, 0
            for row, value in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                if held and size + len(value or b"") > TOGETHER:
                    rows += found(held, first)
                    held, size, first = [], 0, row
                held.append(value or b"")
                size += len(held[-1])
            rows += found(held, first)
            places, *columns = list(zip(*rows, strict=True)) or [[]] * 5
            at, types = pa.array(places, pa.int64()), (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            arrays = [batch.column(0).take(at), batch.column(2).take(at), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "body", "reading", "window", "doc_at", "doc_slots"])

        return each

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("body"))
    return map_batches(rows, start, f"doc_id {kind}, body long, reading int, window long, doc_at long, doc_slots array<long>")


def deciding(windows: DataFrame, found: DataFrame, s: TemplateSettings) -> DataFrame:
    """Rows (item_id, reading, window): of each item the windows of which a hit holds one at least, the rarest in the documents.

    A hit by its share misses 1 - share of the places at most, so one more of
    them than these are enough. One by its run has no gap beyond a window's
    length, and so a place in each segment of that length on its way; it passes
    all segments of one block at least: of each block the rarest segment.
    """
    counts = cut(found.groupBy(F.col("reading").alias("r"), F.col("window").alias("w")).agg(F.count(F.lit(1)).alias("n")))
    places = keyed_join(windows, counts, (F.col("reading") == F.col("r")) & (F.col("window") == F.col("w")), "left")
    places = places.select("item_id", "reading", "window", "item_at", F.coalesce("n", F.lit(0)).alias("n"))
    segments = (s.run - s.words + 1) // 2 // s.words
    if not segments:  # a run may be too short to pass a segment
        return places.select("item_id", "reading", "window").distinct()
    item = Window.partitionBy("item_id", "reading")
    places = places.withColumn("segment", F.floor(F.col("item_at") / s.words))
    places = places.withColumn("block", F.floor(F.col("segment") / segments)).withColumn("held", F.sum("n").over(Window.partitionBy("item_id", "reading", "segment")))
    rank = F.row_number().over(item.orderBy("n", "window", "item_at"))
    in_block = F.rank().over(Window.partitionBy("item_id", "reading", "block").orderBy("held", "segment"))
    ranked = places.select("*", rank.alias("rank"), in_block.alias("in_block"), F.count(F.lit(1)).over(item).alias("all"))
    return ranked.filter((F.col("rank") <= F.floor((1 - s.share) * F.col("all") + 1e-9) + 1) | (F.col("in_block") == 1)).select("item_id", "reading", "window").distinct()


def agreeing(windows: list[dict]) -> tuple[list[int], bool, int]:
    """Of the matches on one diagonal: the item's places that are slot-consistent, whether all slots are the item's own, the longest run in tokens.

    An item's value goes with the value that most of its occurrences have in the
    document; of several with the most, with itself if it is one, else with none.
    """
    stands: dict[int, set] = defaultdict(set)
    for w in windows:
        for spot, own, other in zip(w["item_spots"], w["item_slots"], w["doc_slots"], strict=True):
            stands[own].add((spot, other))
    goes = {}
    for own, found in stands.items():
        votes = Counter(other for _, other in found)
        most = max(votes.values())
        best = [v for v, n in votes.items() if n == most]
        goes[own] = own if own in best else best[0] if len(best) == 1 else None
    places, exact = {}, True
    for w in windows:
        same = w["item_slots"] == w["doc_slots"]
        exact = exact and same
        if same or [goes[v] for v in w["item_slots"]] == w["doc_slots"]:
            places[w["item_at"]] = w["width"]
    run = first = last = 0
    for at in sorted(places):
        first = at if not run or at - last > places[at] else first
        run, last = max(run, at - first + places[at]), at
    return sorted(places), exact, run


def agreeing_lines(lines: DataFrame) -> DataFrame:
    """Rows (doc_id, body, item_id, reading, places, exact, run) for rows (doc_id, body, item_id, reading, windows), but for those without a consistent window."""
    kind = lines.schema["doc_id"].dataType.simpleString()

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            places, exact, run = zip(*map(agreeing, batch.column(4).to_pylist()), strict=True)
            columns = [*batch.columns[:4], pa.array(places, pa.list_(pa.int64())), pa.array(exact, pa.bool_()), pa.array(run, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "body", "item_id", "reading", "places", "exact", "run"])

        return each

    found = map_batches(lines, start, f"doc_id {kind}, body long, item_id long, reading int, places array<long>, exact boolean, run long")
    return found.filter(F.size("places") > 0)


def contaminated(docs: DataFrame, items: DataFrame, s: TemplateSettings = TemplateSettings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per contaminated document and item: doc_id, body, item_id, n_windows, matched, share, exact.

    Of the two readings the one with the larger share counts, the first where
    they are equal. n_windows: the item's windows; matched: those the document
    holds, without windows that contradict their diagonal; exact: whether all
    slot values are the item's own. A hit by its run alone has a share below the
    given one. body is a hash of the text: rows that repeat both id and text are
    one, and texts of null ids stay apart. Null or wordless texts and items
    match nothing; empty tables give an empty result; other columns do not matter.
    An item is its id and its text: item_id has any type, null ids are judged like
    others, and of several texts under one id the one with the largest share is
    reported. Rows that repeat an item count once.
    """
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    key = F.xxhash64(F.col("item_id").isNull(), F.col("item_id").cast("string"), "text").alias("item_key")
    items = items.select(F.col("item_id"), F.col("text")).select("item_id", "text", key)
    named = cut(items.select("item_key", F.col("item_id").alias("own_id")).distinct())
    windows = cut(item_windows(items, s, "item_key"))
    rows = windows.count()
    few = rows <= s.broadcast_windows
    widths = tuple(sorted(r["width"] for r in windows.select("width").distinct().collect()))
    # Bounded: no more than broadcast_windows hashes of 8 bytes.
    wanted = np.sort(np.array([r["window"] for r in windows.select("window").distinct().toLocalIterator()], np.int64).view(U64)) if few and rows else None
    if not rows:
        docs = docs.limit(0)
    found = document_windows(docs, s, doc_id, text, wanted, widths or (s.words,))
    if not few:
        found = found.join(windows.select("window").distinct(), "window", "left_semi")
    found = cut(found)
    met = deciding(windows, found, s)
    near = found.select("doc_id", "body", "reading", "window").join(F.broadcast(met) if few else cut(met), ["reading", "window"])
    near = near.select(F.col("doc_id").alias("near_id"), F.col("body").alias("near_body"), "item_id", F.col("reading").alias("near_reading")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("near_id")) & (F.col("body") == F.col("near_body")) & (F.col("reading") == F.col("near_reading"))
    found = found.join(near, same).drop("near_id", "near_body", "near_reading")
    found = found.join(F.broadcast(windows) if few else windows, ["item_id", "reading", "window"])
    match = F.struct("item_at", "width", "item_spots", "item_slots", "doc_slots").alias("match")
    found = found.select("doc_id", "body", "item_id", "reading", (F.col("doc_at") - F.col("item_at")).alias("diagonal"), match)
    # A diagonal holds each place of the item once at most.
    lines = found.groupBy("doc_id", "body", "item_id", "reading", "diagonal").agg(F.collect_set("match").alias("windows")).drop("diagonal")
    hits = agreeing_lines(lines).groupBy("doc_id", "body", "item_id", "reading").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("matched"), F.min("exact").alias("exact"), F.max("run").alias("run")
    )
    totals = windows.groupBy("item_id", "reading").agg(F.count(F.lit(1)).alias("n_windows"))
    hits = hits.join(F.broadcast(totals) if few else cut(totals), ["item_id", "reading"]).withColumn("share", F.col("matched") / F.col("n_windows"))
    hits = hits.filter((F.col("share") >= s.share) | (F.col("run") >= s.run))
    hits = keyed_join(hits.withColumnRenamed("item_id", "item_key"), named, "item_key").withColumnRenamed("own_id", "item_id")
    best = F.max(F.struct("share", -F.col("reading"), "n_windows", "matched", "exact")).alias("best")
    return hits.groupBy("doc_id", "body", "item_id").agg(best).select("doc_id", "body", "item_id", "best.n_windows", "best.matched", "best.share", "best.exact")


def keep_clean(docs: DataFrame, items: DataFrame, s: TemplateSettings = TemplateSettings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns whatever their names, that no item contaminates. Null and wordless texts stay, empty tables too."""
    name = free_name(docs)
    gone_id, gone_body = name("gone"), name("body")
    gone = contaminated(docs, items, s, doc_id, text).select(F.col("doc_id").alias(gone_id), F.col("body").alias(gone_body)).distinct()
    return docs.join(gone, docs[doc_id].eqNullSafe(F.col(gone_id)) & (F.xxhash64(docs[text]) == F.col(gone_body)), "left_anti")
