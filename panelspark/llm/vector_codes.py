"""Codes for vectors: product quantisation trained by the filtering form of Lloyd's algorithm.

Vectors are cut into equal parts; each part position has a codebook of its own.
Every partition builds kd-trees over its parts, a block of vectors at a time, with
the bounding box, the sum and the count of every node, and writes them to the
shared folder once. In each round the codebooks' entries go down the trees: an
entry stays a candidate of a node unless another one is nearer to all of its box;
a node with one candidate left gives it its whole sum and count. Only sums by
entry leave a task. All numbers are integers, so any order gives the same codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import keyed_join, prepare, written

#: Integer components stay below this, so that squares of four times as much, summed over a part of up to 16 components, stay below 2^63.
MOST = 1 << 27
#: Below this, distances within parts of up to 64 components are exact in doubles too.
DOUBLE_MOST = 1 << 22


@dataclass(frozen=True)
class CodeSettings:
    """scale: of components before they are rounded down. entries: 256 at most, as a code has two digits. block: vectors whose trees are built together. leaf: most parts of a leaf, about."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    block: int = 4_096
    leaf: int = 16


@dataclass
class Trees:
    """kd-trees over the parts of a block, one for each part position: level l of a tree has 2^l nodes of equal size.

    points: (position, place in the tree, component); perm: the vector at each
    place. weight is 0 for places that fill up the last leaves. low, high, sums,
    counts: one array per level, (position, node, component) or (position, node).
    """

    points: np.ndarray
    perm: np.ndarray
    weight: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]
    counts: list[np.ndarray]


def build_trees(cut: np.ndarray, leaf: int) -> Trees:
    """cut: (position, vector, component). Nodes are halved at the median of their widest component."""
    positions, n, width = cut.shape
    depth = max(0, int(np.ceil(np.log2(n / leaf))))
    size = -(-n // (1 << depth)) << depth
    # Places beyond n repeat the last vector without weight, so they widen no box.
    perm = np.broadcast_to(np.minimum(np.arange(size), n - 1), (positions, size)).copy()
    weight = np.broadcast_to(np.arange(size) < n, (positions, size)).astype(np.int64)
    points = np.take_along_axis(cut, perm[:, :, None], 1)
    low, high = [], []
    for level in range(depth + 1):
        shape = (positions, 1 << level, size >> level, width)
        grouped = points.reshape(shape)
        low.append(grouped.min(2))
        high.append(grouped.max(2))
        if level == depth:
            break
        widest = (high[-1] - low[-1]).argmax(2)
        along = np.take_along_axis(grouped, widest[:, :, None, None], 3)[..., 0]
        by = along.argsort(2, kind="stable").astype(np.int64)
        flat = (by + (np.arange(1 << level) * (size >> level))[None, :, None]).reshape(positions, size)
        points = np.take_along_axis(points, flat[:, :, None], 1)
        perm = np.take_along_axis(perm, flat, 1)
        weight = np.take_along_axis(weight, flat, 1)
    sums, counts = [], []
    for level in range(depth + 1):
        parts = (points * weight[:, :, None]).reshape(positions, 1 << level, -1, width)
        sums.append(parts.sum(2))
        counts.append(weight.reshape(positions, 1 << level, -1).sum(2))
    return Trees(points, perm, weight, low, high, sums, counts)


def assigned(trees: Trees, books: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Which entry takes which places: (level, position, node, entry) of nodes taken whole, then (-1, position, place, entry) of single places.

    books: (position, entry, component). Of entries equally near the first one
    takes a part. An entry is dropped for a box if the one nearest to the box's
    middle is nearer at every corner, or as near and earlier.
    """
    positions, entries, _ = books.shape
    squares = (books * books).sum(2)
    where, node = np.arange(positions), np.zeros(positions, np.int64)
    alive = np.ones((positions, entries), bool)
    far = np.iinfo(np.int64).max
    last = len(trees.low) - 1
    for level in range(last + 1):
        low, high, book = trees.low[level][where, node], trees.high[level][where, node], books[where]
        gap = 2 * book - (low + high)[:, None, :]
        near = np.where(alive, (gap * gap).sum(2), far).argmin(1)
        best = book[np.arange(len(where)), near]
        # The least of |p - z|^2 - |p - best|^2 over the box, which is linear in p.
        step = book - best[:, None, :]
        corner = np.where(step > 0, high[:, None, :], low[:, None, :])
        least = squares[where] - squares[where, near][:, None] - 2 * (corner * step).sum(2)
        later = np.arange(entries)[None, :] > near[:, None]
        alive &= ~((least > 0) | (least == 0) & later)
        one = alive.sum(1) == 1
        yield np.full(one.sum(), level), where[one], node[one], near[one]
        where, node, alive = where[~one], node[~one], alive[~one]
        if not len(where):
            return
        if level < last:
            where, alive = np.repeat(where, 2), np.repeat(alive, 2, 0)
            node = np.stack([2 * node, 2 * node + 1], 1).ravel()
    size = trees.points.shape[1] >> last
    place = (node[:, None] * size + np.arange(size)[None, :]).ravel()
    where, alive = np.repeat(where, size), np.repeat(alive, size, 0)
    # Up to DOUBLE_MOST all products and sums are whole numbers below 2^53, exact as doubles.
    kind = np.float64 if max(np.abs(books).max(), *(np.abs(x).max() for x in (trees.low[0], trees.high[0]))) < DOUBLE_MOST else np.int64
    for position in range(positions):
        mine = np.flatnonzero(where == position)
        for at in range(0, len(mine), 65_536):
            some = mine[at : at + 65_536]
            # |p - z|^2 without |p|^2, which all entries share.
            gap = squares[position] - 2 * (trees.points[position, place[some]].astype(kind) @ books[position].T.astype(kind))
            near = np.where(alive[some], gap, far).argmin(1)
            yield np.full(len(near), -1), where[some], place[some], near


def entry_sums(trees: Trees, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, entry, component) sums and (position, entry) counts of the parts that each entry takes."""
    sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    for level, where, node, entry in assigned(trees, books):
        if not len(level):
            continue
        if level[0] < 0:
            weight = trees.weight[where, node]
            np.add.at(sums, (where, entry), trees.points[where, node] * weight[:, None])
            np.add.at(counts, (where, entry), weight)
        else:
            np.add.at(sums, (where, entry), trees.sums[level[0]][where, node])
            np.add.at(counts, (where, entry), trees.counts[level[0]][where, node])
    return sums, counts


def entry_of(trees: Trees, books: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(vector, position) the entry that takes the part, and each vector's squared distances to its entries, summed."""
    positions, size, _ = trees.points.shape
    taken = np.zeros((positions, size), np.int64)
    for level, where, node, entry in assigned(trees, books):
        if not len(level):
            continue
        span = 1 if level[0] < 0 else size >> int(level[0])
        taken[np.repeat(where, span), (node[:, None] * span + np.arange(span)).ravel()] = np.repeat(entry, span)
    rows = np.arange(positions)[:, None]
    gap = trees.points - books[rows, taken]
    codes, error = np.zeros((n, positions), np.int64), np.zeros(n, np.int64)
    real = trees.weight > 0
    codes[trees.perm[real], np.broadcast_to(rows, real.shape)[real]] = taken[real]
    np.add.at(error, trees.perm[real], (gap * gap).sum(2)[real])
    return codes, error


def _packed(trees: Trees) -> dict[str, bytes]:
    flat = lambda arrays: b"".join(a.tobytes() for a in arrays)
    boxes = [a.astype(np.int32) for a in (*trees.low, *trees.high)]
    return {
        "points": trees.points.astype(np.int32).tobytes(), "perm": trees.perm.astype(np.int32).tobytes(), "weight": trees.weight.astype(np.int8).tobytes(),
        "boxes": flat(boxes), "sums": flat(trees.sums), "counts": flat(trees.counts),
    }


def _unpacked(row: dict, positions: int, width: int) -> Trees:
    size = len(row["weight"]) // positions
    depth = row["depth"]

    def per_level(data: bytes, kind, tail: tuple[int, ...], times: int = 1) -> list[list[np.ndarray]]:
        flat, at, out = np.frombuffer(data, kind).astype(np.int64), 0, []
        for _ in range(times):
            out.append([])
            for level in range(depth + 1):
                shape = (positions, 1 << level, *tail)
                out[-1].append(flat[at : at + int(np.prod(shape))].reshape(shape))
                at += int(np.prod(shape))
        return out

    low, high = per_level(row["boxes"], np.int32, (width,), 2)
    (sums,), (counts,) = per_level(row["sums"], np.int64, (width,)), per_level(row["counts"], np.int64, ())
    whole = lambda key, kind, *tail: np.frombuffer(row[key], kind).astype(np.int64).reshape(positions, size, *tail)
    return Trees(whole("points", np.int32, width), whole("perm", np.int32), whole("weight", np.int8), low, high, sums, counts)


TREES = "depth int, points binary, perm binary, weight binary, boxes binary, sums binary, counts binary"


def kept_vectors(vectors: DataFrame, settings: CodeSettings, vec_id: str, vector: str, label: str) -> DataFrame:
    """Rows (vec_id, label, v) with v the components times scale, rounded down; without null vectors and those with null or non-finite components."""
    parts = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), parts.alias("v")).filter("v IS NOT NULL").filter(F.coalesce(finite, F.lit(False)))
    fits = F.forall("v", lambda x: F.abs(x) * settings.scale < MOST)
    scaled = F.transform("v", lambda x: F.floor(x * settings.scale).cast("int"))
    checked = F.when(fits, scaled).otherwise(F.raise_error(F.lit(f"a component times {settings.scale} is beyond {MOST}")).cast("array<int>"))
    return rows.select("vec_id", "label", checked.alias("v"))


def first_books(rows: DataFrame, settings: CodeSettings, length: int) -> np.ndarray:
    """(position, entry, component): the parts of the smallest ids' vectors, in ascending order; a bounded number of rows reaches the driver."""
    found = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(settings.entries).collect()
    return _cut(np.array([r["v"] for r in found], np.int64).reshape(len(found), length), settings.parts)


def _cut(v: np.ndarray, parts: int) -> np.ndarray:
    """(vector, component) -> (position, vector, component); zeros fill the last part."""
    width = -(-v.shape[1] // parts)
    v = np.pad(v, ((0, 0), (0, width * parts - v.shape[1])))
    return v.reshape(len(v), parts, width).swapaxes(0, 1)


def tree_table(rows: DataFrame, settings: CodeSettings) -> DataFrame:
    """A row for each block of vectors: ids, labels and the block's trees, written to the shared folder. A block's vectors come from one partition."""
    schema = f"vec_id array<{rows.schema['vec_id'].dataType.simpleString()}>, label array<{rows.schema['label'].dataType.simpleString()}>, {TREES}"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            n = len(table)
            v = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)
            trees = build_trees(_cut(v, settings.parts), settings.leaf)
            made = {"depth": len(trees.low) - 1} | _packed(trees)
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), table[c].combine_chunks()) for c in ("vec_id", "label")]
            kinds = {"depth": pa.int32()}
            rest = [pa.array([x], kinds.get(k, pa.binary())) for k, x in made.items()]
            return pa.RecordBatch.from_arrays([*lists, *rest], ["vec_id", "label", *made])

        for batch in batches:
            while batch.num_rows:
                room = settings.block - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == settings.block:
                    yield block()
                    held.clear()
        if held:
            yield block()

    return written(rows.mapInArrow(blocks, schema), "vector-trees")


def next_books(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes its parts' mean, rounded down; unused entries stay. Sums by entry reach the driver."""
    positions, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                s, c = entry_sums(_unpacked(row, positions, width), books)
                total += s
                count += c
        used = [(int(p), int(e)) for p, e in zip(*np.nonzero(count), strict=True)]
        columns = [[p * entries + e for p, e in used], [int(count[u]) for u in used], [total[u].tolist() for u in used]]
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["entry", "n", "sums"])

    found = trees.drop("vec_id", "label").mapInArrow(sums, "entry int, n long, sums array<long>")
    totals = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    made = books.copy()
    for row in found.groupBy("entry").agg(F.sum("n").alias("n"), *totals).collect():
        made[divmod(row["entry"], entries)] = [int(row[f"s{k}"]) // row["n"] for k in range(width)]
    return made


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode_vectors(
    vectors: DataFrame, settings: CodeSettings = CodeSettings(), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, label, code, error) and the codebooks (position, entry, component).

    code has two hexadecimal digits for each part; error is the squared distance
    to the coded vector. Null vectors and those with null or non-finite
    components have no row, nor have vectors of another length than the one of
    the smallest id; a length that parts do not divide is filled up with zeros.
    Components of 2^27 / scale and more are an error, as errors would leave 64
    bits. Rows that repeat an id are rows of their own; null ids come last; with
    fewer vectors than entries each vector is an entry; no vectors give no rows
    and codebooks without entries. Other columns do not matter.
    """
    spark: SparkSession = vectors.sparkSession
    prepare(spark)
    rows = kept_vectors(vectors, settings, vec_id, vector, label)
    first = rows.select("vec_id", F.size("v").alias("n"), "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    length = first[0]["n"] if first else 0
    rows = rows.filter(F.size("v") == length)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    if not length:
        return spark.createDataFrame([], schema), np.zeros((settings.parts, 0, 0), np.int64)
    trees = tree_table(rows, settings)
    books = first_books(rows, settings, length)
    for _ in range(settings.rounds):
        books = next_books(trees, books)
    positions, _, width = books.shape

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.drop_columns(["vec_id", "label"]).to_pylist()):
                ids, labels = (batch.column(c)[i].values for c in ("vec_id", "label"))
                found, error = entry_of(_unpacked(row, positions, width), books, len(ids))
                text = pa.array([x.tobytes().hex() for x in found.astype(np.uint8)], pa.string())
                yield pa.RecordBatch.from_arrays([ids, labels, text, pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return trees.mapInArrow(codes, schema), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error: the error of all rows of its label, nulls being one. Sums come first, so a hot label is no hot group."""
    coded = written(coded, "vector-codes")
    sums = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    return keyed_join(coded, sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
