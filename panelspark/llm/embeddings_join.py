"""Embedding near-dedup by an exact metric range join.

Vectors of one length share a space. Pivots, a bounded sample of its vectors,
partition the unit sphere: a vector's home is the nearest pivot's cell. Two vectors within the range meet in the
earlier of their homes' cells, to which the later one is copied where the
triangle inequality allows a partner there: its angle to that pivot may exceed
the one to its own by twice the range at most, and the cell's radius by the
range at most; the plane between two pivots gives a third bound. Cells join
independently, cut into blocks of bounded size. Equal vectors are one weighted
class, and a block sends link counts and spanning edges only, never pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import graph
from panelspark.llm.common import cut, keyed_join, map_batches, prepare, written


@dataclass(frozen=True)
class RangeSettings:
    """cosine: least of a link. cell_rows: vectors that a cell should hold. most_pivots: of a length, they go to every task. block: homes in a block."""

    cosine: float = 0.95
    cell_rows: int = 2_000
    most_pivots: int = 4_096
    block: int = 2_048
    chunk: int = 1_024


#: Room for rounding in the bounds: near 1 a cosine's last bit is 1.5e-8 of the angle. The cosine test itself has none.
SLACK = 1e-7


def unit(vector: list | None) -> np.ndarray | None:
    """The vector over its norm in double precision; None if it is null, empty, zero or has a null or non-finite component."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        v = v / np.abs(v).max() if np.isfinite(v).all() and v.any() else v
        norm = math.sqrt(float(v @ v)) if np.isfinite(v).all() else 0.0
    return v / norm if norm > 0 else None


def units(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Rows (vec_id, cls, unit): cls and unit (bytes) are null for vectors that link with nothing. cls names the exact vector."""
    kind = vectors.schema[vec_id].dataType.simpleString()

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [unit(x) for x in batch.column(1).to_pylist()]
            raw = [None if u is None else u.tobytes() for u in found]
            names = [None if r is None else xxhash.xxh3_64_intdigest(r) - (1 << 63) for r in raw]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64()), pa.array(raw, pa.binary())], ["vec_id", "cls", "unit"])

        return each

    return map_batches(vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")), start, f"vec_id {kind}, cls long, unit binary")


def homes(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles to all pivots, and the place of the nearest."""
    angles = np.arccos(np.clip(rows @ pivots.T, -1, 1))
    return angles, angles.argmin(1)


@dataclass
class Space:
    """Pivots of the vectors of one length. first: number of its first cell; radius, counts: of its cells, once they are known."""

    first: int
    pivots: np.ndarray
    radius: np.ndarray
    counts: np.ndarray


def dealt(classes: DataFrame, spaces: dict[int, Space], bounded: bool, s: RangeSettings) -> DataFrame:
    """Rows (cell, cls, home, weight, blocks, unit): each class in its home's cell and its copies in earlier cells. Not bounded: the homes' angles."""
    reach = math.acos(s.cosine) + SLACK
    chord = math.sqrt(2 - 2 * s.cosine) + SLACK

    def near_cells(rows: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and cell of each place where a row is to be, and the rows' homes."""
        at = np.arange(len(rows))
        angles, home = homes(rows, space.pivots)
        own = angles[at, home]
        near = (angles <= own[:, None] + 2 * reach) & (angles <= space.radius[None, :] + reach)
        cosines = np.cos(angles)
        there, of = np.unique(home, return_inverse=True)
        apart = np.sqrt(np.maximum(2 - 2 * np.clip(space.pivots[there] @ space.pivots.T, -1, 1), 1e-18))
        near &= (cosines[at, home][:, None] - cosines) <= chord * apart[of] + SLACK
        near &= np.arange(len(space.pivots))[None, :] < home[:, None]
        near[at, home] = True
        return *np.nonzero(near), home

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = batch.column(2).to_pylist()
            sizes = np.array([len(x) // 8 for x in raw])
            found = []
            for size in np.unique(sizes):
                at, space = np.flatnonzero(sizes == size), spaces[int(size)]
                rows = np.frombuffer(b"".join([raw[i] for i in at])).reshape(len(at), -1)
                if bounded:
                    row, cell, home = near_cells(rows, space)
                    found.append((at[row], cell + space.first, cell == home[row], -(-space.counts[cell] // s.block)))
                else:
                    angles, home = homes(rows, space.pivots)
                    found.append((home + space.first, angles[np.arange(len(at)), home]))
            columns = [np.concatenate(x) for x in zip(*found, strict=True)]
            if not bounded:
                return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["cell", "angle"])
            row, cell, own, blocks = columns
            at = pa.array(row)
            columns = [pa.array(cell), batch.column(0).take(at), pa.array(own), batch.column(1).take(at), pa.array(blocks), batch.column(2).take(at)]
            return pa.RecordBatch.from_arrays(columns, ["cell", "cls", "home", "weight", "blocks", "unit"])

        return each

    schema = "cell long, cls long, home boolean, weight long, blocks long, unit binary" if bounded else "cell long, angle double"
    return map_batches(classes.select("cls", "weight", "unit"), start, schema)


def spaces_of(classes: DataFrame, s: RangeSettings) -> dict[int, Space]:
    """A space for each length, with pivots, radii and counts. The driver gets most_pivots vectors and as many numbers of a length at most.

    Pivots come in the order of a hash, out of a share of the vectors so chosen
    by it that some eight times as many as are needed take part in the sort.
    """
    size = (F.octet_length("unit") / 8).cast("int")
    spaces: dict[int, Space] = {}
    first = 0
    for length, n in sorted(tuple(r) for r in classes.groupBy(size).count().collect()):
        few = min(s.most_pivots, max(1, n // s.cell_rows))
        part = classes.filter((size == length) & (F.pmod(F.xxhash64("cls"), F.lit(1 << 40)) <= int((8 * few + 64) / n * (1 << 40))))
        pivots = np.array([np.frombuffer(r["unit"]) for r in part.select("cls", "unit").orderBy(F.hash("cls"), "cls").limit(few).collect()])
        spaces[length] = Space(first, pivots, np.full(few, -1.0), np.ones(few, np.int64))
        first += few
    seen = {r["cell"]: (r["angle"], r["n"]) for r in dealt(classes, spaces, False, s).groupBy("cell").agg(F.max("angle").alias("angle"), F.count("cell").alias("n")).collect()}
    for space in spaces.values():
        for i in range(len(space.pivots)):
            space.radius[i], space.counts[i] = seen.get(space.first + i, (-1.0, 1))
    return spaces


def spanning(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Over links of rows with columns: for each row and column the least column of its component; none where it has no link."""
    width = links.shape[1]
    column = np.arange(width)
    while True:
        row = np.where(links, column[None, :], width).min(1)
        new = np.minimum(column, np.where(links, row[:, None], width).min(0))
        if (new == column).all():
            return row, column
        column = new


def joined(cells: DataFrame, s: RangeSettings) -> DataFrame:
    """cells (cell, block, home, cls, weight, unit) -> rows (cls, links, other): links found, and a class of the same component."""

    def run(batches):
        key, homes_, chunk, sums = None, [], [], {}

        def compare(rows: list, inside: bool):
            own = np.array([r[2] for r in homes_])
            them = own if inside else np.array([r[2] for r in rows])
            links = them @ own.T >= s.cosine
            if inside:
                np.fill_diagonal(links, False)
            weights = np.array([r[1] for r in homes_])
            for r, n in zip(rows, links @ weights, strict=True):
                sums[r[0]] = sums.get(r[0], 0) + int(n)
            if not inside:
                for r, n in zip(homes_, np.array([r[1] for r in rows]) @ links, strict=True):
                    sums[r[0]] = sums.get(r[0], 0) + int(n)
            row, column = spanning(links)
            edges = {(r[0], homes_[j][0]) for r, j in zip(rows, row, strict=True) if j < len(homes_)}
            return edges | {(h[0], homes_[j][0]) for h, j in zip(homes_, column, strict=True)}

        def flush(last: bool):
            edges = set()
            if homes_ and chunk:
                edges |= compare(chunk, False)
            chunk.clear()
            if last and homes_:
                edges |= compare(homes_, True)
            found = sorted(e for e in edges if e[0] != e[1])
            out = [(c, n, None) for c, n in sums.items() if n] + [(a, 0, b) for a, b in found] if last else [(a, 0, b) for a, b in found]
            if last:
                sums.clear()
                homes_.clear()
            columns = zip(*out, strict=True) if out else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cls", "links", "other"])

        for batch in batches:
            for *at, home, cls, weight, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != key:
                    yield flush(True)
                    key = at
                (homes_ if home else chunk).append((cls, weight, np.frombuffer(raw)))
                if len(chunk) >= s.chunk:
                    yield flush(False)
        yield flush(True)

    rows = cells.select("cell", "block", "home", "cls", "weight", "unit")
    return rows.repartition("cell", "block").sortWithinPartitions("cell", "block", F.desc("home")).mapInArrow(run, "cls long, links long, other long")


def near_vectors(vectors: DataFrame, s: RangeSettings = RangeSettings(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A row per vector: vec_id, n_links (other vectors linked directly), component_id (least id reachable), kept.

    Null, empty or zero vectors and those with null or non-finite components
    link with nothing; vectors of different lengths do not link. Repeated rows
    link with each other. A null id is passed over for component_id unless no
    other is reachable; then it is null and the row kept. An empty table gives
    an empty result; other columns do not matter.
    """
    prepare(vectors.sparkSession)
    all_rows = written(units(vectors, vec_id, embedding), "units")
    some = all_rows.filter("cls IS NOT NULL")
    classes = written(some.groupBy("cls").agg(F.min("vec_id").alias("id"), F.count("cls").alias("weight"), F.first("unit").alias("unit")), "classes")
    cells = dealt(classes, spaces_of(classes, s), True, s).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    others = F.when(F.col("home"), F.sequence(F.lit(0).cast("long"), F.col("own"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    cells = cells.withColumn("block", F.explode(others)).withColumn("home", F.col("home") & (F.col("block") == F.col("own")))
    found = written(joined(cells, s), "links")
    roots = graph.components(found.filter("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    ids = cut(classes.select("cls", "id").join(roots, F.col("cls") == F.col("node")).select("cls", "id", "root"))
    least = cut(ids.groupBy("root").agg(F.min("id").alias("least_id")))
    linked = keyed_join(ids, least, "root").select(F.col("cls").alias("linked_cls"), "least_id")
    labels = classes.select("cls", "id", "weight").join(links, "cls", "left").join(linked, F.col("cls") == F.col("linked_cls"), "left")
    own = F.when(F.col("linked_cls").isNull(), F.col("id")).otherwise(F.col("least_id"))
    labels = cut(labels.select(F.col("cls").alias("of_cls"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), own.alias("component_id")))
    rows = all_rows.join(labels, F.col("cls") == F.col("of_cls"), "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    rows = rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
