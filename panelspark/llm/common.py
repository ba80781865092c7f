"""What the corpus operators share: the shared folder, cut lineage, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.shared import cut, fresh_path, written  # noqa: F401  the operators import them from here

#: Most rows and bytes of an Arrow batch; texts can be long, so batches are kept short.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Short Arrow batches, so that long texts fit in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Rows of at most some 50 bytes that are broadcast, so 1 MB at most: the driver builds and holds them.
BROADCAST_ROWS = 20_000


def keyed_join(rows: DataFrame, keyed: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """rows joined with a checkpoint or table of few short columns that has one row for each key.

    keyed is counted: up to BROADCAST_ROWS it is broadcast, so that a hot key of
    rows stays where it is. Beyond, both sides have a shuffle of their own, as
    keyed is no aggregate by then, and Spark splits hot keys.
    """
    return rows.join(F.broadcast(keyed) if keyed.count() <= BROADCAST_ROWS else keyed, on, how)


def free_name(*frames: DataFrame) -> Callable[[str], str]:
    """Names for added columns that no column of the frames has, in any case."""
    taken = {c.lower() for df in frames for c in df.columns}

    def name(wanted: str) -> str:
        while wanted.lower() in taken:
            wanted += "_"
        taken.add(wanted.lower())
        return wanted

    return name


def map_batches(df: DataFrame, rows: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with state for each task: rows() is called once there and gives the function of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = rows()
        for batch in batches:
            if batch.num_rows:
                yield each(batch)

    return df.mapInArrow(run, schema)


class Memo(dict):
    """Remembers fill(key). When full, the older half of the keys goes, but for those used again: memory is bounded, frequent keys stay.

    A worker serves many stages in turn; use() empties what other stages left.
    """

    _all: list[Memo] = []

    def __init__(self, fill: Callable, most: int):
        super().__init__()
        self.fill, self.half, self.older = fill, most // 2, {}
        Memo._all.append(self)

    def use(self) -> Memo:
        for other in Memo._all:
            if other is not self:
                other.clear()
                other.older.clear()
        return self

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.fill(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
