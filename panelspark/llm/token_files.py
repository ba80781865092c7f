"""Token-ID output: Parquet list columns that allow selective token and metadata reads.

Documents are range-partitioned and sorted by id, encoded, and written with
dictionary-coded tokens (delta-coded where a dictionary does not pay), bounded
row groups and short pages. Parquet's page indexes and the sorted ids let a
reader skip pages; the metadata columns are read without the tokens.
"""

from __future__ import annotations

import functools
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelspark.llm.common import Memo, cut, keyed_join, map_batches, prepare

#: Encoded chunks that a worker remembers.
MEMO = 800_000

#: The byte-level alphabet by its rule: bytes that print stand for themselves, the others for code points from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTED)}
#: Lower-case letters below this are their own normal form and lower case.
LATIN_END = chr(0x250)

#: Writer settings of the format: version 2 pages give delta coding where there is no dictionary.
FILE_OPTIONS = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
}


class Encoder:
    """Encodes texts chunk by chunk between ASCII white space, with the library's result of each chunk remembered.

    The vocabularies meant here never join or look across white space: it is
    dropped or splits pre-tokens, so chunks encode alone as they do in place.
    They read lower case only, and a full stop or comma after a letter starts a
    pre-token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok, self.memo = Tokenizer.from_file(path), Memo(self.chunk, MEMO)
        self.merge = self.tok.model.tokenize

    def chunk(self, chunk: bytes) -> bytes:
        if chunk[-1] in b".," and b"a" <= chunk[-2:-1] <= b"z":
            return self.memo[chunk[:-1]] + self.memo[chunk[-1:]]
        word = chunk.decode()
        if word.isalpha() and max(word) < LATIN_END and word == word.lower():  # one pre-token as it stands
            ids = [token.id for token in self.merge(chunk.decode("latin-1").translate(BYTE_LETTERS))]
        else:
            ids = self.tok.encode(word, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if b"<|" not in text:  # special strings are matched as they stand
            text = text.lower()
        return b"".join(map(self.memo.__getitem__, text.split()))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (part, seq, doc_id, n_tokens, tokens) in ascending order of id: part is the range, seq the place in it.

    Equal ids are ordered, and may be parted, by their text. A null text counts
    as empty and gives the end id alone; null ids come first. Whole texts are
    encoded, however long; repeated rows stay; an empty table gives an empty
    result; other columns do not matter, whatever their names.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def start():
        coder, part, end = encoder(path), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        coder.memo.use()
        done = 0

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal done
            n = batch.num_rows
            ids = [coder.encode(x or b"") + end for x in batch.column(1).cast(pa.binary()).to_pylist()]
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], lengths.cumsum()]).astype(np.int32)), values)
            columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(done, done + n)), batch.column(0), pa.array(lengths), tokens]
            done += n
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "doc_id", "n_tokens", "tokens"])

        return each

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return map_batches(dealt, start, f"part int, seq long, doc_id {kind}, n_tokens long, tokens array<int>")


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int, **columns: str) -> None:
    """Encodes all documents into files of the format under `out`; corner cases as in encode_documents. An empty table gives files without rows."""
    encode_documents(docs, path, end_id, **columns).write.options(**FILE_OPTIONS).parquet(out)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """The files' rows; selecting or filtering reads only the columns and pages that it needs."""
    return spark.read.parquet(out)


def token_index(spark: SparkSession, out: str) -> DataFrame:
    """From the files, a row per document: doc_id, start (ids before it), n_tokens, ids_crc32.

    Starts are sums in two levels: over the ranges, as many rows as the write
    had partitions, and within each range. An empty table gives an empty result.
    """
    prepare(spark)
    files = read_tokens(spark, out)
    kind = files.schema["doc_id"].dataType.simpleString()

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            tokens = batch.column(3)
            values = tokens.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = tokens.offsets.to_numpy()
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            counts = pa.array(np.diff(ends).astype(np.int64))
            return pa.RecordBatch.from_arrays([*batch.columns[:3], counts, pa.array(crcs, pa.int64())], ["part", "seq", "doc_id", "n_tokens", "ids_crc32"])

        return each

    rows = map_batches(files.select("part", "seq", "doc_id", "tokens"), start, f"part int, seq long, doc_id {kind}, n_tokens long, ids_crc32 long")
    before = (Window.unboundedPreceding, -1)
    ranges = files.groupBy("part").agg(F.sum("n_tokens").alias("range_tokens"))
    ranges = ranges.select("part", F.coalesce(F.sum("range_tokens").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("range_start"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*before)), F.lit(0))
    placed = keyed_join(rows.withColumn("inside", inside), cut(ranges), "part")
    return placed.select("doc_id", (F.col("range_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
