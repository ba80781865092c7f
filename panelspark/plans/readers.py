"""Queries of the readers, by name, with the SQL that must agree.

Spark writes the files from the driver tables to the shared folder, so the work grows with these.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.shared import fresh_path
from panelspark.sources import xls
from panelspark.sources.tables import excel_table, load_table

#: A charset and a remark in a language of its own for each sixth of the customers.
REMARKS = (
    ("utf-8", "만족합니다 – très bien ☺"), ("cp949", "설문에 똠방 응답해 주셔서 고맙습니다"), ("shift_jis", "とても良い商品だと思います"),
    ("gb18030", "我们喜欢这个产品因为质量很好"), ("cp1252", "très agréable, déjà vu à Zürich"), ("utf-16", "둘 или три"),
)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet")


def _written(df: DataFrame, path: str, charset: str = "UTF-8") -> str:
    df.write.mode("append").option("header", True).option("encoding", charset).option("escape", '"').option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def q35_csv_long_ids(spark, sf_dir):
    """Ids of 19 and of 23 digits, and of 40, which stay text."""
    key = F.col("c_custkey")
    rows = _customers(spark, sf_dir).select((key + 1234567890123450000).alias("id19"), F.concat(F.lit("12345678901"), F.lpad(key.cast("string"), 12, "0")).alias("id23"), F.concat(F.lit("9"), F.lpad(key.cast("string"), 39, "0")).alias("id40"), (key / 2).alias("half"))
    read = load_table(spark, _written(rows, f"{fresh_path(spark, 'ids')}.csv"))
    kinds = "/".join(k for _, k in read.dtypes)
    return read.select("id19", F.col("id23").cast("string").alias("id23"), "id40", "half", F.lit(kinds).alias("kinds"))


def q36_csv_charsets(spark, sf_dir):
    """One folder of files in six charsets."""
    path = f"{fresh_path(spark, 'charsets')}.csv"
    for i, (charset, remark) in enumerate(REMARKS):
        rows = _customers(spark, sf_dir).filter(F.col("c_custkey") % len(REMARKS) == i)
        # Spark writes UTF alone, so the others' bytes go as Latin-1 characters.
        spark_writes = charset.startswith("utf")
        text = remark if spark_writes else remark.encode(charset).decode("latin-1")
        _written(rows.select("c_custkey", F.concat_ws(" ", F.lit(text), "c_mktsegment").alias("remark")), path, charset if spark_writes else "ISO-8859-1")
    return load_table(spark, path)


def q37_csv_line_breaks(spark, sf_dir):
    """Line breaks, quotes and commas inside of cells."""
    memo = F.concat(F.lit('said "yes",\n\n'), "c_name", F.lit('\n"'), "c_mktsegment", F.lit(", no\"\n"))
    rows = _customers(spark, sf_dir).select("c_custkey", memo.alias("memo"), "c_acctbal")
    return load_table(spark, _written(rows, f"{fresh_path(spark, 'breaks')}.csv"))


def _xls(columns: list[str], rows: list[tuple]) -> bytes:
    """A binary workbook of numbers and texts, less than 65,536 rows, its stream of 4,096 bytes or more."""
    record = lambda kind, data=b"": struct.pack("<HH", kind, len(data)) + data

    def cell(row: int, col: int, value) -> bytes:
        at = struct.pack("<HHH", row, col, 0)
        if isinstance(value, str):
            return record(xls.LABEL, at + struct.pack("<HB", len(value), 1) + value.encode("utf-16-le"))
        return record(xls.NUMBER, at + struct.pack("<d", value))

    begin = record(xls.BOF, struct.pack("<HH", 0x0600, 5)) + record(xls.XF, bytes(20))
    head = begin + record(xls.BOUNDSHEET, struct.pack("<IBBBB", len(begin) + 17, 0, 0, 1, 0) + b"s") + record(xls.EOF)
    body = b"".join(cell(r, c, v) for r, row in enumerate([tuple(columns), *rows]) for c, v in enumerate(row))
    book = (head + record(xls.BOF, struct.pack("<HH", 0x0600, 0x10)) + body + record(xls.EOF)).ljust(4096, b"\0")
    # The sectors of the table of chains, the directory, then the stream.
    data = -(-len(book) // 512)
    n = next(n for n in range(1, 110) if n * 128 >= n + 1 + data)
    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    chains = [0xFFFFFFFD] * n + [end] + list(range(n + 2, n + 1 + data)) + [end]
    table = struct.pack(f"<{len(chains)}I", *chains).ljust(n * 512, b"\xff")
    entry = lambda name, kind, start, size: name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB3I36xIQ", 2 * len(name) + 2, kind, 1, free, free, 1 if kind == 5 else free, start, size)
    directory = (entry("Root Entry", 5, end, 0) + entry("Workbook", 2, n + 1, len(book))).ljust(512, b"\0")
    header = xls.MAGIC + struct.pack("<16x5H10x8I109I", 0x3E, 3, 0xFFFE, 9, 6, n, n, 0, 4096, end, 0, end, 0, *range(n), *[free] * (109 - n))
    return header + table + directory + book.ljust(data * 512, b"\0")


def q39_xls(spark, sf_dir):
    """A binary workbook for each nation's customers."""
    rows = _customers(spark, sf_dir).select(F.col("c_nationkey").alias("nation"), F.struct("c_custkey", "c_name", "c_acctbal", F.concat(F.lit("똠 "), "c_mktsegment").alias("remark")).alias("r"))
    lists = rows.groupBy("nation").agg(F.collect_list("r").alias("all"))

    @F.pandas_udf("binary")
    def book(lists: pd.Series) -> pd.Series:
        names = ["c_custkey", "c_name", "c_acctbal", "remark"]
        return lists.map(lambda rows: _xls(names, [tuple(r[c] for c in names) for r in rows]))

    return excel_table(lists.select(F.concat(F.col("nation").cast("string"), F.lit(".xls")).alias("path"), book("all").alias("content")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (q35_csv_long_ids, q36_csv_charsets, q37_csv_line_breaks, q39_xls)}
ORACLE: dict[str, str] = {
    "q39_xls": "SELECT c_custkey, c_name, c_acctbal, '똠 ' || c_mktsegment AS remark FROM customer",
    "q35_csv_long_ids": """SELECT c_custkey + 1234567890123450000 AS id19, '12345678901' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS id23, '9' || lpad(CAST(c_custkey AS VARCHAR), 39, '0') AS id40,
  CAST(c_custkey AS DOUBLE) / 2 AS half, 'bigint/decimal(38,0)/string/double' AS kinds FROM customer""",
    "q36_csv_charsets": "SELECT c_custkey, [" + ", ".join(f"'{r}'" for _, r in REMARKS) + f"][c_custkey % {len(REMARKS)} + 1] || ' ' || c_mktsegment AS remark FROM customer",
    "q37_csv_line_breaks": """SELECT c_custkey, 'said "yes",' || chr(10) || chr(10) || c_name || chr(10) || '"' || c_mktsegment || ', no"' || chr(10) AS memo, c_acctbal FROM customer""",
}
