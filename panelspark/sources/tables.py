"""Reading respondent tables: CSV in many charsets, XLSX, XLS, Parquet.

One pass over a folder's lines decides each file's charset, and whether it has
line breaks inside quotes. Files without these are read in splits, cells being
decoded column-wise; lines of the others become records by running sums over the
splits; a workbook is one task's work. Rows wider than the header keep their
cells in columns `Unnamed: k`. Cells that mean "missing" become null; types are
inferred from all cells in one pass.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.shared import cut
from panelspark.sources.charsets import WIDE, charsets_of, wide_charset
from panelspark.sources.xls import xls_rows

#: Cell texts that mean "missing", fixed values.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Stands before the text of a workbook's dates, so that they differ from texts that look like them.
DATE = chr(0xFDD0)
#: Formats of dates among the built-in number formats, fixed values; others are told by their letters.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def unique_names(names: list[str | None]) -> list[str]:
    """Header names with `.1`, `.2` behind repeated ones, and `Unnamed: i` for empty ones."""
    out: list[str] = []
    for i, name in enumerate(names):
        base = name if name else f"Unnamed: {i}"
        new, k = base, 0
        while new in out:
            k += 1
            new = f"{base}.{k}"
        out.append(new)
    return out


#: Kinds that all cells of a column can have, tried in this order, with their patterns; whole numbers of any length are told apart by their bounds.
KINDS = {
    "whole": r"^\s*[+-]?\d+\s*$", "double": r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?inf(inity)?)\s*$",
    "boolean": r"^(True|False|TRUE|FALSE|true|false)$", "timestamp_ntz": rf"^{DATE}\d{{4}}-",
}
LONGEST, DIGITS = (1 << 63) - 1, 38


def infer_types(text: DataFrame, named: int | None = None) -> DataFrame:
    """All-text columns with missing cells as null, cast to what every cell allows: bigint, decimal(38, 0), double, boolean or, for a workbook's dates, timestamp.

    Whole numbers stay exact: beyond 64 bits they are decimals up to 38 digits,
    and text beyond that. Columns from the place `named` on are left out where no
    cell is there. One pass over the cells.
    """
    cells = text.select(*[F.when(F.col(f"`{c}`").isin(*MISSING), None).otherwise(F.col(f"`{c}`")).alias(c) for c in text.columns])
    facts = []
    for i, c in enumerate(cells.columns):
        cell = F.col(f"`{c}`")
        facts += [F.coalesce(F.bool_and(cell.rlike(p)), F.lit(False)).alias(f"{k}{i}") for k, p in KINDS.items()]
        bare = F.ltrim(F.trim(cell), F.lit("+-0"))
        number = F.when(cell.rlike(KINDS["whole"]) & (F.length(bare) <= DIGITS), F.trim(cell)).try_cast("decimal(38,0)")
        facts += [F.count(cell).alias(f"there{i}"), F.max(F.length(bare)).alias(f"digits{i}"), F.min(number).alias(f"low{i}"), F.max(number).alias(f"high{i}")]
    row = cells.agg(*facts).first() if cells.columns else None
    made = []
    for i, c in enumerate(cells.columns):
        if named is not None and i >= named and not row[f"there{i}"]:
            continue
        kind = next((k for k in KINDS if row[f"{k}{i}"]), "string")
        if kind == "whole":
            far = row[f"digits{i}"] > DIGITS
            kind = "string" if far else "bigint" if row[f"low{i}"] >= -LONGEST - 1 and row[f"high{i}"] <= LONGEST else "decimal(38,0)"
        cell = F.ltrim(F.col(f"`{c}`"), F.lit(DATE))
        made.append((cell if kind == "string" else F.trim(cell).cast(kind)).alias(c))
    return cells.select(*made)


def _decoder(charset: str):
    """A column of bytes read as Latin-1, decoded; bytes that the charset does not have are an error."""

    def decode(cell: Column) -> Column:
        if charset == "utf-8":
            return F.decode(F.encode(cell, "ISO-8859-1"), "UTF-8")

        @F.pandas_udf("string")
        def from_page(cells: pd.Series) -> pd.Series:
            return cells.map(lambda x: None if x is None else x.encode("latin-1").decode(charset))

        return from_page(cell)

    return decode


def _all_names(header: list[str | None], width: int) -> list[str]:
    return unique_names([*header, *[None] * (width - len(header))])


def _cells(text: str) -> list[str | None]:
    """The cells of one record; empty ones are null."""
    return [c or None for c in next(csv.reader(io.StringIO(text, newline="")), [])]


def _whole_files(spark: SparkSession, files: list[str], charset: str) -> DataFrame:
    """Rows (file, block, place, cells) of files in a charset of two or four bytes a character, a file being one task's work; blank lines are left out."""

    def rows(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                lines = csv.reader(io.StringIO(content.decode(charset).removeprefix("\ufeff"), newline=""))
                held = [(name, 0, i, [c or None for c in cells]) for i, cells in enumerate(x for x in lines if x)]
                for at in range(0, len(held), 5_000):
                    yield pd.DataFrame(held[at : at + 5_000], columns=["file", "block", "place", "cells"])

    return spark.read.format("binaryFile").load(files).select("path", "content").mapInPandas(rows, "file string, block long, place long, cells array<string>")


#: A quoted cell from its start on, and what closes one that was open before the line.
QUOTED, CLOSING = r'(^|,)"(?:[^"]++|"")*+"', r'^(?:[^"]++|"")*+"(?!")'


def _ends_inside(line: Column) -> Column:
    """Whether a line that begins outside of quotes ends inside."""
    return F.regexp_replace(line, QUOTED, "$1#").rlike('(^|,)"')


def _records(lines: DataFrame, charset: str) -> DataFrame:
    """lines (file, block, place, value) of files with line breaks in quotes -> rows (file, block, place, cells), one for each record.

    Each line is judged for both cases, that it begins outside and inside of
    quotes; running sums within a file's splits, and over the splits, tell which
    case holds. Lines of one record meet by the place of its first one, so a file
    is many tasks' work; a quote that never closes takes in the rest of its file, but for a
    line break at its end.
    """
    line = F.regexp_replace("value", "\r$", "")
    rest = F.regexp_replace(line, CLOSING, "#")
    closes = line.rlike(CLOSING)
    from_out, from_in = _ends_inside(line), ~closes | _ends_inside(rest)
    order = Window.partitionBy("file", "block").orderBy("place")
    here, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    # A line swaps the state, keeps it, or sets it whatever it was.
    judged = lines.withColumns({"sets": F.when(from_out == from_in, from_out), "swaps": (from_out & ~from_in).cast("int")})
    judged = judged.withColumn("swapped", F.sum("swaps").over(here))
    sets = F.when(F.col("sets").isNotNull(), F.struct("sets", "swapped"))
    judged = judged.withColumns({"set_before": F.last(sets, ignorenulls=True).over(before), "swapped_before": F.coalesce(F.sum("swaps").over(before), F.lit(0))})
    # What a split does to the state: the same two numbers at its end.
    ends = judged.groupBy("file", "block").agg(F.max_by(F.struct(F.coalesce(sets, "set_before").alias("set"), "swapped"), "place").alias("end"))
    splits = Window.partitionBy("file").orderBy("block")
    told = ends.withColumn("total", F.sum("end.swapped").over(splits))
    at_set = F.when(F.col("end.set").isNotNull(), F.struct(F.col("end.set.sets").alias("sets"), (F.col("total") - F.col("end.swapped") + F.col("end.set.swapped")).alias("swapped")))
    earlier = splits.rowsBetween(Window.unboundedPreceding, -1)
    told = told.select("file", "block", F.last(at_set, ignorenulls=True).over(earlier).alias("set"), F.coalesce(F.lag("total").over(splits), F.lit(0)).alias("total"))
    odd = lambda n: n % 2 == 1
    first = F.coalesce(F.col("set.sets"), F.lit(False)) != odd(F.col("total") - F.coalesce(F.col("set.swapped"), F.lit(0)))
    told = told.select("file", "block", first.alias("first"))
    judged = judged.join(told, ["file", "block"])
    inside = F.coalesce(F.col("set_before.sets"), F.col("first")) != odd(F.col("swapped_before") - F.coalesce(F.col("set_before.swapped"), F.lit(0)))
    judged = judged.withColumn("starts", ~inside)
    key = F.struct("block", "place")
    own = judged.withColumn("key", F.last(F.when(F.col("starts"), key), ignorenulls=True).over(here))
    # Lines that go on from an earlier split belong to the last record begun there.
    begun = own.groupBy("file", "block").agg(F.max("key").alias("last"))
    begun = begun.select("file", "block", F.max("last").over(earlier).alias("from"))
    own = own.join(begun, ["file", "block"]).withColumn("key", F.coalesce("key", "from"))
    single = F.col("starts") & F.coalesce(F.lead("starts").over(order), F.lit(False))
    own = own.withColumn("single", single).select("file", "key", "block", "place", "value", "single")
    many = own.filter(~F.col("single")).groupBy("file", "key").agg(F.array_sort(F.collect_list(F.struct("block", "place", F.col("value").cast("binary").alias("value")))).alias("all"))
    pieces = F.transform("all", lambda x: x["value"])
    rows = own.filter("single").select("file", "key", F.array(F.col("value").cast("binary")).alias("pieces")).unionByName(many.select("file", "key", pieces.alias("pieces")))

    @F.pandas_udf("array<string>")
    def cells(pieces: pd.Series) -> pd.Series:
        # Quotes, commas and line breaks are bytes of their own in these charsets.
        return pieces.map(lambda p: _cells(b"\n".join(bytes(x) for x in p).removesuffix(b"\r").decode(charset).removeprefix("\ufeff")))

    return rows.select("file", "key.block", "key.place", cells("pieces").alias("cells")).filter(F.size("cells") > 0)


def _without_headers(rows: DataFrame) -> tuple[list[list[str | None]], DataFrame]:
    """Different first records of the files, two at most, and rows without them, in the order of the files."""
    first = cut(rows.groupBy("file").agg(F.min(F.struct("block", "place")).alias("first"), F.min_by("cells", F.struct("block", "place")).alias("names")))
    headers = [list(r["names"]) for r in first.select("names").distinct().limit(2).collect()]
    rest = rows.join(first.select("file", "first"), "file").filter(F.struct("block", "place") != F.col("first"))
    return headers, rest.orderBy("file", "block", "place").select("cells")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or folder with a header line in each file, the same in all; each file in a charset of its own, which it tells by a mark or by its bytes.

    UTF-8, UTF-16 and UTF-32, Korean, Chinese, Japanese and western European code
    pages are known; what a file's charset cannot decode is an error. Repeated
    header names get numbers; blank lines are left out; rows wider than the
    header keep their cells. Files without a line and folders without files give
    an empty table. The driver gets some rows per file. Headers are compared
    between files of different charsets and of those with and without line
    breaks in quotes; beyond that the first file's header counts for all.
    """
    line = F.col("value")
    many = lambda x, c: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(c), F.lit("")))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value"
    )
    # Commas in quotes part no cells; a cell that stays open takes the commas behind it as well, so this is the least width that surely holds all.
    bare = F.when(line.contains('"'), F.regexp_replace(line, QUOTED, "$1#")).otherwise(line)
    facts = lines.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8(line)).alias("valid"), F.bool_or(many(line, '"') % 2 == 1).alias("broken"), F.max(many(bare, ",")).alias("commas"),
        F.min_by(line, F.struct("block", "place")).alias("first"), F.sum(many(line, "\0")).alias("zeros"), F.bool_or(F.regexp_replace(line, "\r$", "") != "").alias("there"),
    )
    facts = [r.asDict() for r in facts.withColumn("told", wide_charset(F.col("first"), F.col("zeros"))).drop("first", "zeros").filter("there").orderBy("file").collect()]
    charsets = charsets_of(lines, facts)
    groups: dict[tuple[str, bool], list] = {}
    for f in facts:
        groups.setdefault((charsets[f["file"]], f["broken"] or charsets[f["file"]] in WIDE), []).append(f)
    parts, header, width = [], None, 0
    for (charset, broken), found in groups.items():
        files = [f["file"] for f in found]
        if broken:
            rows = _whole_files(spark, files, charset) if charset in WIDE else _records(cut(lines.filter(F.col("file").isin(files))), charset)
            headers, rest = _without_headers(cut(rows))
            if not headers:
                continue
            if len(headers) > 1:
                raise ValueError(f"files of {path} have different headers")
            names, wide = headers[0], max(len(headers[0]), rest.agg(F.max(F.size("cells"))).first()[0] or 0)
            part = rest.select(*[F.get("cells", F.lit(k)).alias(f"c{k}") for k in range(wide)])
        else:
            read = spark.read.option("encoding", "ISO-8859-1").option("quote", '"').option("escape", '"')
            first = read.csv(files[0], header=False).first()
            bytes_ = [(c or "").encode("latin-1") for c in first]
            names = [c.decode("utf-8-sig" if charset == "utf-8" and not i else charset) for i, c in enumerate(bytes_)]
            wide = max(len(names), 1 + max(f["commas"] for f in found))
            raw = read.schema(", ".join(f"c{k} string" for k in range(wide))).csv(files, header=True, enforceSchema=True)
            decode = _decoder(charset)
            part = raw.select(*[decode(F.col(c)).alias(c) for c in raw.columns])
        if header is not None and [n or None for n in names] != [n or None for n in header]:
            raise ValueError(f"files of {path} have different headers")
        header, width = names, max(width, wide)
        parts.append(part)
    if header is None:
        return spark.createDataFrame([], "struct<>")
    width = max(width, len(header))
    parts = [p.select(*[F.col(f"c{k}") if k < len(p.columns) else F.lit(None).cast("string").alias(f"c{k}") for k in range(width)]) for p in parts]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return infer_types(rows.toDF(*_all_names(header, width)), len(header))


def date_text(serial: float, since_1904: bool) -> str:
    """A workbook's date number as text: days since 1899-12-30, or since 1904; up to whole microseconds; below a day a time alone."""
    at = (datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30 if serial >= 60 else 31)) + timedelta(seconds=round(serial * 86_400, 3))
    return at.strftime("%H:%M:%S") if 0 <= serial < 1 else DATE + at.isoformat(" ")


def is_date(number: int, own: dict[int, str]) -> bool:
    """Whether a number format is one of dates: by its letters outside of quotes and brackets, or as one of the built-in ones."""
    if number not in own:
        return number in DATE_FORMATS
    return bool(re.search("[ymdhsYMDHS]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.', "", own[number])))


def date_styles(styles: bytes) -> set[int]:
    """Places of the cell styles whose number format is one of dates."""
    root = ElementTree.fromstring(styles)
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_MAIN}numFmt")}
    cells = root.find(f"{_MAIN}cellXfs")
    formats = [int(x.get("numFmtId", "0")) for x in cells] if cells is not None else []
    return {i for i, f in enumerate(formats) if is_date(f, own)}


def _string(x) -> str:
    """The text of a string, of one piece or of runs; how it is read aloud is not part of it."""
    return "".join(t.text or "" for part in x for t in ([part] if part.tag == f"{_MAIN}t" else part.findall(f"{_MAIN}t") if part.tag == f"{_MAIN}r" else []))


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """The cells of a workbook's first sheet as text, row by row, blank rows included; the format bounds a sheet to 1,048,576 rows."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as held:
                for _, x in ElementTree.iterparse(held):
                    if x.tag == f"{_MAIN}si":
                        shared.append(_string(x))
                        x.clear()
        workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
        first = next(workbook.iter(f"{_MAIN}sheet")).get(_LINK)
        dates = date_styles(book.read("xl/styles.xml")) if "xl/styles.xml" in names else set()
        since_1904 = any(x.get("date1904") in ("1", "true") for x in workbook.iter(f"{_MAIN}workbookPr"))
        done = 0
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = links[first].lstrip("/")
        with book.open(target if target.startswith("xl/") else f"xl/{target}") as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str | None] = []
                for _ in range(done + 1, int(row.get("r", done + 1))):
                    done += 1
                    yield []
                for cell in row.iter(f"{_MAIN}c"):
                    letters = "".join(c for c in cell.get("r", "") if c.isalpha())
                    at = len(cells)
                    if letters:
                        at = 0
                        for c in letters:
                            at = 26 * at + ord(c) - 64
                        at -= 1
                    value = cell.find(f"{_MAIN}v")
                    text = None if value is None else value.text
                    if cell.get("t") == "s" and text is not None:
                        text = shared[int(text)]
                    elif cell.get("t") == "inlineStr":
                        text = "".join(map(_string, cell.iter(f"{_MAIN}is")))
                    elif cell.get("t") == "b":
                        text = {"1": "True", "0": "False"}.get(text)
                    elif cell.get("t", "n") == "n" and text is not None and int(cell.get("s", "0")) in dates:
                        text = date_text(float(text), since_1904)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = text
                row.clear()
                done += 1
                yield cells


def _book_rows(content: bytes, suffix: str) -> Iterator[list[str | None]]:
    return sheet_rows(content) if suffix == ".xlsx" else xls_rows(content, is_date, date_text)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheets of a workbook or a folder of them, their first row being the header; each file is parsed once."""
    return excel_table(spark.read.format("binaryFile").load(path).select("path", "content"))


def excel_table(files: DataFrame) -> DataFrame:
    """One table of the workbooks (path, content): paths end in .xlsx or .xls; their headers must agree; null contents are left out."""

    def rows(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                held = []
                for i, cells in enumerate(_book_rows(content, name[name.rindex(".") :].lower()) if content is not None else ()):
                    held.append((i, cells))
                    if len(held) == 5_000:
                        yield pd.DataFrame(held, columns=["i", "cells"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["i", "cells"])

    lines = cut(files.select("path", "content").mapInPandas(rows, "i long, cells array<string>"))
    headers = lines.filter("i = 0").select("cells").distinct().limit(2).collect()
    if not headers:
        return files.sparkSession.createDataFrame([], "struct<>")
    if len(headers) > 1:
        raise ValueError("workbooks have different headers")
    header = list(headers[0]["cells"])
    width = max(len(header), lines.agg(F.max(F.size("cells"))).first()[0])
    cells = [F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(_all_names(header, width))]
    return infer_types(lines.filter("i > 0").select(*cells), len(header))


READERS = {".csv": read_csv, ".xlsx": read_excel, ".xls": read_excel, ".parquet": lambda spark, path: spark.read.parquet(path)}


def _reader(spark: SparkSession, path: str):
    """The reader by the path's suffix in any case, or for a folder by that of its files, if they all have one."""
    known = next((f for s, f in READERS.items() if path.lower().endswith(s)), None)
    if known is not None:
        return known
    try:
        names = spark.read.format("binaryFile").load(path).select(F.lower(F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1)).alias("s")).distinct().limit(2).collect()
    except Exception:  # no such path
        return None
    return READERS.get(names[0]["s"]) if len(names) == 1 else None


def load_table(spark: SparkSession, path: str | None, lenient: bool = False) -> DataFrame | None:
    """A table by the suffix of its path, or of a folder's files, in any case. No path gives None.

    An unknown suffix is an error, as is a file that cannot be read; if lenient, both give None.
    """
    if path is None:
        return None
    reader = _reader(spark, path)
    if reader is None:
        if lenient:
            return None
        raise ValueError(f"no reader for {path}; known: {', '.join(READERS)}")
    try:
        return reader(spark, path)
    except Exception:
        if lenient:
            return None
        raise
