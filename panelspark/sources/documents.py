"""Tables as workbooks: one small one from the driver, or as many as a table needs, written by its tasks."""

from __future__ import annotations

import io
import itertools
import math
import os
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from panelspark.functions.text import sheet_name
from panelspark.shared import put_file

#: What XML 1.0 cannot hold.
_NO_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
#: Rows that a sheet can hold below its header.
SHEET_ROWS = 1_048_575


def _cell(value) -> str:
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return "<c/>"
    if isinstance(value, date):
        at = value.replace(tzinfo=None) if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
        return f'<c s="1"><v>{(at - datetime(1899, 12, 30)) / timedelta(days=1)}</v></c>'
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"<c><v>{value}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_NO_XML.sub("", str(value)))}</t></is></c>'


def workbook_bytes(columns: list[str], rows: Iterable, sheet: str) -> bytes:
    """A workbook of one sheet. Dates and timestamps are date cells; NaN and infinity are empty; characters that the format's XML cannot hold are left out."""
    space = "http://schemas.openxmlformats.org"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as book:
        kinds = "".join(f'<Override PartName="/xl/{p}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{k}+xml"/>' for p, k in (("workbook", "sheet.main"), ("worksheets/sheet1", "worksheet"), ("styles", "styles")))
        book.writestr("[Content_Types].xml", f'<Types xmlns="{space}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{kinds}</Types>')
        link = f'<Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="rId1" Type="{space}/officeDocument/2006/relationships/{{}}" Target="{{}}"/></Relationships>'
        book.writestr("_rels/.rels", link.format("officeDocument", "xl/workbook.xml"))
        links = link.format("worksheet", "worksheets/sheet1.xml").replace("</Relationships>", f'<Relationship Id="rId2" Type="{space}/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", links)
        parts = '<fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{space}/spreadsheetml/2006/main">{parts}<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{space}/spreadsheetml/2006/main" xmlns:r="{space}/officeDocument/2006/relationships"><sheets><sheet name="{escape(_NO_XML.sub("", sheet), {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        with book.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f'<worksheet xmlns="{space}/spreadsheetml/2006/main"><sheetData>'.encode())
            out.write(f"<row>{''.join(map(_cell, columns))}</row>".encode())
            for row in rows:
                out.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
            out.write(b"</sheetData></worksheet>")
    return held.getvalue()


def _valid_sheet(df: DataFrame, sheet: str) -> str:
    return df.sparkSession.range(1).select(sheet_name(F.lit(sheet))).first()[0] or "Sheet1"


def write_workbook(df: DataFrame, path: str, sheet: str) -> int:
    """Writes a small table, such as a codebook, as one workbook from the driver; its number of rows. Too many rows for a sheet are an error: write_workbooks has no bound.

    The sheet's name is made valid. Cells are as in workbook_bytes.
    """
    n = df.limit(SHEET_ROWS + 1).count()
    if n > SHEET_ROWS:
        raise ValueError("more rows than a sheet holds; use write_workbooks")
    put_file(df.sparkSession, path, workbook_bytes(df.columns, df.toLocalIterator(), _valid_sheet(df, sheet)))
    return n


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: the name that each has until all tasks are done, and the one that it gets."""

    names: list[tuple[str, str]]


class WorkbookWriter(DataSourceArrowWriter):
    """A task's rows as workbooks of at most `rows` rows. Files are hidden until all tasks are done; those of failed tries stay hidden."""

    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.folder = options["path"].removeprefix("file://").removeprefix("file:")
        if "://" in self.folder:
            raise ValueError("workbooks are written to folders that driver and executors mount")
        self.sheet, self.rows = options.get("sheet", "Sheet1"), min(SHEET_ROWS, int(options.get("rows", 100_000)))
        self.columns, self.overwrite = columns, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        os.makedirs(self.folder, exist_ok=True)
        rows = (tuple(r.values()) for batch in iterator for r in batch.to_pylist())
        names = []
        for k in itertools.count():
            some = list(itertools.islice(rows, self.rows))
            # The first task writes a header even if there is no row.
            if not some and (k or task.partitionId()):
                break
            final = f"part-{task.partitionId():05d}-{k:05d}-{task.stageId()}.xlsx"
            hidden = f".{final}.{task.taskAttemptId()}"
            with open(os.path.join(self.folder, hidden), "wb") as out:
                out.write(workbook_bytes(self.columns, some, self.sheet))
            names.append((hidden, final))
            if len(some) < self.rows:
                break
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            for name in os.listdir(self.folder):
                if re.fullmatch(r"part-[-0-9]+\.xlsx", name):
                    os.remove(os.path.join(self.folder, name))
        for hidden, final in itertools.chain.from_iterable(m.names for m in messages if m):
            os.replace(os.path.join(self.folder, hidden), os.path.join(self.folder, final))

    def abort(self, messages: list[Written | None]) -> None:
        for hidden, _ in itertools.chain.from_iterable(m.names for m in messages if m):
            os.remove(os.path.join(self.folder, hidden))


class WorkbookSource(DataSource):
    """The format panel_workbook, for writing. Options: path, sheet, and rows, the most in a workbook."""

    @classmethod
    def name(cls) -> str:
        return "panel_workbook"

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options, schema.names, overwrite)


def write_workbooks(df: DataFrame, folder: str, sheet: str, rows: int = 100_000, mode: str = "append") -> None:
    """Writes a table of any size as workbooks into a folder that driver and executors share, each of at most `rows` rows and of one task's; load_table reads the folder.

    Nothing goes through the driver. All workbooks appear at the end or, if a
    task fails, none; a table without rows is one workbook with its header alone.
    """
    df.sparkSession.dataSource.register(WorkbookSource)
    df.write.format("panel_workbook").option("sheet", _valid_sheet(df, sheet)).option("rows", str(rows)).mode(mode).save(folder)
