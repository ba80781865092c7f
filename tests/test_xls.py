"""Binary workbooks made by hand: streams large and small, all kinds of cells, strings over several records."""

import struct
from datetime import datetime

import pytest

from panelspark.sources import tables, xls

END, FREE, FAT = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD


def record(kind, data=b""):
    return struct.pack("<HH", kind, len(data)) + data


def text(value, length="H", wide=None):
    wide = any(ord(c) > 255 for c in value) if wide is None else wide
    return struct.pack(f"<{length}B", len(value), int(wide)) + value.encode("utf-16-le" if wide else "latin-1")


def entry(name, kind, start, size):
    raw = name.encode("utf-16-le")
    return raw.ljust(64, b"\0") + struct.pack("<HBB3I", len(raw) + 2 if name else 0, kind, 1, FREE, FREE, 1 if kind == 5 else FREE) + b"\0" * 36 + struct.pack("<IQ", start, size)


def compound(book, name="Workbook"):
    """A file of 512-byte sectors: FAT, directory, small-stream table, then the stream or, below 4,096 bytes, the small stream that has it."""
    data = -(-len(book) // 512)
    small = len(book) < 4096
    fat = [FAT, END, END] + [i + 4 for i in range(data - 1)] + [END]
    mini = list(range(1, -(-len(book) // 64))) + [END]
    root = entry("Root Entry", 5, 3 if small else END, data * 512 if small else 0)
    directory = root + entry(name, 2, 0 if small else 3, len(book)) + entry("", 0, 0, 0) * 2
    table = lambda x: struct.pack(f"<{len(x)}I", *x).ljust(512, b"\xff")
    assert len(fat) <= 128 and len(mini) <= 128
    header = xls.MAGIC + b"\0" * 16 + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<8I", 1, 1, 0, 4096, 2, 1, END, 0)
    return header + struct.pack("<109I", 0, *[FREE] * 108) + table(fat) + directory.ljust(512, b"\0") + table(mini if small else []) + book.ljust(data * 512, b"\0")


def workbook(cells, strings=(), cut=None, since_1904=False):
    """cut: bytes of the string table's first record; the rest goes to a record that continues it, in the middle of a string's characters."""
    table = struct.pack("<II", len(strings), len(strings)) + b"".join(map(text, strings))
    kept = [record(xls.SST, table)] if cut is None else [record(xls.SST, table[:cut]), record(xls.CONTINUE, bytes([1]) + table[cut:])]
    styles = b"".join(record(xls.XF, struct.pack("<HH", 0, f).ljust(20, b"\0")) for f in (0, 14, 170, 171))
    formats = record(xls.FORMAT, struct.pack("<H", 170) + text("yyyy-mm")) + record(xls.FORMAT, struct.pack("<H", 171) + text('0"d"'))
    begin = record(xls.BOF, struct.pack("<HH", 0x0600, 5)) + record(xls.DATE_1904, struct.pack("<H", since_1904)) + formats + styles
    sheets = lambda at: record(xls.BOUNDSHEET, struct.pack("<IBB", 7, 0, 2) + text("chart", "B")) + record(xls.BOUNDSHEET, struct.pack("<IBB", at, 0, 0) + text("s", "B"))
    head = lambda at: begin + sheets(at) + b"".join(kept) + record(xls.EOF)
    return head(len(head(0))) + record(xls.BOF, struct.pack("<HH", 0x0600, 0x10)) + b"".join(cells) + record(xls.EOF)


at = lambda row, col, style=0: struct.pack("<HHH", row, col, style)
label = lambda row, col, i: record(xls.LABELSST, at(row, col) + struct.pack("<I", i))
double = lambda row, col, x, style=0: record(xls.NUMBER, at(row, col, style) + struct.pack("<d", x))

CELLS = [
    *(label(0, c, c) for c in range(6)), double(1, 0, 1.5), double(1, 1, 45000, 1), label(1, 2, 6), record(xls.BOOLERR, at(1, 3) + b"\1\0"),
    record(xls.RK, at(1, 4) + struct.pack("<I", 7 << 2 | 2)), record(xls.FORMULA, at(1, 5) + b"\0" * 6 + b"\xff\xff" + b"\0" * 8), record(xls.STRING, text("셈")),
    record(xls.MULRK, struct.pack("<HH", 3, 0) + struct.pack("<HI", 3, 250 << 2 | 3) + struct.pack("<HI", 2, (45001 << 2) | 2) + struct.pack("<H", 1)), record(xls.LABEL, at(3, 2) + text("오래된")),
    record(xls.BOOLERR, at(3, 3) + b"\x07\1"), record(xls.RK, at(3, 4) + struct.pack("<I", (-3 << 2) & 0xFFFFFFFF | 2)), record(xls.FORMULA, at(3, 5) + struct.pack("<d", 2.0) + b"\0" * 8), double(3, 6, -0.25),
]
STRINGS = ["n", "at", "이름", "yes", "k", "f", "긴 글자 abc"]
ROWS = [(1.5, datetime(2023, 3, 15), "긴 글자 abc", True, 7, "셈", None), (None, None, None, None, None, None, None), (2.5, datetime(2023, 3, 16), "오래된", None, -3, "2", -0.25)]


@pytest.mark.parametrize("size", ["small", "large"])
@pytest.mark.parametrize("cut", [None, -6])
def test_cells(spark, tmp_path, size, cut):
    extra = [record(0x1234, b"x" * 2_000)] * (3 if size == "large" else 0)
    book = workbook([*extra, *CELLS], STRINGS, cut)
    assert (len(book) >= 4096) == (size == "large")
    (tmp_path / "b.XLS").write_bytes(compound(book))
    df = tables.load_table(spark, str(tmp_path / "b.XLS"))
    assert df.columns == ["n", "at", "이름", "yes", "k", "f", "Unnamed: 6"]
    assert dict(df.dtypes)["at"] == "timestamp_ntz" and [tuple(r) for r in df.collect()] == ROWS


def test_dates_since_1904_and_errors(spark, tmp_path):
    book = workbook([label(0, 0, 0), double(1, 0, 0.5, 1), double(2, 0, 366, 1)], ["d"], since_1904=True)
    (tmp_path / "d.xls").write_bytes(compound(book))
    assert [r.d for r in tables.load_table(spark, str(tmp_path / "d.xls")).collect()] == ["12:00:00", "1905-01-01 00:00:00"]
    for name, data in (("old", compound(book, "Book")), ("text", b"no compound file at all"), ("locked", compound(record(xls.BOF, b"\0" * 4) + record(xls.FILEPASS, b"\0" * 6)))):
        (tmp_path / f"{name}.xls").write_bytes(data)
        assert tables.load_table(spark, str(tmp_path / f"{name}.xls"), lenient=True) is None
        with pytest.raises(Exception, match="Excel 97|compound|password"):
            tables.load_table(spark, str(tmp_path / f"{name}.xls"))
    (tmp_path / "none.xls").write_bytes(compound(workbook([])))
    assert tables.load_table(spark, str(tmp_path / "none.xls")).columns == []
