"""The first sheet of a workbook in the binary format of Excel 97 to 2003, as text.

The file is a compound of sectors in chains; its stream Workbook is a row of
records. A sheet of this format has 65,536 rows at most, so it is one task's work.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

#: Record types, fixed values of the format.
EOF, FORMULA, DATE_1904, FILEPASS, CONTINUE, BOUNDSHEET, MULRK, XF, SST, LABELSST = 0x0A, 0x06, 0x22, 0x2F, 0x3C, 0x85, 0xBD, 0xE0, 0xFC, 0xFD
NUMBER, LABEL, BOOLERR, STRING, RK, FORMAT, BOF = 0x0203, 0x0204, 0x0205, 0x0207, 0x027E, 0x041E, 0x0809
MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")


def stream(content: bytes, name: str) -> bytes | None:
    """A named stream of a compound file, or None."""
    if content[:8] != MAGIC:
        raise ValueError("no compound file")
    shift, mini_shift = struct.unpack_from("<HH", content, 30)
    first_dir, _, cutoff, first_mini, _, first_more, _ = struct.unpack_from("<7I", content, 48)
    size = 1 << shift
    sector = lambda i: content[(i + 1) * size : (i + 2) * size]
    numbers = lambda data: list(struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4]))

    def chain(start: int, table: list[int]) -> Iterator[int]:
        for _ in range(len(table) + 1):
            if start >= len(table):  # the marks of an end are larger than any sector
                return
            yield start
            start = table[start]
        raise ValueError("a chain of sectors has no end")

    listed = list(struct.unpack_from("<109I", content, 76))
    seen = 0
    while first_more < 0xFFFFFFFA and seen * size < len(content):
        more = numbers(sector(first_more))
        listed += more[:-1]
        first_more, seen = more[-1], seen + 1
    table = [x for i in listed if i < 0xFFFFFFFA for x in numbers(sector(i))]
    join = lambda start: b"".join(map(sector, chain(start, table)))
    entries = {}
    directory = join(first_dir)
    for at in range(0, len(directory) - 127, 128):
        length, kind = struct.unpack_from("<HB", directory, at + 64)
        start, bytes_ = struct.unpack_from("<II", directory, at + 116)
        if kind:
            entries[directory[at : at + max(0, length - 2)].decode("utf-16-le").lower()] = start, bytes_, kind
    found = entries.get(name.lower())
    if found is None:
        return None
    start, bytes_, _ = found
    if bytes_ >= cutoff:
        return join(start)[:bytes_]
    small = join(next(s for s, _, kind in entries.values() if kind == 5))
    mini = 1 << mini_shift
    return b"".join(small[i * mini : (i + 1) * mini] for i in chain(start, numbers(join(first_mini))))[:bytes_]


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(type, data and the data of records that continue it) up to the end of the substream at a place."""
    held: tuple[int, list[bytes]] | None = None
    while at + 4 <= len(data):
        kind, length = struct.unpack_from("<HH", data, at)
        body = data[at + 4 : at + 4 + length]
        at += 4 + length
        if kind == CONTINUE and held:
            held[1].append(body)
            continue
        if held:
            yield held
        if kind == EOF:
            return
        held = kind, [body]
    if held:
        yield held


class Pieces:
    """Reads over a record and those that continue it."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n and self.part < len(self.parts):
            some = self.parts[self.part][self.at : self.at + n - len(out)]
            out += some
            self.at += len(some)
            if self.at >= len(self.parts[self.part]) and len(out) < n:
                self.part, self.at = self.part + 1, 0
        return out

    def number(self, kind: str) -> int:
        return struct.unpack(f"<{kind}", self.take(struct.calcsize(f"<{kind}")))[0]

    def string(self, length_kind: str = "H") -> str:
        """A string; where its characters go on in the next record, that one begins with how they are kept there."""
        left, flags = self.number(length_kind), self.number("B")
        runs = self.number("H") if flags & 8 else 0
        extra = self.number("I") if flags & 4 else 0
        text = ""
        while left and self.part < len(self.parts):
            width = 2 if flags & 1 else 1
            here = min(left, (len(self.parts[self.part]) - self.at) // width)
            text += self.take(here * width).decode("utf-16-le" if width == 2 else "latin-1", "surrogatepass")
            left -= here
            if left:
                self.part, self.at = self.part + 1, 0
                if self.part < len(self.parts):
                    flags = self.number("B")
        self.take(4 * runs + extra)
        return text


def rk_number(raw: int) -> float:
    """A number kept in 30 bits: whole or the upper part of a double, as it is or in hundredths."""
    value = float((raw - (1 << 32) if raw >> 31 else raw) >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


def xls_rows(content: bytes, is_date: Callable[[int, dict[int, str]], bool], date_text: Callable[[float, bool], str]) -> Iterator[list[str | None]]:
    """The cells of the first sheet as text, row by row, blank rows included.

    is_date tells whether a format number, or its own code, is one of dates; such
    cells go through date_text. Errors are missing cells; formulas have their last
    value. Files with a password and those older than Excel 97 are an error.
    """
    book = stream(content, "Workbook")
    if book is None:
        raise ValueError("no workbook of Excel 97 or later")
    formats: dict[int, str] = {}
    styles: list[int] = []
    strings: list[str] = []
    sheet, since_1904 = None, False
    for kind, parts in records(book):
        data, pieces = parts[0], Pieces(parts)
        if kind == FILEPASS:
            raise ValueError("the workbook has a password")
        if kind == DATE_1904:
            since_1904 = data[:2] == b"\x01\x00"
        elif kind == FORMAT:
            own = pieces.number("H")
            formats[own] = pieces.string()
        elif kind == XF:
            styles.append(struct.unpack_from("<H", data, 2)[0])
        elif kind == BOUNDSHEET and sheet is None and data[5] == 0:
            sheet = struct.unpack_from("<I", data)[0]
        elif kind == SST:
            pieces.take(4)
            strings = [pieces.string() for _ in range(pieces.number("I"))]
    if sheet is None:
        return
    dates = [is_date(f, formats) for f in styles]
    cells: dict[int, dict[int, str | None]] = {}

    def put(row: int, col: int, text: str | None) -> None:
        cells.setdefault(row, {})[col] = text

    def number(value: float, style: int) -> str:
        if style < len(dates) and dates[style]:
            return date_text(value, since_1904)
        return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)

    asked = None
    for kind, parts in records(book, sheet):
        data = parts[0]
        if kind == STRING and asked:
            put(*asked, Pieces(parts).string())
        if kind not in (NUMBER, RK, MULRK, LABELSST, LABEL, BOOLERR, FORMULA):
            continue
        row, col, style = struct.unpack_from("<HHH", data)
        asked = None
        if kind == NUMBER:
            put(row, col, number(struct.unpack_from("<d", data, 6)[0], style))
        elif kind == RK:
            put(row, col, number(rk_number(struct.unpack_from("<I", data, 6)[0]), style))
        elif kind == MULRK:
            for k, at in enumerate(range(4, len(data) - 2, 6)):
                one, raw = struct.unpack_from("<HI", data, at)
                put(row, col + k, number(rk_number(raw), one))
        elif kind == LABELSST:
            put(row, col, strings[struct.unpack_from("<I", data, 6)[0]])
        elif kind == LABEL:
            put(row, col, Pieces([data[6:], *parts[1:]]).string())
        elif kind == BOOLERR:
            put(row, col, None if data[7] else str(bool(data[6])))
        elif data[12:14] != b"\xff\xff":
            put(row, col, number(struct.unpack_from("<d", data, 6)[0], style))
        elif data[6] == 0:
            asked = row, col
        elif data[6] == 1:
            put(row, col, str(bool(data[8])))
    for row in range(max(cells, default=-1) + 1):
        there = cells.get(row, {})
        yield [there.get(c) for c in range(max(there, default=-1) + 1)]
