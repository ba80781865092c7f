"""Questionnaires in Word files as rows: paragraphs, table cells and the numbers that Word prints.

A file's XML is read in one task, piece by piece, so a worker holds the packed
file and one block of its body; what its lists print is settled for all files at
once by running sums over the paragraphs of each list.
"""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.shared import written

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Levels of a list in the format.
LEVELS = 9
#: Paragraphs that a worker hands over at once.
PIECE_ROWS = 1_000
#: Lists of all files up to so many are broadcast; more are joined by shuffle.
BROADCAST_LISTS = 10_000
#: Korean letters that lists count with, fixed values.
GANADA, CHOSUNG = "가나다라마바사아자차카타파하", "ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎ"
_LEVEL = "start int, override int, format string, text string, restart int, legal boolean"
_ROW = f"path string, place long, tbl int, row int, col int, text string, list string, num string, level int, levels array<struct<{_LEVEL}>>"


def _value(element, tag: str, default: str | None = None) -> str | None:
    found = None if element is None else element.find(f"{_W}{tag}")
    return default if found is None else found.get(f"{_W}val", default)


def _level(lvl) -> dict:
    restart = _value(lvl, "lvlRestart")
    legal = lvl.find(f"{_W}isLgl") is not None and _value(lvl, "isLgl", "1") not in ("0", "false")
    return {
        "start": int(_value(lvl, "start", "0")), "override": None, "format": _value(lvl, "numFmt", "decimal"), "text": _value(lvl, "lvlText", ""),
        "restart": None if restart is None else int(restart), "legal": legal,
    }


def list_levels(numbering: bytes) -> dict[str, tuple[str, list[dict]]]:
    """For each list id its abstract list and its levels, with the overrides of the id."""
    root = ElementTree.fromstring(numbering)
    at = lambda e: int(e.get(f"{_W}ilvl", "0"))
    abstract = {a.get(f"{_W}abstractNumId"): {at(x): _level(x) for x in a.findall(f"{_W}lvl")} for a in root.findall(f"{_W}abstractNum")}
    made = {}
    for num in root.findall(f"{_W}num"):
        of = _value(num, "abstractNumId")
        levels = {k: dict(v) for k, v in abstract.get(of, {}).items()}
        for over in num.findall(f"{_W}lvlOverride"):
            if (own := over.find(f"{_W}lvl")) is not None:
                levels[at(over)] = _level(own)
            if (start := _value(over, "startOverride")) is not None and at(over) in levels:
                levels[at(over)]["override"] = int(start)
        none = {"start": 1, "override": None, "format": "none", "text": "", "restart": None, "legal": False}
        made[num.get(f"{_W}numId")] = (of, [levels.get(k, none) for k in range(LEVELS)])
    return made


def style_lists(styles: bytes) -> dict[str, tuple[str | None, str | None]]:
    """(list id, level) that a paragraph style has, itself or from the style it is based on."""
    own = {s.get(f"{_W}styleId"): s for s in ElementTree.fromstring(styles).findall(f"{_W}style")}

    def of(name: str | None, seen: frozenset = frozenset()) -> tuple[str | None, str | None]:
        style = own.get(name)
        if style is None or name in seen:
            return None, None
        mine = style.find(f"{_W}pPr/{_W}numPr")
        above = of(_value(style, "basedOn"), seen | {name})
        return _value(mine, "numId") or above[0], _value(mine, "ilvl") or above[1]

    return {name: of(name) for name in own}


def _said(p) -> str:
    """The text of a paragraph's own runs; deleted text and text boxes are not among them."""
    out: list[str] = []
    signs = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}

    def walk(element) -> None:
        for x in element:
            if x.tag == f"{_W}t":
                out.append(x.text or "")
            elif x.tag in signs:
                out.append(signs[x.tag])
            elif x.tag not in (f"{_W}del", f"{_W}pPr", f"{_W}drawing", f"{_W}pict") and not x.tag.endswith("}AlternateContent"):
                walk(x)

    walk(p)
    return "".join(out).strip()


def _blocks(source) -> Iterator:
    """The parts of a document in their order: each block of its body as soon as it is read, and let go afterwards; other parts whole."""
    open_: list = []
    for event, element in ElementTree.iterparse(source, ("start", "end")):
        if event == "start":
            open_.append(element)
            continue
        open_.pop()
        inside = len(open_) == 2 and open_[1].tag == f"{_W}body"
        if inside or len(open_) == 1 and element.tag != f"{_W}body":
            yield element
            open_[-1].remove(element)


def word_rows(content: bytes) -> Iterator[dict]:
    """A file's paragraphs in their order, those without text too: the innermost table's number, row and column, the text, the list and its level."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        lists = list_levels(book.read("word/numbering.xml")) if "word/numbering.xml" in names else {}
        styles = style_lists(book.read("word/styles.xml")) if "word/styles.xml" in names else {}
        with book.open("word/document.xml") as source:
            yield from _paragraphs(_blocks(source), lists, styles)


def _paragraphs(blocks: Iterator, lists: dict, styles: dict) -> Iterator[dict]:
    tables = 0

    def walk(element, cell: tuple) -> Iterator[tuple]:
        nonlocal tables
        for x in element:
            if x.tag == f"{_W}p":
                yield x, cell
                for box in x.iter(f"{_W}txbxContent"):
                    yield from walk(box, cell)
            elif x.tag == f"{_W}tbl":
                tables += 1
                mine = tables - 1
                for r, row in enumerate(x.findall(f"{_W}tr")):
                    col = 0
                    for tc in row.iter(f"{_W}tc") if row.find(f"{_W}tc") is None else row.findall(f"{_W}tc"):
                        yield from walk(tc, (mine, r, col))
                        col += int(_value(tc.find(f"{_W}tcPr"), "gridSpan", "1"))
            elif x.tag not in (f"{_W}tcPr", f"{_W}sectPr", f"{_W}del"):
                yield from walk(x, cell)

    found = (pair for block in blocks for pair in walk((block,), (None, None, None)))
    for place, (p, (tbl, row, col)) in enumerate(found):
        props = p.find(f"{_W}pPr")
        own = None if props is None else props.find(f"{_W}numPr")
        style = styles.get(_value(props, "pStyle"), (None, None))
        num, level = _value(own, "numId") or style[0], _value(own, "ilvl") or style[1] or "0"
        of, levels = lists.get(num, (None, None))
        level = min(int(level), LEVELS - 1) if levels else None
        yield {"place": place, "tbl": tbl, "row": row, "col": col, "text": _said(p), "list": of, "num": num if levels else None, "level": level, "levels": levels}


def _roman(n: Column) -> Column:
    """Roman numerals: strokes that are bundled, then written the short way."""
    steps = ("IIIII", "V"), ("VV", "X"), ("XXXXX", "L"), ("LL", "C"), ("CCCCC", "D"), ("DD", "M")
    short = ("DCCCC", "CM"), ("CCCC", "CD"), ("LXXXX", "XC"), ("XXXX", "XL"), ("VIIII", "IX"), ("IIII", "IV")
    return reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), [*steps, *short], F.repeat(F.lit("I"), n))


def number_text(n: Column, kind: Column) -> Column:
    """A list's number in its format; formats that are not known print as decimals."""
    letter = F.repeat(F.char(97 + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int"))
    of = lambda letters: F.substring(F.lit(letters), ((n - 1) % len(letters) + 1).cast("int"), F.lit(1))
    circle = F.when(n.between(1, 20), of("①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳")).otherwise(n.cast("string"))
    kinds = {
        "none": F.lit(""), "decimalZero": F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string")),
        "lowerLetter": letter, "upperLetter": F.upper(letter), "lowerRoman": F.lower(_roman(n)), "upperRoman": _roman(n),
        "ganada": of(GANADA), "chosung": of(CHOSUNG), "decimalEnclosedCircle": circle,
    }
    text = n.cast("string")
    for name, column in kinds.items():
        text = F.when(kind == name, column).otherwise(text)
    return F.when(n < 1, n.cast("string")).otherwise(text)


def with_numbers(rows: DataFrame) -> DataFrame:
    """rows of files with `number`, a paragraph's place in its list, and `label`, what Word prints before it; null without a list.

    Lists that share an abstract list count on from each other. A level begins
    again after a paragraph of a higher level, or of those that its restart rule
    names, and at the first paragraph of a list id that overrides the start. A
    level that was skipped shows its start. Bullets have no label. The levels of a
    list id stand in one of its rows at least.
    """
    lists = rows.filter("levels IS NOT NULL").groupBy("path", "num").agg(F.first("levels").alias("levels"))
    lists = F.broadcast(lists) if lists.limit(BROADCAST_LISTS + 1).count() <= BROADCAST_LISTS else lists
    rows = rows.drop("levels")
    order = Window.partitionBy("path", "list").orderBy("place")
    first = F.row_number().over(Window.partitionBy("path", "list", "num", "level").orderBy("place")) == 1
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    listed = rows.filter("num IS NOT NULL").join(lists, ["path", "num"], "left").withColumn("first", first)
    at = lambda k: F.col("levels")[k]
    here = [(F.col("level") == k).cast("int") for k in range(LEVELS)]
    listed = listed.select("*", *[F.sum(here[k]).over(run).alias(f"s{k}") for k in range(LEVELS)])
    fresh = [(F.col("level") == k) & F.col("first") & at(k)["override"].isNotNull() for k in range(LEVELS)]
    again = [(F.col("level") < F.coalesce(at(k)["restart"], F.lit(k))) | fresh[k] for k in range(LEVELS)]
    # Where the count begins again: what was counted before, and the start that a list id sets there.
    begun = [F.struct((F.col(f"s{k}") - here[k]).alias("ahead"), F.when(fresh[k], at(k)["override"]).alias("start")) for k in range(LEVELS)]
    listed = listed.select("*", *[F.last(F.when(again[k], begun[k]), ignorenulls=True).over(run).alias(f"b{k}") for k in range(LEVELS)])
    counts = [F.greatest(F.col(f"s{k}") - F.coalesce(F.col(f"b{k}.ahead"), F.lit(0)), F.lit(1)) for k in range(LEVELS)]
    starts = [F.coalesce(F.col(f"b{k}.start"), at(k)["override"], at(k)["start"]) for k in range(LEVELS)]
    listed = listed.withColumn("ns", F.array(*[(starts[k] + counts[k] - 1).cast("int") for k in range(LEVELS)]))
    mine = F.get("levels", F.col("level"))
    kind = lambda i: F.when(mine["legal"], F.lit("decimal")).otherwise(F.get("levels", i)["format"])
    listed = listed.withColumn("shown", F.transform("ns", lambda n, i: number_text(n, kind(i))))
    label = reduce(lambda text, k: F.replace(text, F.lit(f"%{k + 1}"), F.col("shown")[k]), range(LEVELS), mine["text"])
    label = F.when(mine["format"] == "bullet", F.lit(None)).otherwise(F.nullif(F.trim(label), F.lit("")))
    numbered = listed.select(*rows.columns, F.get("ns", F.col("level")).alias("number"), label.alias("label"))
    return numbered.unionByName(rows.filter("num IS NULL").withColumns({"number": F.lit(None).cast("int"), "label": F.lit(None).cast("string")}))


def _told_once(rows: Iterator[dict]) -> Iterator[dict]:
    """Rows of a file without the levels of lists that a row before them has."""
    told: set = set()
    for row in rows:
        yield row | {"levels": None} if row["num"] in told else row
        told.add(row["num"])


def paragraph_rows(files: DataFrame) -> DataFrame:
    """Rows (path, pos, in_table, text, tbl, row, col, level, number, label) of the paragraphs with text of files (path, content).

    pos counts a file's paragraphs with text; null contents have no rows. Files are
    read once, into a table in the shared folder that has each list's levels once.
    """

    names = [c.split()[0] for c in _ROW.split(", ")[:10]]

    def rows(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                found = iter(()) if content is None else _told_once(word_rows(content))
                while piece := [{"path": name, **r} for r in itertools.islice(found, PIECE_ROWS)]:
                    yield pd.DataFrame(piece, columns=names, dtype=object)

    numbered = with_numbers(written(files.select("path", "content").mapInPandas(rows, _ROW), "paragraphs")).filter("text <> ''")
    pos = (F.row_number().over(Window.partitionBy("path").orderBy("place")) - 1).cast("long")
    return numbered.select("path", pos.alias("pos"), F.col("tbl").isNotNull().alias("in_table"), "text", "tbl", "row", "col", "level", "number", "label")


def read_questionnaires(spark: SparkSession, path: str) -> DataFrame:
    """paragraph_rows of one or many .docx files, a file being one task's work."""
    return paragraph_rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path))


#: How a question opens: letters and a number, or 문 and a number, then a dot or a bracket.
OPENING = r"^\s*((?:[A-Za-z]{1,3}|문)\s?\d+(?:[-_.]\d+)*)\s*[.)]\s*([\s\S]+)$"


def opening(paragraphs: DataFrame) -> DataFrame:
    """paragraphs with `question` and `stem` where one opens a question, by what is typed or what its list prints.

    A list's plain number with a dot on its first level, `3.`, opens question Q3;
    on deeper levels `3.1.` opens Q3_1.
    """
    said = F.concat_ws(" ", "label", "text")
    plain = F.col("label").rlike(r"^\d+(\.\d+)*\.$") & ~F.col("in_table")
    name = F.when(said.rlike(OPENING), F.regexp_extract(said, OPENING, 1)).when(plain, F.concat(F.lit("Q"), F.rtrim(F.col("label"), F.lit("."))))
    stem = F.when(said.rlike(OPENING), F.regexp_extract(said, OPENING, 2)).when(plain, F.col("text"))
    return paragraphs.withColumn("question", F.translate(F.regexp_replace(name, r"\s", ""), ".", "_")).withColumn("stem", F.trim(stem))


def questions(paragraphs: DataFrame) -> DataFrame:
    """Rows (path, pos, question, text): paragraphs that open with a number such as `Q1.`, `SQ2)` or `문3.`, typed or printed by a list."""
    return opening(paragraphs).filter("question IS NOT NULL").select("path", "pos", "question", F.col("stem").alias("text"))
