"""Word's list numbers, questions and codebooks from Word files made by hand."""

import io
import tracemalloc
import zipfile

import pytest

from panelspark.operators import codebook, questionnaire
from panelspark.sources import word

SPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def para(text, num=None, level=0, style=None):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>' if num is not None else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def table(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def abstract(ident, *levels):
    """levels: (format, text, start, what else)."""
    made = "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="{s}"/><w:numFmt w:val="{f}"/><w:lvlText w:val="{t}"/>{more}</w:lvl>' for i, (f, t, s, more) in enumerate(levels))
    return f'<w:abstractNum w:abstractNumId="{ident}">{made}</w:abstractNum>'


def docx(body, numbering="", styles=""):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as book:
        book.writestr("word/document.xml", f"<w:document {SPACE}><w:body>{body}</w:body></w:document>")
        if numbering:
            book.writestr("word/numbering.xml", f"<w:numbering {SPACE}>{numbering}</w:numbering>")
        if styles:
            book.writestr("word/styles.xml", f"<w:styles {SPACE}>{styles}</w:styles>")
    return held.getvalue()


def rows_of(spark, *files):
    return word.paragraph_rows(spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(files)], "path string, content binary"))


def labels(spark, body, numbering, styles=""):
    return [r.label for r in rows_of(spark, docx(body, numbering, styles)).orderBy("pos").collect()]


OUTLINE = abstract(1, ("decimal", "%1.", 1, ""), ("lowerLetter", "%1.%2)", 1, ""), ("lowerRoman", "(%3)", 3, ""))
NUM = '<w:num w:numId="5"><w:abstractNumId w:val="1"/></w:num>'


def test_nested_lists_begin_again(spark):
    levels = [0, 1, 1, 2, 2, 1, 2, 0, 1, 0]
    found = labels(spark, "".join(para("x", 5, k) for k in levels), OUTLINE + NUM)
    assert found == ["1.", "1.a)", "1.b)", "(iii)", "(iv)", "1.c)", "(iii)", "2.", "2.a)", "3."]


def test_lists_that_share_and_restart(spark):
    """Two ids of one abstract list count on; an id with a start of its own begins again; text between them does not matter."""
    more = '<w:num w:numId="6"><w:abstractNumId w:val="1"/></w:num><w:num w:numId="7"><w:abstractNumId w:val="1"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="10"/></w:lvlOverride></w:num>'
    body = para("a", 5) + para("b", 5) + para("no list") + para("c", 6) + para("d", 7) + para("e", 7) + para("f", 5) + para("", 5) + para("g", 5) + para("h", 0)
    assert labels(spark, body, OUTLINE + NUM + more) == ["1.", "2.", None, "3.", "10.", "11.", "12.", "14.", None]


def test_restart_rules_levels_of_their_own_and_styles(spark):
    never = abstract(2, ("decimal", "Q%1.", 1, ""), ("decimal", "%2)", 1, '<w:lvlRestart w:val="0"/>'), ("upperRoman", "%1-%3", 1, "<w:isLgl/>"))
    nums = '<w:num w:numId="8"><w:abstractNumId w:val="2"/></w:num><w:num w:numId="9"><w:abstractNumId w:val="2"/><w:lvlOverride w:ilvl="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="bullet"/><w:lvlText w:val="*"/></w:lvl></w:lvlOverride></w:num>'
    styles = '<w:style w:styleId="A"><w:pPr><w:numPr><w:numId w:val="8"/></w:numPr></w:pPr></w:style><w:style w:styleId="B"><w:basedOn w:val="A"/><w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr></w:style><w:style w:styleId="C"><w:basedOn w:val="C"/></w:style>'
    body = para("a", style="A") + para("b", style="B") + para("c", style="B") + para("d", style="A") + para("e", style="B") + para("f", 8, 2) + para("g", 9) + para("h", style="C") + para("i", 99)
    assert labels(spark, body, never + nums, styles) == ["Q1.", "1)", "2)", "Q2.", "3)", "2-1", None, None, None]


@pytest.mark.parametrize(("kind", "shown"), [
    ("decimal", "1 4 9 14 27 40"), ("decimalZero", "01 04 09 14 27 40"), ("upperLetter", "A D I N AA NN"), ("lowerRoman", "i iv ix xiv xxvii xl"),
    ("ganada", "가 라 자 하 파 타"), ("decimalEnclosedCircle", "① ④ ⑨ ⑭ 27 40"), ("unknown", "1 4 9 14 27 40"), ("none", "      "),
])
def test_formats(spark, kind, shown):
    numbers = spark.createDataFrame([(n,) for n in (1, 4, 9, 14, 27, 40)], "n int").selectExpr("n", f"'{kind}' AS k")
    found = [r[0] for r in numbers.select(word.number_text(numbers["n"], numbers["k"])).collect()]
    assert found == ([""] * 6 if kind == "none" else shown.split(" "))


def test_large_roman(spark):
    numbers = spark.createDataFrame([(n,) for n in (49, 99, 444, 1994, 3999)], "n int")
    assert [r[0] for r in numbers.select(word._roman(numbers["n"])).collect()] == ["XLIX", "XCIX", "CDXLIV", "MCMXCIV", "MMMCMXCIX"]


BODY = (
    para("Survey of 2024") + para("SQ1. 귀하의 성별은? ① 남 ② 여") + para("Q1) Which brands do you know? (select all that apply)") + para("1) Alpha  2) Beta 2.5") + para("3) Gamma")
    + para("Q2. How old are you?") + para("____ years") + para("Q3-1. Please rate each.") + table(["", "① bad", "② fair", "③ good"], ["Price", "①", "②", "③"], ["Taste", "①", "②", "③"])
    + para("Q4. Rank the top 2 choices.") + para("Red", 5, 1) + para("Green", 5, 1) + para("Blue", 5, 1)
    + para("Q5. Region?") + table(["Code", "Name"], ["1", "North"], ["12", "South"]) + para("Q6. Why did you choose this brand?") + para("Q7. Job?") + table(["① office", "② shop"], ["③ home", "④ (other)"])
    + para("Numbered?", 5, 0) + para("yes", 6, 0) + para("no", 6, 0)
)
LISTS = OUTLINE + abstract(3, ("decimal", "%1)", 1, "")) + NUM + '<w:num w:numId="6"><w:abstractNumId w:val="3"/></w:num>'


def test_codebook_of_all_kinds(spark):
    book = questionnaire.codebook_of(rows_of(spark, docx(BODY, LISTS), docx(para("Q9. Only?")), docx("")))
    found = {(r.path, r.spss_name): (r.question, r.var_label, r.q_type, [tuple(c) for c in r.codes]) for r in book.collect()}
    scale, colours = [(1, "bad"), (2, "fair"), (3, "good")], [(1, "Red"), (2, "Green"), (3, "Blue")]
    brands = "Which brands do you know? (select all that apply)"
    assert found == {
        ("f0", "SQ1"): ("SQ1", "귀하의 성별은?", "single", [(1, "남"), (2, "여")]),
        ("f0", "Q1_1"): ("Q1", f"{brands} - Alpha", "multi", [(1, "Alpha")]),
        ("f0", "Q1_2"): ("Q1", f"{brands} - Beta 2.5", "multi", [(1, "Beta 2.5")]),
        ("f0", "Q1_3"): ("Q1", f"{brands} - Gamma", "multi", [(1, "Gamma")]),
        ("f0", "Q2"): ("Q2", "How old are you?", "open", []),
        ("f0", "Q3_1_1"): ("Q3-1", "Please rate each. - Price", "grid", scale),
        ("f0", "Q3_1_2"): ("Q3-1", "Please rate each. - Taste", "grid", scale),
        ("f0", "Q4_1"): ("Q4", "Rank the top 2 choices. - rank 1", "rank", colours),
        ("f0", "Q4_2"): ("Q4", "Rank the top 2 choices. - rank 2", "rank", colours),
        ("f0", "Q5"): ("Q5", "Region?", "single", [(1, "North"), (12, "South")]),
        ("f0", "Q6"): ("Q6", "Why did you choose this brand?", "open", []),
        ("f0", "Q7"): ("Q7", "Job?", "single", [(1, "office"), (2, "shop"), (3, "home"), (4, "(other)")]),
        ("f0", "Q1"): ("Q1", "Numbered?", "single", [(1, "yes"), (2, "no")]),
        ("f1", "Q9"): ("Q9", "Only?", "open", []),
    }
    sheet = [tuple(r) for r in questionnaire.codebook_sheet(book.filter("path = 'f0'")).collect()]
    assert sheet[:2] == [("SQ1", "SQ1", "귀하의 성별은?", "single", 1, "남"), ("SQ1", "SQ1", "귀하의 성별은?", "single", 2, "여")] and ("Q2", "Q2", "How old are you?", "open", None, None) in sheet
    lines = {r.spss_name: r.line for r in codebook.value_labels(questionnaire.code_rows(book)).collect()}
    assert lines["Q5"] == "VALUE LABELS Q5 1 'North' 12 'South'." and "Q2" not in lines


def test_files_without_questions(spark):
    files = spark.createDataFrame([("a", docx(para("hello"))), ("b", None), ("c", docx(""))], "path string, content binary")
    assert [r.text for r in word.paragraph_rows(files).collect()] == ["hello"]
    assert questionnaire.codebook_of(word.paragraph_rows(files)).collect() == []


def test_text_boxes_deleted_text_and_nested_tables(spark):
    box = '<w:p><w:r><w:t>around</w:t><w:drawing><w:txbxContent><w:p><w:r><w:t>inside</w:t></w:r></w:p></w:txbxContent></w:drawing></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p>'
    nested = f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{para("left")}{table(["deep"])}</w:tc><w:tc>{para("right")}</w:tc></w:tr></w:tbl>'
    rows = rows_of(spark, docx(box + nested)).orderBy("pos").collect()
    assert [(r.text, r.tbl, r.row, r.col) for r in rows] == [("around", None, None, None), ("inside", None, None, None), ("left", 0, 0, 0), ("deep", 1, 0, 0), ("right", 0, 0, 2)]


def test_a_long_file_is_read_in_pieces():
    """A file of 60,000 paragraphs: the first rows come before the rest is parsed, and no more than a part of its text is held."""
    content = docx(para("Q1. a") + table(["deep"]) + f"<w:sdt>{para('inside')}</w:sdt>" + para("Is this so? " * 8) * 60_000 + "<w:sectPr/>")
    tracemalloc.start()
    rows = word.word_rows(content)
    assert [next(rows)["text"] for _ in range(3)] == ["Q1. a", "deep", "inside"]
    count = sum(1 for _ in rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 60_000 and peak < 4_000_000


def test_a_task_hands_over_pieces(spark):
    rows = rows_of(spark, docx(para("x", 5) * 2_500, OUTLINE + NUM), docx("")).orderBy("pos").collect()
    assert [(r.pos, r.number, r.label) for r in rows] == [(i, i + 1, f"{i + 1}.") for i in range(2_500)]


def test_levels_are_told_once_in_a_file(spark, monkeypatch):
    """Nine levels in every row of a list were most of what Python handed over; files are read once."""
    levels = [{"start": 1, "override": None, "format": "decimal", "text": "%1.", "restart": None, "legal": False}] * word.LEVELS
    row = {"tbl": None, "row": None, "col": None, "text": "x", "list": "0", "level": 0, "levels": levels}
    monkeypatch.setattr(word, "word_rows", lambda content: [row | {"place": i, "num": "12"[i % 2]} for i in range(6)])
    told = [r["levels"] is not None for r in word._told_once(word.word_rows(b""))]
    assert told == [True, True, False, False, False, False]
