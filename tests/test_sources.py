"""Readers, writers, quality, codebook and streaming tools on small hand-made inputs."""

import zipfile
from datetime import datetime

import pytest

from panelspark.operators import codebook, quality
from panelspark.sources import documents, tables, word
from panelspark.streaming import responses


def write(path, data):
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize(("data", "columns", "rows"), [
    (b"a,b\n1,x\n", ["a", "b"], [(1, "x")]),
    ("﻿이름,id\n똠방,1\n".encode(), ["이름", "id"], [("똠방", 1)]),
    ("id,이름\n1,똠방\n".encode("cp949"), ["id", "이름"], [(1, "똠방")]),
    (b"a,b,a\n1,2,3\n", ["a", "b", "a.1"], [(1, 2, 3)]),
    (b"a,b,c\nNA,,True\n2,n/a,False\n", ["a", "b", "c"], [(None, None, True), (2, None, False)]),
    (b'a,b\n1.5,"x,""y"""\n2,z\n', ["a", "b"], [(1.5, 'x,"y"'), (2.0, "z")]),
    (b"a,b\n1,2,3\n4,5\n", ["a", "b", "Unnamed: 2"], [(1, 2, 3), (4, 5, None)]),
    (b'"How\nold?",b\n1,"two\nlines"\n\n2,x,y\n', ["How\nold?", "b", "Unnamed: 2"], [(1, "two\nlines", None), (2, "x", "y")]),
    ("나이,\"둘\n줄\"\n1,똠\n".encode("cp949"), ["나이", "둘\n줄"], [(1, "똠")]),
    (b"", [], []),
])
def test_csv(spark, tmp_path, data, columns, rows):
    df = tables.load_table(spark, write(tmp_path / "T.CSV", data))
    assert df.columns == columns and [tuple(r) for r in df.collect()] == rows


def test_other_paths(spark, tmp_path):
    assert tables.load_table(spark, None) is None
    with pytest.raises(ValueError):
        tables.load_table(spark, "x.tsv")
    assert tables.load_table(spark, "x.tsv", lenient=True) is None
    assert tables.load_table(spark, write(tmp_path / "bad.xlsx", b"no workbook"), lenient=True) is None


def test_workbooks(spark, tmp_path):
    book = spark.createDataFrame([("Q1", "나이 <&>", 3), ("Q2", None, 4)], "question string, label string, codes int")
    path = str(tmp_path / "book.xlsx")
    assert documents.write_workbook(book, path, "코드북") == 2
    df = tables.load_table(spark, path)
    assert df.columns == ["question", "label", "codes"] and [tuple(r) for r in df.collect()] == [("Q1", "나이 <&>", 3), ("Q2", None, 4)]


def test_folder_with_two_charsets(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("이름,id\n똠방,1\n".encode())
    (tmp_path / "b.csv").write_bytes("이름,id\n햏,2\n".encode("cp949"))
    (tmp_path / "c.csv").write_bytes('이름,id\n"두\n줄",3,x\n'.encode())
    df = tables.load_table(spark, str(tmp_path))
    assert df.columns == ["이름", "id", "Unnamed: 2"] and {tuple(r) for r in df.collect()} == {("똠방", 1, None), ("햏", 2, None), ("두\n줄", 3, "x")}
    (tmp_path / "b.csv").write_bytes("다른,id\n햏,2\n".encode("cp949"))
    with pytest.raises(ValueError):
        tables.load_table(spark, str(tmp_path))


def test_dates_blank_and_wide_rows_of_workbooks(spark, tmp_path):
    space = "http://schemas.openxmlformats.org"
    main = f'xmlns="{space}/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{space}/officeDocument/2006/relationships"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.0&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        row = lambda r, *cells: f'<row r="{r}">' + "".join(f'<c s="{s}"><v>{v}</v></c>' if s is not None else f'<c t="inlineStr"><is><t>{v}</t></is></c>' for s, v in cells) + "</row>"
        rows = row(1, (None, "at"), (None, "n"), (None, "mixed")) + row(2, (1, 45000), (3, 1.5), (2, 45000.5)) + row(4, (2, 45001.25), (0, 2), (None, "later"), (0, 7))
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
    df = tables.load_table(spark, str(tmp_path / "d.xlsx"))
    assert df.columns == ["at", "n", "mixed", "Unnamed: 3"] and dict(df.dtypes)["at"] == "timestamp_ntz"
    rows = {tuple(r) for r in df.collect()}
    assert rows == {(datetime(2023, 3, 15), 1.5, "2023-03-15 12:00:00", None), (None, None, None, None), (datetime(2023, 3, 16, 6), 2.0, "later", 7)}


def test_workbook_of_odd_cells(spark, tmp_path):
    odd = spark.createDataFrame([("a\x01b", float("nan"), True), ("c", float("inf"), False), ("d", 2.5, None)], "a string, b double, c boolean")
    path = str(tmp_path / "odd.xlsx")
    assert documents.write_workbook(odd, path, "a:b\x02" + "c" * 50) == 3
    assert [tuple(r) for r in tables.load_table(spark, path).collect()] == [("ab", None, True), ("c", None, False), ("d", 2.5, None)]
    with zipfile.ZipFile(path) as book:
        assert f'name="a_b{"c" * 27}' in book.read("xl/workbook.xml").decode()


def test_questionnaires(spark, tmp_path):
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    line = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
    body = line.format("SQ1. How old are you?") + "<w:p/>" + f"<w:tbl><w:tr><w:tc>{line.format('① yes')}</w:tc></w:tr></w:tbl>" + line.format("문2) 모두 고르세요")
    with zipfile.ZipFile(tmp_path / "q.docx", "w") as book:
        book.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
    read = word.read_questionnaires(spark, str(tmp_path))
    assert [(r.pos, r.in_table, r.text) for r in read.orderBy("pos").collect()] == [(0, False, "SQ1. How old are you?"), (1, True, "① yes"), (2, False, "문2) 모두 고르세요")]
    asked = word.questions(read)
    kinds = asked.select("question", codebook.question_kind(asked["text"]).alias("kind")).collect()
    assert {tuple(r) for r in kinds} == {("SQ1", "single"), ("문2", "multi")}


def test_quality(spark):
    df = spark.createDataFrame([(1, 3, 3, 3, "fine"), (2, 3, 3, None, "NA lol"), (3, 1, 2, 1, None)], "id int, Q2 int, Q9 int, Q10 int, OE string")
    assert quality.question_range(df, "Q2", "Q10") == ["Q2", "Q9", "Q10"]
    flags = df.select(quality.straight_line(df, ["Q2", "Q9", "Q10"]), quality.has_keyword(df["OE"], ["lol"])).collect()
    assert [tuple(r) for r in flags] == [(True, False), (False, True), (False, False)]
    assert [r.id for r in quality.remove_flagged(df, df.filter("id = 2"), "id").orderBy("id").collect()] == [1, 3]


def test_codebook(spark):
    raw = spark.createDataFrame([("Q1",), ("Q2",), ("X9",)], "raw_name string")
    book = spark.createDataFrame([("SQ1",), ("Q2",), ("SQ01",)], "spss_name string")
    assert {tuple(r) for r in codebook.match_names(raw, book).collect()} == {("Q1", "SQ01", "normalized"), ("Q2", "Q2", "exact"), ("X9", None, "none")}
    codes = spark.createDataFrame([("SQ1", 10, "it's"), ("SQ1", 2, "no"), ("SQ2", 1, None)], "spss_name string, code int, label string")
    assert {r.line for r in codebook.value_labels(codes).collect()} == {"VALUE LABELS SQ1 2 'no' 10 'it''s'.", "VALUE LABELS SQ2 1 ''."}
    names = spark.createDataFrame([("Q1", "SQ1"), ("Q2", "Q2")], "raw_name string, spss_name string")
    assert [r.line for r in codebook.rename_syntax(names).collect()] == ["RENAME VARIABLES (Q1 = SQ1)."]
    recodes = spark.createDataFrame([("SQ1", 2, 1), ("SQ1", 1, 0)], "spss_name string, old int, new int")
    assert codebook.recode_syntax(recodes).first().line == "RECODE SQ1 (1 = 0) (2 = 1)."
    labels = spark.createDataFrame([("SQ1", "나이")], "spss_name string, var_label string")
    assert codebook.variable_labels(labels).first().line == "VARIABLE LABELS SQ1 '나이'."
    with pytest.raises(ValueError):
        codebook.rename(names, {"raw_name": "spss_name"})


def test_streams(spark, tmp_path):
    schema = "id int, Q1 int, Q2 int, OE string, m_key string"
    spark.createDataFrame([(1, 2, 2, "ok", "a"), (2, 1, 2, "lol", "a"), (3, 1, 1, None, "b")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    main = spark.createDataFrame([("a", 2.0), ("b", 5.0)], "m_key string, target double")
    for name, df, mode in (("flags", responses.flagged(stream, ["Q1", "Q2"], "OE", ["lol"]), "append"), ("fills", responses.quota_progress(stream, main, "m_key"), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert {(r.id, r.straight, r.keyword) for r in spark.table("flags").collect()} == {(1, True, False), (2, False, True), (3, True, False)}
    assert {tuple(r) for r in spark.table("fills").collect()} == {("a", 2, 2), ("b", 5, 1)}


def test_keywords_of_all_scripts(spark):
    """Signs, accents, particles behind Hangul, whole words; few by a pattern and many by an automaton agree."""
    texts = ["what???", "ÉTÉ comme hiver", "특이사항 없음요", "none", "nonesuch", "c++ is fun", "ｆｕｌｌ width", "있음", None, "", "x_none", "none, none"]
    words = ["???", "été", "없음", "none", "c++", "fun"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {0: {"???": 1}, 1: {"été": 1}, 2: {"없음": 1}, 3: {"none": 1}, 5: {"c++": 1, "fun": 1}, 11: {"none": 2}}
    assert {r.id for r in df.filter(quality.has_keyword(df["text"], words)).collect()} == set(want)
    many = [f"w{i}" for i in range(10_000)] + ["full", ""]
    found = {}
    for r in quality.keyword_hits(df, "id", "text", words + many).collect():
        found.setdefault(r.id, {})[r.keyword] = r.hits
    assert found == want | {6: {"full": 1}}
    assert quality.keyword_hits(df, "id", "text", []).collect() == [] and df.filter(quality.has_keyword(df["text"], [""])).count() == 0


def test_workbooks_from_tasks(spark, tmp_path):
    """Sheets are cut at their bound, nothing is left hidden, an empty table keeps its header, a failed task leaves no workbook."""
    folder = str(tmp_path / "books")
    df = spark.range(0, 103, 1, 4).selectExpr("id", "concat('n', id) AS name", "timestamp'2024-01-01 06:00:00' AS at")
    documents.write_workbooks(df, folder, "s:1", rows=10)
    assert len(list((tmp_path / "books").iterdir())) == 12 and all(p.suffix == ".xlsx" for p in (tmp_path / "books").iterdir())
    read = tables.load_table(spark, folder)
    assert sorted(map(tuple, read.collect())) == [(i, f"n{i}", datetime(2024, 1, 1, 6)) for i in range(103)]
    documents.write_workbooks(df.filter("false"), folder, "s", mode="overwrite")
    again = tables.load_table(spark, folder)
    assert again.columns == ["id", "name", "at"] and again.collect() == []
    bad = df.selectExpr("IF(id = 100, raise_error('no'), id) AS id")
    with pytest.raises(Exception, match="no"):
        documents.write_workbooks(bad, str(tmp_path / "bad"), "s")
    assert not list((tmp_path / "bad").glob("part-*"))
    with pytest.raises(Exception, match="mount"):
        documents.write_workbooks(df, "hdfs://x/y", "s")


def test_shared_strings_of_runs(spark, tmp_path):
    """Strings of one piece and of runs; readings are left out."""
    space = "http://schemas.openxmlformats.org"
    main = f'xmlns="{space}/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{space}/officeDocument/2006/relationships"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst {main}><si><t>city</t></si><si><r><t>東</t></r><r><rPr/><t>京</t></r><rPh sb="0" eb="2"><t>トウキョウ</t></rPh></si><si/></sst>')
        cells = "".join(f'<row r="{i + 1}"><c t="s"><v>{i}</v></c></row>' for i in range(2))
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData>{cells}<row r="3"><c t="inlineStr"><is><r><t>서</t></r><r><t>울</t></r></is></c></row></sheetData></worksheet>')
    assert [r.city for r in tables.load_table(spark, str(tmp_path / "s.xlsx")).collect()] == ["東京", "서울"]


def test_program_is_written_in_order(spark, tmp_path):
    lines = spark.createDataFrame([(i, f"LINE {i}.") for i in (3, 1, 2)], "ord long, line string").repartition(3)
    codebook.write_program(lines, str(tmp_path / "program"))
    (part,) = (tmp_path / "program").glob("part-*")
    assert part.read_text() == "LINE 1.\nLINE 2.\nLINE 3.\n"
