"""Queries of questionnaires and quota sheets, by name, with the SQL that must agree.

Spark makes the Word files and the sheets from the driver tables, so the work grows with these.
"""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators import codebook, questionnaire, quota, quota_keys
from panelspark.sources.word import paragraph_rows

_WORD_SPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _para(*text: str | Column, num: int | None = None, level: int = 0) -> Column:
    """A Word paragraph's XML, in a list if num names one."""
    props = "" if num is None else f'<w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr></w:pPr>'
    return F.concat(F.lit(f"<w:p>{props}<w:r><w:t>"), *[F.lit(t) if isinstance(t, str) else t for t in text], F.lit("</w:t></w:r></w:p>"))


def _word_table(*rows: tuple[str | Column, ...]) -> Column:
    cells = [F.concat(F.lit("<w:tr>"), *[F.concat(F.lit("<w:tc>"), _para(c), F.lit("</w:tc>")) for c in r], F.lit("</w:tr>")) for r in rows]
    return F.concat(F.lit("<w:tbl>"), *cells, F.lit("</w:tbl>"))


def _surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Word file (path, content) for each nation, with a question of one of five shapes about each of its customers.

    Files of even nations have questions and rank options numbered by a list, the others typed numbers.
    """
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    rows = _table(spark, sf_dir, "customer").repartition("c_nationkey").withColumn("n", n.cast("string"))
    listed = F.col("c_nationkey") % 2 == 0
    ask = lambda *t: F.when(listed, _para(*t, num=1)).otherwise(_para("Q", F.col("n"), ". ", *t))
    pick = lambda i, t: F.when(listed, _para(t, num=1, level=1)).otherwise(_para(f"({i}) ", t))
    shapes = (
        (ask("How is ", name, "?"), _para("____")),
        (ask("What is ", name, " in?"), _para("1) ", segment), _para("2) other")),
        (ask("Check all that apply to ", name, " ① rich ② poor ③ ", segment),),
        (ask("Please rate ", name, "."), _word_table(("", "① low", "② high"), ("price", "①", "②"), (segment, "①", "②"))),
        (ask("Rank the top 2 of ", name, "."), pick(1, "red"), pick(2, segment), pick(3, "blue")),
    )
    xml = F.element_at(F.array(*[F.concat(*s) for s in shapes]), (F.col("c_custkey") % 5 + 1).cast("int"))
    lists = (
        f'<w:numbering {_WORD_SPACE}><w:abstractNum w:abstractNumId="0">'
        '<w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="Q%1."/></w:lvl>'
        '<w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="decimalEnclosedCircle"/><w:lvlText w:val="%2"/></w:lvl>'
        '</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
    )

    def zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Files of a task's nations, one after the other; a nation's rows follow each other, and its file is packed as they come."""
        rows = (r for batch in batches for r in zip(batch["path"], batch["xml"], strict=True))
        for path, own in itertools.groupby(rows, key=lambda r: r[0]):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as book:
                with book.open("word/document.xml", "w", force_zip64=True) as out:
                    out.write(f"<w:document {_WORD_SPACE}><w:body>".encode())
                    for _, piece in own:
                        out.write((piece or "").encode())
                    out.write(b"</w:body></w:document>")
                book.writestr("word/numbering.xml", lists)
            yield pd.DataFrame({"path": [path], "content": [held.getvalue()]})

    path = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    pieces = rows.select("c_nationkey", "c_custkey", path.alias("path"), xml.alias("xml")).sortWithinPartitions("c_nationkey", "c_custkey")
    return pieces.select("path", "xml").mapInPandas(zipped, "path string, content binary")


def q30_questionnaire_codebook(spark, sf_dir):
    book = questionnaire.codebook_of(paragraph_rows(_surveys(spark, sf_dir)))
    codes = F.array_join(F.transform("codes", lambda c: F.concat_ws("=", c["code"].cast("string"), c["label"])), "|")
    return book.select("path", "question", "spss_name", "var_label", "q_type", codes.alias("codes"))


def q31_questionnaire_syntax(spark, sf_dir):
    book = questionnaire.codebook_of(paragraph_rows(_surveys(spark, sf_dir))).withColumn("spss_name", F.concat_ws("_", "path", "spss_name"))
    return codebook.value_labels(questionnaire.code_rows(book)).unionByName(codebook.variable_labels(book))


def q32_word_numbers(spark, sf_dir):
    return paragraph_rows(_surveys(spark, sf_dir)).select("path", "pos", "label", "text")


def _quota_sheets(spark, sf_dir):
    """Respondents, a main sheet by segment and area with totals by segment, and two sub sheets: by balance with a grand total, and by nation."""
    band = F.floor((F.col("c_acctbal") + 1000) / 2000).cast("string")
    people = _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("respondent_id"), F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") % 5).alias("area"), band.alias("band"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("score")
    )
    nothing = F.lit(None).cast("string")
    share = lambda parts: F.ceil(F.count(F.lit(1)) / parts).cast("double").alias("target")
    cells = lambda df, *q: df.select(*[c.cast("string").alias(n) for n, c in zip(("qt1", "qt2", "qt3"), q, strict=True)], "target")
    each = people.filter("area < 4").groupBy("segment", "area").agg(share(3))
    main = cells(each, F.col("segment"), F.col("area").cast("double"), nothing).unionByName(cells(people.groupBy("segment").agg(share(10)), F.col("segment"), F.lit("전체"), nothing))
    bands = cells(people.groupBy("band").agg(share(4)), F.concat(F.lit(" "), "band"), nothing, nothing).unionByName(cells(people.agg(share(5)), F.lit("합계"), nothing, nothing))
    nations = cells(people.groupBy("nation").agg(share(6)), F.col("nation"), nothing, nothing)
    sheets = [quota_keys.Sheet(c, d) for c, d in ((main, ("segment", "area")), (bands, ("band",)), (nations, ("nation",)))]
    return people, sheets[0], sheets[1:]


def q33_quota_keys(spark, sf_dir):
    rows = quota_keys.with_keys(*_quota_sheets(spark, sf_dir))
    return rows.select("respondent_id", "m_key", F.array_join(F.transform("sub_keys", lambda k: F.array_join(k, "+")), "/").alias("sub_keys"))


def q34_quota_from_sheets(spark, sf_dir):
    people, main, subs = _quota_sheets(spark, sf_dir)
    keyed = quota_keys.with_keys(people, main, subs)
    rows = quota.allocate(keyed, quota_keys.main_targets(main), quota_keys.sub_targets(subs), quota.Starts(deviation=0.0))
    return rows.select(F.col("rank").cast("long").alias("rank"), "respondent_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (q30_questionnaire_codebook, q31_questionnaire_syntax, q32_word_numbers, q33_quota_keys, q34_quota_from_sheets)}

#: Rows (path, question, spss_name, var_label, q_type, codes) of the codebooks of the nations' Word files.
_BOOK = """
WITH c AS (
  SELECT 'N' || c_nationkey AS path, c_nationkey, c_custkey, c_name, c_mktsegment AS s, c_custkey % 5 AS k, 'Q' || row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS q FROM customer
), v AS (
  SELECT c.*, CASE k WHEN 0 THEN 'How is ' || c_name || '?' WHEN 1 THEN 'What is ' || c_name || ' in?' WHEN 2 THEN 'Check all that apply to ' || c_name
      WHEN 3 THEN 'Please rate ' || c_name || '.' ELSE 'Rank the top 2 of ' || c_name || '.' END AS stem,
    ['open', 'single', 'multi', 'grid', 'rank'][k + 1] AS q_type,
    CASE k WHEN 2 THEN ['rich', 'poor', s] WHEN 3 THEN ['price', s] WHEN 4 THEN ['rank 1', 'rank 2'] ELSE [NULL] END AS parts FROM c
), book AS (
  SELECT path, q AS question, CASE WHEN part IS NULL THEN q ELSE q || '_' || i END AS spss_name, CASE WHEN part IS NULL THEN stem ELSE stem || ' - ' || part END AS var_label, q_type,
    CASE k WHEN 0 THEN '' WHEN 1 THEN '1=' || s || '|2=other' WHEN 2 THEN '1=' || part WHEN 3 THEN '1=low|2=high' ELSE '1=red|2=' || s || '|3=blue' END AS codes
  FROM (SELECT *, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i FROM v)
)"""

#: Rows (id, m, b, n, score): respondents with the keys of their main cell, balance and nation; and rows (cell, target) of all cells.
_KEYED = """
WITH RECURSIVE p AS (
  SELECT c_custkey AS id, c_mktsegment AS s, c_nationkey % 5 AS a, to_json([CAST(CAST(floor((c_acctbal + 1000) / 2000) AS BIGINT) AS VARCHAR)])::VARCHAR AS b,
    to_json([CAST(c_nationkey AS VARCHAR)])::VARCHAR AS n, c_acctbal AS score FROM customer
), k AS (
  SELECT id, to_json(CASE WHEN a < 4 THEN [s, CAST(a AS VARCHAR)] ELSE [s, NULL] END)::VARCHAR AS m, b, n, score FROM p
), cells AS (
  SELECT 'm' || to_json([s, CAST(a AS VARCHAR)])::VARCHAR AS cell, ceil(count(*) / 3)::BIGINT AS target FROM p WHERE a < 4 GROUP BY s, a
  UNION ALL SELECT 'm' || to_json([s, NULL])::VARCHAR, ceil(count(*) / 10)::BIGINT FROM p GROUP BY s
  UNION ALL SELECT 'b' || b, ceil(count(*) / 4)::BIGINT FROM p GROUP BY b
  UNION ALL SELECT 'b[null]', ceil(count(*) / 5)::BIGINT FROM p
  UNION ALL SELECT 'n' || n, ceil(count(*) / 6)::BIGINT FROM p GROUP BY n
)"""

ORACLE: dict[str, str] = {
    "q33_quota_keys": f"{_KEYED} SELECT id AS respondent_id, m AS m_key, b || '+[null]/' || n AS sub_keys FROM k",
    "q34_quota_from_sheets": f"""{_KEYED}, o AS (
  SELECT id, ['m' || m, 'b' || b, 'b[null]', 'n' || n] AS c, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS i FROM k
), r AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, FALSE AS ok, map_from_entries(list((cell, target))) AS room FROM cells
  UNION ALL
  SELECT o.i, o.id, a.ok, CASE WHEN a.ok THEN map_concat(room, map_from_entries(list_transform(o.c, lambda x: (x, room[x] - 1)))) ELSE room END
  FROM r JOIN o ON o.i = r.i + 1, LATERAL (SELECT len(list_filter(o.c, lambda x: room[x] <= 0)) = 0 AS ok) a
)
SELECT row_number() OVER (ORDER BY i) AS rank, id AS respondent_id FROM r WHERE ok""",
    "q30_questionnaire_codebook": f"{_BOOK} SELECT * FROM book",
    "q31_questionnaire_syntax": rf"""{_BOOK}
SELECT path || '_' || spss_name AS spss_name, 'VALUE LABELS ' || path || '_' || spss_name || ' ' || replace(regexp_replace(codes, '([0-9]+)=([^|]*)', '\1 ''\2''', 'g'), '|', ' ') || '.' AS line FROM book WHERE codes <> ''
UNION ALL SELECT path || '_' || spss_name, 'VARIABLE LABELS ' || path || '_' || spss_name || ' ''' || var_label || '''.' FROM book""",
    "q32_word_numbers": f"""{_BOOK},
r AS (
  SELECT path, c_custkey, c_nationkey % 2 = 0 AS listed, k, unnest(CASE k WHEN 0 THEN [stem, '____'] WHEN 1 THEN [stem, '1) ' || s, '2) other'] WHEN 2 THEN [stem || ' ① rich ② poor ③ ' || s]
      WHEN 3 THEN [stem, '① low', '② high', 'price', '①', '②', s, '①', '②'] ELSE [stem, 'red', s, 'blue'] END) AS text,
    unnest(range(CASE k WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 9 ELSE 4 END)) AS i, q FROM v
)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY c_custkey, i) - 1 AS pos,
  CASE WHEN listed AND i = 0 THEN q || '.' WHEN listed AND k = 4 THEN ['①', '②', '③'][i] END AS label,
  CASE WHEN NOT listed AND i = 0 THEN q || '. ' || text WHEN NOT listed AND k = 4 AND i > 0 THEN '(' || i || ') ' || text ELSE text END AS text FROM r""",
}
