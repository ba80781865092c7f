"""Queries of the panel operators, by name, with the SQL that must agree.

The driver tables hold no survey data, so each operator runs on stand-in columns.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.cells import collect_values
from panelspark.functions.text import SPACES, clean_text, natural_key, sheet_name
from panelspark.operators import codebook, quality, quota
from panelspark.plans import readers, surveys
from panelspark.shared import fresh_path, put_file
from panelspark.sources.documents import write_workbooks
from panelspark.sources.tables import load_table
from panelspark.sources.word import questions, read_questionnaires

#: Main targets by market segment, and sub-targets by nation and by thousands of balance, tight enough that starts differ.
MAIN = {"BUILDING": 11.5, "AUTOMOBILE": 9.0, "MACHINERY": 7.0, "HOUSEHOLD": 0.0, "FURNITURE": 6.0}
SUB = {n: 1.0 + (n % 3 == 0) for n in range(24)}
BANDS = {b: 3.0 for b in range(11)}
WORDS = ["the", "password", "lien"]
CODEBOOK = ["SC_CUSTKEY", "C_Name", "c_nationkey", "SQ1", "C-MKTSEGMENT"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _main(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MAIN.items()), "m_key string, target double")


def _subs(spark: SparkSession) -> DataFrame:
    rows = [(i, str(k), t) for i, targets in enumerate((SUB, BANDS)) for k, t in targets.items()]
    return spark.createDataFrame(rows, "sub_id int, key string, target double")


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.floor((F.col("c_acctbal") + 1000) / 1000).cast("string")
    keys = F.array(F.array(F.col("c_nationkey").cast("string")), F.array(band))
    score = (F.col("c_acctbal") / 10000).alias("score")
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("respondent_id"), F.col("c_mktsegment").alias("m_key"), score, keys.alias("sub_keys"))


def q01_clean_text(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    padded = docs.select("doc_id", F.concat(F.lit("　\t"), F.coalesce("text", F.lit("")), F.lit("\x1c ")).alias("padded"))
    return padded.select("doc_id", clean_text(padded, "padded").alias("cleaned"))


def q02_collect_values(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).otherwise((F.col("o_custkey") / 4).cast("double")).alias("quarter"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("customer"),
    )
    return orders.select("o_orderkey", F.array_join(collect_values(orders, ["customer", "status", "quarter"]), "|").alias("answers"))


def q03_natural_rank(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    name = F.concat(F.lit("Q"), (F.col("p_partkey") % 40).cast("string"), F.lit("_"), F.col("p_size").cast("string"), F.col("p_brand"))
    named = part.select("p_partkey", "p_type", name.alias("question"))
    order = Window.partitionBy("p_type").orderBy(natural_key(named, "question"), "question", "p_partkey")
    return named.select("p_partkey", "p_type", "question", F.row_number().over(order).cast("long").alias("natural_rank"))


def q04_sheet_name(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", sheet_name(F.col("url")).alias("sheet"))


def _sheet(spark, sf_dir):
    both = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    first = F.when(F.col("n_nationkey") % 4 == 0, F.col("r_name")).alias("group")
    return both.select(first, F.col("n_name").alias("name"), F.col("r_name").alias("area"), (F.col("n_nationkey") * 1.5).cast("double").alias("goal"), F.col("n_nationkey").alias("target"))


def q05_quota_normalize(spark, sf_dir):
    return quota.normalize_quota(_sheet(spark, sf_dir))


def q06_quota_fill_down(spark, sf_dir):
    return quota.normalize_quota(_sheet(spark, sf_dir), fill_down=True, order="target")


def q07_quota_main(spark, sf_dir):
    return quota.allocate_main(_people(spark, sf_dir), _main(spark), "m_key", "score", "respondent_id").select("m_key", F.col("rank").cast("long").alias("rank"), "respondent_id")


def q08_quota_bound(spark, sf_dir):
    return quota.bound(_people(spark, sf_dir), _main(spark), "m_key")


def q09_quota_main_sub(spark, sf_dir):
    rows = quota.allocate(_people(spark, sf_dir), _main(spark), _subs(spark), quota.Starts(count=1, deviation=0.0))
    return rows.select(F.col("rank").cast("long").alias("rank"), "respondent_id")


def q10_quota_multistart(spark, sf_dir):
    _, rows = quota.allocate_best(_people(spark, sf_dir), _main(spark), _subs(spark), quota.Starts(count=8))
    return rows.select(F.col("start_id").cast("long").alias("start_id"), F.col("rank").cast("long").alias("rank"), "respondent_id")


def q11_quota_shortfall(spark, sf_dir):
    people = _people(spark, sf_dir)
    chosen = quota.allocate(people, _main(spark), _subs(spark), quota.Starts(count=1, deviation=0.0))
    return quota.shortfall(quota.with_key(chosen, people), _main(spark))


def q12_straight_line(spark, sf_dir):
    line = _table(spark, sf_dir, "lineitem")
    answers = line.select("l_orderkey", "l_linenumber", *[(F.col(c).cast("long") % 3).alias(f"Q{i}") for i, c in ((2, "l_quantity"), (3, "l_partkey"), (10, "l_suppkey"))])
    asked = quality.question_range(answers, "Q2", "Q10")
    return answers.filter(quality.straight_line(answers, asked)).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("straight"))


def _flagged(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.filter(quality.has_keyword(F.col("text"), WORDS)).select("doc_id")


def q13_keyword(spark, sf_dir):
    return _flagged(spark, sf_dir)


def q14_remove(spark, sf_dir):
    return quality.remove_flagged(_table(spark, sf_dir, "documents"), _flagged(spark, sf_dir), "doc_id").select("doc_id", "lang", "n_chars")


def q15_rename(spark, sf_dir):
    return codebook.rename(_table(spark, sf_dir, "nation"), {"n_nationkey": "n_regionkey", "n_regionkey": "n_nationkey", "n_name": "SQ1"})


def q16_match_names(spark, sf_dir):
    raw = spark.createDataFrame([(c,) for c in [*_table(spark, sf_dir, "customer").columns, "Q01", "q_2"]], "raw_name string")
    return codebook.match_names(raw, spark.createDataFrame([(c,) for c in CODEBOOK], "spss_name string"))


def q17_classify(spark, sf_dir):
    items = _table(spark, sf_dir, "conversations")
    return items.select("conv_id", "turn", codebook.question_kind(F.col("text")).alias("kind"))


def q18_syntax(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation")
    codes = nation.select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("spss_name"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    return codebook.value_labels(codes)


def _file(spark: SparkSession, name: str, content: bytes = b"") -> str:
    """A new file in the shared folder for a reader to read."""
    return put_file(spark, f"{fresh_path(spark, 'files')}/{name}", content)


def _csv(spark, sf_dir, word: str, charset: str) -> DataFrame:
    """The nations as a survey export: written in the charset, read back."""
    out = io.StringIO()
    rows = csv.writer(out, lineterminator="\n")
    rows.writerow(["번호", "이름", "메모"])
    rows.writerows((r["n_nationkey"], r["n_name"], f'{word} "{r["n_name"]}", {r["n_regionkey"]}') for r in _table(spark, sf_dir, "nation").collect())
    read = load_table(spark, _file(spark, "nation.csv", out.getvalue().encode(charset)))
    return read.select(F.col("번호").alias("n_nationkey"), F.col("이름").alias("n_name"), F.col("메모").alias("memo"))


def q19_csv_utf8(spark, sf_dir):
    return _csv(spark, sf_dir, "두 번째", "utf-8-sig")


def q20_csv_cp949(spark, sf_dir):
    return _csv(spark, sf_dir, "똠방", "cp949")


def _round_trip(spark, df: DataFrame) -> DataFrame:
    folder = fresh_path(spark, "books")
    write_workbooks(df, folder, "a:b", rows=20_000)
    return load_table(spark, folder)


def q21_xlsx_dates(spark, sf_dir):
    return _round_trip(spark, _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"))


def q22_docx(spark, sf_dir):
    line = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
    asked = "".join(line.format(f"SQ{r['n_nationkey']}. Have you been to {r['n_name']}?") + line.format("no question") for r in _table(spark, sf_dir, "nation").collect())
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as book:
        book.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{asked}</w:body></w:document>')
    found = questions(read_questionnaires(spark, _file(spark, "asked.docx", held.getvalue())))
    return found.select("question", "text", codebook.question_kind(F.col("text")).alias("kind"))


def q23_workbook_round_trip(spark, sf_dir):
    return _round_trip(spark, _table(spark, sf_dir, "customer"))


def _nation_book(spark, sf_dir):
    """Codebook, codes, names and recodes from the nations."""
    nation = _table(spark, sf_dir, "nation")
    name = F.concat(F.lit("Q"), F.col("n_nationkey").cast("string"))
    area = F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("spss_name")
    book = nation.select(name.alias("spss_name"), F.concat(F.col("n_name"), F.lit("'s")).alias("var_label"))
    codes = nation.select(area, F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    names = nation.select(name.alias("raw_name"), F.when(F.col("n_nationkey") % 3 == 0, name).otherwise(F.concat(F.lit("S"), name)).alias("spss_name"))
    return book, codes, names, nation.select(area, F.col("n_nationkey").alias("old"), (F.col("n_nationkey") + 1).alias("new"))


def q24_variable_labels(spark, sf_dir):
    return codebook.variable_labels(_nation_book(spark, sf_dir)[0])


def q25_rename_syntax(spark, sf_dir):
    return codebook.rename_syntax(_nation_book(spark, sf_dir)[2])


def q26_recode_syntax(spark, sf_dir):
    return codebook.recode_syntax(_nation_book(spark, sf_dir)[3])


def q27_spss_program(spark, sf_dir):
    return codebook.program(*_nation_book(spark, sf_dir))


def q28_match_by_position(spark, sf_dir):
    raw = spark.createDataFrame(list(enumerate(_table(spark, sf_dir, "customer").columns)), "pos int, raw_name string")
    return codebook.match_names(raw, spark.createDataFrame(list(enumerate(CODEBOOK)), "pos int, spss_name string"), by_position=True)


def q29_threshold_stop(spark, sf_dir):
    _, rows = quota.allocate_best(_people(spark, sf_dir), _main(spark), _subs(spark), quota.Starts(count=8, threshold=32, wave=3))
    return rows.select(F.col("start_id").cast("long").alias("start_id"), F.col("rank").cast("long").alias("rank"), "respondent_id")


#: Keywords of four scripts of signs and languages.
KEYWORDS = [*WORDS, "und", "QUE", "données", "the ", "e.g.", "??"]


def q38_keyword_hits(spark, sf_dir):
    return quality.keyword_hits(_table(spark, sf_dir, "documents"), "doc_id", "text", KEYWORDS).select("doc_id", "keyword")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        q01_clean_text, q02_collect_values, q03_natural_rank, q04_sheet_name, q05_quota_normalize, q06_quota_fill_down, q07_quota_main,
        q08_quota_bound, q09_quota_main_sub, q10_quota_multistart, q11_quota_shortfall, q12_straight_line, q13_keyword, q14_remove,
        q15_rename, q16_match_names, q17_classify, q18_syntax, q19_csv_utf8, q20_csv_cp949, q21_xlsx_dates, q22_docx, q23_workbook_round_trip,
        q24_variable_labels, q25_rename_syntax, q26_recode_syntax, q27_spss_program, q28_match_by_position, q29_threshold_stop, q38_keyword_hits,
    )
} | surveys.QUERIES | readers.QUERIES

_MAIN_SQL = ", ".join(f"('{k}', CAST({t} AS DOUBLE))" for k, t in MAIN.items())
_SHEET_SQL = """SELECT CASE WHEN n_nationkey % 4 = 0 THEN r_name END AS qt1, n_name AS qt2, r_name AS qt3,
  CAST(n_nationkey * 1.5 AS DOUBLE) AS target, n_nationkey AS pos FROM nation JOIN region ON n_regionkey = r_regionkey"""


def _greedy_sql(starts: int, deviation: float, tail: str) -> str:
    """The sequential rule as a recursion over the ordered respondents of each start."""
    digest = "md5('42:' || s.start_id || ':' || c_custkey)"
    first = f"(CAST('0x' || substr({digest}, 1, 12) AS BIGINT) + 1) / CAST({1 << 48} AS DOUBLE)"
    second = f"CAST('0x' || substr({digest}, 13, 12) AS BIGINT) / CAST({1 << 48} AS DOUBLE)"
    noise = f"CAST({deviation} AS DOUBLE) * sqrt(-2 * ln({first})) * cos(2 * pi() * {second})" if deviation else "CAST(0 AS DOUBLE)"
    main = ", ".join(f"'{k}': CAST({t} AS DOUBLE)" for k, t in MAIN.items())
    sub, bands = (", ".join(f"'{k}': CAST({t} AS DOUBLE)" for k, t in targets.items()) for targets in (SUB, BANDS))
    return f"""
WITH RECURSIVE o AS (
  SELECT start_id, id, m, k, b, row_number() OVER (PARTITION BY start_id ORDER BY noisy DESC, id) AS i FROM (
    SELECT s.start_id, c_custkey AS id, c_mktsegment AS m, CAST(c_nationkey AS VARCHAR) AS k,
           CAST(CAST(floor((c_acctbal + 1000) / 1000) AS BIGINT) AS VARCHAR) AS b,
           round(c_acctbal / 10000 + {noise}, 9) AS noisy
    FROM customer, (SELECT CAST(range AS INTEGER) AS start_id FROM range({starts})) s)
), r AS (
  SELECT CAST(range AS INTEGER) AS start_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, FALSE AS ok,
         MAP {{{main}}} AS mm, MAP {{{sub}}} AS sm, MAP {{{bands}}} AS bm FROM range({starts})
  UNION ALL
  SELECT o.start_id, o.i, o.id, a.ok,
         CASE WHEN a.ok THEN map_concat(mm, MAP {{o.m: mm[o.m] - 1}}) ELSE mm END,
         CASE WHEN a.ok AND sm[o.k] IS NOT NULL THEN map_concat(sm, MAP {{o.k: sm[o.k] - 1}}) ELSE sm END,
         CASE WHEN a.ok AND bm[o.b] IS NOT NULL THEN map_concat(bm, MAP {{o.b: bm[o.b] - 1}}) ELSE bm END
  FROM r JOIN o ON o.start_id = r.start_id AND o.i = r.i + 1,
       LATERAL (SELECT coalesce(mm[o.m], 0) > 0 AND coalesce(sm[o.k], 1) > 0 AND coalesce(bm[o.b], 1) > 0 AS ok) a
), chosen AS (
  SELECT start_id, id AS respondent_id, row_number() OVER (PARTITION BY start_id ORDER BY i) AS rank FROM r WHERE ok
)
{tail}"""


#: Rows (part, name, line) of the four kinds of syntax.
_SYNTAX = """
SELECT 0 AS part, 'Q' || n_nationkey AS name, 'VARIABLE LABELS Q' || n_nationkey || ' ''' || n_name || '''''s''.' AS line FROM nation UNION ALL
SELECT 1, 'R' || n_regionkey, 'VALUE LABELS R' || n_regionkey || ' ' || string_agg(n_nationkey || ' ''' || n_name || '''', ' ' ORDER BY n_nationkey) || '.' FROM nation GROUP BY n_regionkey UNION ALL
SELECT 2, 'Q' || n_nationkey, 'RENAME VARIABLES (Q' || n_nationkey || ' = SQ' || n_nationkey || ').' FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL
SELECT 3, 'R' || n_regionkey, 'RECODE R' || n_regionkey || ' ' || string_agg('(' || n_nationkey || ' = ' || (n_nationkey + 1) || ')', ' ' ORDER BY n_nationkey) || '.' FROM nation GROUP BY n_regionkey UNION ALL
SELECT 4, '', 'EXECUTE.'"""


def _csv_sql(word: str) -> str:
    return f"""SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, '{word} "' || n_name || '", ' || n_regionkey AS memo FROM nation"""


ORACLE: dict[str, str] = surveys.ORACLE | readers.ORACLE | {
    "q19_csv_utf8": _csv_sql("두 번째"),
    "q20_csv_cp949": _csv_sql("똠방"),
    "q21_xlsx_dates": "SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders",
    "q22_docx": "SELECT 'SQ' || n_nationkey AS question, 'Have you been to ' || n_name || '?' AS text, 'single' AS kind FROM nation",
    "q23_workbook_round_trip": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "q24_variable_labels": f"SELECT name AS spss_name, line FROM ({_SYNTAX}) WHERE part = 0",
    "q25_rename_syntax": f"SELECT name AS raw_name, line FROM ({_SYNTAX}) WHERE part = 2",
    "q26_recode_syntax": f"SELECT name AS spss_name, line FROM ({_SYNTAX}) WHERE part = 3",
    "q27_spss_program": f"SELECT row_number() OVER (ORDER BY part, name, line) AS ord, line FROM ({_SYNTAX})",
    "q28_match_by_position": f"""
WITH raw AS (SELECT column_name AS n, row_number() OVER () - 1 AS pos FROM (DESCRIBE customer)),
book(pos, s) AS (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(CODEBOOK))}),
p AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(n), '[^a-z0-9]', '', 'g'), '^s(q[0-9])', '\\1', 'g'), '([a-z]|^)0+([0-9])', '\\1\\2', 'g') AS plain
  FROM (SELECT n, pos, 'raw' AS side FROM raw UNION ALL SELECT s, pos, 'book' FROM book)),
f AS (SELECT r.n, r.pos, coalesce(e.n, l.n) AS s, CASE WHEN e.n IS NOT NULL THEN 'exact' WHEN l.n IS NOT NULL THEN 'normalized' ELSE 'none' END AS how
  FROM p r LEFT JOIN (SELECT n FROM p WHERE side = 'book') e ON e.n = r.n LEFT JOIN (SELECT plain, min(n) AS n FROM p WHERE side = 'book' GROUP BY plain) l ON l.plain = r.plain WHERE side = 'raw'),
free AS (SELECT pos, s FROM book WHERE s NOT IN (SELECT s FROM f WHERE s IS NOT NULL))
SELECT n AS raw_name, CASE WHEN how = 'none' THEN free.s ELSE f.s END AS spss_name, CASE WHEN how = 'none' AND free.s IS NOT NULL THEN 'position' ELSE how END AS how
FROM f LEFT JOIN free ON free.pos = f.pos""",
    "q29_threshold_stop": _greedy_sql(
        8, 0.5, """, n AS (SELECT start_id, count(*) AS n FROM chosen GROUP BY start_id)
SELECT CAST(start_id AS BIGINT) AS start_id, rank, respondent_id FROM chosen WHERE start_id =
  coalesce((SELECT min(start_id) FROM n WHERE n >= 32), (SELECT start_id FROM n ORDER BY n DESC, start_id LIMIT 1))"""
    ),
    "q01_clean_text": f"SELECT doc_id, trim('　\t' || coalesce(text, '') || chr(28) || ' ', '{SPACES}') AS cleaned FROM documents",
    "q02_collect_values": """SELECT o_orderkey,
  coalesce(CAST(CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS VARCHAR), '') || '|' ||
  coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END, '') || '|' ||
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(CAST(o_custkey AS DOUBLE) / 4 AS VARCHAR) END AS answers FROM orders""",
    "q03_natural_rank": r"""
WITH n AS (SELECT p_partkey, p_type, 'Q' || (p_partkey % 40) || '_' || p_size || p_brand AS question FROM part),
k AS (SELECT *, list_transform(list_filter(regexp_extract_all(question, '[^0-9]*[0-9]*'), lambda x: x <> ''), lambda x: {
  't': regexp_extract(x, '^[^0-9]*'), 'l': CASE WHEN regexp_extract(x, '[0-9]*$') <> '' THEN length(ltrim(regexp_extract(x, '[0-9]*$'), '0')) ELSE -1 END,
  'd': ltrim(regexp_extract(x, '[0-9]*$'), '0')}) AS key FROM n)
SELECT p_partkey, p_type, question, row_number() OVER (PARTITION BY p_type ORDER BY key, question, p_partkey) AS natural_rank FROM k""",
    "q04_sheet_name": r"SELECT page_id, substr(translate(url, ':\/?*[]', '_______'), 1, 31) AS sheet FROM pages",
    "q05_quota_normalize": f"SELECT qt1, qt2, qt3, target FROM ({_SHEET_SQL})",
    "q06_quota_fill_down": f"""SELECT last_value(qt1 IGNORE NULLS) OVER w AS qt1, last_value(qt2 IGNORE NULLS) OVER w AS qt2,
  last_value(qt3 IGNORE NULLS) OVER w AS qt3, last_value(target IGNORE NULLS) OVER w AS target
  FROM ({_SHEET_SQL}) WINDOW w AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "q07_quota_main": f"""SELECT m_key, rank, respondent_id FROM (
  SELECT c_mktsegment AS m_key, c_custkey AS respondent_id, target, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank
  FROM customer JOIN (VALUES {_MAIN_SQL}) q(k, target) ON k = c_mktsegment) WHERE rank <= ceil(target)""",
    "q08_quota_bound": f"""SELECT k AS m_key, coalesce(n, 0) AS available, CAST(ceil(target) AS BIGINT) AS wanted,
  least(coalesce(n, 0), CAST(ceil(target) AS BIGINT)) AS most FROM (VALUES {_MAIN_SQL}) q(k, target)
  LEFT JOIN (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) ON k = c_mktsegment""",
    "q09_quota_main_sub": _greedy_sql(1, 0.0, "SELECT rank, respondent_id FROM chosen"),
    "q10_quota_multistart": _greedy_sql(
        8, 0.5, """SELECT CAST(start_id AS BIGINT) AS start_id, rank, respondent_id FROM chosen WHERE start_id =
  (SELECT start_id FROM chosen GROUP BY start_id ORDER BY count(*) DESC, start_id LIMIT 1)"""
    ),
    "q11_quota_shortfall": _greedy_sql(
        1, 0.0, f"""SELECT k AS m_key, CAST(ceil(target) AS BIGINT) AS wanted, coalesce(n, 0) AS filled, CAST(ceil(target) AS BIGINT) - coalesce(n, 0) AS missing
  FROM (VALUES {_MAIN_SQL}) q(k, target) LEFT JOIN (SELECT c_mktsegment, count(*) AS n FROM chosen JOIN customer ON c_custkey = respondent_id GROUP BY 1) ON k = c_mktsegment"""
    ),
    "q12_straight_line": """SELECT l_orderkey, count(*) AS straight FROM lineitem
  WHERE CAST(l_quantity AS BIGINT) % 3 = l_partkey % 3 AND l_partkey % 3 = l_suppkey % 3 GROUP BY l_orderkey""",
    "q13_keyword": rf"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\b({'|'.join(WORDS)})\b')",
    "q14_remove": rf"SELECT doc_id, lang, n_chars FROM documents WHERE NOT coalesce(regexp_matches(text, '(?i)\b({'|'.join(WORDS)})\b'), FALSE)",
    "q38_keyword_hits": "WITH k(keyword) AS (VALUES " + ", ".join(f"('{w}')" for w in KEYWORDS) + r""")
SELECT doc_id, keyword FROM documents, k WHERE regexp_matches(text, '(?i)' || CASE WHEN regexp_matches(keyword, '^[\p{L}\p{N}_]') THEN '(^|[^\p{L}\p{N}_])' ELSE '' END
  || regexp_escape(keyword) || CASE WHEN regexp_matches(keyword, '[\p{L}\p{N}_]$') THEN '($|[^\p{L}\p{N}_])' ELSE '' END)""",
    "q15_rename": "SELECT n_nationkey AS n_regionkey, n_name AS SQ1, n_regionkey AS n_nationkey FROM nation",
    "q16_match_names": f"""
WITH raw AS (SELECT column_name AS raw_name FROM (DESCRIBE customer) UNION SELECT 'Q01' UNION SELECT 'q_2'),
book(spss_name) AS (VALUES {", ".join(f"('{c}')" for c in CODEBOOK)}),
p AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(n), '[^a-z0-9]', '', 'g'), '^s(q[0-9])', '\\1', 'g'), '([a-z]|^)0+([0-9])', '\\1\\2', 'g') AS plain
  FROM (SELECT raw_name AS n, 'raw' AS side FROM raw UNION ALL SELECT spss_name, 'book' FROM book)),
l AS (SELECT plain, min(n) AS near FROM p WHERE side = 'book' GROUP BY plain)
SELECT n AS raw_name, coalesce(b.spss_name, near) AS spss_name,
  CASE WHEN b.spss_name IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'normalized' ELSE 'none' END AS how
FROM p LEFT JOIN book b ON b.spss_name = n LEFT JOIN l USING (plain) WHERE side = 'raw'""",
    "q17_classify": "SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in codebook.KINDS) + " ELSE 'open' END AS kind FROM conversations",
    "q18_syntax": """SELECT 'R' || n_regionkey AS spss_name, 'VALUE LABELS R' || n_regionkey || ' ' ||
  string_agg(n_nationkey || ' ''' || replace(n_name, '''', '''''') || '''', ' ' ORDER BY n_nationkey) || '.' AS line FROM nation GROUP BY n_regionkey""",
}
