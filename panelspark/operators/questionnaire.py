"""From a questionnaire's paragraphs to a codebook: questions, their options and tables, their kinds, their variables.

Only the names of this tool are given; what it does here is this library's own
design. Paragraphs are dealt to the question that opened last, in one window per
file. Options come from marks at the start of a paragraph or a table cell, from
numbered lists, from marks within the question, or from a table's first column.
All steps are joins, windows and groups by file and question, so many files are
worked on at once, and no group is larger than a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.shared import cut
from panelspark.sources.word import CHOSUNG, GANADA, opening

CIRCLES = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
#: An option's mark: a circled number, or one of up to three digits with a bracket or a dot, at the start or after a space.
MARK = rf"(?:[{CIRCLES}]|(?<![^\s])\(?\d{{1,3}}(?:\)|\.(?!\d)))\s*"
#: A table's cell that is a code alone.
CODE = r"^\(?(\d{1,9})\)?\.?$"
#: Words of rank and of several answers; fixed values.
RANKED = r"(?i)\brank\b|in order of|\d\s*순위|순위대로|순서대로"
SEVERAL = r"(?i)all that apply|select all|check all|multiple (answers|responses)|복수\s*(응답|선택)|모두"
#: How many ranks are asked for.
RANKS = r"(?i)\btop \d|\d\s*(?:순위|most\b|choices\b)"

#: Kinds by priority, each with the condition on a question's features that makes it; open if none holds.
RULES = (
    ("grid", "size(items) > 0 AND size(header) > 1"),
    ("rank", "ranked AND size(options) > 1"),
    ("multi", "several AND size(options) > 0"),
    ("single", "size(options) > 0"),
)

_PAIRS = "array<struct<code: int, label: string>>"


def mark_number(mark: Column) -> Column:
    """The number of an option's mark or of what a list prints; letters count from 1; null without one."""
    sign = F.regexp_extract(mark, rf"(\d+|[{CIRCLES}{GANADA}{CHOSUNG}A-Za-z])", 1)
    number = F.try_to_number(sign, F.lit("999999999")).cast("int")
    for letters in (CIRCLES, GANADA, CHOSUNG, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        place = F.instr(F.lit(letters), sign)
        number = F.when((sign != "") & (place > 0), place).otherwise(number)
    return number


def marked(text: Column) -> Column:
    """array<struct<code, label>> of the marks in a text, each with what stands between it and the next one."""
    labels = F.split(text, MARK)
    pair = lambda m, i: F.struct(mark_number(m).alias("code"), F.trim(F.coalesce(F.get(labels, i + 1), F.lit(""))).alias("label"))
    return F.transform(F.regexp_extract_all(text, F.lit(MARK), F.lit(0)), pair)


def _none() -> Column:
    return F.array().cast(_PAIRS)


def _rising(pairs: Column) -> Column:
    """Whether there are two marks at least and each is one more than the one before."""
    return (F.size(pairs) > 1) & F.forall(F.transform(pairs, lambda p, i: p["code"] - i == pairs[0]["code"]), lambda x: x)


def dealt(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with `at`, the pos at which their question opened; those before the first question are left out."""
    opened = opening(paragraphs)
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return opened.withColumn("at", F.last(F.when(F.col("question").isNotNull(), F.col("pos")), ignorenulls=True).over(before)).filter("at IS NOT NULL")


def paragraph_options(rows: DataFrame) -> DataFrame:
    """Rows (path, at, pos, pairs) of dealt paragraphs outside of tables, or of questions, that hold options."""
    starts = F.col("text").rlike(rf"^\s*{MARK}")
    listed = F.array(F.struct(F.coalesce("number", mark_number(F.col("label"))).alias("code"), F.col("text").alias("label")))
    inline = marked(F.col("stem"))
    pairs = F.when(F.col("question").isNotNull(), F.when(_rising(inline), inline)).when(F.col("in_table"), None).when(starts, marked(F.col("text"))).when(F.col("label").isNotNull(), listed)
    return rows.select("path", "at", "pos", pairs.cast(_PAIRS).alias("pairs")).filter("pairs IS NOT NULL")


def table_options(rows: DataFrame) -> DataFrame:
    """Rows (path, at, pos, pairs, items, header) of the tables behind a question.

    Cells that mostly are marks with labels are options; of two columns, the first
    being codes but for its head, each row is an option; of three and more the
    first column has the items of a grid and the first row its codes.
    """
    said = F.concat_ws(" ", "label", "text")
    cells = rows.filter("in_table AND question IS NULL").groupBy("path", "at", "tbl", "row", "col").agg(F.array_sort(F.collect_list(F.struct("pos", said.alias("said")))).alias("all"))
    text = F.trim(F.array_join(F.transform("all", lambda x: x["said"]), "\n"))
    cells = cells.select("path", "at", "tbl", F.struct("row", "col", text.alias("text"), F.filter(marked(text), lambda p: p["label"] != "").alias("marks")).alias("cell"), F.col("all")[0]["pos"].alias("pos"))
    tables = cells.groupBy("path", "at", "tbl").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list("cell")).alias("cells"), F.max("cell.row").alias("rows"), F.max("cell.col").alias("cols"))
    there = F.filter("cells", lambda c: c["text"] != "")
    signs = F.filter("cells", lambda c: F.size(c["marks"]) > 0)
    first = F.filter("cells", lambda c: (c["col"] == 0) & (c["text"] != ""))
    codes = F.filter(first, lambda c: c["text"].rlike(CODE))
    beside = lambda c: F.coalesce(F.filter("cells", lambda o: (o["row"] == c["row"]) & (o["col"] == 1))[0]["text"], F.lit(""))
    layout = (F.size(signs) > 0) & (2 * F.size(signs) >= F.size(there))
    listed = ~layout & (F.col("cols") == 1) & (F.size(codes) > 0) & (F.size(codes) >= F.size(first) - 1)
    grid = ~layout & ~listed & (F.col("rows") > 0) & (F.col("cols") > 1)
    pair = lambda c: F.struct(F.regexp_extract(c["text"], CODE, 1).cast("int").alias("code"), beside(c).alias("label"))
    pairs = F.when(layout, F.flatten(F.transform(signs, lambda c: c["marks"]))).when(listed, F.transform(codes, pair)).otherwise(_none())
    bare = lambda c: F.trim(F.regexp_replace(c["text"], rf"^\s*(?:{MARK}|\(?\d{{1,9}}\)?\s*$)", ""))
    number = lambda c: F.when(c["text"].rlike(rf"^\s*(?:{MARK}|\(?\d{{1,9}}\)?\s*$)"), mark_number(c["text"])).otherwise(c["col"])
    head = F.filter("cells", lambda c: (c["row"] == 0) & (c["col"] > 0))
    header = F.transform(head, lambda c: F.struct(number(c).alias("code"), F.coalesce(F.nullif(bare(c), F.lit("")), number(c).cast("string")).alias("label")))
    items = F.transform(F.filter("cells", lambda c: (c["col"] == 0) & (c["row"] > 0) & (c["text"] != "")), lambda c: F.coalesce(F.nullif(bare(c), F.lit("")), c["text"]))
    nothing = F.array().cast("array<string>")
    return tables.select("path", "at", "pos", pairs.cast(_PAIRS).alias("pairs"), F.when(grid, items).otherwise(nothing).alias("items"), F.when(grid, header.cast(_PAIRS)).otherwise(_none()).alias("header"))


def question_features(paragraphs: DataFrame) -> DataFrame:
    """A row per question: path, at, question, stem, options, items, header, ranked, several, ranks.

    Of repeated codes the first option counts. A question of several grids has
    the items of all and the codes of the first. ranks is the largest number of
    ranks that its texts name, null for none. Files are read once: the dealt
    paragraphs are a checkpoint.
    """
    rows = cut(dealt(paragraphs))
    heads = rows.filter("question IS NOT NULL")
    stem = F.when(_rising(marked(F.col("stem"))), F.split("stem", MARK)[0]).otherwise(F.col("stem"))
    heads = heads.select("path", "at", "question", F.trim(stem).alias("stem"))
    tables = table_options(rows)
    lists = paragraph_options(rows)
    given = lists.unionByName(tables.select("path", "at", "pos", "pairs")).groupBy("path", "at").agg(F.array_sort(F.collect_list(F.struct("pos", "pairs"))).alias("all"))
    flat = F.flatten(F.transform("all", lambda x: x["pairs"]))
    once = F.aggregate(flat, _none(), lambda a, p: F.when(F.exists(a, lambda o: o["code"].eqNullSafe(p["code"])), a).otherwise(F.array_append(a, p)))
    given = given.select("path", "at", once.alias("options"))
    grids = tables.filter("size(items) > 0").groupBy("path", "at").agg(F.array_sort(F.collect_list(F.struct("pos", "items", "header"))).alias("all"))
    grids = grids.select("path", "at", F.flatten(F.transform("all", lambda x: x["items"])).alias("items"), F.col("all")[0]["header"].alias("header"))
    # Options are no instructions, so their words do not count.
    words = rows.join(lists.filter("pos <> at").select("path", "pos"), ["path", "pos"], "left_anti").filter("NOT in_table")
    asked = F.array_max(F.transform(F.regexp_extract_all("text", F.lit(RANKS), F.lit(0)), lambda x: F.regexp_extract(x, r"(\d)", 1).cast("int")))
    words = words.groupBy("path", "at").agg(F.bool_or(F.col("text").rlike(RANKED)).alias("ranked"), F.bool_or(F.col("text").rlike(SEVERAL)).alias("several"), F.max(asked).alias("ranks"))
    joined = reduce(lambda a, b: a.join(b, ["path", "at"], "left"), [given, grids, words], heads)
    empty = F.array().cast("array<string>")
    return joined.select(
        "path", "at", "question", "stem", F.coalesce("options", _none()).alias("options"), F.coalesce("items", empty).alias("items"), F.coalesce("header", _none()).alias("header"),
        F.coalesce("ranked", F.lit(False)).alias("ranked"), F.coalesce("several", F.lit(False)).alias("several"), "ranks",
    )


def kind_of_features() -> Column:
    """grid, rank, multi, single or open, by the first rule that holds."""
    kind = F.lit("open")
    for name, condition in reversed(RULES):
        kind = F.when(F.expr(condition), name).otherwise(kind)
    return kind


def codebook_of(paragraphs: DataFrame) -> DataFrame:
    """Rows (path, at, place, question, spss_name, var_label, q_type, codes), one for each variable; paragraphs as paragraph_rows gives them.

    Single and open questions are one variable; a question of several answers has
    one for each option, coded 1; a grid one for each item; a ranking one for each
    rank asked for, or for each option. Signs that names cannot have become `_`.
    No questions give no rows.
    """
    found = question_features(paragraphs).withColumn("q_type", kind_of_features())
    name = F.regexp_replace("question", r"[^\p{L}\p{N}_]", "_")
    one = lambda tail, label, codes: F.struct(F.concat(name, tail).alias("spss_name"), label.alias("var_label"), codes.cast(_PAIRS).alias("codes"))
    behind = lambda x: F.concat_ws(" - ", "stem", x)
    number = lambda n: F.concat(F.lit("_"), n.cast("string"))
    many = F.transform("options", lambda o: one(number(o["code"]), behind(o["label"]), F.array(F.struct(F.lit(1).alias("code"), o["label"].alias("label")))))
    grid = F.transform("items", lambda item, i: one(number(i + 1), behind(item), F.col("header")))
    ranks = F.sequence(F.lit(1), F.least(F.coalesce("ranks", F.size("options")), F.size("options")))
    rank = F.transform(ranks, lambda r: one(number(r), behind(F.concat(F.lit("rank "), r.cast("string"))), F.col("options")))
    kind = F.col("q_type")
    made = F.when(kind == "grid", grid).when(kind == "rank", rank).when(kind == "multi", many).otherwise(F.array(one(F.lit(""), F.col("stem"), F.col("options"))))
    rows = found.select("path", "at", "question", "q_type", F.posexplode(made).alias("place", "v"))
    return rows.select("path", "at", "place", "question", "v.spss_name", "v.var_label", "q_type", "v.codes")


def code_rows(book: DataFrame) -> DataFrame:
    """Rows (spss_name, code, label) of a codebook, as value_labels takes them."""
    return book.select("spss_name", F.inline("codes"))


def codebook_sheet(book: DataFrame) -> DataFrame:
    """A codebook as a flat table for a workbook: a row for each code, and one for each variable without codes, in the order of the file."""
    rows = book.select("path", "at", "place", "question", "spss_name", "var_label", "q_type", F.posexplode_outer("codes").alias("n", "c"))
    return rows.orderBy("path", "at", "place", "n").select("question", "spss_name", "var_label", "q_type", F.col("c.code").alias("code"), F.col("c.label").alias("label"))
