"""Codebooks: matching and renaming variables, kinds of questions, SPSS syntax.

Only the names of these tools are given; what they do here is this library's own design.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plain_name(name: Column) -> Column:
    """Lower-case letters and digits alone, without a leading s or leading zeros of numbers: SQ01, Q1 and q_1 agree."""
    bare = F.regexp_replace(F.lower(name), r"[^a-z0-9]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^s(q[0-9])", "$1"), r"([a-z]|^)0+([0-9])", "$1$2")


def match_names(raw: DataFrame, codebook: DataFrame, by_position: bool = False) -> DataFrame:
    """raw (raw_name) with codebook (spss_name) -> rows (raw_name, spss_name, how): exact, normalized, position, or none with a null name.

    Of several normalized matches the least name counts. by_position: both tables
    have a column pos, and a name that finds nothing else gets the codebook's name
    of its place, if that one is no other's.
    """
    book = codebook.select("spss_name").distinct()
    exact = raw.select("raw_name").distinct().join(book.withColumn("raw_name", F.col("spss_name")).withColumnRenamed("spss_name", "same"), "raw_name", "left")
    loose = book.groupBy(plain_name(F.col("spss_name")).alias("plain")).agg(F.min("spss_name").alias("near"))
    both = exact.withColumn("plain", plain_name(F.col("raw_name"))).join(loose, "plain", "left")
    how = F.when(F.col("same").isNotNull(), "exact").when(F.col("near").isNotNull(), "normalized").otherwise("none")
    found = both.select("raw_name", F.coalesce("same", "near").alias("spss_name"), how.alias("how"))
    if not by_position:
        return found
    free = codebook.select("spss_name", "pos").join(found.filter("how <> 'none'").select("spss_name"), "spss_name", "left_anti")
    places = raw.groupBy("raw_name").agg(F.min("pos").alias("pos")).join(free.groupBy("pos").agg(F.min("spss_name").alias("there")), "pos")
    both = found.join(places.select("raw_name", "there"), "raw_name", "left")
    placed = (F.col("how") == "none") & F.col("there").isNotNull()
    return both.select("raw_name", F.when(placed, F.col("there")).otherwise(F.col("spss_name")).alias("spss_name"), F.when(placed, "position").otherwise(F.col("how")).alias("how"))


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed at once, so that names can be swapped; clashes are an error."""
    new = [names.get(c, c) for c in df.columns]
    if len(set(new)) < len(new):
        raise ValueError(f"two columns would have one name: {sorted(c for c in new if new.count(c) > 1)[0]}")
    return df.toDF(*new)


#: Patterns of question texts, in the order in which they are tried; fixed values.
KINDS = (
    ("rank", r"(?i)\brank\b|in order of|순위|순서대로"),
    ("multi", r"(?i)all that apply|select all|multiple|복수|모두"),
    ("grid", r"(?i)each of the following|for each|각각|다음 항목"),
    ("open", r"(?i)^\W*(why|please (explain|describe|specify))\b|in your own words|이유|자유롭게|적어 ?주"),
    ("single", r"(?i)\?|select one|choose one|단수|하나만"),
)


def question_kind(text: Column) -> Column:
    """rank, multi, grid, open or single by the first pattern that fits, from the text alone; else open. A questionnaire's structure tells more: codebook_of."""
    kind = F.lit("open")
    for name, pattern in reversed(KINDS):
        kind = F.when(text.rlike(pattern), name).otherwise(kind)
    return F.when(text.isNull(), F.lit("open")).otherwise(kind)


def quoted(text: Column) -> Column:
    """A syntax string: in single quotes, those inside doubled."""
    return F.concat(F.lit("'"), F.replace(F.coalesce(text, F.lit("")), F.lit("'"), F.lit("''")), F.lit("'"))


def variable_labels(codebook: DataFrame) -> DataFrame:
    """codebook (spss_name, var_label) -> rows (spss_name, line)."""
    line = F.concat(F.lit("VARIABLE LABELS "), "spss_name", F.lit(" "), quoted(F.col("var_label")), F.lit("."))
    return codebook.select("spss_name", line.alias("line"))


def value_labels(codes: DataFrame) -> DataFrame:
    """codes (spss_name, code, label) -> a row (spss_name, line) per variable, codes in ascending order."""
    entries = codes.select("spss_name", F.col("code").alias("c"), F.concat(F.col("code").cast("string"), F.lit(" "), quoted(F.col("label"))).alias("e"))
    lists = entries.groupBy("spss_name").agg(F.array_sort(F.collect_list(F.struct("c", "e"))).alias("all"))
    line = F.concat(F.lit("VALUE LABELS "), "spss_name", F.lit(" "), F.concat_ws(" ", F.transform("all", lambda x: x["e"])), F.lit("."))
    return lists.select("spss_name", line.alias("line"))


def rename_syntax(names: DataFrame) -> DataFrame:
    """names (raw_name, spss_name) -> rows (raw_name, line), for names that change."""
    line = F.concat(F.lit("RENAME VARIABLES ("), "raw_name", F.lit(" = "), "spss_name", F.lit(")."))
    return names.filter("raw_name <> spss_name").select("raw_name", line.alias("line"))


def recode_syntax(codes: DataFrame) -> DataFrame:
    """codes (spss_name, old, new) -> a row (spss_name, line) per variable, old codes in ascending order."""
    lists = codes.groupBy("spss_name").agg(F.array_sort(F.collect_list(F.struct("old", "new"))).alias("all"))
    pairs = F.concat_ws(" ", F.transform("all", lambda x: F.concat(F.lit("("), x["old"].cast("string"), F.lit(" = "), x["new"].cast("string"), F.lit(")"))))
    return lists.select("spss_name", F.concat(F.lit("RECODE "), "spss_name", F.lit(" "), pairs, F.lit(".")).alias("line"))


def program(codebook: DataFrame, codes: DataFrame, names: DataFrame, recodes: DataFrame) -> DataFrame:
    """All of a codebook's syntax as one ordered text: rows (ord, line), from 1 on, the last one EXECUTE.

    Labels come first, of raw names, then renames, then recodes of the new
    names. The order is that of one window, as a codebook is bounded by its format.
    """
    parts = (variable_labels(codebook), value_labels(codes), rename_syntax(names), recode_syntax(recodes))
    lines = [p.select(F.lit(i).alias("part"), F.col(p.columns[0]).alias("name"), "line") for i, p in enumerate(parts)]
    last = codebook.sparkSession.range(1).select(F.lit(len(parts)).alias("part"), F.lit("").alias("name"), F.lit("EXECUTE.").alias("line"))
    everything = reduce(DataFrame.unionByName, [*lines, last])
    return everything.select(F.row_number().over(Window.orderBy("part", "name", "line")).cast("long").alias("ord"), "line")


def write_program(lines: DataFrame, path: str) -> None:
    """Writes a program as one text file in its order, into a folder."""
    lines.orderBy("ord").coalesce(1).select("line").write.text(path)
