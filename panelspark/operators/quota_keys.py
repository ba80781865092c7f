"""Keys of quotas from quota sheets: which cells of a main and of sub sheets a respondent falls in.

A sheet's row names a cell by up to three dimensions; one that is missing, or a
word for all, is left open, so a row can be a total over it. A key is the JSON
text of a cell's dimensions, null where open. Each combination of dimensions that
a sheet names, a mask, is one equi-join of respondents with its keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.text import clean_text
from panelspark.operators.quota import COLUMNS, small
from panelspark.shared import written

#: Words that leave a dimension open, in lower case; fixed values.
OPEN = ("", "전체", "합계", "계", "소계", "total", "all", "-", "*")
DIMENSIONS = COLUMNS[:3]


@dataclass(frozen=True)
class Sheet:
    """cells: (qt1, qt2, qt3, target) as normalize_quota gives them. dimensions: the respondents' columns that qt1, qt2 and qt3 speak of; those not named are not read."""

    cells: DataFrame
    dimensions: tuple[str, ...]


def plain_value(df: DataFrame, name: str) -> Column:
    """A dimension's value as text, stripped, whole numbers without `.0`; null where it is missing or open."""
    text = F.regexp_replace(clean_text(df, name), r"^([+-]?\d+)\.0+$", "$1")
    return F.when(F.lower(text).isin(*OPEN), None).otherwise(text)


def sheet_keys(sheet: Sheet) -> DataFrame:
    """Rows (key, mask, target) of a sheet; of repeated cells the largest target counts. mask: a bit for each dimension that is named, the first one highest."""
    names = DIMENSIONS[: len(sheet.dimensions)]
    if len(sheet.dimensions) > len(DIMENSIONS) or not names:
        raise ValueError(f"a sheet has one to {len(DIMENSIONS)} dimensions")
    values = [plain_value(sheet.cells, n) for n in names]
    mask = sum((F.when(v.isNotNull(), 1 << (len(names) - 1 - i)).otherwise(0) for i, v in enumerate(values)), F.lit(0))
    rows = sheet.cells.select(F.to_json(F.array(*values)).alias("key"), mask.alias("mask"), F.col("target").cast("double").alias("target"))
    return rows.groupBy("key", "mask").agg(F.max("target").alias("target"))


def _met(people: DataFrame, sheet: Sheet, keys: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    """people with a column for each mask of the sheet, the key met or null, most dimensions first; their names."""
    width = len(sheet.dimensions)
    masks = sorted((r["mask"] for r in keys.select("mask").distinct().collect()), key=lambda m: (-m.bit_count(), -m))  # 2^3 at most
    names = []
    texts = {d: f"{name}d{i}" for i, d in enumerate(sheet.dimensions)}
    people = people.withColumns({t: plain_value(people, d) for d, t in texts.items()})
    for m in masks:
        named = [bool(m >> (width - 1 - i) & 1) for i in range(width)]
        values = [F.col(texts[d]) if here else F.lit(None).cast("string") for d, here in zip(sheet.dimensions, named, strict=True)]
        # A respondent without a value has no cell that names its dimension.
        there = [F.col(texts[d]).isNotNull() for d, here in zip(sheet.dimensions, named, strict=True) if here]
        wanted = F.to_json(F.array(*values))
        for t in there:
            wanted = F.when(t, wanted)
        column = f"{name}{m}"
        cells = small(keys.filter(F.col("mask") == m).select(F.col("key").alias(column)))
        people = people.join(cells, wanted == F.col(column), "left")
        names.append(column)
    return people, names


def with_keys(people: DataFrame, main: Sheet, subs: list[Sheet]) -> DataFrame:
    """people with m_key, the main cell with most dimensions that a respondent falls in, null for none, and sub_keys, for each sub sheet the list of all its cells that do.

    Of cells with equally many dimensions the one that names the earlier ones is
    the main key. Missing values fall only in cells that leave their dimension
    open. Columns of people named m_key or sub_keys are an error; rows that repeat
    stay; no people give no rows.
    """
    if {"m_key", "sub_keys"} & {c.lower() for c in people.columns}:
        raise ValueError("people have a column m_key or sub_keys already")
    columns = [F.col(f"`{c}`") for c in people.columns]
    found, mine = _met(people, main, written(sheet_keys(main), "keys"), "_main")
    lists = []
    for i, sub in enumerate(subs):
        found, names = _met(found, sub, written(sheet_keys(sub), "keys"), f"_sub{i}_")
        lists.append(F.array_compact(F.array(*[F.col(n) for n in names])) if names else F.array().cast("array<string>"))
    m_key = F.coalesce(*[F.col(n) for n in mine]) if mine else F.lit(None).cast("string")
    sub_keys = F.array(*lists) if lists else F.array().cast("array<array<string>>")
    return found.select(*columns, m_key.alias("m_key"), sub_keys.alias("sub_keys"))


def main_targets(main: Sheet) -> DataFrame:
    """Rows (m_key, target) as the allocation takes them."""
    return sheet_keys(main).select(F.col("key").alias("m_key"), "target")


def sub_targets(subs: list[Sheet]) -> DataFrame:
    """Rows (sub_id, key, target) of sub sheets as the allocation takes them; at least one sheet."""
    parts = [sheet_keys(s).select(F.lit(i).alias("sub_id"), "key", "target") for i, s in enumerate(subs)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows
