"""Column functions over cell text: Python-like text, stripping, natural order, sheet names.

Each takes a DataFrame and a column's name, since what counts as missing, and
how a number reads, depend on the column's type. All stay inside Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that stripping removes at both ends: all that Unicode or ASCII calls space.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Characters that sheet names cannot hold (fixed values), and the longest name.
SHEET_INVALID = ":\\/?*[]"
SHEET_LENGTH = 31
#: Decimal digits beyond ASCII by their value, for reading numbers in any script.
DIGITS = [(chr(c), str(int(chr(c)))) for c in range(128, 0x1FBFA) if chr(c).isdecimal()]


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating-point column; empty text and infinity are there."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def float_text(column: Column) -> Column:
    """Doubles as Python prints them: fixed from 1e-4 to below 1e16, else with a signed two-digit exponent."""
    plain = column.cast("double").cast("string")
    sign = F.when(plain.startswith("-"), "-").otherwise("")
    parts = F.split(F.regexp_replace(plain, "^-", ""), "E")
    mantissa, power = parts[0], F.try_element_at(parts, F.lit(2)).cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    size = F.length(digits)
    large = F.when(size - 1 <= power, F.concat(F.rpad(digits, power + 1, "0"), F.lit(".0")))
    large = large.otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, size)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    short = F.regexp_replace(mantissa, r"\.0$", "")
    exponent = F.concat(short, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    exponent = F.when(F.abs(power) > 99, F.concat(short, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.abs(power).cast("string"))).otherwise(exponent)
    moved = F.when((power >= 0) & (power < 16), large).when((power < 0) & (power >= -4), small).otherwise(exponent)
    number = F.when(power.isNull(), F.concat(sign, mantissa)).otherwise(F.concat(sign, moved))
    return F.when(plain.isin("NaN", "Infinity", "-Infinity"), F.replace(F.lower(plain), F.lit("infinity"), F.lit("inf"))).otherwise(number)


def python_text(df: DataFrame, name: str) -> Column:
    """A cell as text: floats and booleans as Python prints them, the rest as Spark casts them."""
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float_text(column)
    if isinstance(kind, T.BooleanType):
        return F.initcap(column.cast("string"))
    return column.cast("string")


def clean_text(df: DataFrame, name: str) -> Column:
    """Text without space characters at its ends; empty for a missing cell."""
    return F.when(is_missing(df, name), F.lit("")).otherwise(F.btrim(python_text(df, name), F.lit(SPACES)))


def natural_key(df: DataFrame, name: str) -> Column:
    """A key to sort by, in which runs of digits compare as numbers: array<struct<t, l, d>>.

    Each part is text, then the number's length without leading zeros (-1: no
    number) and its digits, so that numbers of any length compare exactly. Digits
    of all scripts count. Equal keys, such as of Q1 and Q01, need a tie-breaker.
    """
    text = F.coalesce(python_text(df, name), F.lit(""))
    parts = F.filter(F.regexp_extract_all(text, F.lit(r"(\P{Nd}*)(\p{Nd}*)"), F.lit(0)), lambda x: x != "")
    foreign, ascii_ = "".join(a for a, _ in DIGITS), "".join(b for _, b in DIGITS)

    def part(x: Column) -> Column:
        digits = F.ltrim(F.translate(F.regexp_extract(x, r"(\p{Nd}*)$", 1), foreign, ascii_), F.lit("0"))
        number = F.regexp_extract(x, r"(\p{Nd}*)$", 1) != ""
        return F.struct(F.regexp_extract(x, r"^(\P{Nd}*)", 1).alias("t"), F.when(number, F.length(digits)).otherwise(-1).alias("l"), digits.alias("d"))

    return F.transform(parts, part)


def sheet_name(name: Column) -> Column:
    """A workbook sheet's name: invalid characters replaced, at most 31 code points. Names may collide or be empty."""
    return F.substring(F.translate(name, SHEET_INVALID, "_" * len(SHEET_INVALID)), 1, SHEET_LENGTH)
