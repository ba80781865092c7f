"""Cell text, natural order, sheet names: values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from panelspark.functions.cells import collect_values
from panelspark.functions.text import SPACES, clean_text, natural_key, python_text, sheet_name


def column(spark, kind, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def values(df, made):
    return [r[0] for r in df.orderBy("i").select(made).collect()]


def test_spaces_are_those_that_strip_removes():
    assert len(SPACES) == 29 and not f"{SPACES}x{SPACES}".strip() != "x"


def test_clean_text(spark):
    given = [None, "  a ", "　a\xa0", "\x1ca", "a b", "", "\t\n"]
    df = column(spark, "string", given)
    assert values(df, clean_text(df, "v")) == ["" if v is None else v.strip() for v in given]
    df = column(spark, "double", [None, float("nan"), 1.0])
    assert values(df, clean_text(df, "v")) == ["", "", "1.0"]


NUMBERS = [0.0, -0.0, 1.0, -1.5, 0.1, 123456789.125, 1e7, 1e15, 9999999999999998.0, 1e16, 1.5e17, 1e-3, 1e-4, 1.25e-4, 1e-5, 2.5e-7, 1e100, 1.5e300, 1e-300, math.inf, -math.inf, 12345678.9, -1e16]


def test_floats_read_as_python_prints_them(spark):
    df = column(spark, "double", NUMBERS)
    assert values(df, python_text(df, "v")) == [str(v) for v in NUMBERS]
    df = column(spark, "boolean", [True, False])
    assert values(df, python_text(df, "v")) == ["True", "False"]


def test_natural_order(spark):
    order = ["", "1", "2a", "10", "Q", "Q0", "Q0a", "Q1", "Q1a", "Q2", "Q2_10", "Q10", "문2", "문10"]
    df = column(spark, "string", order[::-1])
    assert [r.v for r in df.orderBy(natural_key(df, "v")).collect()] == order
    df = column(spark, "string", ["Q01", "Q1", "Q3", "Q" + chr(0x663), "Q1" + "0" * 44, "Q" + "9" * 44, None, "²"])
    keys = values(df, natural_key(df, "v"))
    assert keys[0] == keys[1] and keys[2] == keys[3] and keys[5] < keys[4] and keys[6] == []


def test_sheet_names(spark):
    df = column(spark, "string", [r"a:b\c/d?e*f[g]", "아" * 40, "", "🙂" * 40])
    assert values(df, sheet_name(F.col("v"))) == ["a_b_c_d_e_f_g_", "아" * 31, "", "🙂" * 31]


def test_collect_values(spark):
    df = spark.createDataFrame([(None, "x", float("nan"))], "a int, b string, c double")
    assert df.select(collect_values(df, ["a", "b", "c"])).first()[0] == ["", "x", ""]
    assert df.select(collect_values(df, ["b", "a"])).first()[0] == ["x", ""]
    assert df.select(collect_values(df, [])).first()[0] == []


@pytest.mark.parametrize("made", [clean_text, natural_key])
def test_no_python_in_plans(spark, made):
    df = column(spark, "string", ["a"])
    assert "Python" not in df.select(made(df, "v"))._jdf.queryExecution().toString()
