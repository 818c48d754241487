import math

import pytest
from pyspark.sql import functions as F

from ricefield.functions import exprs as X


def test_r2_matches_python_round(spark):
    fixed = [2.675, 1.005, 0.125, 0.375, 1234.565, -2.675, 0.0, -0.0, 1e-9, 12557.293]
    values = fixed + [n / 1000 for n in range(10000)] + [-(n / 1000) for n in range(0, 10000, 7)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(X.r2("x")).collect()]
    assert got == [round(v, 2) for v in values]
    assert got[:6] == [2.67, 1.0, 0.12, 0.38, 1234.57, -2.67]


def test_r2_null_and_infinity(spark):
    df = spark.createDataFrame([(None,), (float("inf"),)], "x double")
    assert [r[0] for r in df.select(X.r2("x")).collect()] == [None, float("inf")]


@pytest.mark.parametrize("old,new,want", [(0, 0, 0.0), (0, 5, None), (4, 5, 25.0), (5, 4, -20.0), (1.3, 1.5, 15.38)])
def test_pct_change(spark, old, new, want):
    df = spark.createDataFrame([(float(old), float(new))], "o double, n double")
    assert df.select(X.pct_change("o", "n")).first()[0] == want


def test_ratio0_zero_denominator(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 3.0), (2.0, None)], "n double, d double")
    assert [r[0] for r in df.select(X.ratio0("n", "d")).collect()] == [0.0, 0.33, 0.0]


def test_keys_differ_on_tabs(spark):
    df = spark.createDataFrame([(" Alpha ",), ("\tAlpha\n",), ("ÑA",)], "s string")
    rows = df.select(X.sql_key("s"), X.py_key("s")).collect()
    assert rows[0] == ("alpha", "alpha")
    assert rows[1] == ("\talpha\n", "alpha")
    assert rows[2] == ("ña", "ña")


def test_full_name_null_parts(spark):
    df = spark.createDataFrame([("Cruz", None, None), (None, "Ana", None), (None, None, None), ("Cruz", "Ana", "B")], "l string, f string, m string")
    assert [r[0] for r in df.select(X.full_name("l", "f", "m")).collect()] == ["Cruz,", ", Ana", ",", "Cruz, Ana B"]


def test_like_term_wildcards_and_backslash(spark):
    df = spark.createDataFrame([("a%b",), ("axb",), ("ab",), ("a\\b",), ("A_B",)], "s string")

    def hits(term):
        return sorted(r[0] for r in df.where(X.contains_any(["s"], term)).collect())

    assert hits("a%b") == ["A_B", "a%b", "a\\b", "ab", "axb"]  # '%' in the term matches any run
    assert hits("_") == ["A_B", "a%b", "a\\b", "ab", "axb"]
    assert hits("\\") == ["a\\b"]
    assert hits("CRUZ") == []


def test_number_or_zero(spark):
    cells = ["1.5", "1,200", "x", " 45 ", "1e1", "12d", "3f", "nan", "", None, ".5", "-2", "inf"]
    df = spark.createDataFrame([(c,) for c in cells], "s string")
    got = [r[0] for r in df.select(X.number_or_zero("s")).collect()]
    assert got == [1.5, 0.0, 0.0, 45.0, 10.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5, -2.0, 0.0]


def test_text_or_blank(spark):
    cells = [" Ana ", "NA", "N/A", "nan", None, "None", " NA ", "null", "x"]
    df = spark.createDataFrame([(c,) for c in cells], "s string")
    got = [r[0] for r in df.select(X.text_or_blank("s")).collect()]
    assert got == ["Ana", "", "", "", "", "", "NA", "", "x"]


def test_trend_and_marker(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (0.0,), (None,)], "d double")
    rows = df.select(X.trend("d"), X.change_marker("d")).collect()
    assert [r[0] for r in rows] == ["increased", "decreased", "no change", "no change"]
    assert [r[1] for r in rows] == ["▲ 1.00%", "▼ -1.00%", "▬ 0%", "N/A"]


def test_slug(spark):
    df = spark.createDataFrame([("Rice One",), ("San José\tFarmers",), ("../x",), ("Customer#000000001",)], "s string")
    assert [r[0] for r in df.select(X.slug("s")).collect()] == ["rice_one", "san_jose_farmers", "x", "customer000000001"]


def test_r2_random_doubles_match_python(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    values = []

    @settings(max_examples=300, deadline=None)
    @given(st.floats(min_value=-1e9, max_value=1e9, allow_nan=False, allow_infinity=False))
    def collect(v):
        values.append(v)

    collect()
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(X.r2("x")).collect()]
    assert got == [round(v, 2) for v in values]
