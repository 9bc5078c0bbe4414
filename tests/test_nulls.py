"""Rules for missing values, ratios, order and text, one small frame each."""

import math

import pytest
from pyspark.sql import functions as F

from seaplate.functions import nulls, text
from seaplate.operators.shape import left_lookup, wide_sum


def column(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def test_sums_and_means_with_gaps(frame):
    df = frame([("a", 1.0), ("a", None), ("b", None), ("c", 2.0), ("c", 4.0)], "k string, v double")
    rows = df.groupBy("k").agg(
        nulls.sum_skipna("v").alias("skip"),
        nulls.sum_strict("v").alias("strict"),
        nulls.mean_strict("v").alias("mean"),
        nulls.sd_strict("v").alias("sd"),
    )
    got = {r["k"]: tuple(r)[1:] for r in rows.collect()}
    assert got["a"] == (1.0, None, None, None)
    assert got["b"] == (0.0, None, None, None)
    assert got["c"] == (6.0, 6.0, 3.0, pytest.approx(math.sqrt(2)))


def test_sd_of_one_row_is_null(frame):
    df = frame([(1.0,)], "v double").agg(nulls.sd_strict("v").alias("sd"))
    assert df.first()["sd"] is None


def test_ratio(frame):
    df = frame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (None, 0.0), (1.0, None)], "n double, d double")
    assert column(df, nulls.ratio("n", "d")) == [math.inf, -math.inf, None, 0.25, None, None]


def test_flag_is_null_when_a_side_is_unknown(frame):
    df = frame([("A", "A"), ("A", "B"), (None, "A"), ("A", None), (None, None)], "x string, y string")
    assert column(df, nulls.same_or_other("x", "y")) == ["your_country", "other_country", None, None, None]


def test_not_in_keeps_null(frame):
    df = frame([("A",), ("B",), (None,)], "x string")
    assert [r[0] for r in df.filter(nulls.not_in("x", ["A"])).collect()] == ["B", None]


def test_caps_keep_null(frame):
    df = frame([(1.0,), (9.0,), (None,)], "x double")
    assert column(df, nulls.cap_at("x", 5)) == [1.0, 5.0, None]
    assert column(df, nulls.floor_at_zero(F.col("x") - 4)) == [0.0, 5.0, None]


def test_dim_first_takes_the_whole_first_row(frame):
    df = frame([("a", "x", None, 2), ("a", None, "p", 1), ("b", "y", "q", 3)], "k string, u string, v string, line int")
    got = sorted(tuple(r) for r in nulls.dim_first(df, "k", "line").collect())
    assert got == [("a", None, "p", 1), ("b", "y", "q", 3)]


def test_recode_and_lookup(frame):
    df = frame([("A",), ("B",), (None,)], "x string")
    assert column(df, text.recode("x", {"A": "1"})) == ["1", "B", None]
    assert column(df, text.lookup("x", {"A": "1"})) == ["1", None, None]


def test_text_rules(frame):
    df = frame([(" a\t",), ("homarus AMERICANUS",)], "x string")
    assert column(df, text.trim_space("x"))[0] == "a"
    assert column(df, text.sentence_case("x"))[1] == "Homarus americanus"
    assert column(df, text.word("x", 2))[1] is None
    names = frame([("Côte d'Ivoire",), ("  São Tomé & Príncipe ",)], "x string")
    assert column(names, text.plain_name("x")) == ["cote d ivoire", "sao tome principe"]


def test_wide_sum_keeps_keys_without_listed_values(frame):
    rows = [("a", "x", 1.0), ("a", None, 5.0), ("b", None, 7.0), ("c", "x", None), ("c", "y", 2.0), ("c", "x", 1.0)]
    df = frame(rows, "k string, p string, v double")
    loose = {r["k"]: tuple(r)[1:] for r in wide_sum(df, ["k"], "p", {"x": "x", "y": "y"}, "v").collect()}
    strict = {r["k"]: tuple(r)[1:] for r in wide_sum(df, ["k"], "p", {"x": "x", "y": "y"}, "v", True).collect()}
    assert loose == {"a": (1.0, None), "b": (None, None), "c": (1.0, 2.0)}
    assert strict == {"a": (1.0, None), "b": (None, None), "c": (None, 2.0)}


def test_left_lookup_keeps_unmatched_rows(frame):
    df, dim = frame([("a",), (None,)], "k string"), frame([("a", 1)], "key string, v int")
    assert sorted(map(tuple, left_lookup(df, dim, {"k": "key"}, ["v"]).collect()), key=str) == [("a", 1), (None, None)]
