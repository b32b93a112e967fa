"""Literal cases of the scalar functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.functions import scalars as S

c = F.col


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first().x


@pytest.mark.parametrize("n, roman", [(1, "I"), (4, "IV"), (9, "IX"), (14, "XIV"), (42, "XLII"), (99, "XCIX"), (2026, "MMXXVI"), (0, "0"), (-3, "-3"), (None, None)])
def test_to_roman(spark, n, roman):
    assert one(spark, n, S.to_roman(c("v")), "int") == roman


@pytest.mark.parametrize("text, n", [("i", 1), ("iv", 4), ("XIV", 14), ("xlii", 42), ("not_a_roman", None), ("", None), (" ix ", 9), (None, None), ("mix", 1009)])
def test_from_roman(spark, text, n):
    assert one(spark, text, S.from_roman(c("v"))) == n


def test_roman_round_trip(spark):
    rows = spark.range(1, 4000).select(c("id").cast("int").alias("v")).where(S.from_roman(S.to_roman(c("v"))) == c("v"))
    assert rows.count() == 3999


@pytest.mark.parametrize("n, letters", [(1, "a"), (26, "z"), (27, "aa"), (702, "zz"), (703, "aaa"), (0, "0"), (2147483647, "fxshrxw")])
def test_letters(spark, n, letters):
    assert one(spark, n, S.to_letters(c("v")), "int") == letters
    assert one(spark, n, S.to_letters(c("v"), True), "int") == letters.upper()


def test_page_numbers(spark):
    styles = ["decimal", "lowerRoman", "upperRoman", "lowerLetter", "upperLetter", "other"]
    got = spark.createDataFrame([(5, s) for s in styles], "n int, s string").select(S.page_number(c("n"), c("s")).alias("x")).collect()
    assert [r.x for r in got] == ["5", "v", "V", "e", "E", "5"]


@pytest.mark.parametrize("name, parts, numeral, title", [
    ("2.10 Scope.docx", [2, 10], None, "Scope"), ("一、总则.pdf", [1], "一", "总则"), ("(3) Third", [3], None, "Third"), ("（12）附件", [12], None, "附件"),
    ("Plain name", [999], None, "Plain name"), ("7", [7], None, "7"), ("2.100.3-x", [2, 100, 3], None, "x"), ("", [999], None, ""),
])
def test_name_parts(spark, name, parts, numeral, title):
    assert tuple(one(spark, name, S.name_parts(c("v")))) == (parts, numeral, title)
    assert one(spark, None, S.name_parts(c("v"))) is None


@pytest.mark.parametrize("text, kind, depth", [
    ("2026.09.07 notes", "date_or_version", None), ("1.1.1. Detailed", "hierarchical_arabic", 3), ("2.3 x", "hierarchical_arabic", 2), ("第三章 内容", "section_label", 1), ("1. Introduction", "simple_arabic", 1), ("3）x", None, None),
    ("5、x", "simple_arabic", 1), ("no number", None, None), (None, None, None), ("12", None, None),
])
def test_numbering(spark, text, kind, depth):
    got = one(spark, text, S.numbering(c("v")))
    assert (got.kind, got.depth) == (kind, depth)


def test_spaces(spark):
    assert one(spark, "　a  b\t\nc ", S.delete_space(c("v"))) == "abc"
    assert one(spark, "　a  b\t\nc ", S.collapse_space(c("v"))) == "a b c"
    assert one(spark, None, S.text_hash(c("v"))) == one(spark, "  ", S.text_hash(c("v")))


@pytest.mark.parametrize("value, unit, size, twips", [(12.0, "pt", None, 240), (25.4, "mm", None, 1440), (2.0, "char", 16.0, 640), (2.0, "char", None, None), (1.0, "yard", None, None)])
def test_units(spark, value, unit, size, twips):
    row = spark.createDataFrame([(value, unit, size)], "v double, u string, s double").select(S.to_twips(c("v"), c("u"), c("s")).alias("x")).first()
    assert row.x == twips


def test_columns_and_boxes(spark):
    assert one(spark, [5000, 3000, 2000], S.rescaled_columns(c("v"), F.lit(5000)), "array<int>") == [2500, 1500, 1000]
    assert one(spark, [1, 1, 1], S.rescaled_columns(c("v"), F.lit(2)), "array<int>") == [1, 1, 1]
    assert one(spark, [10, None], S.rescaled_columns(c("v"), F.lit(100)), "array<int>") == [10, None]
    assert tuple(one(spark, 2.0, S.fitted_box(c("v"), F.lit(1.0), F.lit(14.0), F.lit(26.0)), "double")) == (14.0, 7.0)
    assert tuple(one(spark, 0.0, S.fitted_box(c("v"), F.lit(1.0), F.lit(14.0), F.lit(26.0)), "double")) == (14.0, 26.0)


@pytest.mark.parametrize("name, fault", [("a.docx", None), ("con.docx", "reserved"), ("a.pdf", "suffix"), (".a.docx", "hidden"), ("a?.docx", "forbidden"), ("a .docx", "edge"), ("", "empty"), (None, "empty"), ("a\u0085.docx", "control")])
def test_filenames(spark, name, fault):
    assert one(spark, name, S.filename_fault(c("v"))) == fault


def test_fields(spark):
    assert one(spark, r"  pageref \\h  x", S.field_instruction(c("v"))) == r"pageref \h x"
    assert one(spark, r"REF name \h", S.field_identity(c("v"))) == r"REF <bookmark> \h"
    assert one(spark, "seq Figure", S.field_dependency(c("v"))) == "SEQ:Figure"
    assert one(spark, None, S.field_dependency(c("v"))) is None


def test_template_is_filled_once(spark):
    assert one(spark, "{b}", S.fill_template(F.lit("{a}-{b}-{a}"), {"{a}": c("v"), "{b}": F.lit("x")})) == "{b}-x-{b}"


def test_comparisons(spark):
    assert one(spark, "SimSun", S.same_font(F.lit("宋体"), c("v"))) and one(spark, None, S.same_font(c("v"), F.lit("x")))
    assert one(spark, "auto", S.same_colour(c("v"), F.lit("000000"))) and not one(spark, "auto", S.same_colour(c("v"), F.lit("ff0000")))
    assert one(spark, 1.0, S.near(c("v"), F.lit(1.4), 0.5), "double") and not one(spark, None, S.near(c("v"), F.lit(1.0)), "double")


@settings(max_examples=15, deadline=None)
@given(st.text(max_size=30))
def test_collapse_is_stable(spark, text):
    text = text.replace("\x00", "").encode("utf-8", "ignore").decode()
    once = one(spark, text, S.collapse_space(c("v")))
    assert one(spark, once, S.collapse_space(c("v"))) == once


def test_collision_keys(spark):
    from sheaf.functions.names import collision_key, font_key

    names = ["Straße", "STRASSE", "Cafe\u0301", "CAFÉ", " a", "a", None, "", "ſ", "S"]
    keys = [tuple(r) for r in spark.createDataFrame([(n, i) for i, n in enumerate(names)], "n string, i int").orderBy("i").select(collision_key("n"), font_key("n")).collect()]
    own = [k for k, _ in keys]
    assert own[0] == own[1] and own[2] == own[3] == "café" and own[4] != own[5] and own[6:8] == [None, ""] and own[8] == own[9] == "s"
    assert keys[4][1] == keys[5][1] == "a" and keys[6][1] is None
