"""Reading and mending cells, case by case."""

import pytest
from pyspark.sql import functions as F

from tabprofile.functions import text as X


def values(spark, expr, cells):
    df = spark.createDataFrame(list(enumerate(cells)), "k int, c string")
    return [r["v"] for r in df.select("k", expr(F.col("c")).alias("v")).orderBy("k").collect()]


def test_blank_and_trim(spark):
    cells = [None, "", " \t", " 　", "﻿ a ", "x"]
    assert values(spark, X.is_blank, cells) == [True, True, True, True, False, False]
    assert values(spark, X.js_trim, cells)[4:] == ["a", "x"]


def test_numbers(spark):
    cells = ["1 234.5", "1 000", "-.5e3", "5.", "1f", "0x1A", "NaN", "Infinity", "1.2.3", "12-", "1e999", "47,9", "", None]
    assert values(spark, X.parse_number, cells) == [1234.5, 1000.0, -500.0, 5.0] + [None] * 10
    comma = values(spark, lambda c: X.parse_number(c, True), ["47,9", "1,2,3", "1.5", "1,5.2"])
    assert comma == [47.9, None, 1.5, None]


@pytest.mark.parametrize(
    "order, cell, ms",
    [
        ("ymd", "1970-01-02", 86_400_000.0),
        ("ymd", "1970/1/1T00:00:01.5", 1500.0),
        ("ymd", "1970-01/02", None),
        ("ymd", "2021-02-29", None),
        ("dmy", "02.01.1970", 86_400_000.0),
        ("dmy", "31/04/2020", None),
        ("dmy", "01-01-1970 24:00", None),
        ("time", "9:05", 32_700_000.0),
        ("time", "00:00:00,1239", 123.0),
        ("time", "12:60", None),
    ],
)
def test_temporal(spark, order, cell, ms):
    assert values(spark, lambda c: X.parse_temporal(c, order), [cell]) == [ms]


def test_format_temporal(spark):
    out = values(spark, lambda c: X.format_temporal(X.parse_temporal(c, "dmy"), "dmy", True), ["05/02/2015 10:11", "05/02/2015 10:11:12"])
    assert out == ["05/02/2015 10:11", "05/02/2015 10:11:12"]
    assert values(spark, lambda c: X.format_temporal(X.parse_temporal(c, "time"), "time"), ["7:03"]) == ["07:03:00"]


def test_mojibake(spark):
    cells = ["CafÃ©", "Ça va", "TrÃ¨s bon", "â‚¬ 12", "plain", None, "Ã moi"]
    assert values(spark, X.fix_mojibake, cells) == ["Café", None, "Très bon", "€ 12", None, None, None]


def test_shapes_and_keys(spark):
    assert values(spark, X.value_pattern, ["AB-12", "Jean 3", ""]) == ["A-99", "Aa 9", ""]
    assert values(spark, X.title_case, ["jean-paul d'ARC", "o’neil  x"]) == ["Jean-Paul D'Arc", "O’Neil  X"]
    assert values(spark, X.loose_key, ["Étoile!", "étoile", " A  b "]) == ["etoile", "etoile", "a b"]
    assert values(spark, X.visible_text, [" a  b​", "x y"]) == ["␣a ␣b‹200B›", "x⍽y"]


def test_difference(spark):
    got = values(spark, lambda c: X.difference(F.lit("Lyon"), c), ["lyon", "Lyon ", "Lyons", "Ly​on", "Lyon ", "Lýon", "Lyon"])
    assert got == [["capital letters"], ["spaces"], ["spelling"], ["hidden character"], ["non-breaking space", "spaces"], ["accents"], ["spelling"]]


def test_null_tokens(spark):
    assert values(spark, X.null_token, [" N/A ", "?", "nope", ""]) == ["known", "extra", None, None]


def test_labels_and_figures():
    from tabprofile.functions import format as FM
    from tabprofile.operators.profile import distribution_kind
    from tabprofile.plans import recipe as C

    assert distribution_kind("numeric", 10, 10) == "histogram" and distribution_kind("text", 0, 0) == "ranking"
    assert distribution_kind("text", 100, 61) == "lengths" and distribution_kind("text", 100, 60) == "ranking"
    assert C.describe(C.Rename("a", "b")) == "Rename “a” to “b”" and C.describe(C.RemoveDuplicates(("x", "y"))) == "Remove duplicate rows by x, y"
    assert C.describe(C.Merge("v", ("a", "b"), "c")) == "Merge 2 spellings into “c” in “v”"
    assert C.describe_effect(C.Trim("a"), 1) == "1 cell changed" and C.describe_effect(C.DropRows((1, 2)), 1200) == "1,200 rows dropped"
    for step in (C.Remove("a"), C.SetType("a", "date"), C.Clean("a"), C.Case("a", "title"), C.Replace("a", "x", "y"), C.Empty("a", ("-",)),
                 C.FillValue("a", "0"), C.FixEncoding("a"), C.FillDown("a"), C.FillUp("a"), C.Round("a", 2), C.DropEmpty("a"), C.RemoveBlankRows()):
        assert C.describe(step)
    assert [FM.num(x) for x in (None, 1234.0, 0.5, 1234.56789, 0.00001, 12345678.5, -2.0)] == ["", "1,234", "0.5", "1,234.568", "1e-5", "1.235e+7", "-2"]
    assert (FM.count(12345), FM.percent(0.1234)) == ("12,345", "12.3 %")
