"""Recipes with their effects, filters and their treatment of blanks, sessions, exported code."""

import pytest
from pyspark.sql import functions as F

from tabprofile.operators import diagnose as D
from tabprofile.operators import profile as P
from tabprofile.operators import quality, relate
from tabprofile.operators.order import fill, positions
from tabprofile.plans import filters as FL
from tabprofile.plans import recipe as C
from tabprofile.plans.session import Session
from tabprofile.plans.table import ROW, ColumnInfo, Table
from tabprofile.functions.infer import infer


def raw_table(spark, header, rows, delimiter=","):
    cols = [f"c{k}" for k in range(len(header))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ", ".join([f"{ROW} long", *[f"{c} string" for c in cols]]))
    return infer(Table(df, tuple(ColumnInfo(c, header=h) for c, h in zip(cols, header)), delimiter))


ROWS = [("  Lyon", "12", "a"), ("paris", "", "b"), ("lyon", "12", "a"), ("Nice", "3", "c"), ("", "", "")]


def test_effects_and_rows(spark):
    t = raw_table(spark, ["ville", "prix", "note"], ROWS)
    done = C.apply_steps(t, (C.Trim("c0"), C.Case("c0", "title"), C.RemoveDuplicates(), C.RemoveBlankRows(), C.DropEmpty("c1")))
    assert [r["effect"] for r in done.effects().orderBy("step").collect()] == [1, 2, 1, 1, 1]
    left = done.rows().df.orderBy(ROW).collect()
    assert [(r[ROW], r["c0"]) for r in left] == [(0, "Lyon"), (3, "Nice")]
    assert t.df.count() == 5  # the original is as it was


def test_removed_columns_still_count_for_duplicates(spark):
    t = raw_table(spark, ["a", "b"], [("x", "1"), ("x", "2"), ("x", "1")])
    done = C.apply_steps(t, (C.Remove("c1"), C.RemoveDuplicates(), C.Rename("c0", "A")))
    assert [r["effect"] for r in done.effects().orderBy("step").collect()] == [0, 1, 0]
    assert done.output().columns == ["A"]


@pytest.mark.parametrize(
    "step, expected",
    [
        (C.Replace("c0", "a", "b"), ["b$b", "", "12 x"]),
        (C.Replace("c0", "", "b"), ["a$a", "", "12 x"]),
        (C.Replace("c0", "a$a", "z", "whole"), ["z", "", "12 x"]),
        (C.Replace("c0", r"(\d+) (x)", "$2-$1 $& $$", "regex"), ["a$a", "", "x-12 12 x $"]),
        (C.Replace("c0", "(", "z", "regex"), ["a$a", "", "12 x"]),
        (C.Replace("c0", "a", "\\", "regex"), ["\\$\\", "", "12 x"]),
        (C.Empty("c0", ("12 x",)), ["a$a", "", ""]),
        (C.Merge("c0", ("a$a", "12 x"), "m"), ["m", "", "m"]),
        (C.FillValue("c0", "f"), ["a$a", "f", "12 x"]),
        (C.FillDown("c0"), ["a$a", "a$a", "12 x"]),
        (C.FillUp("c0"), ["a$a", "12 x", "12 x"]),
        (C.SetType("c0", "numeric"), ["", "", ""]),
    ],
)
def test_cell_steps(spark, step, expected):
    t = raw_table(spark, ["x"], [("a$a",), ("",), ("12 x",)])
    done = C.apply_steps(t, (step,)).rows().df.orderBy(ROW).collect()
    assert [r["c0"] for r in done] == expected


def test_round_as_written(spark):
    t = raw_table(spark, ["x"], [("1.005",), ("2.50",), ("-0.125",), ("1 000",), ("",)])
    done = C.apply_steps(t, (C.Round("c0", 2),)).rows().df.orderBy(ROW).collect()
    assert [r["c0"] for r in done] == ["1", "2.5", "-0.13", "1000", ""]


def test_type_steps_coalesce():
    steps = C.add_step(C.add_step((C.Trim("c0"),), C.SetType("c0", "date")), C.SetType("c0", "text"))
    assert steps == (C.Trim("c0"), C.SetType("c0", "text"))


def test_fill_and_positions_across_stretches(spark):
    df = spark.range(0, 1000, 3).select(F.col("id").alias(ROW), F.when(F.col("id") % 100 == 0, F.col("id")).alias("v"))
    got = fill(df, F.col("v"), F.col("v").isNull(), F.col(ROW) % 7 != 0, size=16).orderBy(ROW).collect()
    last = None
    for r in got:
        if r[ROW] % 7 != 0:
            last = r["v"] if r["v"] is not None else last
            assert r["_filled"] == last
        else:
            assert r["_filled"] == r["v"]
    assert [r["_pos"] for r in positions(df, size=16).orderBy(ROW).collect()] == list(range(334))


def test_filters_and_blanks(spark):
    t = raw_table(spark, ["n", "s"], [("1", "Ab"), ("", "b"), ("3", " "), ("x1", "AB")])
    t = t.with_columns(ColumnInfo("c0", "numeric"))

    def kept(*f):
        return [r[ROW] for r in FL.apply_filters(t, f).df.orderBy(ROW).collect()]

    assert kept(FL.TextFilter("c1", "contains", "aB")) == [0, 3]
    assert kept(FL.TextFilter("c1", "not_contains", "b")) == [2]
    assert kept(FL.TextFilter("c1", "equals", "ab", blanks="add")) == [0, 2, 3]
    assert kept(FL.CompareFilter("c0", ">", 1)) == [2]
    assert kept(FL.CompareFilter("c0", "!=", 1)) == [1, 2, 3]
    assert kept(FL.CompareFilter("c0", "!=", 1, blanks="exclude")) == [2, 3]
    assert kept(FL.CompareFilter("c0", "between", 3, 1)) == [0, 2]
    assert kept(FL.ValuesFilter("c1", ("", "b"))) == [1, 2]
    assert kept(FL.hide_empty("c1")) == [0, 1, 3]
    assert kept(FL.RangeFilter("c0", 1, 3)) == [0]
    assert kept(FL.RangeFilter("c0", 1, 3, last=True, blank=True)) == [0, 1, 2]
    assert kept(FL.OutsideFilter("c0", 2, 9)) == [0]
    assert kept(FL.ValuesFilter("c1", tuple(f"v{k}" for k in range(1500)) + ("b", ""))) == [1, 2]


def test_set_filters_see_what_cell_filters_keep(spark):
    t = raw_table(spark, ["a", "b"], [("x", "1"), ("x", "2"), ("y", "2"), ("", "2"), (" ", "2")])
    rows = lambda *f: [r[ROW] for r in FL.apply_filters(t, f).df.orderBy(ROW).collect()]
    assert rows(FL.DistinctFilter("c0")) == [0, 2, 3]
    assert rows(FL.DistinctFilter("c0"), FL.ValuesFilter("c1", ("2",))) == [1, 2, 3]
    assert rows(FL.UniqueFilter("c0"), FL.ValuesFilter("c1", ("2",))) == [1, 2]


def test_profile_of_a_raw_table(spark):
    cells = [("1",), ("2",), ("2",), ("",), ("100",), ("3",), ("4",)]
    r = P.profile(raw_table(spark, ["n"], cells)).first()
    assert (r["kind"], r["total"], r["missing"], r["distinct"], r["unique"]) == ("numeric", 7, 1, 5, 4)
    assert (r["q1"], r["median"], r["q3"], r["outliers"]) == (2.0, 2.5, 3.75, 1)
    h = P.histogram(raw_table(spark, ["n"], cells)).collect()
    assert sum(x["n"] for x in h) == 6 and len(h) == 20


def test_empty_table(spark):
    t = raw_table(spark, ["n", "s"], [])
    assert {r["kind"] for r in P.profile(t).collect()} in (set(), {"text"})
    assert C.apply_steps(t, (C.Trim("c0"), C.FillDown("c1"), C.RemoveDuplicates())).rows().df.count() == 0
    assert D.findings(t).count() == 0 and quality.similar_spellings(t).count() == 0


def test_inference(spark):
    def kinds(header, *columns):
        return [c.kind for c in raw_table(spark, header, list(zip(*columns))).columns]

    assert kinds(["d"], ["01/02/2015", "03/04/2016"]) == ["text"]
    assert kinds(["d"], ["01/02/2015", "25/02/2015"]) == ["date"]
    assert kinds(["t"], ["9:05", "10:00:01"]) == ["time"]
    assert kinds(["n", "telephone", "zip code", "interval"], ["1", "2"], ["1", "2"], ["06", "07"], ["1", "2"]) == ["numeric", "text", "text", "numeric"]
    assert kinds(["n"], ["012", "13"]) == ["text"]


def test_placeholders(spark):
    values = [str(20 + k % 17) for k in range(200)] + ["-999"] * 12 + ["9999"]
    got = {r["value"]: r["n"] for r in D.numeric_placeholders(raw_table(spark, ["n"], [(v,) for v in values])).collect()}
    assert got == {-999.0: 12}
    most = [str(20 + k % 17) for k in range(100)] + ["-999"] * 150
    got = {r["value"]: r["n"] for r in D.numeric_placeholders(raw_table(spark, ["n"], [(v,) for v in most])).collect()}
    assert got == {-999.0: 150}


def test_gaps(spark):
    ids = [k for k in range(1, 41) if k not in (4, 17, 18)]
    found = D.sequence_gaps(raw_table(spark, ["id"], [(str(k),) for k in ids]), "c0").orderBy("after").collect()
    assert [(r["after"], r["before"], r["missing"]) for r in found] == [(3.0, 5.0, 1), (16.0, 19.0, 2)]
    days = [(f"2020-01-{k:02d}",) for k in range(1, 29) if k != 9]
    row = D.sequence_gaps(raw_table(spark, ["d"], days), "c0").first()
    assert (row["missing"], row["every"]) == (1, "day")


def test_spellings(spark):
    cells = ["Lyon"] * 120 + ["Lyons"] * 3 + ["lyon "] * 2 + ["Chine"] * 10 + ["Chili"] * 9 + ["Mali"] * 8 + ["Mal"] + ["A1", "A2"]
    got = quality.similar_spellings(raw_table(spark, ["v"], [(c,) for c in cells])).collect()
    assert {(r["canonical"], r["value"], r["n"]) for r in got} == {("Lyon", "Lyons", 3), ("Lyon", "lyon ", 2)}
    report = {r["shown"]: r["kinds"] for r in quality.spelling_report(raw_table(spark, ["v"], [(c,) for c in cells])).collect()}
    assert report == {"Lyons": ["spelling"], "lyon␣": ["spaces", "capital letters"]}


def test_level_shift(spark):
    flat = [(str(10 + (k * 7919 % 13) / 10),) for k in range(400)]
    jump = [(str(float(v[0]) + (20 if k >= 150 else 0)),) for k, v in enumerate(flat)]
    rising = [(str(k * 1.0),) for k in range(400)]
    assert relate.level_shift(raw_table(spark, ["v"], flat), "c0").count() == 0
    assert relate.level_shift(raw_table(spark, ["v"], rising), "c0").count() == 0
    assert abs(relate.level_shift(raw_table(spark, ["v"], jump), "c0").first()["position"] - 150) <= 2


def test_duplicates(spark):
    t = raw_table(spark, ["a", "b"], [("x", "1"), ("y", "1"), ("x", "1"), ("x", "1"), ("y", "1"), ("z", "")])
    assert [(r["first_row"], r["n"]) for r in D.duplicate_groups(t).orderBy("first_row").collect()] == [(0, 3), (1, 2)]
    assert D.duplicate_count(t).first().asDict() == {"groups": 2, "extras": 3}


def test_session(spark):
    t = raw_table(spark, ["ville", "prix", "note"], ROWS)
    s = Session(t).with_step(C.Trim("c0")).toggle(FL.ValuesFilter("c2", ("a", "b"))).toggle(FL.TextFilter("c0", "contains", "o"))
    assert [r[ROW] for r in s.rows().collect()] == [0, 2]
    assert {(r["value"], r["n"]) for r in s.value_counts("c2").collect()} == {("a", 2)}
    assert s.toggle(FL.TextFilter("c0", "contains", "o")).filters == (FL.ValuesFilter("c2", ("a", "b")),)
    assert [x.sort for x in (s.cycle_sort("c0"), s.cycle_sort("c0").cycle_sort("c0"))] == [("c0", False), ("c0", True)]
    assert s.cycle_sort("c0").cycle_sort("c0").cycle_sort("c0").sort is None
    code = s.code("in.csv")
    compile(code, "code", "exec")
    assert "C.Trim(column='c0')" in code and "F.ValuesFilter(column='c2', values=('a', 'b'))" in code
    assert Session(t).with_step(C.Trim("c0")).without_step(0).effects().count() == 0


def test_exported_code_runs(spark, tmp_path):
    """The script gives the rows of the session it was exported from."""
    from tabprofile.sources.csv import read_csv

    path = tmp_path / "in.csv"
    path.write_text("name;n;day\n Lyon;5;25/02/2015\nlyon;7;01/03/2015\n;1,5;13/04/2015\nNice;x;\nNice;x;\n")
    s = Session(read_csv(spark, str(path)))
    for step in (C.Trim("c0"), C.Case("c0", "title"), C.Rename("c1", "number"), C.SetType("c1", "numeric"), C.Remove("c2"), C.RemoveDuplicates()):
        s = s.with_step(step)
    s = s.toggle(FL.DistinctFilter("c0")).toggle(FL.hide_empty("c0")).cycle_sort("c0").cycle_sort("c0")
    made: dict = {}
    exec(s.code(str(path)), made)
    want = [tuple(r) for r in s.rows().collect()]
    assert [tuple(r) for r in made["rows"].collect()] == want and [r[0] for r in want] == ["Nice", "Lyon"]


def test_recipes_leave_columns_of_any_name(spark):
    t = Table.of(spark.createDataFrame([(0, " a", "x", "p"), (1, "b", "y", "q")], f"{ROW} long, _dropped_at string, __new string, _e0 string"))
    done = C.apply_steps(t, (C.Trim("_dropped_at"), C.DropRows((1,))))
    assert [tuple(r) for r in done.output().collect()] == [("a", "x", "p")]
    assert [r["effect"] for r in done.effects().orderBy("step").collect()] == [1, 1]
