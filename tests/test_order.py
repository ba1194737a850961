"""Radix quantiles, moments of pairs, range exchanges and scripts that stand alone."""

import json
import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprofile.operators import diagnose as D
from tabprofile.operators import gram
from tabprofile.operators import order as O
from tabprofile.operators import profile as P
from tabprofile.operators import relate as R
from tabprofile.plans import filters as FL
from tabprofile.plans import recipe as C
from tabprofile.plans.durable import settle
from tabprofile.plans.session import Session
from tabprofile.plans.table import ROW, Table
from tabprofile.sources.csv import read_csv


@pytest.fixture
def generated(spark):
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield spark
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


def test_image_keeps_the_order_of_doubles(generated):
    tiny = np.nextafter(0, 1)
    values = [0.0, -0.0, 1.0, np.nextafter(1, 2), np.nextafter(1, 0), 2.0, 3.0, tiny, 2.2250738585072014e-308, np.nextafter(2.2250738585072014e-308, 0), 1e300, 1.7976931348623157e308, float("inf")]
    rng = np.random.default_rng(1)
    values += [float(x) for x in np.exp(rng.normal(size=3000) * 100)] + [float(2.0**k) for k in range(-1074, 1024)] + [float(np.nextafter(2.0**k, 0)) for k in range(-1000, 1024)]
    values = [float(v) for v in values]
    values += [-v for v in values]
    df = generated.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(P.image(F.col("v"))).collect()]
    bits = np.array(values).view(np.int64)
    want = np.where(bits >= 0, bits, -(bits & np.int64(2**63 - 1)))
    assert got == want.tolist()


def test_quantiles_of_crowded_values(generated, monkeypatch):
    """Log-normal values and far extremes, with cells of at most 64 values, so that every round of the selection is used."""
    rng = np.random.default_rng(5)
    wide = np.exp(5 * rng.normal(size=20_000))
    far = np.concatenate([rng.normal(size=5000), [1e300, -1e300, 1e100, 1e100]])
    close = 1 + rng.integers(0, 4000, 8000) * np.finfo(float).eps
    rows = [(g, float(v)) for g, vs in (("wide", wide), ("far", far), ("close", close), (None, far[:3])) for v in vs]
    df = generated.createDataFrame(pd.DataFrame(rows, columns=["g", "value"]).astype({"g": object}))
    fractions = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    for cell in (64, 1 << 16):
        monkeypatch.setattr(P, "CELL", cell)
        got = {(r["g"], r["f"]): r["q"] for r in P.quantiles(df, ["g"], fractions).collect()}
        for g, vs in (("wide", wide), ("far", far), ("close", close), (None, far[:3])):
            assert [got[(g, f)] for f in fractions] == pytest.approx([float(np.quantile(vs, f)) for f in fractions], rel=1e-14)


def test_no_window_of_the_selection_is_large(generated):
    """The leading bits of a million values about the median make few sums, and their cells hold at most 2**16 of them."""
    v = np.sort(np.exp(5 * np.random.default_rng(2).normal(size=1_000_000)))
    v[:3] = [1e100, 1e300, -1e300]
    lead = v.view(np.int64) >> 48
    kinds = np.unique(lead, return_counts=True)
    assert len(kinds[0]) <= 1 << 16 and kinds[1].max() <= P.CELL
    df = generated.range(1_000_000).select(F.exp(5 * F.randn(3)).alias("value"), F.lit(0).alias("c"))
    assert P.quantiles(df, ["c"], (0.5,)).first()["q"] == pytest.approx(1, rel=0.05)


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(1)
    k, n = 130, 160
    x = rng.normal(size=(n, k)) * 10.0 ** rng.integers(-3, 4, k) + 10.0 ** rng.integers(0, 6, k)
    x[:, 1] = 3 - 2 * x[:, 0]
    x[:, 2] = 0.1
    x[rng.random((n, k)) < 0.2] = np.nan
    x[:-19, 3] = np.nan  # too few
    frame = pd.DataFrame(x, columns=[f"c{i}" for i in range(k)])
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"c{i} double" for i in range(k))).repartition(5)
    got = {(r["left_column"], r["right_column"]): r["r"] for r in R.correlation_pairs(Table.of(df)).collect()}
    assert len(got) == k * (k - 1) // 2
    want = frame.corr(min_periods=20)
    for (a, b), r in got.items():
        if a in ("c2", "c3") or b in ("c2", "c3"):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-7)  # 1e-3 wide about 1e5
    assert got[("c0", "c1")] == pytest.approx(-1)


def test_moments_of_parts_add_up():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 5)) + 1e6
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:30, 2] = np.nan  # a part without any
    whole, parts = gram.moments(x), [gram.moments(p) for p in (x[:30], x[30:31], x[31:])]
    merged = gram.merge(gram.merge(parts[0], parts[1]), parts[2])
    for a, b in zip(whole, merged):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-6)


def test_positions_split_a_hot_value(spark):
    """All rows of one value: the stretches are cut by row as well."""
    t = Table.of(spark.range(3000).select(F.col("id").alias(ROW), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("v"), F.when(F.col("id") % 3 == 0, "x").alias("w")))
    dealt = O.ranged(t.df, *FL.sort_keys(t, "v", True), size=200)
    assert dealt.groupBy("_part").count().agg(F.max("count")).first()[0] < 600
    for column, down in (("v", True), ("v", False), ("w", False), (None, False)):
        want = [r[ROW] for r in FL.sort_rows(t, column, down).collect()]
        got = {r["place"]: r[ROW] for r in FL.sorted_positions(t, column, down, rows_per_stretch=200).collect()}
        assert [got[k] for k in range(3000)] == want
    assert FL.sorted_positions(t.with_df(t.df.limit(0)), "v").count() == 0


def test_neighbours_across_stretches(spark):
    """Values crowded at two scales, each next to those on either side."""
    rng = np.random.default_rng(6)
    values = sorted({float(x) for x in np.concatenate([rng.random(400) * 1e-9, rng.random(300) * 1e9, [5.0]])})
    df = spark.createDataFrame([("a", v, k) for k, v in enumerate(values)] + [("b", 1.0, 0)], "c string, value double, n long")
    dealt = O.ranged(df, F.asc("c"), F.asc("value"), size=50)
    assert dealt.select("_part").distinct().count() > 5
    got = {(r["c"], r["n"]): (r["before"] and r["before"]["value"], r["after"] and r["after"]["value"]) for r in O.neighbours(dealt, "value", by="c").collect()}
    padded = [None, *values, None]
    assert got == {("a", k): (padded[k], padded[k + 2]) for k in range(len(values))} | {("b", 0): (None, None)}


def test_gaps_and_spikes_come_from_one_walk(spark):
    ids = [k for k in range(1, 400) if k not in (7, 50, 51)] + [1_000_000]
    t = Table.of(spark.createDataFrame([(i, v) for i, v in enumerate(ids)], f"{ROW} long, v long"))
    gaps = {(r["after"], r["before"], r["missing"]) for r in D.sequence_gaps(t, "v").collect()}
    assert gaps == {(6, 8, 1), (49, 52, 2), (399, 1_000_000, 999_600)}
    rows = [float(x % 50) for x in range(3000)] + [500.0] * 40 + [499.0] * 20 + [600.0] * 2 + [700.0] * 40 + [702.0] * 5
    t = Table.of(spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"{ROW} long, v double"))
    assert {(r["value"], r["n"]) for r in D.numeric_placeholders(t).collect()} == {(700.0, 40)}


def test_buckets_and_shifts_along_a_sorted_view(spark):
    n = 400
    t = Table.of(spark.range(n).select(F.col("id").alias(ROW), ((F.col("id") * 37) % n).alias("k"), (F.when((F.col("id") * 37) % n < 150, 1).otherwise(9) + F.col("id") % 3).alias("v")))
    assert R.level_shift(t, "v").count() == 0
    assert R.level_shift(t, "v", sort=("k", False)).first()["position"] == 150
    up = {r["bucket"]: r["mean"] for r in R.row_order_buckets(t, "v", most=4, sort=("k", True)).collect()}
    assert up[0] > 9 and up[1] > 9 and up[3] < 3 and R.row_order_buckets(t, "v", sort=("k", True)).agg(F.sum("n")).first()[0] == n


def test_only_the_empty_string_stands_for_blanks(spark):
    cells = ["", "  ", "\t", "﻿", "a", " a"]
    t = Table.of(spark.createDataFrame(list(enumerate(cells)), f"{ROW} long, c string"))
    many = tuple(f"v{k}" for k in range(1500))
    for values, want in ((("  ",), [1]), (("",), [0, 1, 2, 3]), (("﻿", "a"), [3, 4]), (("", " a"), [0, 1, 2, 3, 5])):
        for listed in (values, values + many):
            for exclude in (False, True):
                got = [r[ROW] for r in FL.apply_filters(t, (FL.ValuesFilter("c", listed, exclude),)).df.orderBy(ROW).collect()]
                assert got == ([k for k in range(6) if k not in want] if exclude else want)


CSV = "name;n;day;note\n Lyon;5;25/02/2015;a​b\nlyon;7;01/03/2015;\n;1,5;13/04/2015;NA\nNice;x;;Ã©tÃ©\nNice;x;;Ã©tÃ©\n;;;\nparis nord;12,25;02/01/2016;\"q;\"\"r\"\"z\"\n"


def _run_alone(tmp_path, code):
    """The rows of a script, run where this package cannot be imported."""
    path = tmp_path / "alone.py"
    tail = "\nimport json, sys\ntry:\n    import tabprofile\n    sys.exit('the package is there')\nexcept ImportError:\n    pass\nprint('ROWS' + json.dumps([list(r) for r in rows.collect()]))\n"
    head = "from pyspark.sql import SparkSession as S\nS.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '1').getOrCreate()\n"
    future, _, rest = code.partition("\n")
    path.write_text(future + "\n" + head + rest + tail)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    line = next((x for x in done.stdout.splitlines() if x.startswith("ROWS")), None)
    assert line, done.stderr[-3000:]
    return json.loads(line[4:])


def test_scripts_stand_alone(generated, tmp_path):
    """Two scripts with all kinds of steps and filters give the sessions' rows without the package."""
    path = tmp_path / "in.csv"
    path.write_text(CSV)
    t = read_csv(generated, str(path))
    t = t.with_df(settle(t.df))  # the steps replay it several times
    s = Session(t)
    steps = [
        C.Trim("c0"), C.Case("c0", "title"), C.Clean("c3"), C.FixEncoding("c3"), C.Empty("c3", ("NA",)), C.FillValue("c3", "none"), C.Rename("c1", "number"),
        C.SetType("c1", "numeric"), C.Round("c1", 1), C.FillDown("c2"), C.Replace("c0", "o(.)", "0$1", "regex"), C.Replace("c0", "(", "x", "regex"),
        C.Replace("c3", "q", "Q"), C.Merge("c0", ("Ly0n",), "Lyon"), C.RemoveDuplicates(), C.DropEmpty("c0"), C.DropRows((6, 99)), C.RemoveBlankRows(), C.Remove("c3"),
    ]
    for step in steps:
        s = s.with_step(step)
    s = s.toggle(FL.CompareFilter("c1", "between", 0, 10, blanks="add")).toggle(FL.TextFilter("c0", "not_contains", "zz")).cycle_sort("c1").cycle_sort("c1")
    plain = Session(t).toggle(FL.DistinctFilter("c0")).toggle(FL.ValuesFilter("c0", ("", "x"), exclude=True)).toggle(FL.CompareFilter("c2", ">", "26/02/2015", blanks="add")).cycle_sort("c2")
    for session in (s, plain):
        code = session.script(str(path))
        assert "tabprofile" not in code
        want = [list(r) for r in session.rows().select(*[c.name for c in session.view().columns]).collect()]
        assert _run_alone(tmp_path, code) == want and want


def _rounded(row):
    return repr([round(x, 9) if isinstance(x, float) else x for x in row])


def test_facets_equal_the_panels_one_by_one(spark):
    rows = [(k, float(k % 17) if k % 9 else None, ["a", "b", "", "c d"][k % 4], k % 5) for k in range(300)] + [(300, 1.0, "b", 1), (301, 1.0, "b", 1)]
    t = Table.of(spark.createDataFrame(rows, f"{ROW} long, x double, y string, z int"))
    filters = (FL.CompareFilter("x", ">", 3), FL.CompareFilter("x", "<", 12), FL.ValuesFilter("y", ("a", "b", "")))
    for more in ((), (FL.DistinctFilter("z"),), (FL.DuplicatesFilter(),), (FL.ValuesFilter("z", tuple(str(k) for k in range(3)) + tuple(f"v{k}" for k in range(1500))),)):
        session = Session(t, filters=filters + more)
        with session.facets() as f:
            got = [f.profile(), f.histogram(), f.top_values()]
            want = [P.profile(session.view()), P.histogram(session.view()), P.top_values(session.view())]
            for a, b in zip(got, want):
                assert sorted(map(_rounded, a.select(*b.columns).collect())) == sorted(map(_rounded, b.collect()))
            for c in ("x", "y", "z"):
                assert [tuple(r) for r in f.value_counts(c).collect()] == [tuple(r) for r in session.value_counts(c).collect()]


def test_facets_scan_once(spark):
    """Everything that is read comes from one stage over the input."""
    t = Table.of(spark.range(500).select(F.col("id").alias(ROW), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("y")))
    with Session(t, filters=(FL.CompareFilter("x", ">", 1),)).facets() as f:
        for df in (f.profile(), f.histogram(), f.top_values()):
            df.collect()
        plan = f.value_counts("y")._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" in plan


def test_pages_read_their_file_only(spark, tmp_path):
    t = Table.of(spark.range(4000).select(F.col("id").alias(ROW), ((F.col("id") * 7919) % 4000).alias("k"), F.when(F.col("id") % 3 == 0, "x").alias("w")))
    s = Session(t, filters=(FL.CompareFilter("k", "<", 3997),)).cycle_sort("w")
    pages = s.pages(str(tmp_path / "pages"), size=4)
    want = [r[ROW] for r in s.rows().collect()]
    assert pages.rows == len(want) == 3997 and len(pages) == 1000
    for k in (0, 1, 333, 999):
        page = pages.page(k)
        assert [r[ROW] for r in page.collect()] == want[4 * k : 4 * k + 4]
        assert page.select(F.input_file_name()).distinct().count() == 1  # of 100 files
    assert "PartitionFilters: [isnotnull(_file" in pages.page(7)._jdf.queryExecution().executedPlan().toString()
    assert pages.page(1000).count() == 0 and pages.page(-1).count() == 0
    none = Session(t.with_df(t.df.limit(0))).pages(str(tmp_path / "none"))
    assert len(none) == 0


def test_effects_are_observed_while_saving(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(CSV)
    s = Session(read_csv(spark, str(path)))
    for step in (C.Trim("c0"), C.Case("c0", "lower"), C.RemoveDuplicates(), C.RemoveBlankRows(), C.Rename("c1", "n"), C.FillDown("c2")):
        s = s.with_step(step)
    target, effects = s.save(str(path))
    assert effects == [r["effect"] for r in s.effects().orderBy("step").collect()] and sum(effects) > 3
    assert target.endswith("in.clean.csv")
    back = read_csv(spark, target)
    assert back.df.count() == s.view().df.count()
