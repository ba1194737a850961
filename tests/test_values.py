"""Quantiles, spellings, placeholders, gaps, duplicates and typed bounds against plain re-computation."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprofile.functions import text as X
from tabprofile.operators import diagnose as D
from tabprofile.operators import profile as P
from tabprofile.operators import quality, relate
from tabprofile.operators.order import neighbours, ranged
from tabprofile.plans import filters as FL
from tabprofile.plans.table import ROW, Table


def table_of(spark, rows, schema):
    return Table.of(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"{ROW} long, {schema}"))


@pytest.fixture
def generated(spark):
    """Generated code on, as in production; the other tests run without it."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield spark
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


def test_quantiles_are_exact(generated):
    rng = np.random.default_rng(5)
    groups = {
        "even": rng.random(3000) * 1e6,
        "far": np.concatenate([rng.random(3000), [1e300, -1e300]]),
        "crowded": 1.7e12 + rng.integers(0, 5000, 4000).astype(float),
        "scales": 10.0 ** rng.integers(-200, 200, 500),
        "ties": np.repeat([1.0, 2.0, 2.5], [7, 1, 2]),
        "one": np.array([4.25]),
        "two": np.array([-3.0, 9.0]),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), ("even", None), (None, 3.0), (None, 5.0)]
    df = generated.createDataFrame(rows, "g string, value double")
    got = {(r["g"], r["f"]): r["q"] for r in P.quantiles(df, ["g"], (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    for g, vs in {**groups, None: np.array([3.0, 5.0])}.items():
        for f in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert got[g, f] == pytest.approx(np.quantile(vs, f), rel=1e-12), (g, f)
    assert not any(g == "none" for g, _ in got)
    assert P.quantiles(df.limit(0), ["g"], (0.5,)).count() == 0


def test_profile_of_empty_and_odd_columns(spark):
    t = table_of(spark, [(None, None, ""), (2.0, None, "x"), (2.0, None, None)], "a double, b int, c string")
    got = {r["column"]: r for r in P.profile(t).collect()}
    assert (got["a"]["present"], got["a"]["distinct"], got["a"]["deviation"], got["a"]["outliers"]) == (2, 1, 0.0, 0)
    assert (got["b"]["missing"], got["b"]["min"], got["c"]["present"]) == (3, None, 1)
    bins = [r["n"] for r in P.histogram(t, ["a"]).orderBy("bin").collect()]
    assert bins == [2] + [0] * 19
    empty = t.with_df(t.df.limit(0))
    assert P.histogram(empty).count() == 0 and P.measures(empty).count() == 0 and P.profile(empty).count() == 0
    assert P.summary_without(t, "a", (2.0,)).count() == 0
    assert P.summary_without(t, "a", ()).first()["count"] == 2


def test_value_counts_keep_raw_values_apart(spark):
    t = table_of(spark, [("",), ("  ",), (None,), ("a",), ("a ",)], "v string")
    assert {(r["value"], r["n"]) for r in P.value_counts(t, "v").collect()} == {("", 2), ("  ", 1), ("a", 1), ("a ", 1)}


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _grouped(counts):
    """From the most frequent value down, by plain comparison with all groups so far."""
    key = lambda v: " ".join(v.lower().replace("-", "").split())
    order = sorted(((v, n, key(v)) for v, n in counts.items() if len(key(v)) >= 2), key=lambda x: (-x[1], x[0]))
    groups, found = [], set()
    for v, n, k in order:
        homes = [
            (gv, gn) for gv, gn, gk in groups
            if gk == k or (min(len(k), len(gk)) >= 4 and gn >= 3 * n and _edits(gk, k) <= (2 if len(k) >= 9 else 1))
        ]
        if homes:
            found.add((*homes[0], v, n))
        else:
            groups.append((v, n, k))
    return found


def test_spellings_are_grouped_as_one_by_one(generated):
    rng = random.Random(7)
    words = ["lyon", "paris", "marseille", "bordeaux", "saint-etienne", "nice", "mali", "mal", "feu", "grenoble city"]
    columns = {}
    for c in ("x", "y"):
        cells = Counter()
        for w in words:
            cells[w] += rng.randrange(10, 60)
            for _ in range(25):
                v = list(w)
                for _ in range(rng.randrange(1, 4)):
                    at = rng.randrange(len(v))
                    v[at : at + rng.randrange(2)] = rng.choice(["", "e", "ss", v[at].upper(), "-"])
                if "".join(v).strip():
                    cells["".join(v)] += rng.randrange(1, 9)
        columns[c] = cells
    most = max(sum(n.values()) for n in columns.values())
    lists = [list(c.elements()) + [None] * (most - c.total()) for c in columns.values()]
    t = table_of(generated, list(zip(*lists)), "x string, y string")
    got = quality.similar_spellings(t).collect()
    for c, cells in columns.items():
        mine = {(r["canonical"], r["canonical_n"], r["value"], r["n"]) for r in got if r["column"] == c}
        assert mine == _grouped({v: n for v, n in cells.items() if len(v.strip()) >= 2}) and len(mine) > 20
    assert quality.similar_spellings(t.with_df(t.df.limit(0))).count() == 0 and quality.skipped_columns(t).count() == 0


def test_accents_of_all_scripts(spark):
    cells = ["Nguyễn", "Άλφα", "Ёлка", "Łódź", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r["k"] for r in df.select(X.strip_accents(F.col("c")).alias("k")).collect()] == ["Nguyen", "Αλφα", "Елка", "Łodz", None]


def test_many_spellings_are_reported(spark, monkeypatch):
    monkeypatch.setattr(quality, "MAX_DISTINCT", 2)
    t = table_of(spark, [("aa", "b"), ("bb", "bb"), ("cc", "bbb")], "v string, w string")
    assert [(r["column"], r["spellings"]) for r in quality.skipped_columns(t).collect()] == [("v", 3)]


def _placeholders(values):
    """The rule, value by value."""
    counts = Counter(v for v in values if v is not None)
    ordered = sorted(counts)

    def fences(vs):
        q1, q3 = np.quantile(vs, [0.25, 0.75])
        return lambda v: v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)

    out, found, late = fences(list(counts.elements())), set(), []
    for k, v in enumerate(ordered):
        n = counts[v]
        if v in D.SENTINELS and n >= 2:
            if out(v):
                found.add((v, n))
            else:
                late.append(v)
        elif v not in D.SENTINELS and out(v) and n >= max(3, -(-counts.total() // 1000)):
            near = [counts[ordered[j]] for j in (k - 1, k + 1) if 0 <= j < len(ordered)]
            if n >= 3 * max(near, default=0):
                found.add((v, n))
    rest = [v for v in counts.elements() if v not in late]
    return found | {(v, counts[v]) for v in late if rest and fences(rest)(v)}


def test_placeholders_beside_each_other(generated):
    rng = random.Random(2)
    base = [float(rng.randrange(40)) for _ in range(600)]
    spikes = [500.0] * 9 + [501.0] * 3 + [700.0] * 5 + [900.0] * 15 + [901.0] * 5 + [-50.0] * 4 + [-51.0]
    columns = [base + spikes, [9999.0] * 400 + base[:200] + [None] * 5, [-999.0] * 2 + base + [99.0] * 3, [1.0, 1.0, 1.0]]
    most = max(map(len, columns))
    rows = list(zip(*[c + [None] * (most - len(c)) for c in columns]))
    t = table_of(generated, rows, "a double, b double, c double, d double")
    got = D.numeric_placeholders(t).collect()
    for name, values in zip("abcd", columns):
        assert {(r["value"], r["n"]) for r in got if r["column"] == name} == _placeholders(values), name
    assert {r["value"] for r in got if r["column"] == "a"} >= {900.0}
    assert D.numeric_placeholders(t.with_df(t.df.limit(0))).count() == 0


def test_gaps_of_crowded_values(spark):
    """A far value does not spoil a sequence, whatever the stretches."""
    values = [*range(1000, 1400), *range(1410, 1500), 10**9]
    df = spark.createDataFrame([(float(v),) for v in values], "value double")
    for size in (1 << 16, 100):
        near = neighbours(ranged(df, F.asc("value"), size=size), "value").where("before is not null")
        got = {(r["before"]["value"], r["value"]) for r in near.collect()}
        assert got == {(float(a), float(b)) for a, b in zip(values, values[1:])}
    t = table_of(spark, [(v,) for v in values], "v long")
    gaps = {(r["after"], r["before"], r["missing"]) for r in D.sequence_gaps(t, "v").collect()}
    assert gaps == {(1399.0, 1410.0, 10), (1499.0, 1e9, 10**9 - 1500)}


def test_duplicates_of_a_hot_row_and_nulls(spark):
    rows = [("a", 1)] * 50 + [(None, 1), ("", 1), (None, 1), ("b", None), ("a", 2)]
    t = table_of(spark, rows, "s string, i int")
    assert {(r["first_row"], r["n"]) for r in D.duplicate_groups(t).collect()} == {(0, 50), (50, 2)}
    assert {(r[ROW], r["_group"]) for r in FL.duplicate_rows(t).collect()} == {*((k, 0) for k in range(50)), (50, 50), (52, 50)}
    assert D.duplicate_count(t).first()["extras"] == 50
    assert FL.duplicate_rows(t.with_df(t.df.limit(0))).count() == 0


def test_bounds_as_they_are_typed(spark):
    from tabprofile.functions.infer import infer

    rows = [("25/02/2015", "7:30", "1 234"), ("03/03/2015", "8:00", "5"), ("", "23:59", "x")]
    t = infer(table_of(spark, rows, "d string, c string, n string"))
    assert (t["d"].kind, t["c"].kind, t["n"].kind) == ("date", "time", "text")
    kept = lambda *f: {r[ROW] for r in FL.apply_filters(t, f).df.collect()}
    assert kept(FL.CompareFilter("d", ">", "25/02/2015")) == {1} and kept(FL.CompareFilter("d", ">=", "2015-02-25")) == {0, 1}
    assert kept(FL.CompareFilter("d", "between", "2015-03-03", "01/01/2015", blanks="add")) == {0, 1, 2}
    assert kept(FL.CompareFilter("c", "<", "8:00")) == {0} and kept(FL.CompareFilter("d", ">", "soon")) == set()
    assert kept(FL.CompareFilter("d", "!=", "03/03/2015")) == {0, 2}
    assert FL.label(FL.CompareFilter("d", "between", "2015-03-03", "01/01/2015")) == "d ∈ [2015-03-03, 01/01/2015]"


def test_finding_values_are_raw(spark):
    rows = [("Lyon",), ("lyon ",), ("N/A",), (" n/a",), ("Nice",), ("TrÃ¨s",), (None,)]
    t = table_of(spark, rows, "v string")
    got = {(r["kind"], r["what"], r["value"], r["n"]) for r in D.finding_values(t).collect()}
    assert got == {
        ("case variants", "Lyon", "Lyon", 1), ("case variants", "lyon", "lyon ", 1),
        ("case variants", "N/A", "N/A", 1), ("case variants", "n/a", " n/a", 1),
        ("padded", None, "lyon ", 1), ("padded", None, " n/a", 1),
        ("null token", "N/A", "N/A", 1), ("null token", "n/a", " n/a", 1),
        ("damaged encoding", "Très", "TrÃ¨s", 1),
    }
    texts = {r["kind"]: (r["n"], r["text"]) for r in D.findings(t).collect()}
    assert texts["case variants"] == (4, "v: 4 spellings differ in capitals only")
    assert texts["null token"] == (2, "v: nothing is written N/A (1), n/a (1)")
    assert texts["damaged encoding"] == (1, "v: 1 cells like TrÃ¨s for Très")
    assert D.findings(t.with_df(t.df.limit(0))).count() == 0


def test_groups_times_and_buckets_of_odd_tables(spark):
    rows = [(None if k % 5 == 0 else float(k), ["a", "b", None, " "][k % 4], None) for k in range(40)]
    t = table_of(spark, rows, "m double, g string, d date")
    means = {r["category"]: r["n"] for r in relate.group_means(t, "m", ["g"]).collect()}
    assert sum(means.values()) == 32 and set(means) == {"a", "b", ""}
    shown = relate.shown_groups(relate.group_means(t, "m", ["g"]), k=2).collect()
    assert len(shown) == 2 and {r["hidden"] for r in shown} == {1}
    assert relate.time_breakdown(t, "d").count() == 0
    buckets = relate.row_order_buckets(t, "m").collect()
    assert sum(r["n"] for r in buckets) == 40 and sum(r["empty"] for r in buckets) == 8
    empty = t.with_df(t.df.limit(0))
    assert relate.row_order_buckets(empty, "m").count() == 0 and relate.group_means(empty, "m", ["g"]).count() == 0
    assert relate.correlation_pairs(t, sample=10).count() == 0
