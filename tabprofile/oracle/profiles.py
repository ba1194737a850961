"""Profiles, histograms, rankings, filters and sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..plans import filters as FL
from .common import Registry, rounded, table, union_sql

R = Registry()
LINEITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_shipdate"]


def value_sql(c: str, date: bool = False) -> str:
    return f"epoch_ms({c})::DOUBLE" if date else f"{c}::DOUBLE"


def profile_sql(source: str, c: str, date: bool = False, label: str | None = None) -> str:
    """One column's profile; ``source`` is a table or a parenthesised query."""
    v = value_sql(c, date)
    return f"""SELECT '{label or c}' AS "column", s.total, s.missing, s.present, s."distinct",
  (SELECT count(*) FROM (SELECT 1 FROM {source} x WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) = 1)) AS "unique",
  s."min", s."max", round(s.mean, 4) AS mean, round(s.deviation, 4) AS deviation, round(s.q1, 4) AS q1, round(s."median", 4) AS "median", round(s.q3, 4) AS q3,
  (SELECT count(*) FROM {source} x WHERE {v} < s.q1 - 1.5 * (s.q3 - s.q1) OR {v} > s.q3 + 1.5 * (s.q3 - s.q1)) AS outliers
FROM (SELECT count(*) AS total, count(*) - count({c}) AS missing, count({c}) AS present, count(DISTINCT {c}) AS "distinct",
  min({v}) AS "min", max({v}) AS "max", avg({v}) AS mean, coalesce(stddev_samp({v}), 0) AS deviation,
  quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS "median", quantile_cont({v}, 0.75) AS q3 FROM {source} y) s"""


PROFILE_COLUMNS = ["column", "total", "missing", "present", "distinct", "unique", "min", "max", "mean", "deviation", "q1", "median", "q3", "outliers"]


@R.add(union_sql([profile_sql("lineitem", c, c == "l_shipdate") for c in LINEITEM]))
def profile_numeric(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem", LINEITEM)
    return rounded(P.profile(t).select(*PROFILE_COLUMNS), "mean", "deviation", "q1", "median", "q3")


TEXTS = {"customer": ["c_name", "c_mktsegment"], "orders": ["o_orderpriority", "o_orderstatus"], "part": ["p_name", "p_type", "p_brand"]}


@R.add(
    union_sql(
        [
            f"""SELECT '{c}' AS "column", count(*) AS total, count_if(trim(coalesce({c}, '')) = '') AS missing, count_if(trim(coalesce({c}, '')) <> '') AS present,
  count(DISTINCT {c}) AS "distinct",
  (SELECT count(*) FROM (SELECT 1 FROM {t} GROUP BY {c} HAVING count(*) = 1)) AS "unique",
  min(length({c}))::INT AS min_length, max(length({c}))::INT AS max_length, round(avg(length({c})), 4) AS mean_length FROM {t}"""
            for t, cs in TEXTS.items()
            for c in cs
        ]
    )
)
def profile_text(spark, sf_dir):
    out = None
    for name, cols in TEXTS.items():
        t = table(spark, sf_dir, name, cols)
        one = P.counts(t).join(P.lengths(t), "column")
        out = one if out is None else out.unionByName(one)
    return rounded(out, "mean_length")


TOPS = {"lineitem": ["l_returnflag", "l_linestatus"], "orders": ["o_orderpriority"], "part": ["p_type", "p_brand"]}


@R.add(
    union_sql(
        [
            f"""SELECT '{c}' AS "column", rank::INT AS rank, value, n, round(n / total, 6) AS share, n_values, (total - sum(n) OVER ())::BIGINT AS other FROM (
  SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rank, sum(n) OVER () AS total, count(*) OVER () AS n_values FROM (
    SELECT coalesce({c}, '') AS value, count(*) AS n FROM {t} GROUP BY 1)) WHERE rank <= 7"""
            for t, cs in TOPS.items()
            for c in cs
        ]
    )
)
def top_values(spark, sf_dir):
    out = None
    for name, cols in TOPS.items():
        one = P.top_values(table(spark, sf_dir, name, cols))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "share", digits=6)


@R.add(
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rank, sum(n) OVER () AS total, count(*) OVER () AS vals FROM (
  SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1))
SELECT 'p_type' AS "column", least(rank, 7)::INT AS rank, CASE WHEN rank < 7 OR vals <= 7 THEN value END AS value, sum(n)::BIGINT AS n FROM r GROUP BY 2, 3"""
)
def folded_ranking(spark, sf_dir):
    return P.fold_ranking(P.top_values(table(spark, sf_dir, "part", ["p_type"])))


def histogram_sql(t: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", g.bin::INT AS bin, coalesce(h.n, 0) AS n, round(CASE WHEN g.bin = 0 THEN "min" ELSE f + g.bin * ((u - f) / 20) END, 4) AS low_bound,
  round(CASE WHEN g.bin = 19 THEN "max" ELSE f + (g.bin + 1) * ((u - f) / 20) END, 4) AS high_bound, coalesce(h.below, 0) AS below, coalesce(h.above, 0) AS above
FROM (WITH q AS (SELECT quantile_cont({c}::DOUBLE, 0.25) q1, quantile_cont({c}::DOUBLE, 0.75) q3, min({c})::DOUBLE "min", max({c})::DOUBLE "max" FROM {t}),
  e AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q),
  o AS (SELECT e.*, (SELECT count(*) FROM {t} WHERE {c} < low OR {c} > high) AS outs FROM e)
  SELECT *, CASE WHEN outs > 0 THEN greatest(low, "min") ELSE "min" END AS f, CASE WHEN outs > 0 THEN least(high, "max") ELSE "max" END AS u FROM o) s
CROSS JOIN range(20) g(bin)
LEFT JOIN LATERAL (SELECT count(*) AS n, count_if({c} < s.low) AS below, count_if({c} > s.high) AS above FROM {t}
  WHERE greatest(0, least(19, floor(({c} - s.f) / (s.u - s.f) * 20))) = g.bin) h ON true"""


@R.add(union_sql([histogram_sql("lineitem", "l_extendedprice"), histogram_sql("lineitem", "l_quantity")]))
def histogram(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem", ["l_extendedprice", "l_quantity"])
    return rounded(P.histogram(t), "low_bound", "high_bound")


@R.add("SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F' GROUP BY 1")
def value_counts_cross_filtered(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    filters = (
        FL.CompareFilter("o_totalprice", ">", 100000),
        FL.ValuesFilter("o_orderstatus", ("F",), exclude=True),
        FL.ValuesFilter("o_orderpriority", ("1-URGENT",)),
        FL.DistinctFilter("o_custkey"),
    )
    return P.value_counts(FL.apply_filters(t, FL.without_column(filters, "o_orderpriority")), "o_orderpriority")


@R.add(
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) q1, quantile_cont(o_totalprice, 0.75) q3 FROM orders)
SELECT o_orderkey, o_totalprice FROM orders, q WHERE o_totalprice < q1 - 0.2 * (q3 - q1) OR o_totalprice > q3 + 0.2 * (q3 - q1)"""
)
def outliers_filter(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    q = P.quartiles(t.df.select(F.col("o_totalprice").alias("value"), F.lit(0).alias("c")), ["c"]).first()  # one row
    spread = 0.2 * (q["q3"] - q["q1"])
    f = FL.OutsideFilter("o_totalprice", q["q1"] - spread, q["q3"] + spread)
    return FL.apply_filters(t, (f,)).df.select("o_orderkey", "o_totalprice")


@R.add(
    union_sql(
        [
            f"SELECT '{op}' AS op, count(*) AS n, min(p_partkey) AS first, max(p_partkey) AS last FROM part WHERE {cond}"
            for op, cond in {
                "contains": "contains(lower(p_name), 'ar')",
                "not_contains": "NOT contains(lower(p_name), 'ar')",
                "starts": "starts_with(lower(p_name), 'b')",
                "ends": "ends_with(lower(p_name), 'e')",
                "equals": "lower(p_name) = 'part 1'",
                "not_equals": "lower(p_name) <> 'part 1'",
            }.items()
        ]
    )
)
def filter_text_ops(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    out = None
    for op, text in {"contains": "AR", "not_contains": "Ar", "starts": "B", "ends": "E", "equals": "PART 1", "not_equals": "Part 1"}.items():
        kept = FL.apply_filters(t, (FL.TextFilter("p_name", op, text),)).df
        one = kept.agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last")).select(F.lit(op).alias("op"), "*")
        out = one if out is None else out.unionByName(one)
    return out


BLANKED = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END"
COMPARES = {
    "gt": ("v > 50", FL.CompareFilter("v", ">", 50)),
    "ge add": ("v >= 50 OR v IS NULL", FL.CompareFilter("v", ">=", 50, blanks="add")),
    "ne": ("v IS NULL OR v <> 50", FL.CompareFilter("v", "!=", 50)),
    "ne exclude": ("v <> 50", FL.CompareFilter("v", "!=", 50, blanks="exclude")),
    "between": ("v BETWEEN 10 AND 30", FL.CompareFilter("v", "between", 30, 10)),
    "lt": ("v < 5", FL.CompareFilter("v", "<", 5)),
    "le": ("v <= 5", FL.CompareFilter("v", "<=", 5)),
}


@R.add(
    union_sql(
        [
            f"SELECT '{k}' AS op, count(*) AS n, coalesce(sum(event_id), 0)::BIGINT AS ids FROM (SELECT event_id, {BLANKED} AS v FROM events) WHERE {cond}"
            for k, (cond, _) in COMPARES.items()
        ]
    )
)
def filter_compare_blank(spark, sf_dir):
    t = table(spark, sf_dir, "events", ["event_id", "v"], {"v": F.expr(BLANKED)})
    out = None
    for k, (_, f) in COMPARES.items():
        one = FL.apply_filters(t, (f,)).df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("event_id"), F.lit(0)).alias("ids"))
        one = one.select(F.lit(k).alias("op"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@R.add("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def filter_values_in(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    return FL.apply_filters(t, (FL.ValuesFilter("o_orderstatus", ("F", "P", "X")),)).df.select("o_orderkey", "o_orderstatus")


#: Cells of white space of several kinds, besides names.
SPACED = "CASE c_custkey % 6 WHEN 0 THEN '  ' WHEN 1 THEN '' WHEN 2 THEN {feff} WHEN 3 THEN {tab} ELSE c_name END"
SPACES = {
    "two": ("v = '  '", ("  ",), False),
    "mark and name": ("v IN ({feff}, 'Customer#000000004')", ("\ufeff", "Customer#000000004"), False),
    "all": ("v IN ('  ', '', {feff}, {tab})", ("  ", ""), False),
    "not two": ("v <> '  '", ("  ",), True),
    "not blank": ("v NOT IN ('  ', '', {feff}, {tab})", ("",), True),
}


@R.add(
    union_sql(
        [
            f"SELECT '{k}' AS op, count(*) AS n, coalesce(sum(c_custkey), 0)::BIGINT AS ids FROM (SELECT c_custkey, {SPACED} AS v FROM customer) WHERE {cond}".format(
                feff="chr(65279)", tab="chr(9)"
            )
            for k, (cond, _, _) in SPACES.items()
        ]
    )
)
def filter_values_of_spaces(spark, sf_dir):
    """Only '' stands for blank cells; other white space is itself."""
    t = table(spark, sf_dir, "customer", ["c_custkey", "v"], {"v": F.expr(SPACED.format(feff="'\ufeff'", tab="'\t'"))})
    out = None
    for k, (_, listed, exclude) in SPACES.items():
        one = FL.apply_filters(t, (FL.ValuesFilter("v", listed, exclude),)).df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("c_custkey"), F.lit(0)).alias("ids"))
        one = one.select(F.lit(k).alias("op"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@R.add("SELECT p_partkey FROM part WHERE p_partkey > 1500 OR p_partkey IS NULL")
def filter_values_not_in(spark, sf_dir):
    """A list of 1,500 values, which is joined."""
    t = table(spark, sf_dir, "part", ["p_partkey"], None)
    listed = tuple(str(k) for k in range(0, 1501))
    return FL.apply_filters(t, (FL.ValuesFilter("p_partkey", listed, exclude=True),)).df.select("p_partkey")


@R.add("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount >= 0.02 AND l_discount < 0.05 AND l_quantity BETWEEN 10 AND 20")
def filter_range_bin(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    f = (FL.RangeFilter("l_discount", 0.02, 0.05), FL.RangeFilter("l_quantity", 10, 20, last=True))
    return FL.apply_filters(t, f).df.select("l_orderkey", "l_linenumber", "l_discount")


_CROSS = "(SELECT * FROM orders WHERE o_totalprice >= 50000 AND o_orderpriority IN ('1-URGENT', '2-HIGH'))"


@R.add(union_sql([profile_sql(_CROSS, c, c == "o_orderdate") for c in ("o_totalprice", "o_custkey", "o_orderdate")]))
def cross_filter_profile(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    kept = FL.apply_filters(t, (FL.CompareFilter("o_totalprice", ">=", 50000), FL.ValuesFilter("o_orderpriority", ("1-URGENT", "2-HIGH"))))
    out = P.profile(kept, ["o_totalprice", "o_custkey", "o_orderdate"]).select(*PROFILE_COLUMNS)
    return rounded(out, "mean", "deviation", "q1", "median", "q3")


@R.add("SELECT event_id, user_id FROM events WHERE event_type <> 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def distinct_first(spark, sf_dir):
    t = table(spark, sf_dir, "events")
    f = (FL.DistinctFilter("user_id"), FL.TextFilter("event_type", "not_equals", "click"))
    return FL.apply_filters(t, f).df.select("event_id", "user_id")


@R.add("SELECT event_id, value FROM events WHERE value IS NOT NULL QUALIFY count(*) OVER (PARTITION BY value) = 1")
def unique_values(spark, sf_dir):
    return FL.apply_filters(table(spark, sf_dir, "events"), (FL.UniqueFilter("value"),)).df.select("event_id", "value")


@R.add(
    "SELECT row_number() OVER (ORDER BY v DESC NULLS LAST, c_custkey) - 1 AS place, c_custkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 > 0 THEN round(c_acctbal, -2) END AS v FROM customer)"
)
def sort_numeric(spark, sf_dir):
    """Every row's place by a measure with ties and gaps, the largest first."""
    t = table(spark, sf_dir, "customer", ["v", "c_custkey"], {"v": F.expr("CASE WHEN c_custkey % 9 > 0 THEN round(c_acctbal, -2) END")})
    return FL.sorted_positions(t, "v", descending=True, rows_per_stretch=500).select("place", "c_custkey")


@R.add("SELECT row_number() OVER (ORDER BY lower(v), v, p_partkey) - 1 AS place, p_partkey FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 > 0 THEN p_type ELSE '' END AS v FROM part)")
def sort_text(spark, sf_dir):
    """Every row's place by a text column, by the rules of Unicode."""
    t = table(spark, sf_dir, "part", ["v", "p_partkey"], {"v": F.expr("CASE WHEN p_partkey % 9 > 0 THEN p_type END")})
    return FL.sorted_positions(t, "v", rows_per_stretch=500).select("place", "p_partkey")


@R.add("SELECT coalesce(o_orderpriority, '') AS value, count(*) AS n FROM (SELECT upper(o_orderpriority) AS o_orderpriority, o_totalprice FROM orders) GROUP BY 1")
def all_value_counts(spark, sf_dir):
    """Counts over all cleaned rows, whatever the filters are."""
    from ..plans import recipe as C
    from ..plans.session import Session

    s = Session(table(spark, sf_dir, "orders", ["o_orderpriority", "o_totalprice"])).with_step(C.Case("o_orderpriority", "upper"))
    return s.toggle(FL.CompareFilter("o_totalprice", ">", 100000)).all_value_counts("o_orderpriority")


@R.add(
    union_sql(
        [
            f"SELECT '{k}' AS op, count(*) AS n, coalesce(sum(o_orderkey), 0)::BIGINT AS keys FROM orders WHERE {cond}"
            for k, cond in {"after": "o_orderdate > DATE '1995-03-15'", "between": "o_orderdate BETWEEN DATE '1994-01-01' AND DATE '1994-12-31'", "not": "o_orderdate <> DATE '1996-01-02'"}.items()
        ]
    )
)
def filter_typed_dates(spark, sf_dir):
    """Bounds as they are typed into a filter of a date column."""
    t = table(spark, sf_dir, "orders")
    filters = {
        "after": FL.CompareFilter("o_orderdate", ">", "1995-03-15"),
        "between": FL.CompareFilter("o_orderdate", "between", "1994-12-31", "1994/01/01"),
        "not": FL.CompareFilter("o_orderdate", "!=", "1996-01-02"),
    }
    out = None
    for k, f in filters.items():
        one = FL.apply_filters(t, (f,)).df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("o_orderkey"), F.lit(0)).alias("keys"))
        one = one.select(F.lit(k).alias("op"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@R.add(
    f"SELECT 'only' AS op, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (SELECT event_id, {BLANKED} AS v FROM events) WHERE v IS NULL UNION ALL SELECT 'hide', count(*), sum(event_id)::BIGINT FROM (SELECT event_id, {BLANKED} AS v FROM events) WHERE v IS NOT NULL"
)
def filter_empty(spark, sf_dir):
    t = table(spark, sf_dir, "events", ["event_id", "v"], {"v": F.expr(BLANKED)})
    parts = []
    for k, f in {"only": FL.only_empty("v"), "hide": FL.hide_empty("v")}.items():
        one = FL.apply_filters(t, (f,)).df.agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
        parts.append(one.select(F.lit(k).alias("op"), "*"))
    return parts[0].unionByName(parts[1])


@R.add(
    """WITH r AS (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS rank, count(*) OVER () AS vals FROM (
  SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1))
SELECT rank::INT AS rank, value AS label, n FROM r WHERE rank <= 20
UNION ALL SELECT 21, 'Other (' || (any_value(vals) - 20) || ' values)', sum(n)::BIGINT FROM r WHERE rank > 20 HAVING count(*) > 0"""
)
def ranked_values(spark, sf_dir):
    return P.ranked_values(table(spark, sf_dir, "part", ["p_name"]), "p_name")


@R.add(
    """SELECT count(*) AS "count", min(v) AS "min", max(v) AS "max", round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS deviation, round(median(v), 4) AS "median"
FROM (SELECT CASE WHEN event_id % 40 = 0 THEN -999.0 ELSE value END::DOUBLE AS v FROM events) WHERE v <> -999"""
)
def summary_without(spark, sf_dir):
    t = table(spark, sf_dir, "events", ["v"], {"v": F.expr("CASE WHEN event_id % 40 = 0 THEN -999.0D ELSE value END")})
    return rounded(P.summary_without(t, "v", (-999.0,)), "mean", "deviation", "median")


@R.add("SELECT length(trim(p_name)) AS length, count(*) AS n FROM part GROUP BY 1")
def length_distribution(spark, sf_dir):
    return P.length_distribution(table(spark, sf_dir, "part", ["p_name"]), "p_name")


QUERIES, ORACLE = R.queries, R.oracle
