"""Correlations, what a category explains, time, row order, level shifts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import relate
from .common import Registry, rounded, table, union_sql

R = Registry()
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [
    f"SELECT '{a}' AS left_column, '{b}' AS right_column, round(corr({a}, {b}), 4) + 0 AS r FROM lineitem" for a, b in combinations(NUMBERS, 2)
]


@R.add(
    f"""WITH p AS ({union_sql(_PAIRS)}) SELECT * FROM p UNION ALL SELECT right_column, left_column, r FROM p
UNION ALL SELECT unnest([{', '.join(f"'{c}'" for c in NUMBERS)}]), unnest([{', '.join(f"'{c}'" for c in NUMBERS)}]), 1.0"""
)
def correlation_matrix(spark, sf_dir):
    return rounded(relate.correlation_matrix(table(spark, sf_dir, "lineitem", NUMBERS)), "r")


_NET = "l_extendedprice * (1 - l_discount)"
_NET_PAIRS = [
    f"SELECT '{a}' AS left_column, '{b}' AS right_column, round(corr({a}, {b}), 4) + 0 AS r FROM (SELECT *, {_NET} AS net FROM lineitem)"
    for a, b in combinations([*NUMBERS, "net"], 2)
]


@R.add(f"WITH p AS ({union_sql(_NET_PAIRS)}) SELECT * FROM p WHERE abs(r) >= 0.1 ORDER BY abs(r) DESC, left_column, right_column LIMIT 6")
def top_correlations(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem", [*NUMBERS, "net"], {"net": F.expr(_NET)})
    return rounded(relate.top_correlations(t, least=0.1), "r")


def _eta(c: str) -> str:
    return f"""SELECT '{c}' AS category_column, {c} AS category, count(*) AS n, round(avg(o_totalprice), 4) AS mean,
  round((SELECT sum(k * pow(m - g, 2)) / s FROM (SELECT count(*) AS k, avg(o_totalprice) AS m FROM orders GROUP BY {c}), (SELECT avg(o_totalprice) AS g, var_pop(o_totalprice) * count(*) AS s FROM orders) GROUP BY s), 6) AS explained,
  (SELECT count(DISTINCT {c}) FROM orders) AS groups FROM orders GROUP BY {c}"""


@R.add(union_sql([_eta("o_orderpriority"), _eta("o_orderstatus")]))
def category_eta2(spark, sf_dir):
    means = relate.group_means(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority", "o_orderstatus"])
    return rounded(rounded(means, "mean"), "explained", digits=6)


@R.add(
    f"SELECT category_column, explained, groups FROM (SELECT DISTINCT category_column, explained, groups FROM ({union_sql([_eta('o_orderpriority'), _eta('o_orderstatus')])}))"
)
def category_candidates(spark, sf_dir):
    return rounded(relate.category_candidates(table(spark, sf_dir, "orders"), "o_totalprice"), "explained", digits=6)


@R.add(
    """SELECT part, slot::INT AS slot, n FROM (
SELECT 'year' AS part, year(o_orderdate) AS slot, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'month', month(o_orderdate), count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'weekday', isodow(o_orderdate) - 1, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'hour', hour(o_orderdate), count(*) FROM orders GROUP BY 2)"""
)
def time_breakdown(spark, sf_dir):
    return relate.time_breakdown(table(spark, sf_dir, "orders"), "o_orderdate")


_SERIES = "CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END"


@R.add(
    f"""WITH e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, {_SERIES} AS v FROM events),
f AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, count(*) AS n FROM e),
g AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM f)
SELECT floor(pos * least(n, 160) / n)::INT AS bucket, round(avg(v) FILTER (v BETWEEN low AND high), 4) AS mean, count_if(coalesce(v > high, false)) AS above,
  count_if(coalesce(v < low, false)) AS below, count_if(v IS NULL) AS empty, count(*) AS n FROM e, g GROUP BY 1"""
)
def row_order_buckets(spark, sf_dir):
    t = table(spark, sf_dir, "events", ["v"], {"v": F.expr(_SERIES)})
    return rounded(relate.row_order_buckets(t, "v"), "mean")


@R.add(
    f"""WITH e AS (SELECT row_number() OVER (ORDER BY user_id DESC NULLS LAST, event_id) - 1 AS pos, {_SERIES} AS v FROM events),
f AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, count(*) AS n FROM e),
g AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM f)
SELECT floor(pos * least(n, 160) / n)::INT AS bucket, round(avg(v) FILTER (v BETWEEN low AND high), 4) AS mean, count_if(coalesce(v > high, false)) AS above,
  count_if(coalesce(v < low, false)) AS below, count_if(v IS NULL) AS empty, count(*) AS n FROM e, g GROUP BY 1"""
)
def row_order_buckets_sorted(spark, sf_dir):
    """Along the view as it is sorted by user, the latest user first."""
    t = table(spark, sf_dir, "events", ["v", "user_id"], {"v": F.expr(_SERIES)})
    return rounded(relate.row_order_buckets(t, "v", sort=("user_id", True)), "mean")


@R.add(
    """WITH s AS (SELECT row_number() OVER (ORDER BY user_id, event_id) AS k, value % 20 + CASE WHEN user_id > (SELECT quantile_disc(user_id, 0.4) FROM events) THEN 60 ELSE 0 END AS v FROM events WHERE value IS NOT NULL),
q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM s),
c AS (SELECT k, greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), v)) - (SELECT avg(v) FROM s) AS v FROM s, q),
p AS (SELECT k, sum(v) OVER w AS a, sum(v * v) OVER w AS b, sum(v) OVER () AS ta, sum(v * v) OVER () AS tb, count(*) OVER () AS n FROM c WINDOW w AS (ORDER BY k)),
x AS (SELECT k, abs(a / k - (ta - a) / (n - k)) / sqrt((tb - b - pow(ta - a, 2) / (n - k) + b - pow(a, 2) / k) / (n - 2)) AS effect, n FROM p
  WHERE k >= ceil(n * 0.1) AND k <= floor(n * 0.9) AND (k - ceil(n * 0.1)::BIGINT) % greatest(1, n // 200) = 0)
SELECT k AS position, round(effect * sqrt(k * (n - k)::DOUBLE / n), 4) AS score FROM x WHERE effect >= 1 ORDER BY score DESC, k LIMIT 1"""
)
def level_shift_sorted(spark, sf_dir):
    """A shift that shows only along the view sorted by user."""
    from .common import read

    cut = read(spark, sf_dir, "events").selectExpr("percentile_disc(0.4) WITHIN GROUP (ORDER BY user_id)").first()[0]
    t = table(spark, sf_dir, "events", ["v", "user_id"], {"v": F.expr(f"value % 20 + CASE WHEN user_id > {int(cut)} THEN 60 ELSE 0 END")})
    return rounded(relate.level_shift(t, "v", sort=("user_id", False)), "score")


#: Up by 60 after three tenths of the events.
_SHIFTED = "value % 20 + CASE WHEN event_id > {cut} THEN 60 ELSE 0 END"


@R.add(
    """WITH s AS (SELECT row_number() OVER (ORDER BY event_id) AS k, value % 20 + CASE WHEN event_id > (SELECT floor(max(event_id) * 0.3) FROM events) THEN 60 ELSE 0 END AS v FROM events WHERE value IS NOT NULL),
q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM s),
c AS (SELECT k, greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), v)) - (SELECT avg(v) FROM s) AS v FROM s, q),
p AS (SELECT k, sum(v) OVER w AS a, sum(v * v) OVER w AS b, sum(v) OVER () AS ta, sum(v * v) OVER () AS tb, count(*) OVER () AS n FROM c WINDOW w AS (ORDER BY k)),
x AS (SELECT k, abs(a / k - (ta - a) / (n - k)) / sqrt((tb - b - pow(ta - a, 2) / (n - k) + b - pow(a, 2) / k) / (n - 2)) AS effect, n FROM p
  WHERE k >= ceil(n * 0.1) AND k <= floor(n * 0.9) AND (k - ceil(n * 0.1)::BIGINT) % greatest(1, n // 200) = 0)
SELECT k AS position, round(effect * sqrt(k * (n - k)::DOUBLE / n), 4) AS score FROM x WHERE effect >= 1 ORDER BY score DESC, k LIMIT 1"""
)
def level_shift(spark, sf_dir):
    from .common import read

    last = read(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    t = table(spark, sf_dir, "events", ["v"], {"v": F.expr(_SHIFTED.format(cut=int(last * 0.3)))})
    return rounded(relate.level_shift(t, "v"), "score")


QUERIES, ORACLE = R.queries, R.oracle
