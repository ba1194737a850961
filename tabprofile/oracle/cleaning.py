"""Cleaning steps and their effects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..plans import recipe as C
from .common import Registry, table, union_sql

R = Registry()
GAPPY = "CASE WHEN event_id % 5 IN (1, 2) THEN NULL ELSE value END"


@R.add(f"SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), v) AS v FROM (SELECT event_id, {GAPPY} AS v FROM events)")
def fill_down(spark, sf_dir):
    t = table(spark, sf_dir, "events", ["event_id", "v"], {"v": F.expr(GAPPY)})
    return C.apply_steps(t, (C.FillDown("v"),)).output()


@R.add(
    f"SELECT event_id, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM (SELECT event_id, {GAPPY} AS v FROM events)"
)
def fill_up(spark, sf_dir):
    t = table(spark, sf_dir, "events", ["event_id", "v"], {"v": F.expr(GAPPY)})
    return C.apply_steps(t, (C.FillUp("v"),)).output()


@R.add(r"""SELECT p_partkey, replace(p_name, 'a', '4') AS p_name, regexp_replace(p_type, '([A-Z])([a-z]+)', '\2\1', 'g') AS p_type, p_brand FROM part""")
def replace_values(spark, sf_dir):
    t = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_type", "p_brand"])
    steps = (
        C.Replace("p_name", "a", "4"),
        C.Replace("p_type", "([A-Z])([a-z]+)", "$2$1", "regex"),
        C.Replace("p_brand", "(", "x", "regex"),  # an invalid pattern changes nothing
    )
    return C.apply_steps(t, steps).output()


@R.add(
    """SELECT p_partkey, trim(p_name, chr(32) || chr(9)) AS p_name,
  array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS p_type, upper(p_brand) AS p_brand
FROM (SELECT p_partkey, '  ' || p_name || chr(9) AS p_name, p_type, p_brand FROM part)"""
)
def trim_case_title(spark, sf_dir):
    t = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_type", "p_brand"], {"p_name": F.concat(F.lit("  "), "p_name", F.lit("\t"))})
    return C.apply_steps(t, (C.Trim("p_name"), C.Case("p_type", "title"), C.Case("p_brand", "upper"))).output()


@R.add("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1")
def dedupe_on_columns(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    left = C.apply_steps(t, (C.RemoveDuplicates(("o_custkey", "o_orderstatus")),)).rows()
    return left.df.select("o_orderkey", "o_custkey", "o_orderstatus")


@R.add("SELECT text, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY text, lang, source ORDER BY doc_id) = 1")
def dedupe_rows(spark, sf_dir):
    """Whole rows, the key left out of the columns."""
    t = table(spark, sf_dir, "documents", ["text", "lang", "source"])
    return C.apply_steps(t, (C.RemoveDuplicates(),)).output()


@R.add("SELECT event_id, round(value, 1) + 0 AS value FROM events WHERE value IS NOT NULL AND event_id % 11 <> 0")
def drop_and_round(spark, sf_dir):
    t = table(spark, sf_dir, "events", ["event_id", "value"], {"value": F.expr("CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END")})
    return C.apply_steps(t, (C.DropEmpty("value"), C.Round("value", 1))).output().withColumn("value", F.round(F.col("value"), 1) + 0.0)


@R.add(
    """WITH a AS (SELECT o_orderkey AS r, ' ' || o_orderstatus AS s, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE o_orderpriority END AS p FROM orders),
b AS (SELECT r, trim(s) AS s, p FROM a), c AS (SELECT r, s, CASE WHEN p = '5-LOW' THEN '' ELSE p END AS p FROM b),
d AS (SELECT * FROM c WHERE p <> ''), e AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY s, p ORDER BY r) = 1)
SELECT 0 AS step, (SELECT count(*) FROM a WHERE trim(s) <> s) AS effect
UNION ALL SELECT 1, (SELECT count(*) FROM b WHERE p = '5-LOW')
UNION ALL SELECT 2, (SELECT count(*) FROM c WHERE p = '')
UNION ALL SELECT 3, (SELECT count(*) FROM d) - (SELECT count(*) FROM e)
UNION ALL SELECT 4, (SELECT count(*) FROM e WHERE lower(p) <> p)
UNION ALL SELECT 5, (SELECT count(*) FROM e WHERE s = 'F')"""
)
def recipe_effects(spark, sf_dir):
    extra = {
        "s": F.concat(F.lit(" "), "o_orderstatus"),
        "p": F.when(F.col("o_orderkey") % 9 == 0, F.lit("")).otherwise(F.col("o_orderpriority")),
    }
    t = table(spark, sf_dir, "orders", ["s", "p"], extra)
    steps = (
        C.Trim("s"),
        C.Empty("p", ("5-LOW",)),
        C.DropEmpty("p"),
        C.RemoveDuplicates(),
        C.Case("p", "lower"),
        C.Merge("s", ("F",), "finished"),
    )
    return C.apply_steps(t, steps).effects()


_NOTE = "CASE c_custkey % 6 WHEN 0 THEN 'CafÃ©' WHEN 1 THEN 'Ça va' WHEN 2 THEN 'TrÃ¨s bon' WHEN 3 THEN 'Ãœber' WHEN 4 THEN 'â‚¬ 12' ELSE c_mktsegment END"


@R.add(
    f"""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Café' WHEN 2 THEN 'Très bon' WHEN 3 THEN 'Über' WHEN 4 THEN '€ 12' ELSE note END AS note
FROM (SELECT c_custkey, {_NOTE} AS note FROM customer)"""
)
def mojibake_fix(spark, sf_dir):
    """A column of notes with damaged accents, mended by a step."""
    t = table(spark, sf_dir, "customer", ["c_custkey", "note"], {"note": F.expr(_NOTE)})
    return C.apply_steps(t, (C.FixEncoding("note"),)).output()


@R.add(
    """SELECT p_partkey, replace(p_name, 'a', 'a') AS p_name, CASE WHEN p_brand = 'Brand#12' THEN 'the twelfth' ELSE p_brand END AS p_brand,
  coalesce(TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_partkey::VARCHAR END AS INT)::VARCHAR, '') AS n FROM part WHERE p_partkey % 11 > 0"""
)
def clean_merge_type(spark, sf_dir):
    """Hidden characters dropped, a whole cell replaced, unreadable numbers emptied (a second type replaces the first), blank rows dropped."""
    full = F.col("p_partkey") % 11 > 0
    extra = {
        "p_name": F.when(full, F.concat(F.lit("\u200b"), "p_name", F.lit("\x07"))),
        "p_brand": F.when(full, F.col("p_brand")),
        "n": F.when(full, F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.col("p_partkey").cast("string"))),
    }
    t = table(spark, sf_dir, "part", ["p_name", "p_brand", "n"], extra)
    steps: tuple = ()
    for step in (
        C.Clean("p_name"),
        C.Replace("p_brand", "Brand#12", "the twelfth", "whole"),
        C.SetType("n", "date"),
        C.SetType("n", "numeric"),
        C.RemoveBlankRows(),
    ):
        steps = C.add_step(steps, step)
    left = C.apply_steps(t, steps).rows()
    return left.df.select(F.col("_row").alias("p_partkey"), "p_name", "p_brand", "n")


@R.add(
    """SELECT 'trim' AS step, 0::BIGINT AS effect UNION ALL SELECT 'upper', count_if(c_mktsegment <> upper(c_mktsegment)) FROM customer
UNION ALL SELECT 'merge', count_if(c_mktsegment IN ('BUILDING', 'MACHINERY')) FROM customer
UNION ALL SELECT 'duplicates', count(*) - count(DISTINCT c_mktsegment) FROM customer"""
)
def preview_effects(spark, sf_dir):
    """What single steps would do, before one is taken."""
    t = table(spark, sf_dir, "customer", ["c_mktsegment"])
    steps = {
        "trim": C.Trim("c_mktsegment"),
        "upper": C.Case("c_mktsegment", "upper"),
        "merge": C.Merge("c_mktsegment", ("BUILDING", "MACHINERY"), "things"),
        "duplicates": C.RemoveDuplicates(),
    }
    parts = [C.preview_effect(t, s).select(F.lit(k).alias("step"), "effect") for k, s in steps.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@R.add("SELECT doc_id, md5(coalesce(text, '')) AS text_md5, coalesce(lang, '') AS lang FROM documents")
def csv_round_trip(spark, sf_dir):
    """Documents to delimited lines and back by the record reader, texts of many lines included."""
    from ..sources import csv as S

    t = table(spark, sf_dir, "documents", ["text", "lang"])
    line = S.csv_lines(t, ",", header=False).select("_row", F.posexplode(F.split("line", "\n")).alias("p", "text"))
    lines = line.select((F.col("_row") * (1 << 24) + F.col("p")).alias(S.LINE), "text")  # numbers need not be gapless
    back = S.read_records(lines, ",")
    cell = lambda k: F.coalesce(F.get("fields", F.lit(k)), F.lit(""))
    return back.select(F.floor(F.col(S.LINE) / (1 << 24)).alias("doc_id"), F.md5(cell(0)).alias("text_md5"), cell(1).alias("lang"))


@R.add("SELECT c_custkey AS id, c_name AS customer, CASE WHEN c_custkey % 4 = 0 THEN 'none' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey NOT IN (1, 2, 3)")
def rename_remove_fill(spark, sf_dir):
    t = table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], {"c_mktsegment": F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))})
    steps = (
        C.Rename("c_custkey", "id"),
        C.Rename("c_name", "customer"),
        C.Remove("c_nationkey"),
        C.FillValue("c_mktsegment", "none"),
        C.DropRows((1, 2, 3)),
    )
    return C.apply_steps(t, steps).output()


QUERIES, ORACLE = R.queries, R.oracle
