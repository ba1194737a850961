"""Missing values in disguise, variants, patterns, placeholders, gaps, repeats, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import EXTRA_NULL_TOKENS, KNOWN_NULL_TOKENS
from ..operators import diagnose as D
from ..operators import quality
from .common import Registry, table, union_sql

R = Registry()
#: A derived column with defects set by the key, in words both engines know.
DIRTY = (
    "CASE WHEN c_custkey % 13 = 0 THEN 'N/A' WHEN c_custkey % 17 = 0 THEN ' unknown ' WHEN c_custkey % 19 = 0 THEN '  ' WHEN c_custkey % 23 = 0 THEN ''"
    " WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 7 = 0 THEN concat(c_mktsegment, ' ') ELSE c_mktsegment END"
)
_DIRTY = f"(SELECT {DIRTY} AS seg FROM customer)"


def _dirty(spark, sf_dir):
    return table(spark, sf_dir, "customer", ["seg"], {"seg": F.expr(DIRTY)})


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


@R.add(
    f"""SELECT 'seg' AS "column", count_if(seg = '') AS empty, count_if(seg <> '' AND trim(seg) = '') AS whitespace_only,
  count_if(lower(trim(seg)) IN ({_list(KNOWN_NULL_TOKENS)})) AS known_tokens,
  count_if(trim(seg) = '' OR lower(trim(seg)) IN ({_list(KNOWN_NULL_TOKENS)})) AS effective_missing FROM {_DIRTY}"""
)
def missing_cells(spark, sf_dir):
    return D.missing_cells(_dirty(spark, sf_dir))


@R.add(
    f"""SELECT 'seg' AS "column", trim(seg) AS token, lower(trim(seg)) IN ({_list(KNOWN_NULL_TOKENS)}) AS known, count(*) AS n FROM {_DIRTY}
WHERE lower(trim(seg)) IN ({_list(KNOWN_NULL_TOKENS + EXTRA_NULL_TOKENS)}) GROUP BY 2, 3"""
)
def null_tokens(spark, sf_dir):
    return D.null_tokens(_dirty(spark, sf_dir))


_VARIANTS = f"""(SELECT *, trim(seg) AS spelling FROM {_DIRTY}
  WHERE lower(trim(seg)) IN (SELECT lower(trim(seg)) FROM {_DIRTY} WHERE trim(seg) <> '' GROUP BY 1 HAVING count(DISTINCT trim(seg)) > 1))"""


@R.add(f"""SELECT 'seg' AS "column", lower(spelling) AS folded, spelling, count(*) AS n FROM {_VARIANTS} GROUP BY ALL""")
def case_variants(spark, sf_dir):
    return D.case_variants(_dirty(spark, sf_dir))


@R.add(f"""SELECT 'seg' AS "column", seg AS value, count(*) AS n FROM {_DIRTY} WHERE trim(seg) <> '' AND trim(seg) <> seg GROUP BY seg""")
def padded(spark, sf_dir):
    return D.padded(_dirty(spark, sf_dir))


PATTERNED = {"supplier": "s_name", "part": "p_brand", "customer": "c_name"}


@R.add(
    union_sql(
        [
            f"""SELECT '{c}' AS "column", pattern, count(DISTINCT {c}) AS "values", count(*) AS n FROM (
  SELECT {c}, regexp_replace(regexp_replace(regexp_replace({c}, '\\d', '9', 'g'), '\\p{{Lu}}+', 'A', 'g'), '\\p{{Ll}}+', 'a', 'g') AS pattern FROM {t}) GROUP BY pattern"""
            for t, c in PATTERNED.items()
        ]
    )
)
def value_patterns(spark, sf_dir):
    out = None
    for t, c in PATTERNED.items():
        one = D.patterns(table(spark, sf_dir, t, [c]))
        out = one if out is None else out.unionByName(one)
    return out


@R.add(
    """SELECT 'p_brand' AS "column", regexp_replace(regexp_replace(regexp_replace(p_brand, '\\d', '9', 'g'), '\\p{Lu}+', 'A', 'g'), '\\p{Ll}+', 'a', 'g') AS pattern,
  p_brand AS value, count(*) AS n FROM part GROUP BY p_brand"""
)
def pattern_values(spark, sf_dir):
    return D.pattern_values(table(spark, sf_dir, "part", ["p_brand"]))


SPIKED = "CASE WHEN event_id % 40 = 0 THEN -999.0 WHEN event_id % 67 = 0 THEN 123456.0 ELSE value END"
DOMINATED = "CASE WHEN event_id % 5 < 3 THEN 9999.0 ELSE value END"


_OUT = "(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))"


def placeholders_sql(cells: str) -> str:
    """Placeholders of the cells (col, v) of a query, by their rule."""
    known = ", ".join(map(str, D.SENTINELS))
    return f"""WITH c AS ({cells}),
q AS (SELECT col, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, count(v) AS total FROM c GROUP BY col),
f AS (SELECT col, v, count(*) AS n FROM c WHERE v IS NOT NULL GROUP BY col, v),
g AS (SELECT *, greatest(coalesce(lag(n) OVER w, 0), coalesce(lead(n) OVER w, 0)) AS near FROM f WINDOW w AS (PARTITION BY col ORDER BY v)),
j AS (SELECT *, {_OUT} AS o, v IN ({known}) AS k FROM g JOIN q USING (col)),
again AS (SELECT col, v, n FROM j WHERE NOT o AND k AND n >= 2),
r AS (SELECT col, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM c WHERE (col, v) NOT IN (SELECT (col, v) FROM again) GROUP BY col)
SELECT col AS "column", v AS value, n FROM j WHERE o AND k AND n >= 2
UNION ALL SELECT col, v, n FROM j WHERE o AND NOT k AND n >= greatest(3, ceil(total * 0.001)) AND n >= 3 * near
UNION ALL SELECT col, v, n FROM again JOIN r USING (col) WHERE {_OUT}"""


@R.add(placeholders_sql(f"SELECT 'spiked' AS col, ({SPIKED})::DOUBLE AS v FROM events UNION ALL SELECT 'dominated', ({DOMINATED})::DOUBLE FROM events"))
def placeholders_numeric(spark, sf_dir):
    t = table(spark, sf_dir, "events", ["spiked", "dominated"], {"spiked": F.expr(SPIKED), "dominated": F.expr(DOMINATED)})
    return D.numeric_placeholders(t)


@R.add(
    """WITH v AS (SELECT o_orderkey AS v FROM orders WHERE o_orderkey % 50 NOT IN (7, 8)),
d AS (SELECT v, lag(v) OVER (ORDER BY v) AS b FROM v), s AS (SELECT v - b AS step, count(*) AS n FROM d WHERE b IS NOT NULL GROUP BY 1 ORDER BY n DESC, step LIMIT 1)
SELECT b::DOUBLE AS after, v::DOUBLE AS before, (round((v - b) / step) - 1)::BIGINT AS missing, step::DOUBLE AS step, NULL::VARCHAR AS every FROM d, s
WHERE b IS NOT NULL AND v - b > 1.5 * step"""
)
def sequence_gaps(spark, sf_dir):
    t = table(spark, sf_dir, "orders", ["o_orderkey"])
    return D.sequence_gaps(t.with_df(t.df.where("o_orderkey % 50 not in (7, 8)")), "o_orderkey")


@R.add(
    """SELECT 'k' AS "column", count_if(n > 1) AS "values", sum(n) FILTER (n > 1)::BIGINT AS rows, count(*) AS "distinct" FROM (
  SELECT k, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 100 = 3 THEN o_orderkey - 1 ELSE o_orderkey END AS k FROM orders) GROUP BY k)"""
)
def near_key_repeats(spark, sf_dir):
    extra = {"k": F.expr("CASE WHEN o_orderkey % 100 = 3 THEN o_orderkey - 1 ELSE o_orderkey END")}
    return D.near_key_repeats(table(spark, sf_dir, "orders", ["k", "o_orderstatus"], extra))


@R.add(
    """SELECT 'k' AS "column", k::VARCHAR AS value, count(*) AS n, (SELECT count(DISTINCT k) FROM (SELECT CASE WHEN o_orderkey % 100 = 3 THEN o_orderkey - 1 ELSE o_orderkey END AS k FROM orders)) AS "distinct"
FROM (SELECT CASE WHEN o_orderkey % 100 = 3 THEN o_orderkey - 1 ELSE o_orderkey END AS k FROM orders) GROUP BY k HAVING count(*) > 1"""
)
def repeated_values(spark, sf_dir):
    extra = {"k": F.expr("CASE WHEN o_orderkey % 100 = 3 THEN o_orderkey - 1 ELSE o_orderkey END")}
    return D.repeated_values(table(spark, sf_dir, "orders", ["k", "o_orderstatus"], extra))


@R.add("SELECT min(doc_id) AS first_row, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return D.duplicate_groups(table(spark, sf_dir, "documents", ["text"]))


@R.add("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_row FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1")
def duplicate_rows(spark, sf_dir):
    from ..plans.filters import duplicate_rows as rows
    from ..plans.table import ROW

    found = rows(table(spark, sf_dir, "documents", ["text"]))
    return found.select(F.col(ROW).alias("doc_id"), F.col("_group").alias("first_row"))


@R.add(
    """SELECT 'lang' AS "column", min(length(lang))::INT AS min_length, max(length(lang))::INT AS max_length, round(avg(length(lang)), 4) AS mean_length FROM documents
UNION ALL SELECT 'text', min(length(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))))::INT, max(length(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))))::INT,
  round(avg(length(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))), 4) FROM documents WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''"""
)
def text_lengths(spark, sf_dir):
    from ..operators.profile import lengths
    from .common import rounded

    return rounded(lengths(table(spark, sf_dir, "documents", ["lang", "text"])), "mean_length")


def hints_sql(t: str, c: str) -> str:
    """How a numeric column would be read, and a smaller type that would do."""
    whole, size = f"bool_and({c} = floor({c}))", "CASE WHEN lo >= -128 AND hi <= 127 THEN 1 WHEN lo >= -32768 AND hi <= 32767 THEN 2 WHEN lo >= -2147483648 AND hi <= 2147483647 THEN 4 ELSE 8 END"
    return f"""SELECT '{c}' AS "column", CASE WHEN whole AND gaps = 0 THEN 'int64' ELSE 'float64' END AS dtype,
  CASE WHEN whole AND gaps > 0 THEN 'Int64' WHEN whole AND size < 8 AND n * (8 - size) >= 524288 THEN 'int' || size * 8
    WHEN NOT whole AND digits <= 7 AND n * 4 >= 524288 THEN 'float32' END AS hint
FROM (SELECT *, {size} AS size FROM (SELECT count(*) AS n, count(*) - count({c}) AS gaps, {whole} AS whole, min({c}) AS lo, max({c}) AS hi,
  max(length(ltrim(regexp_replace({c}::VARCHAR, '[^0-9]', '', 'g'), '0'))) AS digits FROM {t}))"""


@R.add(
    """SELECT 'l_returnflag' AS "column", 'object' AS dtype, CASE WHEN count(l_returnflag) >= 1000 AND count(DISTINCT l_returnflag) <= 100
  AND count(DISTINCT l_returnflag) <= 0.05 * count(l_returnflag) THEN 'category' END AS hint FROM lineitem
UNION ALL """
    + hints_sql("lineitem", "l_linenumber")
    + "\nUNION ALL "
    + hints_sql("lineitem", "l_discount")
)
def storage_hints(spark, sf_dir):
    return D.storage_hints(table(spark, sf_dir, "lineitem", ["l_returnflag", "l_linenumber", "l_discount"]))


_SPELT = (
    "CASE WHEN c_custkey % 29 = 0 THEN concat(c_mktsegment, 'S') WHEN c_custkey % 31 = 0 THEN lower(c_mktsegment)"
    " WHEN c_custkey % 37 = 0 THEN substring(c_mktsegment, 2) ELSE c_mktsegment END"
)


@R.add(
    f"""WITH RECURSIVE v AS (SELECT seg AS raw, count(*) AS n, trim(regexp_replace(regexp_replace(lower(strip_accents(seg)), '[^\\p{{L}}\\p{{N}} ]', '', 'g'), ' +', ' ', 'g')) AS key
  FROM (SELECT {_SPELT} AS seg FROM customer) WHERE length(trim(seg)) >= 2 AND NOT regexp_matches(seg, '\\d') GROUP BY seg),
o AS (SELECT *, row_number() OVER (ORDER BY n DESC, raw) AS i FROM v),
step AS (
  SELECT 0::BIGINT AS i, [struct_pack(key := '', raw := '', n := 0::BIGINT)][:0] AS groups, NULL::STRUCT(key VARCHAR, raw VARCHAR, n BIGINT) AS home, NULL::VARCHAR AS raw, NULL::BIGINT AS n
  UNION ALL
  SELECT i, CASE WHEN home IS NULL THEN list_append(groups, struct_pack(key := key, raw := raw, n := n)) ELSE groups END, home, raw, n FROM (
    SELECT o.i, o.raw, o.n, o.key, s.groups, list_filter(s.groups, lambda g: g.key = o.key OR (least(length(g.key), length(o.key)) >= 4 AND g.n >= 3 * o.n
      AND levenshtein(g.key, o.key) <= CASE WHEN length(o.key) >= 9 THEN 2 ELSE 1 END))[1] AS home FROM step s JOIN o ON o.i = s.i + 1)
)
SELECT 'seg' AS "column", home.raw AS canonical, home.n AS canonical_n, raw AS value, n FROM step WHERE home IS NOT NULL"""
)
def similar_spellings(spark, sf_dir):
    """Market segments with misspellings by key: one letter added, dropped, or small."""
    return quality.similar_spellings(table(spark, sf_dir, "customer", ["seg"], {"seg": F.expr(_SPELT)}))


_TOKENS = _list(KNOWN_NULL_TOKENS + EXTRA_NULL_TOKENS)


@R.add(
    f"""SELECT 'seg' AS "column", 'case variants' AS kind, count(DISTINCT spelling) AS n, 'merge' AS fix, 'seg: ' || count(DISTINCT spelling) || ' spellings differ in capitals only' AS text FROM {_VARIANTS}
UNION ALL SELECT 'seg', 'padded', count(*), 'trim', 'seg: ' || count(*) || ' cells with spaces at an end' FROM {_DIRTY} WHERE trim(seg) <> '' AND trim(seg) <> seg
UNION ALL SELECT 'seg', 'null token', sum(n)::BIGINT, 'empty', 'seg: nothing is written ' || string_agg(t || ' (' || n || ')', ', ' ORDER BY n DESC, t)
FROM (SELECT trim(seg) AS t, count(*) AS n FROM {_DIRTY} WHERE lower(trim(seg)) IN ({_TOKENS}) GROUP BY 1)"""
)
def findings(spark, sf_dir):
    return D.findings(_dirty(spark, sf_dir))


@R.add(
    f"""SELECT 'seg' AS "column", 'case variants' AS kind, 'merge' AS fix, spelling AS what, seg AS value, count(*) AS n FROM {_VARIANTS} GROUP BY ALL
UNION ALL SELECT 'seg', 'padded', 'trim', NULL, seg, count(*) FROM {_DIRTY} WHERE trim(seg) <> '' AND trim(seg) <> seg GROUP BY seg
UNION ALL SELECT 'seg', 'null token', 'empty', trim(seg), seg, count(*) FROM {_DIRTY} WHERE lower(trim(seg)) IN ({_TOKENS}) GROUP BY seg"""
)
def finding_values(spark, sf_dir):
    return D.finding_values(_dirty(spark, sf_dir))


#: A measure with a sentinel, filler dates as text, and notes with damaged accents.
_ODD = {
    "m": "CASE WHEN c_custkey % 40 = 0 THEN -999 ELSE c_custkey % 100 END",
    "d": "CASE WHEN c_custkey % 30 = 0 THEN ' 1900-01-01' WHEN c_custkey % 31 = 0 THEN '1970-01-01' ELSE concat('20', lpad(cast(c_custkey % 90 + 10 as string), 2, '0'), '-03-04') END",
    "note": "CASE WHEN c_custkey % 50 = 0 THEN 'TrÃ¨s bon' WHEN c_custkey % 50 = 1 THEN 'CafÃ©' ELSE 'bon' END",
}


def _odd(spark, sf_dir):
    from ..functions.infer import infer

    return infer(table(spark, sf_dir, "customer", list(_ODD), {k: F.expr(e) for k, e in _ODD.items()}))


@R.add(
    f"""WITH t AS (SELECT {', '.join(f'{e} AS {k}' for k, e in _ODD.items())} FROM customer)
SELECT 'm' AS "column", 'placeholder' AS kind, n, 'empty' AS fix, 'm: ' || value::BIGINT || ' in ' || n || ' cells stands for nothing' AS text
FROM ({placeholders_sql("SELECT 'm' AS col, m::DOUBLE AS v FROM t")})
UNION ALL SELECT 'd', 'placeholder', count(*), 'empty', 'd: ' || trim(d) || ' in ' || count(*) || ' cells stands for nothing' FROM t WHERE trim(d) IN ({_list(D.FILLER_DATES)}) GROUP BY trim(d) HAVING count(*) >= 2
UNION ALL SELECT 'd', 'padded', count(*), 'trim', 'd: ' || count(*) || ' cells with spaces at an end' FROM t WHERE trim(d) <> d
UNION ALL SELECT 'note', 'damaged encoding', count(*), 'fix encoding', 'note: ' || count(*) || ' cells like ' ||
  (SELECT CASE note WHEN 'CafÃ©' THEN 'CafÃ© for Café' ELSE 'TrÃ¨s bon for Très bon' END FROM t WHERE contains(note, 'Ã') GROUP BY note ORDER BY count(*) DESC, note DESC LIMIT 1) FROM t WHERE contains(note, 'Ã')"""
)
def findings_of_kinds(spark, sf_dir):
    return D.findings(_odd(spark, sf_dir))


@R.add(
    f"""SELECT 'd' AS "column", trim(d) AS token, count(*) AS n FROM (SELECT {_ODD['d']} AS d FROM customer) WHERE trim(d) IN ({_list(D.FILLER_DATES)}) GROUP BY 2 HAVING count(*) >= 2"""
)
def placeholders_temporal(spark, sf_dir):
    return D.temporal_placeholders(_odd(spark, sf_dir))


#: Codes with leading zeros, prices with spellings of a missing value, notes with damaged accents.
_CODE = "lpad(cast(c_custkey as string), 5, '0')"
_PRICE = "CASE WHEN c_custkey % 6 = 0 THEN 'NULL' WHEN c_custkey % 10 = 1 THEN '-' ELSE cast(c_custkey as string) END"
_NOTE = "CASE WHEN c_custkey % 50 = 0 THEN 'TrÃ¨s bon' WHEN c_custkey % 50 = 1 THEN 'Ça va' ELSE 'bon' END"


def _written(spark, sf_dir):
    extra = {"code": F.expr(_CODE), "price": F.expr(_PRICE), "note": F.expr(_NOTE)}
    return table(spark, sf_dir, "customer", ["code", "price", "note"], extra)


@R.add(
    union_sql(
        [
            f"""SELECT '{c}' AS "column" FROM (SELECT {e} AS v FROM customer) HAVING bool_and(regexp_full_match(v, '\\d+')) AND bool_or(regexp_matches(v, '^0\\d'))"""
            for c, e in {"code": _CODE, "price": _PRICE, "note": _NOTE}.items()
        ]
    )
)
def leading_zeros(spark, sf_dir):
    return D.leading_zeros(_written(spark, sf_dir))


@R.add(
    union_sql(
        [
            f"""SELECT '{c}' AS "column", string_agg(DISTINCT v, ', ' ORDER BY v) FILTER (token) AS tokens
FROM (SELECT *, lower(trim(v)) IN ({_TOKENS}) AS token FROM (SELECT {e} AS v FROM customer) WHERE trim(v) <> '')
HAVING bool_or(token) AND bool_or(NOT token) AND bool_and(token OR regexp_full_match(v, '[+-]?\\d+'))"""
            for c, e in {"code": _CODE, "price": _PRICE, "note": _NOTE}.items()
        ]
    )
)
def would_be_numeric(spark, sf_dir):
    return D.would_be_numeric(_written(spark, sf_dir)).withColumn("tokens", F.array_join("tokens", ", "))


# A letter from U+00C0 on, its two bytes read one by one: Ã and the letter 64 below.
@R.add(
    f"""WITH c AS (SELECT {_NOTE} AS raw FROM customer), p AS (SELECT raw, string_split(raw, 'Ã') AS p FROM c)
SELECT 'note' AS "column", raw, p[1] || array_to_string(list_transform(p[2:], lambda x: chr(unicode(x[1:1]) + 64) || x[2:]), '') AS fixed, count(*) AS n
FROM p WHERE len(p) > 1 GROUP BY ALL"""
)
def garbled(spark, sf_dir):
    return D.garbled(_written(spark, sf_dir))


@R.add(
    """SELECT 'number' AS kind, value, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 11 = 0 THEN 'x' || (c_custkey % 3) END AS value FROM customer)
WHERE value IS NOT NULL GROUP BY value"""
)
def offenders(spark, sf_dir):
    e = "CASE WHEN c_custkey % 11 = 0 THEN concat('x', c_custkey % 3) ELSE cast(c_custkey as string) END"
    return D.offenders(table(spark, sf_dir, "customer", ["v"], {"v": F.expr(e)}), "v")


@R.add(
    f"""SELECT 'c_mktsegment' AS "column", 'text' AS kind, count(*) FILTER (trim(c_mktsegment) <> '' AND lower(trim(c_mktsegment)) NOT IN ({_list(KNOWN_NULL_TOKENS)})) AS non_null, 'object' AS dtype, false AS truncated FROM customer
UNION ALL SELECT 'c_acctbal', 'numeric', count(c_acctbal), CASE WHEN bool_and(c_acctbal = floor(c_acctbal)) AND count(*) = count(c_acctbal) THEN 'int64' ELSE 'float64' END, false FROM customer"""
)
def dataset_info(spark, sf_dir):
    return D.dataset_info(table(spark, sf_dir, "customer", ["c_mktsegment", "c_acctbal"]))


@R.add("SELECT p_partkey, concat_ws(',', p_partkey, '\"' || p_name || ', \"\"' || p_brand || '\"\"\"', '\"' || p_type || ' \"') AS line FROM part")
def csv_lines(spark, sf_dir):
    from ..plans.table import ROW
    from ..sources.csv import csv_lines as lines

    extra = {"p_name": F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')), "p_type": F.concat("p_type", F.lit(" "))}
    t = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_type"], extra)
    return lines(t, ",", header=False).select(F.col(ROW).alias("p_partkey"), "line")


@R.add("SELECT c_custkey, unnest(range(0, 3))::INT AS col, unnest([c_name, '\"' || c_mktsegment || ',\"', c_nationkey::VARCHAR]) AS field FROM customer")
def raw_segments(spark, sf_dir):
    from ..sources.csv import raw_segments as segments
    from .common import read

    df = read(spark, sf_dir, "customer")
    line = F.concat_ws(",", "c_name", F.concat(F.lit('"'), "c_mktsegment", F.lit(',"')), "c_nationkey")
    out = df.select("c_custkey", F.explode(segments(line, ",")).alias("s")).where("s.column >= 0")
    return out.select("c_custkey", F.col("s.column").alias("col"), F.col("s.text").alias("field"))


#: Market segments with spaces of several kinds, what cannot be seen, other letters.
_NB, _ZW = chr(0xA0), chr(0x200B)
_VARIANT = (
    "CASE c_custkey % 6 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN c_mktsegment || '  ' "
    f"WHEN 2 THEN substr(c_mktsegment, 1, 3) || '{_NB}' || substr(c_mktsegment, 4) WHEN 3 THEN substr(c_mktsegment, 1, 2) || '{_ZW}' || substr(c_mktsegment, 3) "
    "WHEN 4 THEN ' ' || replace(c_mktsegment, 'E', 'É') ELSE c_mktsegment || 'x' END"
)


@R.add(
    f"""WITH v AS (SELECT c_custkey, c_mktsegment AS t, {_VARIANT} AS v FROM customer),
f AS (SELECT *, replace(replace(v, '{_ZW}', ''), '{_NB}', ' ') AS flat FROM v),
d AS (SELECT *, trim(regexp_replace(flat, ' {{2,}}', ' ', 'g')) AS tidy, replace(replace(v, '{_NB}', '⍽'), '{_ZW}', '‹200B›') AS s FROM f)
SELECT c_custkey, array_to_string(list_filter([
    CASE WHEN contains(v, '{_ZW}') THEN 'hidden character' END, CASE WHEN contains(v, '{_NB}') THEN 'non-breaking space' END, CASE WHEN flat <> tidy THEN 'spaces' END,
    CASE WHEN tidy = t THEN NULL WHEN lower(tidy) = lower(t) THEN 'capital letters' WHEN lower(strip_accents(tidy)) = lower(strip_accents(t)) THEN 'accents' ELSE 'spelling' END
  ], lambda x: x IS NOT NULL), ', ') AS kinds,
  repeat('␣', length(s) - length(ltrim(s))) || trim(s) || repeat('␣', length(s) - length(rtrim(s))) AS shown
FROM d"""
)
def spelling_differences(spark, sf_dir):
    """How variants differ from a spelling, and how they are shown."""
    from ..functions import text as X
    from .common import read

    df = read(spark, sf_dir, "customer").withColumn("v", F.expr(_VARIANT))
    return df.select("c_custkey", F.array_join(X.difference(F.col("c_mktsegment"), F.col("v")), ", ").alias("kinds"), X.visible_text(F.col("v")).alias("shown"))


@R.add("SELECT c_custkey AS _row, c_name || chr(9) || '\"a \"\"' || c_mktsegment || '\"\"' || chr(9) || '\"' AS line FROM customer WHERE c_custkey IN (1, 5, 7, 100)")
def selected_rows(spark, sf_dir):
    """Chosen rows as tab-separated text."""
    from ..sources.csv import selected_rows_text

    seg = F.concat(F.lit('a "'), "c_mktsegment", F.lit('"\t'))
    t = table(spark, sf_dir, "customer", ["c_name", "c_mktsegment"], {"c_mktsegment": seg})
    return selected_rows_text(t, [1, 5, 7, 100, 10**9])


@R.add(
    """SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row, c_custkey::VARCHAR AS id, c_name || ';' AS name, 'é ' || c_mktsegment || chr(10) || '"' AS segment,
  'numeric' AS id_kind, 'text' AS name_kind FROM customer"""
)
def csv_file_round_trip(spark, sf_dir):
    """A file of quoted cells over several lines: written in parts, its encoding, delimiter, records, headers and kinds found anew."""
    import uuid

    from ..plans.durable import shared_folder
    from ..sources import csv as S

    extra = {"c_name": F.concat("c_name", F.lit(";")), "c_mktsegment": F.concat(F.lit("é "), "c_mktsegment", F.lit('\n"'))}
    path = f"{shared_folder(spark)}/customer-{uuid.uuid4().hex}.csv"
    S.write_csv(table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment"], extra), path, ";")
    t = S.read_csv(spark, path)
    kinds = [F.lit(t[c].kind).alias(n) for c, n in (("c0", "id_kind"), ("c1", "name_kind"))]
    return t.df.select(F.col("_row").alias("row"), F.col("c0").alias("id"), F.col("c1").alias("name"), F.col("c2").alias("segment"), *kinds)


QUERIES, ORACLE = R.queries, R.oracle
