"""What is odd about columns and rows: missing values in disguise, variants, patterns, placeholders, gaps, repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.infer import readability
from ..plans.filters import duplicate_groups as groups_of_rows
from ..plans.table import Table
from .freq import frequencies, held, local, only
from .order import neighbours, ranged
from .profile import quartiles

# Numbers and dates that exports write for "nothing".
SENTINELS = (-99999, -9999, -999, -99, 99, 999, 9999, 99999, 9999999)
FILLER_DATES = ("1900-01-01", "1970-01-01", "9999-12-31", "0000-00-00", "01/01/1900", "1/1/1900", "31/12/9999", "1900-01-00")
MIN_SPIKE, SPIKE_SHARE, SPIKE_FACTOR = 3, 0.001, 3
MAX_PATTERNS, ALMOST = 12, 0.8
UNITS = ((1000, "second"), (60_000, "minute"), (3_600_000, "hour"), (86_400_000, "day"), (604_800_000, "week"))


def missing_cells(table: Table, names: list[str] | None = None) -> DataFrame:
    """(column, empty, whitespace_only, known_tokens, effective_missing)."""
    n = F.col("n")
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    known = X.null_token(F.col("raw")) == "known"
    return (
        frequencies(table, names)
        .groupBy("column")
        .agg(
            total(F.col("raw") == "").alias("empty"),
            total(F.col("blank") & (F.col("raw") != "")).alias("whitespace_only"),
            total(~F.col("blank") & known).alias("known_tokens"),
        )
        .withColumn("effective_missing", F.col("empty") + F.col("whitespace_only") + F.col("known_tokens"))
    )


def null_tokens(table: Table, names: list[str] | None = None) -> DataFrame:
    """(column, token, known, n): spellings of a missing value, trimmed; ``known`` ones any CSV reader knows."""
    return _tokens(frequencies(table, names)).groupBy("column", "token", "known").agg(F.sum("n").alias("n"))


def _tokens(f: DataFrame) -> DataFrame:
    kind = X.null_token(F.col("raw"))
    some = only(f, ~F.col("blank") & kind.isNotNull())
    return some.select("column", "raw", X.js_trim(F.col("raw")).alias("token"), (kind == "known").alias("known"), "n")


def case_variants(table: Table, names: list[str] | None = None) -> DataFrame:
    """(column, folded, spelling, n): each trimmed spelling that differs from others in capitals only."""
    return _spellings(frequencies(table, names)).groupBy("column", "folded", "spelling").agg(F.sum("n").alias("n"))


def _spellings(f: DataFrame) -> DataFrame:
    """(column, folded, spelling, raw, n) of the raw values behind case variants."""
    t = X.js_trim(F.col("raw"))
    raw = only(f, ~F.col("blank")).select("column", F.lower(t).alias("folded"), t.alias("spelling"), "raw", "n")
    one, other = F.min("spelling"), F.max("spelling")  # two spellings are enough to know
    several = raw.groupBy("column", "folded").agg(one.alias("__one"), other.alias("__other")).where("__one <> __other")
    return raw.join(several.select("column", "folded"), ["column", "folded"], "left_semi")


def padded(table: Table, names: list[str] | None = None) -> DataFrame:
    """(column, value, n): present raw values with white space at an end."""
    return _padded(frequencies(table, names))


def _padded(f: DataFrame) -> DataFrame:
    raw = F.col("raw")
    return only(f, ~F.col("blank") & (raw != X.js_trim(raw))).groupBy("column", raw.alias("value")).agg(F.sum("n").alias("n"))


def leading_zeros(table: Table, names: list[str] | None = None) -> DataFrame:
    """(column): text columns of digits only, some with a zero before another digit."""
    f = frequencies(table, [c.name for c in table.columns if c.stored == "raw" and (names is None or c.name in names)])
    t = X.js_trim(F.col("raw"))
    flags = f.where("not blank").groupBy("column").agg(F.bool_and(t.rlike(r"^\d+$")).alias("d"), F.bool_or(t.rlike(r"^0\d")).alias("z"))
    return flags.where("d and z").select("column")


def pattern_values(table: Table, names: list[str] | None = None) -> DataFrame:
    """(column, pattern, value, n): the raw, present values of each shape, for columns with at most 12 shapes."""
    f = frequencies(table, names)
    values = only(f, ~F.col("blank")).groupBy("column", X.value_pattern(F.col("raw")).alias("pattern"), F.col("raw").alias("value")).agg(F.sum("n").alias("n"))
    shapes = values.groupBy("column", "pattern").agg(F.count(F.lit(1)).alias("__v"))
    few = shapes.groupBy("column").agg(F.count(F.lit(1)).alias("__p")).where(F.col("__p") <= MAX_PATTERNS)
    return values.join(F.broadcast(few.select("column")), "column", "left_semi")  # a row for each column


def patterns(table: Table, names: list[str] | None = None) -> DataFrame:
    """(column, pattern, values, n): shapes of present cells, for columns with at most 12 of them."""
    found = pattern_values(table, names)
    return found.groupBy("column", "pattern").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("n"))


def offenders(table: Table, name: str) -> DataFrame:
    """(kind, value, n): cells that are unreadable in their column.

    For text the kind is the first of number, date and time that reads at
    least 80 % of the present cells but not all; without one there are none.
    """
    c = table[name]
    f = frequencies(table, [name]).where("not blank")
    if c.measurable:
        kind = {"numeric": "number"}.get(c.kind, c.kind)
        return f.where("value is null").select(F.lit(kind).alias("kind"), F.col("raw").alias("value"), "n")
    row = readability(f, c.decimal_comma).first()
    raw = F.col("raw")
    date = X.parse_temporal(raw, "ymd").isNotNull() | X.parse_temporal(raw, "dmy").isNotNull()
    readers = {
        "number": X.parse_number(raw, c.decimal_comma).isNotNull(),
        "date": date,
        "time": X.parse_temporal(raw, "time").isNotNull(),
    }
    kind = None
    if row:
        read = {"number": row["numbers"], "date": row["ymd"] + row["dmy"], "time": row["time"]}  # no text is both
        kind = next((k for k, n in read.items() if n < row["present"] and n >= ALMOST * row["present"]), None)
    if kind is None:
        return f.where(F.lit(False)).select(F.lit("").alias("kind"), raw.alias("value"), "n")
    return f.where(~readers[kind]).select(F.lit(kind).alias("kind"), raw.alias("value"), "n")


def numeric_placeholders(table: Table, names: list[str] | None = None) -> DataFrame:
    """(column, value, n): numbers that stand for an absence.

    Outside the fences and either a known sentinel seen twice, or as frequent
    as a spike (3 and 0.1 % of the cells) and three times as frequent as the
    next values on either side.  A sentinel that dominates its column pulls the
    fences over itself; known ones that are not found yet are judged by the
    fences of all other values.  Columns without numbers have no rows.
    """
    names = [c.name for c in table.columns if c.kind == "numeric" and (names is None or c.name in names)]
    f = frequencies(table, names, "identity").where("value is not null").groupBy("column", "value").agg(F.sum("n").alias("n"))
    with held(f) as f:
        return _placeholders(f)


def _placeholders(f: DataFrame) -> DataFrame:
    """Placeholders from a held table (column, value, n); gathered between its steps, as a column has a thousand at most."""
    n, v = F.col("n"), F.col("value")
    spread = F.col("q3") - F.col("q1")
    out = (v < F.col("q1") - 1.5 * spread) | (v > F.col("q3") + 1.5 * spread)
    totals = f.groupBy("column").agg(F.sum("n").alias("__all"))
    facts = totals.join(F.broadcast(quartiles(f, ["column"], counted=True)), "column")
    facts = local(facts.collect(), facts)  # a row for each column
    spike = F.greatest(F.lit(MIN_SPIKE), F.ceil(F.col("__all") * SPIKE_SHARE))
    known = v.isin(*[float(x) for x in SENTINELS])
    judged = f.join(F.broadcast(facts), "column")
    # Each spike has 0.1 % of its column's cells, so a column has at most 1,000.
    odd = judged.where((known & (n >= 2)) | (out & ~known & (n >= spike))).select("column", "value", "n", out.alias("out"), known.alias("known"))
    odd = local(odd.collect(), odd)
    sure = odd.where("out and known").select("column", "value", "n")
    spikes = odd.where("out and not known").select("column", "value", "n")
    # The values on either side come from one walk along the values of the columns that have a spike.
    with_spikes = f.join(F.broadcast(spikes.select("column").distinct()), "column", "left_semi")
    walk = neighbours(ranged(with_spikes, F.asc("column"), F.asc("value")), "n", by="column") if not spikes.isEmpty() else None
    alone = spikes
    if walk is not None:
        near = walk.join(F.broadcast(spikes.select("column", "value")), ["column", "value"])
        most = F.greatest(F.coalesce("before.n", F.lit(0)), F.coalesce("after.n", F.lit(0)))
        alone = near.where(n >= SPIKE_FACTOR * most).select("column", "value", "n")
    again = odd.where("known and not out").select("column", "value", "n")
    rest = f.join(F.broadcast(again), ["column", "value"], "left_anti")  # nine values a column at most
    rest = rest.join(F.broadcast(again.select("column").distinct()), "column", "left_semi")
    late = again.join(F.broadcast(quartiles(rest, ["column"], counted=True)), "column").where(out).select("column", "value", "n")
    found = sure.unionByName(alone).unionByName(late)
    return local(found.collect(), found)


def temporal_placeholders(table: Table, names: list[str] | None = None) -> DataFrame:
    """(column, token, n): filler dates as written, seen at least twice; only raw columns have any."""
    names = [c.name for c in table.columns if names is None or c.name in names]
    return _fillers(frequencies(table, names), table).groupBy("column", "token").agg(F.max("__n").alias("n"))


def _fillers(f: DataFrame, table: Table) -> DataFrame:
    """(column, token, raw, n, __n) of the raw values behind filler dates."""
    dates = [c.name for c in table.columns if c.kind in ("date", "time") and c.stored == "raw"]
    token = X.js_trim(F.col("raw"))
    some = only(f, F.col("column").isin(*dates) & token.isin(*FILLER_DATES)).select("column", token.alias("token"), "raw", "n")
    twice = some.groupBy("column", "token").agg(F.sum("n").alias("__n")).where("__n >= 2")  # eight tokens a column
    return some.join(F.broadcast(twice), ["column", "token"])


def garbled(table: Table, names: list[str] | None = None) -> DataFrame:
    """(column, raw, fixed, n): text cells that were decoded with the wrong encoding."""
    return _garbled(frequencies(table, [c.name for c in table.columns if names is None or c.name in names]), table)


def _garbled(f: DataFrame, table: Table) -> DataFrame:
    texts = [c.name for c in table.columns if c.kind == "text" and c.stored == "raw"]
    fixed = X.fix_mojibake(F.col("raw"))
    some = only(f, F.col("column").isin(*texts) & fixed.isNotNull())
    return some.select("column", "raw", fixed.alias("fixed"), "n")


def sequence_gaps(table: Table, name: str) -> DataFrame:
    """(after, before, missing, step, every): the gaps of a column that is a regular sequence, else nothing.

    At least 20 different points (for numbers: integers, nearly unique), and
    one difference covers 80 % of the steps; the smallest value breaks a tie.
    """
    c = table[name]
    temporal = c.kind in ("date", "time")
    f = only(frequencies(table, [name], "identity"), F.col("value").isNotNull()).groupBy("value").agg(F.sum("n").alias("n"))
    dealt = ranged(f, F.asc("value"))
    facts = dealt.agg(
        F.count(F.lit(1)).alias("points"), F.sum("n").alias("present"), F.bool_and(F.col("value") == F.floor("value")).alias("whole")
    )
    steps = neighbours(dealt, "value").where("before is not null")
    steps = steps.select("value", F.col("before.value").alias("before"), (F.col("value") - F.col("before.value")).alias("delta"))
    modes = steps.groupBy("delta").agg(F.count(F.lit(1)).alias("times"), F.min("value").alias("first"))
    mode = modes.agg(F.max_by(F.struct("delta", "times"), F.struct("times", (-F.col("first")).alias("f"))).alias("m")).select(
        F.col("m.delta").alias("step"), F.col("m.times").alias("times")
    )
    regular = mode.join(facts, F.lit(True))  # one row each
    ok = (F.col("points") >= 20) & (F.col("times") >= 0.8 * (F.col("points") - 1)) & (F.col("step") > 0)
    ok = ok & (F.col("step") >= 1000) if temporal else ok & F.col("whole") & (F.col("points") >= 0.9 * F.col("present"))
    every = F.lit(None).cast("string")
    for size, unit in UNITS if temporal else ():
        every = F.when(F.col("step") == size, unit).otherwise(every)
    found = steps.join(F.broadcast(regular.where(ok).select("step")), F.col("delta") > 1.5 * F.col("step"))
    return found.select(
        F.col("before").alias("after"),
        F.col("value").alias("before"),
        (F.floor(F.col("delta") / F.col("step") + 0.5) - 1).cast("long").alias("missing"),
        "step",
        every.alias("every"),
    )


def repeated_values(table: Table, names: list[str] | None = None) -> DataFrame:
    """(column, value, n, distinct): the values that repeat in a column that is nearly a key, placeholders left out.

    At least 20 present cells, 90 % of them different, and numbers only if
    they are whole.
    """
    chosen = [c.name for c in table.columns if c.kind in ("numeric", "text") and (names is None or c.name in names)]
    f = frequencies(table, chosen)
    numeric = [c.name for c in table.columns if c.kind == "numeric" and c.name in chosen]
    present = only(f, ~F.col("blank"))
    whole = F.coalesce(F.bool_and(F.when(F.col("column").isin(*numeric), F.col("value") == F.floor("value"))), F.lit(True))
    facts = present.groupBy("column").agg(F.sum("n").alias("present"), F.count(F.lit(1)).alias("distinct"), whole.alias("whole"))
    key = (F.col("present") >= 20) & (F.col("distinct") >= 0.9 * F.col("present")) & F.col("whole")
    keys = facts.where(key).select("column", "distinct")  # a row for each column
    again = only(f, ~F.col("blank") & (F.col("n") > 1)).join(F.broadcast(keys), "column")
    if numeric:
        stand_ins = numeric_placeholders(table, numeric).select("column", "value")
        again = again.join(F.broadcast(stand_ins), ["column", "value"], "left_anti")
    return again.select("column", F.col("raw").alias("value"), "n", "distinct")


def near_key_repeats(table: Table, names: list[str] | None = None) -> DataFrame:
    """(column, values, rows, distinct): how many values repeat in a column that is nearly a key, and in how many rows."""
    found = repeated_values(table, names).groupBy("column", "distinct").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows"))
    return found.select("column", "values", "rows", "distinct")


def duplicate_groups(table: Table) -> DataFrame:
    """(first_row, n): groups of equal rows (hidden columns included), by first appearance."""
    return groups_of_rows(table).select("first_row", "n")


def duplicate_count(table: Table) -> DataFrame:
    """(groups, extras): groups of equal rows and rows beyond the first of each."""
    return duplicate_groups(table).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extras"))


def storage_hints(table: Table, names: list[str] | None = None) -> DataFrame:
    """(column, dtype, hint): how the column would be read, and a smaller type that would do."""
    cols = {c.name: c for c in table.columns if names is None or c.name in names}
    f = frequencies(table, list(cols))
    n = F.col("n")
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    digits = F.length(F.regexp_replace(F.regexp_replace("raw", r"[^0-9]", ""), r"^0+", ""))
    facts = f.groupBy("column").agg(
        F.sum("n").alias("rows"),
        total(F.col("blank")).alias("gaps"),
        total(~F.col("blank")).alias("present"),
        F.count_if(~F.col("blank")).alias("distinct"),
        F.coalesce(F.bool_and(F.when(~F.col("blank"), F.col("value") == F.floor("value"))), F.lit(False)).alias("whole"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.max(F.when(F.col("value").isNotNull(), digits)).alias("digits"),
    )
    kinds = table.df.sparkSession.createDataFrame([(c.name, c.kind) for c in cols.values()], "column string, kind string")
    facts = facts.join(F.broadcast(kinds), "column")
    numeric, half = F.col("kind") == "numeric", 512 * 1024
    size = F.lit(8)
    for bytes_ in (4, 2, 1):
        bound = 2 ** (8 * bytes_ - 1)
        size = F.when((F.col("min") >= -bound) & (F.col("max") <= bound - 1), F.lit(bytes_)).otherwise(size)
    saved = F.col("rows") * (8 - size)
    hint = (
        F.when(numeric & F.col("whole") & (F.col("gaps") > 0), "Int64")
        .when(numeric & F.col("whole") & (size < 8) & (saved >= half), F.concat(F.lit("int"), (size * 8).cast("string")))
        .when(numeric & ~F.col("whole") & (F.col("digits") <= 7) & (F.col("rows") * 4 >= half), "float32")
        .when((F.col("kind") == "text") & (F.col("present") >= 1000) & (F.col("distinct") <= 100) & (F.col("distinct") <= 0.05 * F.col("present")), "category")
    )
    dtype = (
        F.when(numeric & F.col("whole") & (F.col("gaps") == 0), "int64")
        .when(numeric, "float64")
        .when(F.col("kind") == "date", "datetime64[ns]")
        .when(F.col("kind") == "time", "timedelta64[ns]")
        .otherwise("object")
    )
    return facts.select("column", dtype.alias("dtype"), hint.alias("hint"))


def would_be_numeric(table: Table, names: list[str] | None = None) -> DataFrame:
    """(column, tokens): text columns that are numbers but for spellings of a missing value."""
    cols = [c for c in table.columns if c.kind == "text" and c.stored == "raw" and (names is None or c.name in names)]
    comma = table.delimiter == ";"
    f = frequencies(table, [c.name for c in cols]).where("not blank").withColumn("__k", X.null_token(F.col("raw")).isNotNull())
    number = X.parse_number(F.col("raw"), comma).isNotNull()
    g = f.groupBy("column").agg(
        F.bool_or("__k").alias("some"),
        F.bool_or(~F.col("__k")).alias("rest"),
        F.bool_and(F.col("__k") | number).alias("numbers"),
        F.array_sort(F.collect_set(F.when(F.col("__k"), X.js_trim(F.col("raw"))))).alias("tokens"),  # of 20 spellings
    )
    return g.where("some and rest and numbers").select("column", "tokens")


def finding_values(table: Table) -> DataFrame:
    """(column, kind, fix, what, value, n): everything a cleaning step could mend, with the raw values to filter on.

    ``what`` tells findings of one kind apart: the placeholder, or what a
    garbled value should be; the trimmed token or spelling.  ``n`` counts
    rows.  All kinds come from one table of values, and so from one scan;
    placeholders among numbers are looked for before, in a scan of the numbers.
    """
    f = frequencies(table)
    numeric = [c.name for c in table.columns if c.kind == "numeric"]

    def part(rows: DataFrame, kind: str, fix: str, what: Column, value: Column) -> DataFrame:
        return rows.select("column", F.lit(kind).alias("kind"), F.lit(fix).alias("fix"), what.alias("what"), value.alias("value"), "n")

    raw = F.col("raw")
    found = [
        part(_spellings(f), "case variants", "merge", F.col("spelling"), raw),
        part(_padded(f), "padded", "trim", F.lit(None).cast("string"), F.col("value")),
        part(_garbled(f, table), "damaged encoding", "fix encoding", F.col("fixed"), raw),
        part(_fillers(f, table), "placeholder", "empty", F.col("token"), raw),
        part(_tokens(f), "null token", "empty", F.col("token"), raw),
    ]
    if numeric:
        stand_ins = F.broadcast(numeric_placeholders(table, numeric).select("column", "value"))
        shown = F.when(F.col("value") == F.floor("value"), F.col("value").cast("decimal(38,0)").cast("string")).otherwise(F.col("value").cast("string"))
        found.append(part(only(f, F.col("value").isNotNull()).join(stand_ins, ["column", "value"]), "placeholder", "empty", shown, raw))
    return reduce(DataFrame.unionByName, found)


def findings(table: Table) -> DataFrame:
    """(column, kind, n, fix, text): one row for each finding, in words; :func:`finding_values` has the values behind it.

    ``n`` counts spellings for case variants and rows for all else.  Each
    placeholder is a finding of its own; the null tokens of a column are one.
    """
    v = finding_values(table)
    titles = table.df.sparkSession.createDataFrame([(c.name, c.title) for c in table.columns], "column string, title string")
    per = v.groupBy("column", "kind", "fix", "what").agg(F.sum("n").alias("n"), F.min("value").alias("value"))
    own = F.when(F.col("kind") == "placeholder", F.col("what"))
    count = F.when(F.col("kind") == "case variants", F.count(F.lit(1))).otherwise(F.sum("n"))
    some = F.max_by(F.struct("what", "value"), F.struct("n", "value"))  # the most frequent one stands for the others
    token = F.when(F.col("kind") == "null token", F.struct((-F.col("n")).alias("n"), "what"))
    tokens = F.transform(F.array_sort(F.collect_set(token)), lambda x: F.concat(x["what"], F.lit(" ("), (-x["n"]).cast("string"), F.lit(")")))  # of 20 words
    rows = per.groupBy("column", "kind", "fix", own.alias("__own")).agg(count.alias("n"), some.alias("__some"), F.array_join(tokens, ", ").alias("__tokens"))
    n = F.col("n").cast("string")
    text = (
        F.when(F.col("kind") == "case variants", F.concat(n, F.lit(" spellings differ in capitals only")))
        .when(F.col("kind") == "padded", F.concat(n, F.lit(" cells with spaces at an end")))
        .when(F.col("kind") == "damaged encoding", F.concat(n, F.lit(" cells like "), F.col("__some.value"), F.lit(" for "), F.col("__some.what")))
        .when(F.col("kind") == "placeholder", F.concat(F.col("__own"), F.lit(" in "), n, F.lit(" cells stands for nothing")))
        .otherwise(F.concat(F.lit("nothing is written "), F.col("__tokens")))
    )
    return rows.join(F.broadcast(titles), "column").select("column", "kind", "n", "fix", F.concat("title", F.lit(": "), text).alias("text"))


def dataset_info(table: Table) -> DataFrame:
    """(column, kind, non_null, dtype, truncated): ``truncated`` if rows of the file were left out."""
    m = missing_cells(table).join(storage_hints(table), "column")
    rows = table.df.agg(F.count(F.lit(1)).alias("__rows"))
    kinds = table.df.sparkSession.createDataFrame([(c.name, c.kind) for c in table.columns], "column string, kind string")
    return m.join(F.broadcast(rows), F.lit(True)).join(F.broadcast(kinds), "column").select(
        "column", "kind", (F.col("__rows") - F.col("effective_missing")).alias("non_null"), "dtype", F.lit(table.truncated).alias("truncated")
    )
