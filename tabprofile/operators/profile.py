"""The profile of a column: counts, exact quantiles, outliers, histogram, top values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..plans.table import Table
from .freq import cells, frequencies, held, local

BINS, TOP_VALUES = 20, 7
#: Bits of the image of a value that a round of the radix selection looks at.
DIGIT = 16
#: Different values of a cell up to which they are ranked one by one.
CELL = 1 << DIGIT


def image(v: Column) -> Column:
    """The bits of a double as a long in the order of the doubles: sign and magnitude, NaN last; 0 for both zeros.

    Arithmetic by powers of two is exact, so no value is rounded.
    """
    a = F.abs(v)
    guess = F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2(a))))  # the logarithm may be off by its last bit
    m = a * F.pow(F.lit(2.0), -guess)
    high, low = m >= 2, (m < 1) & (guess > -1022)
    exponent = guess + F.when(high, 1).when(low, -1).otherwise(0)
    fraction = m * F.when(high, 0.5).when(low, 2.0).otherwise(1.0)
    bits = (exponent + 1022).cast("long") * (1 << 52) + (fraction * float(1 << 52)).cast("long")
    size = F.when(F.isnan(v), F.lit((2047 << 52) + 1)).when(a == float("inf"), F.lit(2047 << 52)).when(a == 0, F.lit(0)).otherwise(bits)
    return F.when(v < 0, -size).otherwise(size)


def quantiles(values: DataFrame, by: list[str], fractions: tuple[float, ...], counted: bool = False) -> DataFrame:
    """Exact quantiles of ``value`` in each group, interpolated at ``f * (n - 1)``: the group, ``f``, ``q``.

    ``counted`` says that ``values`` has counts ``n``; it is read two to five
    times, so it should be held.  Null values are left out; a group without
    values has no row.  See :func:`selected`.
    """
    if not counted:
        with held(values.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))) as t:
            return quantiles(t, by, fractions, counted=True)
    types = dict(values.dtypes)
    out = [(*k, f, x) for k, (_, q) in selected(values, by, fractions).items() for f, x in q.items()]
    return values.sparkSession.createDataFrame(out, f"{', '.join(f'`{c}` {types[c]}' for c in by)}, f double, q double")


def selected(t: DataFrame, by: list[str], fractions: tuple[float, ...]) -> dict[tuple, tuple[dict, dict[float, float]]]:
    """For each group its ``n``, ``min``, ``max``, ``mean``, and the quantile of each fraction; from values with counts.

    Radix selection over the bits of the doubles (:func:`image`), for all
    groups and ranks at once, whatever the distribution: the leading 16 bits
    give at most 2**16 sums a group, which tell the cell that a rank lies in.
    A cell of at most 2**16 different values is ranked one by one; if one has
    more, the next 16 bits cut it up.  No window ever holds more.  Groups are
    few (columns): what passes between the jobs is a row for each rank.
    """
    t = t.where(F.col("value").isNotNull()).select(*by, "value", "n")
    g = [f"__g{k}" for k in range(len(by))]
    rename = [F.col(c).alias(x) for c, x in zip(by, g)]
    spark, types = t.sparkSession, dict(t.dtypes)
    keys = ", ".join(f"{x} {types[c]}" for c, x in zip(by, g))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(x)) for c, x in zip(by, g)])
    v, n = F.col("value"), F.col("n")
    sums = [F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("kinds")]

    whole, upto = W.partitionBy(*g), W.partitionBy(*g).orderBy("low").rowsBetween(W.unboundedPreceding, 0)
    first = t.groupBy(*rename, F.shiftright(image(v), 64 - DIGIT).alias("at")).agg(*sums, F.sum(v * n).alias("s"))
    first = first.withColumns({"to": F.sum("n").over(upto), "total": F.sum("n").over(whole), "min": F.min("low").over(whole), "max": F.max("high").over(whole), "sum": F.sum("s").over(whole)})
    asked = F.array(*[F.struct(F.lit(float(f)).alias("f"), F.lit(up).alias("up")) for f in fractions for up in (0, 1)])
    rank = F.least(F.floor(F.col("x.f") * (F.col("total") - 1)) + F.col("x.up"), F.col("total") - 1)
    hit = first.withColumn("x", F.explode(asked)).withColumn("r", rank - F.col("to") + n).where("r >= 0 and r < n")
    found = hit.select(*g, "x.f", "x.up", "r", "low", "high", "kinds", "total", "min", "max", "sum").collect()
    facts = {tuple(r[x] for x in g): {"n": r["total"], "min": r["min"], "max": r["max"], "mean": r["sum"] / r["total"]} for r in found}
    at: dict[tuple, float] = {}
    shift = 64 - DIGIT
    while True:
        cells_: dict[tuple, list] = {}
        most = 0
        for r in found:
            k = tuple(r[x] for x in g)
            if r["low"] == r["high"] or r["kinds"] == 1:
                at[(*k, r["f"], r["up"])] = r["low"]
            else:
                cells_.setdefault((*k, r["low"], r["high"]), []).append((r["f"], r["up"], r["r"]))
                most = max(most, r["kinds"])
        if not cells_:
            break
        shift -= DIGIT
        schema = f"{keys}, __w array<struct<low:double,high:double,ranks:array<struct<f:double,up:int,r:long>>>>"
        groups: dict[tuple, list] = {}
        for (*k, low, high), ranks in cells_.items():
            groups.setdefault(tuple(k), []).append((low, high, ranks))
        listed = spark.createDataFrame([(*k, w) for k, w in groups.items()], schema)
        near = F.filter("__w", lambda x: v.between(x["low"], x["high"]))
        inside = t.join(F.broadcast(listed), same).select(*g, "value", "n", F.explode(near).alias("w"))  # a row for each rank
        cut = v if most <= CELL else F.shiftright(image(v), shift)
        part = inside.groupBy(*g, F.col("w.low").alias("from"), cut.alias("at")).agg(F.first("w.ranks").alias("ranks"), *sums)
        order = W.partitionBy(*g, "from").orderBy("low").rowsBetween(W.unboundedPreceding, 0)
        part = part.withColumn("to", F.sum("n").over(order)).withColumn("x", F.explode("ranks"))
        part = part.withColumn("r", F.col("x.r") - F.col("to") + n).where("r >= 0 and r < n")
        found = part.select(*g, "x.f", "x.up", "r", "low", "high", "kinds").collect()
    out = {}
    for k, fact in facts.items():
        q = {}
        for f in fractions:
            low, share = at[(*k, f, 0)], f * (fact["n"] - 1) % 1
            q[f] = low + (at[(*k, f, 1)] - low) * share if share else low
        out[k] = (fact, q)
    return out


def quartiles(values: DataFrame, by: list[str], counted: bool = False) -> DataFrame:
    """(group, q1, median, q3)."""
    q = quantiles(values, by, (0.25, 0.5, 0.75), counted)
    pick = lambda f: F.max(F.when(F.col("f") == f, F.col("q")))
    return q.groupBy(*by).agg(pick(0.25).alias("q1"), pick(0.5).alias("median"), pick(0.75).alias("q3"))


def fences() -> tuple[Column, Column]:
    """1.5 interquartile ranges below q1 and above q3."""
    spread = F.col("q3") - F.col("q1")
    return F.col("q1") - 1.5 * spread, F.col("q3") + 1.5 * spread


def counts(table: Table, names: list[str] | None = None) -> DataFrame:
    """Per column: total, missing, present, distinct, unique; distinct and unique are of raw, present values."""
    return _counts(frequencies(table, names, "identity"))


def _counts(f: DataFrame) -> DataFrame:
    n = F.col("n")
    return f.groupBy("column").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(F.col("blank"), n)), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(~F.col("blank"), n)), F.lit(0)).alias("present"),
        F.count_if(~F.col("blank")).alias("distinct"),
        F.count_if(~F.col("blank") & (n == 1)).alias("unique"),
    )


def _measurable(table: Table, names: list[str] | None) -> list[str]:
    return [c.name for c in table.columns if c.measurable and (names is None or c.name in names)]


def measures(table: Table, names: list[str] | None = None) -> DataFrame:
    """Per measurable column: min, max, mean, deviation, q1, median, q3, low, high (fences), outliers.

    The deviation of a single value is 0.  Unreadable cells take no part; a
    column without readable cells has no row, nor has an empty table.
    """
    with held(frequencies(table, _measurable(table, names), "identity")) as f:
        return _measures(f)


def _edges(f: DataFrame) -> DataFrame:
    """min, max, mean, quartiles and fences of each column of a held table of values with counts; a local table."""
    rows = []
    for (column,), (fact, q) in selected(f, ["column"], (0.25, 0.5, 0.75)).items():
        spread = q[0.75] - q[0.25]
        rows.append((column, fact["min"], fact["max"], fact["mean"], q[0.25], q[0.5], q[0.75], q[0.25] - 1.5 * spread, q[0.75] + 1.5 * spread, fact["n"]))
    names = ("min", "max", "mean", "q1", "median", "q3", "low", "high")
    return f.sparkSession.createDataFrame(rows, f"column string, {', '.join(f'{x} double' for x in names)}, __n long")


def _measures(f: DataFrame) -> DataFrame:
    """Measures from a held table of values with their counts; a row for each column, so they are gathered."""
    v, n = F.col("value"), F.col("n")
    edges = _edges(f)
    # Squares about a mean that may be off by its last bits, less what that adds.
    d = v - F.col("mean")
    spread = F.greatest(F.lit(0.0), F.sum(d * d * n) - F.pow(F.sum(d * n), 2) / F.col("__n"))
    some = f.where(v.isNotNull()).join(F.broadcast(edges), "column")
    out = some.groupBy("column", *[c for c in edges.columns if c != "column"]).agg(
        F.coalesce(F.sqrt(spread / F.when(F.col("__n") > 1, F.col("__n") - 1)), F.lit(0.0)).alias("deviation"),
        F.coalesce(F.sum(F.when((v < F.col("low")) | (v > F.col("high")), n)), F.lit(0)).alias("outliers"),
    )
    out = out.select("column", "min", "max", "mean", "deviation", "q1", "median", "q3", "low", "high", "outliers")
    return local(out.collect(), out)


def profile(table: Table, names: list[str] | None = None) -> DataFrame:
    """One row per column: kind, counts with shares, and the measures where there are any.

    Everything comes from one held table of values with their counts, and so from one scan.
    """
    with held(frequencies(table, names, "identity")) as f:
        return profile_of(f, table, names)


def profile_of(f: DataFrame, table: Table, names: list[str] | None = None) -> DataFrame:
    """The profile from a held table of values with their counts."""
    kinds = table.df.sparkSession.createDataFrame([(c.name, c.kind) for c in table.columns], "column string, kind string")
    all_ = _counts(f)
    all_ = local(all_.collect(), all_).join(F.broadcast(kinds), "column")
    if _measurable(table, names):
        all_ = all_.join(F.broadcast(_measures(f)), "column", "left")
    return all_.withColumns(
        {
            "missing_share": F.try_divide("missing", "total"),
            "distinct_share": F.coalesce(F.try_divide("distinct", "present"), F.lit(0.0)),
        }
    )


def histogram(table: Table, names: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """(column, bin, n, low_bound, high_bound, below, above): every bin of each measurable column.

    The range goes from fence to fence, clipped to the values, if there are
    outliers, else over all values; what lies outside falls into the edge
    bins, which reach to the extremes.  ``below`` and ``above`` count the
    outliers of the edge bins.  Equal values all fall into the first bin; a
    column without readable cells has no bins.
    """
    with held(frequencies(table, _measurable(table, names), "identity")) as f:
        out = _histogram(f, bins)
        return local(out.collect(), out)


def _histogram(f: DataFrame, bins: int) -> DataFrame:
    outside = (F.col("min") < F.col("low")) | (F.col("max") > F.col("high"))
    clip = outside & (F.least("high", "max") > F.greatest("low", "min"))
    span = _edges(f).select(
        F.col("column").alias("__c"),
        "min",
        "max",
        "low",
        "high",
        F.when(clip, F.greatest("low", "min")).otherwise(F.col("min")).alias("from"),
        F.when(clip, F.least("high", "max")).otherwise(F.col("max")).alias("to"),
    )
    width = F.col("to") - F.col("from")
    place = F.floor((F.col("value") - F.col("from")) / F.when(width > 0, width) * bins)
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(place, F.lit(0)))).cast("int")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    values = f.where(F.col("value").isNotNull()).join(F.broadcast(span), F.col("column") == F.col("__c"))
    got = values.groupBy("column", bin_.alias("bin")).agg(
        F.sum("n").alias("n"), n(F.col("value") < F.col("low")).alias("below"), n(F.col("value") > F.col("high")).alias("above")
    )
    grid = span.select(F.col("__c").alias("column"), "min", "max", "from", "to", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = width / bins
    low = F.when(F.col("bin") == 0, F.col("min")).otherwise(F.col("from") + F.col("bin") * step)
    high = F.when(F.col("bin") == bins - 1, F.col("max")).otherwise(F.col("from") + (F.col("bin") + 1) * step)
    return grid.join(got, ["column", "bin"], "left").select(
        "column",
        "bin",
        F.coalesce("n", F.lit(0)).alias("n"),
        low.alias("low_bound"),
        high.alias("high_bound"),
        F.coalesce("below", F.lit(0)).alias("below"),
        F.coalesce("above", F.lit(0)).alias("above"),
    )


def top_values(table: Table, names: list[str] | None = None, k: int = TOP_VALUES) -> DataFrame:
    """(column, rank, value, n, share, n_values, other): the k most frequent values, blanks being one value ''.

    Ties go by value.  ``share`` is of all rows; ``other`` is what the values
    below rank k add up to.
    """
    return top_of(frequencies(table, names), k)


def top_of(f: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """The most frequent values from a table of values with their counts."""
    f = f.groupBy("column", F.when(F.col("blank"), "").otherwise(F.col("raw")).alias("value")).agg(F.sum("n").alias("n"))
    whole = f.groupBy("column").agg(F.sum("n").alias("__all"), F.count(F.lit(1)).alias("n_values"))
    rank = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))
    best = f.withColumn("rank", rank).where(F.col("rank") <= k)  # planned with a group limit: no column is gathered
    got = F.sum("n").over(W.partitionBy("column"))
    return best.join(F.broadcast(whole), "column").select(
        "column", "rank", "value", "n", (F.col("n") / F.col("__all")).alias("share"), "n_values", (F.col("__all") - got).alias("other")
    )


def fold_ranking(top: DataFrame, rows: int = TOP_VALUES) -> DataFrame:
    """The ranking in ``rows`` rows: if more is left than fits, the last one becomes what is left (value null)."""
    more = (F.col("other") > 0) | (F.max("rank").over(W.partitionBy("column")) > rows)
    folds = more & (F.col("rank") >= rows)
    slot = F.when(folds, F.lit(rows)).otherwise(F.col("rank"))
    shown = top.select("column", slot.alias("rank"), F.when(~folds, F.col("value")).alias("value"), "n", folds.alias("__f"), "other")
    return shown.groupBy("column", "rank", "value").agg(
        (F.sum("n") + F.coalesce(F.max(F.when(F.col("__f"), F.col("other"))), F.lit(0))).alias("n")
    )


def value_counts(table: Table, name: str) -> DataFrame:
    """(value, n) of the raw values, as they are written, most frequent first; null counts as ''."""
    return table.df.groupBy(table[name].raw().alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def lengths(table: Table, names: list[str] | None = None) -> DataFrame:
    """(column, min_length, max_length, mean_length) of trimmed, present cells, in code points."""
    from ..functions.text import js_trim

    size = F.length(js_trim(F.col("raw")))
    return cells(table, names).where("not blank").groupBy("column").agg(
        F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.avg(size).alias("mean_length")
    )


def length_distribution(table: Table, name: str) -> DataFrame:
    """(length, n) over trimmed, present cells."""
    from ..functions.text import js_trim

    return cells(table, [name]).where("not blank").groupBy(F.length(js_trim(F.col("raw"))).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def ranked_values(table: Table, name: str, k: int = 20) -> DataFrame:
    """(rank, label, n): the k most frequent values, then what is left as ``Other (n values)``; blanks are ``(blank)``."""
    top = top_values(table, [name], k)
    label = F.when(F.col("value") == "", "(blank)").otherwise(F.col("value"))
    shown = top.select(F.col("rank").cast("int").alias("rank"), label.alias("label"), "n")
    rest = top.where((F.col("rank") == k) & (F.col("n_values") > k)).select(
        F.lit(k + 1).alias("rank"), F.concat(F.lit("Other ("), (F.col("n_values") - k).cast("string"), F.lit(" values)")).alias("label"), F.col("other").alias("n")
    )
    return shown.unionByName(rest)


def summary_without(table: Table, name: str, excluded: tuple[float, ...]) -> DataFrame:
    """(count, min, max, mean, median, deviation) of a measure without the placeholders ``excluded``."""
    kept = ~F.col("value").isin(*excluded) if excluded else F.lit(True)
    with held(frequencies(table, [name], "identity").where(kept)) as f:
        count = f.groupBy("column").agg(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("count"))
        out = local(count.collect(), count).join(_measures(f), "column")
    return out.select("count", "min", "max", "mean", "median", "deviation")


def distribution_kind(kind: str, present: int, distinct: int) -> str:
    """How a column is best shown: ``histogram`` of a measure, ``lengths`` of free text, else a ``ranking``."""
    if kind != "text":
        return "histogram"
    return "lengths" if present and distinct / present > 0.6 else "ranking"
