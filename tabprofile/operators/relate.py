"""How columns go together, and how a column runs along rows and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..plans.table import ROW, Table
from . import gram
from .order import placed, positions, ranged
from .profile import fences, quartiles

SAMPLE = 20_000


def _pearson(x: Column, y: Column, least: int = 20) -> Column:
    """The correlation over rows where both have a value; null below ``least`` rows or without variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))
    r = F.try_divide(F.covar_pop(a, b), spread)
    return F.when(F.count_if(both) >= least, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def _thinned(table: Table, sample: int | None) -> DataFrame:
    """Every k-th row by position, so that at most ``sample`` are left; None takes all."""
    if sample is None:
        return table.df
    rows = table.df.count()
    stride = max(1, -(-rows // sample))
    return table.df if stride == 1 else positions(table.df).where(F.col("_pos") % stride == 0).drop("_pos")


def correlation_pairs(table: Table, names: list[str] | None = None, sample: int | None = None) -> DataFrame:
    """(left_column, right_column, r) of each pair of numeric columns, in one pass over all rows.

    Moments of pairs are matrix products of batches (:mod:`gram`), so 500
    columns take one pass and a plan of 500 expressions.  A row counts for a pair if it has both values.  ``r`` is null for less
    than 20 such rows or a constant column.  ``sample`` (a systematic one) is
    there for previews of large tables.
    """
    cols = [c for c in table.columns if c.kind == "numeric" and (names is None or c.name in names)]
    spark = table.df.sparkSession
    if len(cols) < 2:
        return spark.createDataFrame([], "left_column string, right_column string, r double")
    values = _thinned(table, sample).select(gram.as_array([c.value() for c in cols]))
    return gram.correlations(values, [c.name for c in cols])


def top_correlations(table: Table, names: list[str] | None = None, least: float = 0.5, k: int = 6, sample: int | None = None) -> DataFrame:
    """The k pairs with the largest absolute correlation of at least ``least``."""
    strong = correlation_pairs(table, names, sample).where(F.abs("r") >= least)
    return strong.orderBy(F.desc(F.abs("r")), "left_column", "right_column").limit(k)


def correlation_matrix(table: Table, names: list[str] | None = None, sample: int | None = None) -> DataFrame:
    """All ordered pairs, the diagonal (1) included."""
    pairs = correlation_pairs(table, names, sample)
    turned = pairs.select(F.col("right_column").alias("left_column"), F.col("left_column").alias("right_column"), "r")
    own = [(c.name, c.name, 1.0) for c in table.columns if c.kind == "numeric" and (names is None or c.name in names)]
    return pairs.unionByName(turned).unionByName(table.df.sparkSession.createDataFrame(own, turned.schema))


def group_means(table: Table, measure: str, by: list[str]) -> DataFrame:
    """(category_column, category, n, mean, explained, groups): means of ``measure`` per value of each category column.

    ``explained`` is the share of the variance between groups.  Blank cells
    are a category of their own, ''; rows without a value take no part.
    Candidates with less than 2 groups or 10 rows have no rows, nor has an
    empty table.  All candidates share one pass: sums are taken per value,
    and the totals, a row for each candidate, from those.
    """
    m = table[measure].value()
    label = lambda c: F.when(c.blank(), "").otherwise(c.raw())
    rows = table.df.withColumn("__v", m).where("__v is not null")
    tall = rows.select("__v", F.explode(F.array(*[F.struct(F.lit(n).alias("c"), label(table[n]).alias("k")) for n in by])).alias("__x"))
    per = tall.groupBy(F.col("__x.c").alias("category_column"), F.col("__x.k").alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("__v").alias("mean"), F.var_pop("__v").alias("__var")
    )
    # All candidates have the same rows, and so the same mean to take squares about.
    center = rows.agg(F.avg("__v").alias("__center"))
    between = F.sum(F.col("n") * F.pow(F.col("mean") - F.col("__center"), 2)).alias("__between")
    totals = per.join(F.broadcast(center), F.lit(True)).groupBy("category_column").agg(
        between, F.sum(F.col("n") * F.col("__var")).alias("__inside"), F.count(F.lit(1)).alias("groups"), F.sum("n").alias("__rows")
    )
    ratio = F.coalesce(F.try_divide(F.col("__between"), F.col("__between") + F.col("__inside")), F.lit(0.0))
    totals = totals.where("groups >= 2 and __rows >= 10").withColumn("explained", F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))
    out = per.join(F.broadcast(totals), "category_column")
    return out.select("category_column", "category", "n", "mean", "explained", "groups")


def category_candidates(table: Table, measure: str, most: int = 30) -> DataFrame:
    """(category_column, explained, groups): text columns of 2 to 30 values, by how much of the measure they explain."""
    from .profile import counts

    texts = [c.name for c in table.columns if c.kind == "text"]
    sizes = counts(table, texts).where(F.col("distinct").between(2, most)).select("column").collect()  # names only
    names = [r["column"] for r in sizes]
    if not names:
        return table.df.sparkSession.createDataFrame([], "category_column string, explained double, groups long")
    g = group_means(table, measure, names)
    return g.groupBy("category_column").agg(F.first("explained").alias("explained"), F.first("groups").alias("groups"))


def shown_groups(means: DataFrame, k: int = 12) -> DataFrame:
    """The k largest groups of each candidate (equal ones by name), by mean, with the number of groups that are not shown."""
    rank = F.row_number().over(W.partitionBy("category_column").orderBy(F.desc("n"), "category"))
    big = means.withColumn("__r", rank).where(F.col("__r") <= k).drop("__r")
    return big.withColumn("hidden", F.greatest(F.lit(0), F.col("groups") - k))


def time_breakdown(table: Table, name: str) -> DataFrame:
    """(part, slot, n): rows by year (if there are several), month, weekday (Monday 0) and hour, all slots that occur.

    Blank and unreadable cells are in no slot; without any other there are no rows.
    """
    c = table[name]
    v = c.value()
    hour = F.floor(v / 3_600_000) % 24
    rows = table.df.where(v.isNotNull())
    if c.kind == "time":
        parts = [("hour", hour)]
    else:
        at = F.timestamp_millis(F.floor(v).cast("long"))
        parts = [("year", F.year(at)), ("month", F.month(at)), ("weekday", F.weekday(at)), ("hour", F.hour(at))]
    tall = rows.select(F.explode(F.array(*[F.struct(F.lit(p).alias("part"), e.cast("int").alias("slot")) for p, e in parts])).alias("x"))
    got = tall.groupBy("x.part", "x.slot").agg(F.count(F.lit(1)).alias("n"))
    several = F.count(F.lit(1)).over(W.partitionBy("part")) > 1  # a few hundred rows
    return got.withColumn("__s", several).where((F.col("part") != "year") | F.col("__s")).drop("__s")


def view(table: Table, sort: tuple[str, bool] | None, *columns: Column) -> DataFrame:
    """``_row``, the columns and ``_pos``, the place (from 0) in the view: by ``_row``, or sorted by (column, descending)."""
    from ..plans.filters import sort_keys

    if sort is None:
        return positions(table.df.select(ROW, *columns))
    return placed(ranged(table.df, *sort_keys(table, *sort), keep=[F.col(ROW), *columns]))


def row_order_buckets(table: Table, name: str, most: int = 160, sort: tuple[str, bool] | None = None) -> DataFrame:
    """(bucket, mean, above, below, empty, n): a measure along the rows, in at most 160 stretches of the view.

    The view is in the order of ``_row``, or sorted by ``sort`` (column,
    descending) as :func:`plans.filters.sort_rows` does.  ``mean`` is of values within the fences, null in a stretch without any;
    less than 30 rows, or no value at all, give nothing.
    """
    c = table[name]
    rows = view(table, sort, c.value().alias("value"), c.blank().alias("blank"))
    low, high = fences()
    values = table.df.select(c.value().alias("value"), F.lit(0).alias("__c"))
    q = quartiles(values, ["__c"]).select(low.alias("low"), high.alias("high"))
    size = table.df.agg(F.count(F.lit(1)).alias("__rows"))
    b = F.floor(F.col("_pos") * F.least(F.col("__rows"), F.lit(most)) / F.col("__rows")).cast("int")
    v = F.col("value")
    full = rows.join(F.broadcast(q), F.lit(True)).join(F.broadcast(size), F.lit(True)).where("__rows >= 30")
    return full.groupBy(b.alias("bucket")).agg(
        F.avg(F.when(v.between(F.col("low"), F.col("high")), v)).alias("mean"),
        F.count_if(v > F.col("high")).alias("above"),
        F.count_if(v < F.col("low")).alias("below"),
        F.count_if("blank").alias("empty"),
        F.count(F.lit(1)).alias("n"),
    )


def level_shift(table: Table, name: str, sort: tuple[str, bool] | None = None) -> DataFrame:
    """(position, score): where the level of a measure changes most along the view; nothing if it does not.

    Values are clamped to the fences; of at most about 320 cuts the one whose
    two sides differ most, in standard deviations within them, is taken if
    they differ by one and the score reaches 8.  A steady trend (a correlation
    with the position of 0.9) has no shift.

    The sums up to each cut come from sums of the stretches between cuts, so
    no task sees all rows.
    """
    c = table[name]
    v = F.col("value")
    some = table.with_df(table.df.where(c.value().isNotNull()))
    low, high = fences()
    values = some.df.select(c.value().alias("value"), F.lit(0).alias("__c"))
    q = quartiles(values, ["__c"]).select(low.alias("low"), high.alias("high"))
    series = view(some, sort, c.value().alias("value")).join(F.broadcast(q), F.lit(True))
    series = series.select("_pos", F.greatest(F.col("low"), F.least(F.col("high"), v)).alias("value"))
    facts = series.agg(
        F.count(F.lit(1)).alias("n"), _pearson(F.col("_pos").cast("double"), v).alias("trend"), F.avg("value").alias("center")
    )
    n = F.col("n")
    first, step = F.ceil(n * 0.1), F.greatest(F.lit(1), F.floor(n / 200))
    stretch = F.floor((F.col("_pos") - first) / step) + 1  # rows before the first cut are stretch 0 or less
    # Centred values: sums of squares then keep their digits.
    d = v - F.col("center")
    parts = series.join(F.broadcast(facts), F.lit(True)).groupBy(F.greatest(F.lit(0), stretch).alias("s"), "n", "trend").agg(
        F.sum(d).alias("a"), F.sum(d * d).alias("b"), F.count(F.lit(1)).alias("k")
    )
    upto = W.orderBy("s").rowsBetween(W.unboundedPreceding, 0)  # some hundred rows
    whole = W.partitionBy("n")
    cuts = parts.withColumns(
        {
            "ca": F.sum("a").over(upto),
            "cb": F.sum("b").over(upto),
            "ck": F.sum("k").over(upto),
            "ta": F.sum("a").over(whole),
            "tb": F.sum("b").over(whole),
        }
    ).where((n >= 40) & ((F.col("trend").isNull()) | (F.abs("trend") < 0.9)) & (F.col("ck") <= F.floor(n * 0.9)) & (F.col("ck") < n))
    k = F.col("ck")
    left, right = F.try_divide(F.col("ca"), k), F.try_divide(F.col("ta") - F.col("ca"), n - k)
    # Squares about the two means: all squares less what each mean explains.
    within = F.col("tb") - k * left * left - (n - k) * right * right
    effect = F.try_divide(F.abs(left - right), F.sqrt(F.greatest(F.lit(0.0), within) / (n - 2)))
    scored = cuts.select(k.alias("position"), effect.alias("effect"), (effect * F.sqrt(k * (n - k) / n)).alias("score"))
    best = scored.where("effect >= 1").agg(F.max_by(F.struct("position", "score"), F.struct("score", (-F.col("position")).alias("p"))).alias("m"))
    return best.where("m is not null").select(F.col("m.position").alias("position"), F.col("m.score").alias("score")).where("score >= 8")
