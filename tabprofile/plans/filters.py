"""Filters as data, and the predicates and windows they compile to.

Cell filters are predicates of one cell and are joined by AND.  Set filters
(one row per value, values seen once) look at the rows that all cell filters
keep, in the order in which they were added.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.order import placed, ranged
from .table import ROW, ColumnInfo, Table

#: Lists longer than this are joined instead of written into the plan.
LISTED_VALUES = 1000


@dataclass(frozen=True)
class TextFilter:
    """``contains``, ``not_contains``, ``starts``, ``ends``, ``equals``, ``not_equals``; capitals do not matter.

    ``blanks`` set to ``add`` or ``exclude`` decides blank cells, whatever the condition says.
    """

    column: str
    op: str
    text: str
    blanks: str | None = None


@dataclass(frozen=True)
class CompareFilter:
    """``=``, ``!=``, ``>``, ``>=``, ``<``, ``<=`` or ``between`` (bounds in any order, both included).

    A bound is a number, or text as it is typed: a date as the column writes
    it or ISO, a time, a number.  A blank or unreadable cell fulfils ``!=``
    only, unless ``blanks`` decides the blank ones.
    """

    column: str
    op: str
    value: float | str
    other: float | str | None = None
    blanks: str | None = None


@dataclass(frozen=True)
class ValuesFilter:
    """Raw values, exactly as written, white space too; '' stands for every blank cell besides."""

    column: str
    values: tuple[str, ...]
    exclude: bool = False


@dataclass(frozen=True)
class RangeFilter:
    """A bin: ``low <= v < high``, with ``last`` the upper bound included; ``blank`` adds the blank cells."""

    column: str
    low: float
    high: float
    last: bool = False
    blank: bool = False


@dataclass(frozen=True)
class OutsideFilter:
    """Below ``low`` or above ``high``; blank and unreadable cells are not."""

    column: str
    low: float
    high: float


@dataclass(frozen=True)
class DuplicatesFilter:
    """All members of groups of rows that are equal in all columns, the first included."""

    column: str = field(default="", repr=False)


@dataclass(frozen=True)
class DistinctFilter:
    """The first row of each value; all blanks are one value."""

    column: str


@dataclass(frozen=True)
class UniqueFilter:
    """Rows whose value is seen once; blanks are not."""

    column: str


Filter = TextFilter | CompareFilter | ValuesFilter | RangeFilter | OutsideFilter | DuplicatesFilter | DistinctFilter | UniqueFilter
SET_FILTERS = (DistinctFilter, UniqueFilter)


def only_empty(column: str) -> ValuesFilter:
    return ValuesFilter(column, ("",))


def hide_empty(column: str) -> ValuesFilter:
    return ValuesFilter(column, ("",), exclude=True)


def _text(f: TextFilter, c: ColumnInfo) -> Column:
    have, want = F.lower(c.raw()), F.lower(F.lit(f.text))
    tests = {
        "contains": have.contains(want),
        "not_contains": ~have.contains(want),
        "starts": have.startswith(want),
        "ends": have.endswith(want),
        "equals": have == want,
        "not_equals": have != want,
    }
    return tests[f.op]


def typed(bound: float | str, c: ColumnInfo) -> Column:
    """A bound as the number that cells of the column are read as; null for text that cannot be read."""
    if not isinstance(bound, str):
        return F.lit(float(bound))
    text = F.lit(bound)
    if c.kind == "time":
        return X.parse_temporal(text, "time")
    if c.kind == "date":
        return F.coalesce(X.parse_temporal(text, c.order or "ymd"), X.parse_temporal(text, "ymd"))
    return X.parse_number(text, c.decimal_comma)


def _compare(f: CompareFilter, c: ColumnInfo) -> Column:
    """An unreadable bound compares with nothing; Spark folds the reading of a bound into a constant."""
    v, bound = c.value(), typed(f.value, c)
    if f.op == "between":
        other = bound if f.other is None else typed(f.other, c)
        return F.coalesce((v >= F.least(bound, other)) & (v <= F.greatest(bound, other)), F.lit(False))
    tests = {"=": v == bound, "!=": v != bound, ">": v > bound, ">=": v >= bound, "<": v < bound, "<=": v <= bound}
    return F.coalesce(tests[f.op], F.lit(f.op == "!="))


def predicate(f: Filter, table: Table) -> Column:
    """A cell filter as a boolean column without nulls."""
    c = table[f.column]
    if isinstance(f, (TextFilter, CompareFilter)):
        base = _text(f, c) if isinstance(f, TextFilter) else _compare(f, c)
        return base if f.blanks is None else F.when(c.blank(), F.lit(f.blanks == "add")).otherwise(base)
    if isinstance(f, ValuesFilter):
        hit = c.raw().isin(*f.values) if f.values else F.lit(False)
        if "" in f.values:
            hit = hit | c.blank()
        return ~hit if f.exclude else hit
    v = c.value()
    if isinstance(f, RangeFilter):
        hit = F.coalesce((v >= f.low) & ((v <= f.high) if f.last else (v < f.high)), F.lit(False))
        return hit | c.blank() if f.blank else hit
    if isinstance(f, OutsideFilter):
        return F.coalesce((v < f.low) | (v > f.high), F.lit(False))
    raise TypeError(f"{f} is no cell filter")


def _long_list(df: DataFrame, f: ValuesFilter, table: Table) -> DataFrame:
    """A list too long for the plan: a join with its values, broadcast by Spark's own size check."""
    c = table[f.column]
    spark = df.sparkSession
    listed = spark.createDataFrame([(v,) for v in set(f.values)], "__v string")
    raw = F.when(c.blank(), F.lit("")).otherwise(c.raw()) if "" in f.values else c.raw()
    keyed = df.withColumn("__raw", raw)
    return keyed.join(listed, F.col("__raw") == F.col("__v"), "left_anti" if f.exclude else "left_semi").drop("__raw")


def _row_digest(table: Table) -> Column:
    """A SHA-256 of all cells of a row as they are written; null and '' differ."""
    return F.sha2(F.to_json(F.struct(*[c.cell for c in table.columns])), 256)


def duplicate_groups(table: Table) -> DataFrame:
    """(first_row, n, digest): groups of equal rows (hidden columns included); copies are counted before they meet."""
    groups = table.df.groupBy(_row_digest(table).alias("digest")).agg(F.min(ROW).alias("first_row"), F.count(F.lit(1)).alias("n"))
    return groups.where("n > 1").select("first_row", "n", "digest")


def duplicate_rows(table: Table) -> DataFrame:
    """The table's rows that have a twin, with ``_group`` (the ``_row`` of the first of the group)."""
    # A key of their own: groups and rows are both dealt out for this join, which lets Spark split the rows of a large group.
    groups = duplicate_groups(table).select(F.concat("digest", F.lit("")).alias("__group"), F.col("first_row").alias("_group"))
    rows = table.df.withColumn("__digest", _row_digest(table))
    return rows.join(groups, F.col("__digest") == F.col("__group")).drop("__digest", "__group")


def _value_key(c: ColumnInfo) -> Column:
    return F.when(c.blank(), F.lit("")).otherwise(c.raw())


def apply_filters(table: Table, filters: tuple[Filter, ...] = ()) -> Table:
    """The rows that all filters keep."""
    df = table.df
    cell = [f for f in filters if not isinstance(f, (*SET_FILTERS, DuplicatesFilter))]
    short = [f for f in cell if not (isinstance(f, ValuesFilter) and len(f.values) > LISTED_VALUES)]
    if any(isinstance(f, DuplicatesFilter) for f in filters):
        df = duplicate_rows(table).drop("_group")
    if short:
        df = df.where(reduce(lambda a, b: a & b, (predicate(f, table) for f in short)))
    for f in cell:
        if f not in short:
            df = _long_list(df, f, table)
    for f in filters:
        if isinstance(f, DistinctFilter):
            c = table[f.column]
            firsts = df.groupBy(_value_key(c).alias("__v")).agg(F.min(ROW).alias("__first")).select("__first")
            df = df.join(firsts, F.col(ROW) == F.col("__first"), "left_semi")  # a hot value is one row by then
        elif isinstance(f, UniqueFilter):
            c = table[f.column]
            once = (
                df.where(~c.blank())
                .groupBy(c.raw().alias("__v"))
                .agg(F.min(ROW).alias("__only"), F.count(F.lit(1)).alias("__n"))
                .where("__n = 1")
                .select("__only")
            )
            df = df.join(once, F.col(ROW) == F.col("__only"), "left_semi")
    return table.with_df(df)


def toggle(filters: tuple[Filter, ...], f: Filter) -> tuple[Filter, ...]:
    """Without ``f`` if it is there, else with it at the end."""
    return tuple(x for x in filters if x != f) if f in filters else (*filters, f)


def replace_column(filters: tuple[Filter, ...], column: str, *new: Filter) -> tuple[Filter, ...]:
    """All filters of the column replaced."""
    return (*[f for f in filters if f.column != column], *new)


def without_column(filters: tuple[Filter, ...], column: str) -> tuple[Filter, ...]:
    """The cell filters of the other columns: what a column's own value counts honour."""
    return tuple(f for f in filters if f.column != column and not isinstance(f, SET_FILTERS))


def label(f: Filter) -> str:
    """A filter in a few characters."""
    name = f.column
    if isinstance(f, TextFilter):
        return f"{name} {f.op.replace('_', ' ')} “{f.text}”" + (f" ({f.blanks} blanks)" if f.blanks else "")
    if isinstance(f, CompareFilter):
        say = lambda x: x if isinstance(x, str) else f"{x:g}"
        if f.op == "between":
            low, high = f.value, f.value if f.other is None else f.other
            if not isinstance(low, str) and not isinstance(high, str):
                low, high = sorted((low, high))
            return f"{name} ∈ [{say(low)}, {say(high)}]"
        return f"{name} {dict([('!=', '≠'), ('>=', '≥'), ('<=', '≤')]).get(f.op, f.op)} {say(f.value)}"
    if isinstance(f, ValuesFilter):
        shown = [v or "(empty)" for v in f.values]
        if len(shown) == 1:
            return f"{name} {'≠' if f.exclude else '='} {shown[0]}"
        more = f" +{len(shown) - 3}" if len(shown) > 3 else ""
        return f"{name} {'∉' if f.exclude else '∈'} {{{', '.join(shown[:3])}{more}}}"
    if isinstance(f, RangeFilter):
        return f"{name} ∈ [{f.low:g}, {f.high:g}{']' if f.last else '['}" + (" or empty" if f.blank else "")
    if isinstance(f, OutsideFilter):
        return f"{name} < {f.low:g} or > {f.high:g}"
    if isinstance(f, DuplicatesFilter):
        return "duplicate rows"
    return f"{name}: {'one row per value' if isinstance(f, DistinctFilter) else 'values seen once'}"


def sort_keys(table: Table, column: str | None = None, descending: bool = False) -> list[Column]:
    """The keys of an order of rows: by value with unreadable cells last in both directions, text by the rules of Unicode, then by ``_row``."""
    if column is None:
        return [F.asc(ROW)]
    c = table[column]
    if c.measurable:
        return [c.value().desc_nulls_last() if descending else c.value().asc_nulls_last(), F.asc(ROW)]
    text = F.collate(_value_key(c), "UNICODE")
    return [text.desc() if descending else text.asc(), F.asc(ROW)]


def sort_rows(table: Table, column: str | None = None, descending: bool = False) -> DataFrame:
    """Rows in the order of :func:`sort_keys`."""
    return table.df.orderBy(*sort_keys(table, column, descending))


def sorted_positions(table: Table, column: str | None, descending: bool = False, rows_per_stretch: int = 1 << 16, out: str = "place") -> DataFrame:
    """All rows with their place (from 0) in the order of :func:`sort_rows`, without bringing them to one task.

    A range exchange by value and ``_row`` cuts the order into stretches of
    about ``rows_per_stretch`` rows; rows of one value are split as well.
    """
    return placed(ranged(table.df, *sort_keys(table, column, descending), size=rows_per_stretch), out)
