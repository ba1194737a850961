"""Cells of all columns in one tall table, and how often each value occurs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.table import ColumnInfo, Table

#: Types whose values a double holds exactly.
EXACT = {"tinyint", "smallint", "int", "float", "double"}


def _identity(c: ColumnInfo, dtype: str) -> Column:
    """A text that, with the value, tells different cells apart, without formatting numbers and dates that do so themselves."""
    if c.stored == "raw":
        return c.raw()
    if c.stored == "timestamp":
        return F.coalesce(F.unix_micros(c.cell.cast("timestamp")).cast("string"), F.lit(""))
    if c.stored == "date":
        return F.lit("")
    return F.when(c.value().isNull(), c.raw()).otherwise(F.lit("")) if dtype in EXACT else c.raw()


def cells(table: Table, names: list[str] | None = None, text: str | None = "shown") -> DataFrame:
    """(column, raw, blank, value) of each cell: one scan for all columns asked for.

    ``text`` None leaves ``raw`` out; ``identity`` fills it only as far as
    cells cannot be told apart by their value.  Formatting what nobody reads
    costs more than all the rest.
    """
    infos = [c for c in table.columns if names is None or c.name in names]
    if not infos:
        empty = table.df.sparkSession.createDataFrame([], "column string, raw string, blank boolean, value double")
        return empty if text else empty.drop("raw")
    types = dict(table.df.dtypes)

    def one(c: ColumnInfo) -> Column:
        raw = [(_identity(c, types[c.name]) if text == "identity" else c.raw()).alias("raw")] if text else []
        return F.struct(F.lit(c.name).alias("column"), *raw, c.blank().alias("blank"), c.value().alias("value"))

    return table.df.select(F.explode(F.array(*[one(c) for c in infos])).alias("__c")).select("__c.*")


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a table for the jobs of an operator that returns a few rows for each column; it can be computed again if parts are lost."""
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def local(rows: list, like: DataFrame) -> DataFrame:
    """A few collected rows as a table of the same schema."""
    return like.sparkSession.createDataFrame(rows, like.schema)


def only(freq: DataFrame, condition: Column) -> DataFrame:
    """Rows of a frequency table that fulfil a condition, tested after they are counted.

    A plain filter would move below the aggregation, and each reader of the
    table would then count cells of its own; so they share one exchange, and
    all that is derived from a table in one query comes from one scan.
    """
    return freq.where(F.when(condition, F.col("n")) > 0)


def frequencies(table: Table, names: list[str] | None = None, text: str = "shown") -> DataFrame:
    """(column, raw, blank, value, n): each raw value of each column with its count."""
    return cells(table, names, text).groupBy("column", "raw", "blank", "value").agg(F.count(F.lit(1)).alias("n"))
