"""What all panels show under a set of filters, from one scan.

Each row gets a bit for each column whose filters it fails.  A cell counts for
the view if no bit is set, and for the counts of its own column if no other
column's bit is.  One aggregate over the cells of all columns has both counts
of each value; profiles, histograms, rankings and the counts under "all
filters but its own" are read from that table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.freq import local
from . import filters as FL
from .table import ROW, Table


class Facets:
    """Held counts of all values; a context manager, as the table of values is kept until it ends.

    ``names`` limits the columns.  Filters of whole sets of rows (duplicates,
    one row per value, values seen once) and lists too long for a plan count
    by a join; those of one row per value and of values seen once do not count
    for a column's own counts.
    """

    def __init__(self, table: Table, filters: tuple[FL.Filter, ...], names: list[str] | None = None) -> None:
        self.table = table
        self.names = [c.name for c in table.columns if names is None or c.name in names]
        self.held = self._counted(filters).persist()

    def __enter__(self) -> Facets:
        return self

    def __exit__(self, *_) -> None:
        self.held.unpersist()

    def _counted(self, filters: tuple[FL.Filter, ...]) -> DataFrame:
        """(column, raw, blank, value, n, own): counts in the view, and under the filters of the other columns."""
        table = self.table
        sets = [f for f in filters if isinstance(f, FL.SET_FILTERS)]
        twins = [f for f in filters if isinstance(f, FL.DuplicatesFilter)]
        long_ = [f for f in filters if isinstance(f, FL.ValuesFilter) and len(f.values) > FL.LISTED_VALUES]
        by_column: dict[str, list] = {}
        for f in filters:
            if f not in sets and f not in twins:
                by_column.setdefault(f.column, []).append(f)
        df = FL.duplicate_rows(table).drop("_group") if twins else table.df
        for k, f in enumerate(long_):
            hit = FL.apply_filters(table, (f,)).df.select(F.col(ROW).alias(f"__r{k}"))
            df = df.join(hit, F.col(ROW) == F.col(f"__r{k}"), "left").withColumn(f"__l{k}", F.col(f"__r{k}").isNotNull()).drop(f"__r{k}")
        if sets:
            alive = FL.apply_filters(table, filters).df.select(F.col(ROW).alias("__alive"))
            df = df.join(alive, F.col(ROW) == F.col("__alive"), "left")
        passes = {}
        for column, own in by_column.items():
            tests = [F.col(f"__l{long_.index(f)}") if f in long_ else FL.predicate(f, table) for f in own]
            passes[column] = reduce(lambda a, b: a & b, tests)
        fails = F.array(*[F.when(~p, F.lit(c)) for c, p in passes.items()]) if passes else F.array().cast("array<string>")
        seen = F.col("__alive").isNotNull() if sets else F.lit(True)
        df = df.withColumn("__f", F.array_compact(fails)).withColumn("__seen", (F.size("__f") == 0) & seen).where("size(__f) < 2")

        def one(name: str):
            c = table[name]
            mine = (F.size("__f") == 0) | (F.get("__f", F.lit(0)) == name)
            return F.struct(F.lit(name).alias("column"), c.raw().alias("raw"), c.blank().alias("blank"), c.value().alias("value"), F.col("__seen").alias("seen"), mine.alias("own"))

        cells = df.select(F.explode(F.array(*[one(n) for n in self.names])).alias("c")).select("c.*").where("seen or own")
        return cells.groupBy("column", "raw", "blank", "value").agg(F.count_if("seen").alias("n"), F.count_if("own").alias("own"))

    def _view(self) -> DataFrame:
        return self.held.where("n > 0").drop("own")

    def profile(self) -> DataFrame:
        """As :func:`profile.profile` has it for the view."""
        return P.profile_of(self._view(), self.table, self.names)

    def histogram(self, bins: int = P.BINS) -> DataFrame:
        """As :func:`profile.histogram` has it for the view."""
        out = P._histogram(self._view().where(F.col("value").isNotNull()), bins)
        return local(out.collect(), out)

    def top_values(self, k: int = P.TOP_VALUES) -> DataFrame:
        """As :func:`profile.top_values` has it for the view."""
        out = P.top_of(self._view(), k)
        return local(out.collect(), out)

    def value_counts(self, column: str) -> DataFrame:
        """(value, n) of a column under the filters of the other columns; to be read before the facets end."""
        own = self.held.where((F.col("column") == column) & (F.col("own") > 0))
        return own.groupBy(F.col("raw").alias("value")).agg(F.sum("own").alias("n")).orderBy(F.desc("n"), "value")
