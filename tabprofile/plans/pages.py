"""A view in pages: rows laid out in files by their place, so that a page is read without the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import placed, positions, ranged
from .filters import sort_keys
from .table import ROW, Table

PAGE_ROWS = 20_000
#: Pages that a file holds.
PAGES_A_FILE = 10
PLACE, FILE = "_place", "_file"


@dataclass(frozen=True)
class Pages:
    """Pages of ``size`` rows of a view that :func:`lay_out` wrote to ``folder``."""

    spark: SparkSession
    folder: str
    size: int
    rows: int

    def __len__(self) -> int:
        return -(-self.rows // self.size)

    def page(self, k: int) -> DataFrame:
        """The rows of page ``k`` (from 0) in order, with ``_place``; none beyond the last.

        The file is found by its folder, the rows inside by the bounds that
        Parquet keeps of ``_place``.
        """
        if not 0 <= k < len(self):
            return self.spark.read.parquet(self.folder).where(F.lit(False)).drop(FILE)
        here = F.col(PLACE).between(k * self.size, (k + 1) * self.size - 1)
        found = self.spark.read.parquet(self.folder).where((F.col(FILE) == k // PAGES_A_FILE) & here)
        return found.drop(FILE).orderBy(PLACE)


def lay_out(table: Table, folder: str, sort: tuple[str, bool] | None = None, size: int = PAGE_ROWS) -> Pages:
    """Write the rows in the order of the view, a file for each ten pages; ``folder`` must not exist.

    Places come from a range exchange by the sort keys, so neither the order
    nor a page is ever in one task; each file is written by one task.
    """
    if sort is None:
        rows = positions(table.df, PLACE)
    else:
        rows = placed(ranged(table.df, *sort_keys(table, *sort)), PLACE)
    rows = rows.withColumn(FILE, F.floor(F.col(PLACE) / (size * PAGES_A_FILE)).cast("int"))
    n = table.df.count()
    files = max(1, -(-n // (size * PAGES_A_FILE)))
    if n == 0:
        rows.write.mode("errorifexists").parquet(folder)
    else:
        dealt = rows.repartitionByRange(files, FILE).sortWithinPartitions(FILE, PLACE)
        dealt.write.mode("errorifexists").partitionBy(FILE).parquet(folder)
    return Pages(table.df.sparkSession, folder, size, n)
