"""Work along an order of rows without bringing them all to one task.

Along ``_row``, rows are cut into stretches by that number.  Along any other
order, a range exchange deals them out by the whole sort key, which Spark
samples for its bounds, so neither crowded nor equal keys meet in one task.
Each stretch is worked on alone; what passes from one to the next (a count,
the last cell with content) is a table of one row a stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..plans.durable import settle
from ..plans.table import ROW

#: Rows a stretch spans, as counted by ``_row``.
STRETCH = 1 << 16


def _stretch(row: Column, size: int) -> Column:
    return F.floor(row / size)


def positions(df: DataFrame, out: str = "_pos", size: int = STRETCH) -> DataFrame:
    """Add the gapless position (from 0) by ``_row``."""
    cut = df.withColumn("__s", _stretch(F.col(ROW), size))
    sums = cut.groupBy("__s").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__s").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(F.col("__s").alias("__t"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    rank = F.row_number().over(W.partitionBy("__s").orderBy(ROW))
    return (
        cut.withColumn("__r", rank)
        .join(offsets, F.col("__s") == F.col("__t"))
        .withColumn(out, F.col("__o") + F.col("__r") - 1)
        .drop("__s", "__t", "__o", "__r")
    )


def ranged(df: DataFrame, *keys: Column, keep: list[Column] | None = None, size: int = STRETCH) -> DataFrame:
    """All rows in the order of the keys: ``_part`` numbers the stretches in order, ``_at`` the rows inside from 0.

    The keys have to tell all rows apart (so ``_row`` is the last of them);
    then the bounds of the exchange split rows of equal leading keys as well.
    ``keep`` limits the columns.  Settled, since another run would draw other
    bounds.
    """
    dealt = df.repartitionByRange(max(1, -(-df.count() // size)), *keys).sortWithinPartitions(*keys)
    dealt = dealt.select(*keep) if keep else dealt
    place = F.monotonically_increasing_id()  # the partition in the upper 31 bits, the row in it below
    return settle(dealt.withColumn("__i", place)).withColumns({"_part": F.shiftright("__i", 33), "_at": F.col("__i").bitwiseAND((1 << 33) - 1)}).drop("__i")


def placed(dealt: DataFrame, out: str = "_pos") -> DataFrame:
    """The rows of :func:`ranged` with their gapless position (from 0) in place of stretch and number."""
    sums = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a stretch
    offsets = sums.select(F.col("_part").alias("__t"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    return dealt.join(offsets, F.col("_part") == F.col("__t")).withColumn(out, F.col("__o") + F.col("_at")).drop("_part", "_at", "__t", "__o")


def neighbours(dealt: DataFrame, *carried: str, by: str | None = None) -> DataFrame:
    """The rows of :func:`ranged` with ``before`` and ``after``: structs of the ``carried`` columns of the rows on either side.

    Null at the ends, and with ``by`` (the leading key) where that differs.
    """
    whole = F.struct(*([by] if by else []), *carried)
    ends = dealt.groupBy("_part").agg(F.min_by(whole, "_at").alias("__first"), F.max_by(whole, "_at").alias("__last"))
    order = W.orderBy("_part")  # a row a stretch
    ends = ends.select(F.col("_part").alias("__t"), F.lag("__last").over(order).alias("__prior"), F.lead("__first").over(order).alias("__next"))
    near = W.partitionBy("_part").orderBy("_at")
    found = dealt.join(ends, F.col("_part") == F.col("__t"))
    found = found.withColumns({"before": F.coalesce(F.lag(whole).over(near), "__prior"), "after": F.coalesce(F.lead(whole).over(near), "__next")})
    if by:
        found = found.withColumns({x: F.when(F.col(f"{x}.{by}") == F.col(by), F.col(x)) for x in ("before", "after")})
    return found.drop("_part", "_at", "__t", "__prior", "__next")


def fill(df: DataFrame, cell: Column, blank: Column, alive: Column, down: bool = True, out: str = "_filled", size: int = STRETCH) -> DataFrame:
    """Add ``cell`` with blank cells replaced by the last one with content above (below if not ``down``).

    Rows that are not ``alive`` neither give nor take.  Cells without anything
    above (below) stay as they are.
    """
    cut = df.withColumn("__s", F.when(alive, _stretch(F.col(ROW), size))).withColumn("__v", F.when(alive & ~blank, cell))
    place = F.struct(F.col(ROW).alias("r"), F.col("__v").alias("v"))
    found = F.when(F.col("__v").isNotNull(), place)
    edge = cut.where("__s is not null").groupBy("__s").agg((F.max(found) if down else F.min(found)).alias("__e"))
    before = W.orderBy(F.col("__s") if down else F.desc("__s")).rowsBetween(W.unboundedPreceding, -1)
    carried = edge.select(F.col("__s").alias("__t"), F.last("__e.v", ignorenulls=True).over(before).alias("__c"))
    inner = W.partitionBy("__s").orderBy(ROW if down else F.desc(ROW)).rowsBetween(W.unboundedPreceding, 0)
    own = F.last("__v", ignorenulls=True).over(inner)
    dead = cut.where("__s is null").withColumn(out, cell).drop("__s", "__v")
    live = (
        cut.where("__s is not null")
        .withColumn("__own", own)
        .join(carried, F.col("__s") == F.col("__t"), "left")
        .withColumn(out, F.coalesce("__own", "__c", cell))
        .drop("__s", "__v", "__own", "__t", "__c")
    )
    return live.unionByName(dead)
