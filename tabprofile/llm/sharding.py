"""Sharding by proportional stratified interleaving (native DataFrame code)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import bits_for, hash52, row_key, settle, without


def interleave_shards(
    docs: DataFrame,
    shards: int = 16,
    seed: str = "shard",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_per_bucket: int = 10_000,
) -> DataFrame:
    """Deal the rows into ``shards`` shards, each a picture of the source mixture.

    Returns the columns of ``docs`` plus ``shard`` (int) and ``slot`` (long,
    gapless from 0 within the shard).  Rows of a source are ranked in a seeded
    random order; all rows are sorted by fractional rank
    ``(2 rank - 1) / (2 rows of the source)``; shard ``k`` is the k-th of
    ``shards`` equal cuts of that order.  Counts of shards therefore differ by
    at most one, and a source's share of a shard by about one row.

    No source is gathered in one task: a rank is the offset of a hash bucket
    of the source plus the rank inside the bucket, and the place in the sorted
    order is found the same way from buckets of the fractional rank.

    Null sources form one source; a null id is replaced by a digest of the
    text; equal rows are ordered by a hash of their content, and which of two
    rows equal in all columns comes first cannot be told.  An empty table
    gives an empty result.  Columns called like an output column are replaced.
    """
    docs = without(docs, "shard", "slot")
    kept = list(docs.columns)
    keyed = docs.withColumn("__key", row_key(id_col, text_col)).withColumn("__at", hash52(seed, F.col("__key")))
    rows = docs.count()
    bits = bits_for(rows, rows_per_bucket)
    keyed = keyed.withColumn("__b1", F.shiftright("__at", 52 - bits)).withColumn(
        "__src", F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("none"))
    )

    # At most 2**bits rows a source, whatever its size.
    counts = keyed.groupBy("__src", "__b1").agg(F.count(F.lit(1)).alias("__size"))
    whole = W.partitionBy("__src")
    before = whole.orderBy("__b1").rowsBetween(W.unboundedPreceding, -1)
    offsets = settle(
        counts.select(
            F.col("__src").alias("__s"),
            F.col("__b1").alias("__b"),
            F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__o1"),
            F.sum("__size").over(whole).alias("__n"),
        )
    )
    if offsets.count() <= 200_000:  # about 10 MB; else joined by shuffle
        offsets = F.broadcast(offsets)
    content = F.xxhash64(*[F.col(f"`{c}`") for c in kept])
    in_bucket = W.partitionBy("__src", "__b1").orderBy("__at", "__key", "__content")
    ranked = (
        keyed.withColumn("__content", content)
        .withColumn("__r1", F.row_number().over(in_bucket))
        .join(offsets, (F.col("__src") == F.col("__s")) & (F.col("__b1") == F.col("__b")))
        .withColumn("__rank", F.col("__o1") + F.col("__r1"))
        .withColumn("__frac", (2 * F.col("__rank") - 1) / (2 * F.col("__n")))
        .withColumn("__b2", F.floor(F.col("__frac") * (1 << bits)).cast("int"))
    )
    sizes = ranked.groupBy("__b2").agg(F.count(F.lit(1)).alias("__size"))
    order = W.orderBy("__b2").rowsBetween(W.unboundedPreceding, -1)  # over at most 2**bits rows
    starts = sizes.select(F.col("__b2").alias("__c"), F.coalesce(F.sum("__size").over(order), F.lit(0)).alias("__o2"))
    place = W.partitionBy("__b2").orderBy("__frac", "__src", "__at", "__key", "__content")
    position = F.col("__o2") + F.col("__r2") - 1
    shard = F.expr(f"(__pos * {shards}L) div {max(rows, 1)}L")
    first = F.expr(f"(__shard * {rows}L + {shards - 1}L) div {shards}L")
    return (
        ranked.withColumn("__r2", F.row_number().over(place))
        .join(F.broadcast(starts), F.col("__b2") == F.col("__c"))
        .withColumn("__pos", position)
        .withColumn("__shard", shard)
        .select(*kept, F.col("__shard").cast("int").alias("shard"), (F.col("__pos") - first).alias("slot"))
    )
