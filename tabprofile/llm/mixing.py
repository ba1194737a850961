"""Mixing sources to target weights by Poisson replication (native DataFrame code)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import bits_for, hash52, row_key, settle, without

#: One inversion serves means up to this; a larger mean is a sum of so many equal draws, which is again Poisson.
MEAN_PER_DRAW = 32.0
#: Sources up to this number are broadcast with their tables (each under 2 KB); more are joined by shuffle.
BROADCAST_SOURCES = 4096


def _cdf(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable, up to where doubles no longer grow."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    first = F.exp(-mean)

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(
            p.alias("p"), (acc["sum"] + p).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + p)).alias("all")
        )

    start = F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])


def repetition_rates(docs: DataFrame, weights: dict | None, total: int | None, source_col: str) -> DataFrame:
    """Per source: rows, mean repetition rate and the inverse-CDF table of one draw.

    ``weights`` maps source to target weight (any positive scale; a source it
    leaves out gets 0); None weighs all sources alike.  The mean rate is
    ``total * share / rows``; ``total`` defaults to the number of rows.
    """
    counts = docs.groupBy(F.col(source_col).alias("__src")).agg(F.count(F.lit(1)).alias("__n"))
    if weights is None:
        weighed = counts.withColumn("__w", F.lit(1.0))
    else:
        spark = docs.sparkSession
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "__k string, __w double")
        weighed = counts.join(F.broadcast(given), F.col("__src").eqNullSafe(F.col("__k")), "left").select(
            "__src", "__n", F.coalesce("__w", F.lit(0.0)).alias("__w")
        )
    weighed = settle(weighed)
    sums = weighed.agg(F.sum("__w"), F.sum("__n")).first()
    weight_sum, rows = sums[0] or 1.0, sums[1] or 0
    goal = float(rows if total is None else total)
    mean = F.col("__w") * goal / (F.lit(float(weight_sum)) * F.col("__n"))
    draws = F.greatest(F.lit(1), F.ceil(mean / MEAN_PER_DRAW)).cast("int")
    return (
        weighed.withColumn("__mean", mean)
        .withColumn("__draws", draws)
        .withColumn("__cdf", _cdf(F.col("__mean") / F.col("__draws")))
    )


def mix_sources(
    docs: DataFrame,
    weights: dict | None = None,
    total: int | None = None,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_per_bucket: int = 20_000,
) -> DataFrame:
    """Repeat each document by a seeded Poisson count and shuffle all copies globally.

    Returns the columns of ``docs`` plus ``n_copies`` (int), ``copy`` (int,
    from 1) and ``position`` (long, gapless from 0: the place in the global
    shuffle).  The count inverts the Poisson distribution whose mean is the
    source's target repetition rate at a hash of seed and id, so any engine
    or rerun makes the same draw.

    Every source with a hot share is only counted, never gathered: the rates
    are a small table joined by broadcast (by shuffle beyond
    ``BROADCAST_SOURCES``).  The global order is by a hashed key whose leading
    bits deal the rows into even buckets; a row's position is its bucket's
    offset plus its rank in the bucket.

    Null sources form one source.  A null id is replaced by a digest of the
    text; rows of equal id draw the same count and lie side by side in an
    order set by their content.  Null and empty texts are documents like any other; an empty table
    gives an empty result.  Columns of ``docs`` called like an output column
    are replaced.
    """
    docs = without(docs, "n_copies", "copy", "position")
    rates = settle(repetition_rates(docs, weights, total, source_col))
    stats = rates.agg(F.count(F.lit(1)), F.sum(F.col("__mean") * F.col("__n"))).first()
    n_sources, expected = stats[0], int(stats[1] or 0)
    rates = rates.select("__src", "__draws", "__cdf")
    if n_sources <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)

    def draw(j: Column) -> Column:
        u = hash52(seed, F.col("__key"), j.cast("string")) / F.lit(float(1 << 52))
        return F.size(F.filter(F.col("__cdf"), lambda c: c <= u))

    count = F.aggregate(F.sequence(F.lit(1), F.col("__draws")), F.lit(0), lambda acc, j: acc + draw(j))
    kept = [c for c in docs.columns]
    bits = bits_for(expected, rows_per_bucket)
    copies = (
        docs.withColumn("__key", row_key(id_col, text_col))
        .join(rates, F.col(source_col).eqNullSafe(F.col("__src")), "inner")
        .withColumn("n_copies", count)
        .where("n_copies > 0")
        .select(*kept, "__key", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
        .withColumn("__at", hash52(seed + "/shuffle", F.col("__key"), F.col("copy").cast("string")))
        .withColumn("__bucket", F.shiftright("__at", 52 - bits))
    )
    sizes = copies.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__size"))  # at most 2**bits rows
    before = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("__bucket").alias("__b"), F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset")
    )
    content = F.xxhash64(*[F.col(f"`{c}`") for c in kept])
    place = W.partitionBy("__bucket").orderBy("__at", "__key", "copy", "__content")
    return (
        copies.withColumn("__content", content)
        .withColumn("__rank", F.row_number().over(place))
        .join(F.broadcast(offsets), F.col("__bucket") == F.col("__b"))
        .select(*kept, "n_copies", "copy", (F.col("__offset") + F.col("__rank") - 1).alias("position"))
    )
