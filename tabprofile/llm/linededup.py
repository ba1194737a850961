"""Line dedup with a suffix array over line-ID sequences, sorted by prefix doubling (native DataFrame code).

The lines of all documents are one sequence of line ids, with an end of its
own after each document.  A suffix's rank at level k orders it by its first
2**k lines; level k + 1 follows from the ranks of a suffix and of the one
2**k lines further on.  Suffixes whose first 2**k lines occur nowhere else
drop out, so later levels hold repeated runs only.  Suffixes that agree in
their first n lines form one interval of the array with a longest common
prefix of at least n; its earliest member is the original, the others are
later copies, and the lines of a copy are deleted.

A run of lines counts once it has ``min_chars`` code points.  The shortest
such run that starts, and the shortest that ends, at each line decide
everything: together they cover exactly the maximal repeated runs that are
long enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import bits_for, forget, settle, without

#: Code points (each line with its line feed) from which a repeated run counts.
MIN_CHARS = 40
#: Ranks inside a group are summed in slices, so that no task gets all followers of a frequent line.
SLICES = 256

_AT = ["__id", "__t", "__ln"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _min_rank(counts: DataFrame, group: list[str], order: str, spread: Column) -> DataFrame:
    """Add ``__before``: rows of the group that sort before, from counts (``__n``) of equal rows.

    ``spread`` grows with ``order`` and cuts each group into slices: sums in a
    slice and sums of slices never bring a whole group's rows together.
    """
    cut = counts.withColumn("__slice", spread)
    inner = W.partitionBy(*group, "__slice").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*group).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    sums = cut.groupBy(*group, "__slice").agg(F.sum("__n").alias("__sum"))
    sums = sums.withColumn("__offset", F.coalesce(F.sum("__sum").over(outer), F.lit(0))).drop("__sum")
    return (
        cut.withColumn("__inner", F.coalesce(F.sum("__n").over(inner), F.lit(0)))
        .join(sums, [*group, "__slice"])
        .withColumn("__before", F.col("__inner") + F.col("__offset"))
        .drop("__inner", "__offset", "__slice")
    )


def _line_table(named: DataFrame, heads: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """Per line of the first documents: its place, digest, and the lengths of the shortest long enough runs from it and up to it.

    Texts are taken apart where they are read; only digests and lengths are shuffled.
    """
    lines = named.select("__id", "__t", F.posexplode(_lines(F.col(text_col))).alias("__ln", "__line")).select(
        *_AT, F.unhex(F.md5("__line")).alias("__d"), (F.length("__line") + 1).cast("long").alias("__c")
    )
    lines = lines.join(heads, ["__id", "__t"], "left_semi")
    doc = W.partitionBy("__id", "__t")
    one = lines.groupBy(*_AT).agg(F.first("__d").alias("__d"), F.first("__c").alias("__c"))
    placed = (
        one.withColumn("__end", F.sum("__c").over(doc.orderBy("__ln")))
        .withColumn("__start", F.col("__end") - F.col("__c"))
        .withColumn("__all", F.sum("__c").over(doc))
    )
    ahead = F.count(F.lit(1)).over(doc.orderBy("__start").rangeBetween(0, min_chars - 1))
    behind = F.count(F.lit(1)).over(doc.orderBy("__end").rangeBetween(1 - min_chars, 0))
    return placed.select(
        *_AT,
        "__d",
        F.when(F.col("__all") - F.col("__start") >= min_chars, ahead).cast("int").alias("__ahead"),
        F.when(F.col("__end") >= min_chars, behind).cast("int").alias("__behind"),
    )


def _first_level(lines: DataFrame) -> DataFrame:
    """Ranks by the first line, of lines that occur more than once."""
    counts = lines.groupBy("__d").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    counts = settle(counts)
    bits = bits_for(counts.count(), 4096)
    bucket = F.shiftright(F.conv(F.hex(F.substring("__d", 1, 4)), 16, 10).cast("long"), 32 - bits)
    inner = W.partitionBy("__bucket").orderBy("__d").rowsBetween(W.unboundedPreceding, -1)
    cut = counts.withColumn("__bucket", bucket)
    sums = cut.groupBy("__bucket").agg(F.sum("__n").alias("__sum"))  # at most 2**bits rows
    outer = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("__bucket").alias("__b"), F.coalesce(F.sum("__sum").over(outer), F.lit(0)).alias("__offset"))
    ranks = cut.withColumn("__inner", F.coalesce(F.sum("__n").over(inner), F.lit(0))).join(
        F.broadcast(sums), F.col("__bucket") == F.col("__b")
    )
    ranks = ranks.select("__d", (F.col("__inner") + F.col("__offset")).alias("__r"))
    return lines.join(ranks, "__d").select(*_AT, "__r")


def _next_level(level: DataFrame, step: int, rows: int) -> DataFrame:
    """Ranks by the first 2 * step lines from ranks by the first ``step``; only runs that occur more than once; settled."""
    further = level.select("__id", "__t", (F.col("__ln") - step).alias("__ln"), F.col("__r").alias("__r2"))
    paired = settle(level.join(further, _AT))
    pairs = paired.groupBy("__r", "__r2").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    width = max(1, -(-rows // SLICES))
    ranks = _min_rank(pairs, ["__r"], "__r2", F.floor(F.col("__r2") / width))
    ranks = ranks.select("__r", "__r2", (F.col("__r") + F.col("__before")).alias("__new"))
    out = settle(paired.join(ranks, ["__r", "__r2"]).select(*_AT, F.col("__new").alias("__r")))
    forget(paired)
    return out


def later_copies(lines: DataFrame) -> DataFrame:
    """Places and lengths of the shortest long enough runs that repeat an earlier one: the id, ``__t``, ``__ln``, ``__len``."""
    runs = lines.select(*_AT, F.col("__ahead").alias("__len")).where("__ahead is not null")
    ends = lines.where("__behind is not null").select(
        "__id", "__t", (F.col("__ln") - F.col("__behind") + 1).alias("__ln"), F.col("__behind").alias("__len")
    )
    runs = settle(runs.unionByName(ends).distinct())
    longest = runs.agg(F.max("__len")).first()[0] or 0
    place = F.struct(*_AT)
    level, step, found = settle(_first_level(lines)), 1, None
    while longest >= step and (rows := level.count()):
        own = runs.where(F.col("__len").between(step, 2 * step - 1))
        last = level.select(
            F.col("__id").alias("__id2"), F.col("__t").alias("__t2"), F.col("__ln").alias("__ln2"), F.col("__r").alias("__r2")
        )
        same = (
            (F.col("__id") == F.col("__id2"))
            & (F.col("__t") == F.col("__t2"))
            & (F.col("__ln") + F.col("__len") - step == F.col("__ln2"))
        )
        # The interval of a run of n lines: equal ranks of its first and of its last 2**k lines.
        members = own.join(level, _AT).join(last, same).select(*_AT, "__len", "__r", "__r2")
        key = ["__len", "__r", "__r2"]
        intervals = members.groupBy(*key).agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__n"))
        # Settled, it is a small table of its own: the join may then split the rows of a frequent line.
        intervals = settle(intervals.where("__n > 1").drop("__n"))
        copies = (
            members.withColumn("__place", place)
            .join(intervals, key)
            .where(F.col("__place") > F.col("__first"))
            .select(*_AT, "__len")
        )
        copies = settle(copies)
        found = copies if found is None else found.unionByName(copies)
        if 2 * step > longest:
            break
        before, level = level, _next_level(level, step, _span(level))
        forget(before)
        step *= 2
    return found if found is not None else runs.where(F.lit(False))


def _span(level: DataFrame) -> int:
    """Ranks lie below this."""
    return int(level.agg(F.max("__r")).first()[0] or 0) + 1


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Delete the later copies of repeated runs of lines.

    Returns the columns of ``docs``, the text without the deleted lines, plus
    ``n_lines`` and ``n_deleted`` int.  Documents are ordered by id (null ids
    last, several texts of an id by a hash of the text).  A line is deleted if
    it lies in a run of consecutive lines of at least ``min_chars`` code
    points (line feeds included) that also occurs further up in its document
    or in an earlier document.

    Documents with equal texts meet first, by digest: of a text of at least
    ``min_chars`` only the first document keeps lines, and the copies take no
    part in the sorting.  Rows equal in id and text are one document and share
    its fate.  A null text stays null and has no lines; an empty text is one
    empty line.  A document that loses all lines keeps an empty text.  An
    empty table gives an empty result; columns called like the two counts are
    replaced.
    """
    docs = without(docs, "n_lines", "n_deleted")
    kept = list(docs.columns)
    # A struct is never null and its fields compare as equal when both are: null ids need no joins of their own.
    order = F.struct(F.col(id_col).isNull().alias("null"), F.col(id_col).alias("id"))
    named = docs.withColumns({"__id": order, "__t": F.xxhash64(text_col)})
    heads = settle(
        named.where(F.col(text_col).isNotNull())
        .groupBy(F.md5(F.col(text_col)).alias("__digest"))
        .agg(F.min("__id").alias("__id"), F.first("__t").alias("__t"))  # equal texts have equal hashes
        .select("__id", "__t")
    )
    lines = settle(_line_table(named, heads, text_col, min_chars))
    gone = (
        later_copies(lines)
        .select("__id", "__t", F.explode(F.sequence("__ln", F.col("__ln") + F.col("__len") - 1)).alias("__ln"))
        .groupBy("__id", "__t")
        .agg(F.sort_array(F.collect_set("__ln")).alias("__gone"))
    )
    # All that is known about a first document in one row, so that the texts are shuffled once.
    marks = settle(heads.join(gone, ["__id", "__t"], "left").withColumn("__first", F.lit(True)))
    marked = named.join(marks, ["__id", "__t"], "left").withColumn("__lines", _lines(F.col(text_col)))
    n = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size("__lines"))
    copy = F.col("__first").isNull() & F.col(text_col).isNotNull() & (F.length(text_col) + 1 >= min_chars)
    # Lines between deleted runs, taken by slices.
    g = F.col("__gone")
    starts = F.filter(g, lambda x, i: (i == 0) | (F.get(g, i - 1) != x - 1))
    ends = F.filter(g, lambda x, i: (i == F.size(g) - 1) | (F.get(g, i + 1) != x + 1))
    from_ = F.concat(F.array(F.lit(0)), F.transform(ends, lambda x: x + 1))
    to = F.concat(starts, F.array(F.col("n_lines")))
    pieces = F.zip_with(from_, to, lambda a, b: F.slice(F.col("__lines"), a + 1, b - a))
    left = F.array_join(F.flatten(pieces), "\n")
    text = F.when(copy, F.lit("")).when(g.isNotNull(), left).otherwise(F.col(text_col))
    deleted = F.when(copy, F.col("n_lines")).when(g.isNotNull(), F.size(g)).otherwise(F.lit(0))
    done = marked.withColumn("n_lines", n).withColumn("n_deleted", deleted).withColumn("__kept", text)
    return done.select(*[F.col("__kept").alias(c) if c == text_col else F.col(f"`{c}`") for c in kept], "n_lines", "n_deleted")
