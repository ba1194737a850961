"""Benchmark decontamination by spaced-seed hashing (native DataFrame code).

A mask of ``SPAN`` token positions keeps six and ignores four.  Every window
of a benchmark item and of a document is hashed once under each mask, so a
passage whose tokens were replaced here and there still shares a hash with
its source.  The hashes are joined; around each hit the tokens themselves are
compared along the whole item, and runs that tolerate substitutions are what
is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Which positions of a window count.  Of four masks some one is free of any two substitutions in 97 % of the
#: patterns over 14 tokens, and of any single one always.
MASKS = ("##---###-#", "#-####---#", "###-#--#-#", "#--#-#-###")
SPAN = len(MASKS[0])
#: Substituted tokens in a row that an overlap goes across, least equal tokens and least share of equal tokens.
GAP, MIN_EQUAL, MIN_SHARE = 2, 10, 0.8
#: Sources of seeds (about 100 bytes each) up to which the benchmark's side is broadcast; more meet by shuffle.
BROADCAST_SEEDS = 200_000
#: Sources from which a seed is hot: where only the documents are asked for, one of them stands for all at first.
HOT_SEED = 16


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits; none for a null text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def seed(hashes: Column, start: Column, mask: int) -> Column:
    """The hash of the window at ``start`` under a mask; the mask's number is part of it."""
    kept = [F.get(hashes, start + j) for j, c in enumerate(MASKS[mask]) if c == "#"]
    return F.xxhash64(F.lit(mask), *kept)


def windows(rows: DataFrame, kept: list[str]) -> DataFrame:
    """Explode ``__tokens`` into seeds: the kept columns, ``__at`` (start of the window) and ``__seed``.

    The token hashes are made once a row; the windows are evaluated inside
    generated code, no array of windows is ever stored.
    """
    hashed = rows.withColumn("__hashes", F.transform("__tokens", lambda t: F.xxhash64(t)))
    starts = F.when(F.size("__tokens") >= SPAN, F.sequence(F.lit(0), F.size("__tokens") - SPAN))
    at = hashed.select(*kept, "__hashes", F.explode(starts).alias("__at"))
    seeds = F.array(*[seed(F.col("__hashes"), F.col("__at"), m) for m in range(len(MASKS))])
    return at.select(*kept, "__at", F.explode(seeds).alias("__seed"))


def overlaps(equal: Column) -> Column:
    """Runs of ``equal`` (array<boolean>) that go across at most GAP false in a row.

    array<struct<start,length,equal>>.
    """
    places = F.sequence(F.lit(0), F.size(equal) - 1)

    def any_near(j: Column, step: int) -> Column:
        near = F.lit(False)
        for d in range(1, GAP + 2):
            near = near | F.coalesce(F.get(equal, j + step * d), F.lit(False))
        return near

    starts = F.filter(places, lambda j: F.get(equal, j) & ~any_near(j, -1))
    ends = F.filter(places, lambda j: F.get(equal, j) & ~any_near(j, 1))
    return F.transform(
        F.arrays_zip(starts.alias("s"), ends.alias("e")),
        lambda x: F.struct(
            x["s"].alias("start"),
            (x["e"] - x["s"] + 1).alias("length"),
            F.size(F.filter(F.slice(equal, x["s"] + 1, x["e"] - x["s"] + 1), lambda b: b)).alias("equal"),
        ),
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_equal: int = MIN_EQUAL,
    min_share: float = MIN_SHARE,
    broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """The overlaps of documents with benchmark items, the best of each pair.

    Columns: the document's id, the item's id, ``doc_start`` and
    ``item_start`` int (token numbers from 0), ``n_tokens`` int (length of the
    overlap), ``n_equal`` int.  An overlap is a run of positions on one
    diagonal that goes across at most ``GAP`` substituted tokens in a row; it
    counts with at least ``min_equal`` equal tokens that make up at least
    ``min_share`` of it.  The best of a pair has most equal tokens, then
    fewest tokens, then starts first in the document and the item.

    Null and empty texts, on either side, and items shorter than a mask (10
    tokens) match nothing.  Rows of equal id, null included, are one document
    (or one item) with several texts; repeated rows and items change nothing.
    Empty tables give an empty result; extra columns are left out.

    The documents are read once and never shuffled while the seeds of the
    benchmark have at most ``broadcast_seeds`` sources (they are counted
    first).  Beyond that the seeds meet by shuffle, the documents' hits being
    joined to their tokens afterwards; a seed that many documents share is
    split by Spark's skew join.
    """
    items, seeds = _prepared(benchmark, item_col, item_text_col)
    good = _good(_tokenised(docs, id_col, text_col), items, seeds, min_equal, min_share, broadcast_seeds)
    o = F.col("__o")
    best = good.groupBy("__id", "__item").agg(
        F.max(
            F.struct(
                o["equal"].alias("equal"),
                (-o["length"]).alias("length"),
                (-(F.col("__from") + o["start"])).alias("doc"),
                (-o["start"]).alias("item"),
            )
        ).alias("__b")
    )
    b = F.col("__b")
    return best.select(
        F.col("__id").alias(id_col),
        F.col("__item").alias(item_col),
        (-b["doc"]).alias("doc_start"),
        (-b["item"]).alias("item_start"),
        (-b["length"]).alias("n_tokens"),
        b["equal"].alias("n_equal"),
    )


def _tokenised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("__id"), tokens(F.col(text_col)).alias("__tokens"))


def _prepared(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Items (__key, __item, __tokens) and the sources of their seeds (__known, __key, __at, __length); settled."""
    items = (
        benchmark.select(F.col(item_col).alias("__item"), tokens(F.col(text_col)).alias("__tokens"))
        .where(F.size("__tokens") >= SPAN)
        .withColumn("__key", F.md5(F.concat_ws(" ", F.coalesce(F.col("__item").cast("string"), F.lit("null")), F.array_join("__tokens", " "))))
        .dropDuplicates(["__key"])
    )
    items = settle(items)
    seeds = windows(items.withColumn("__length", F.size("__tokens")), ["__key", "__length"])
    return items, settle(seeds.select(F.col("__seed").alias("__known"), "__key", "__at", "__length"))


def _good(rows: DataFrame, items: DataFrame, seeds: DataFrame, min_equal: int, min_share: float, broadcast_seeds: int) -> DataFrame:
    """(__id, __item, __from, __o): the runs along a diagonal with a hit that are long and equal enough."""
    near = _hits_by_broadcast if seeds.count() <= broadcast_seeds else _hits_by_shuffle
    sources = seeds.select("__known", F.struct("__key", "__at", "__length").alias("__s"))
    compared = near(rows, sources).join(items.select("__key", "__item", F.col("__tokens").alias("__theirs")), "__key")
    equal = F.zip_with("__ours", "__theirs", lambda a, b: F.coalesce(a == b, F.lit(False)))
    found = compared.withColumn("__equal", equal).select(
        "__id", "__item", "__from", F.explode(overlaps(F.col("__equal"))).alias("__o")
    )
    o = F.col("__o")
    return found.where((o["equal"] >= min_equal) & (o["equal"] >= min_share * o["length"]))


def _opposite(tokens_: Column, start: Column, length: Column) -> Column:
    """The document's tokens opposite to an item's: null before its start, less than ``length`` where it ends.

    Without a lambda, which generated code cannot hold: a stage would end here, and a document's tokens be kept
    once for each of its hits.
    """
    first = F.greatest(start, F.lit(0))
    before = F.array_repeat(F.lit(None).cast("string"), first - start)
    return F.concat(before, F.slice(tokens_, first + 1, length - (first - start)))


def _hits_by_broadcast(rows: DataFrame, item_seeds: DataFrame) -> DataFrame:
    """Distinct (__id, __key, __from, __ours): diagonals with a hit, the document's tokens along the item."""
    hits = (
        windows(rows, ["__id", "__tokens"])
        .join(F.broadcast(item_seeds), F.col("__seed") == F.col("__known"))
        .select("__id", "__tokens", "__at", "__s")
    )
    start = F.col("__at") - F.col("__s.__at")
    return hits.select(
        "__id",
        F.col("__s.__key").alias("__key"),
        start.alias("__from"),
        _opposite(F.col("__tokens"), start, F.col("__s.__length")).alias("__ours"),
    ).distinct()


def _hits_by_shuffle(rows: DataFrame, item_seeds: DataFrame) -> DataFrame:
    """The same without a broadcast: seeds are shuffled, and hits meet their document's tokens afterwards."""
    named = rows.withColumn("__own", F.xxhash64("__tokens"))
    hits = (
        windows(named, ["__id", "__own"])
        .join(item_seeds.hint("merge"), F.col("__seed") == F.col("__known"))
        .select(
            F.col("__id").alias("__hid"),
            F.col("__own").alias("__hown"),
            F.col("__s.__key").alias("__key"),
            F.col("__s.__length").alias("__length"),
            (F.col("__at") - F.col("__s.__at")).alias("__from"),
        )
        .distinct()
    )
    same = F.col("__id").eqNullSafe(F.col("__hid")) & (F.col("__own") == F.col("__hown"))
    return (
        hits.join(named, same)
        .select("__id", "__key", "__from", _opposite(F.col("__tokens"), F.col("__from"), F.col("__length")).alias("__ours"))
        .distinct()
    )


def contaminated_ids(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_equal: int = MIN_EQUAL,
    min_share: float = MIN_SHARE,
    broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """(``__bad``): the ids of all documents in :func:`contaminated`, without a row for each pair.

    A seed that many items share (a preamble) would bring each document
    together with each of them.  One source, the same for all documents,
    stands for such a seed at first; only documents that it does not settle
    meet the others.
    """
    items, seeds = _prepared(benchmark, item_col, item_text_col)
    source = F.struct("__key", "__at", "__length")
    per = seeds.groupBy("__known").agg(F.count(F.lit(1)).alias("__n"), F.min(source).alias("__s"))
    hot = settle(per.where(F.col("__n") > HOT_SEED).select(F.col("__known").alias("__hot"), "__s.*"))
    rare = seeds.join(hot.select("__hot"), F.col("__known") == F.col("__hot"), "left_anti")
    stand_ins = hot.select(F.col("__hot").alias("__known"), "__key", "__at", "__length")
    rows = _tokenised(docs, id_col, text_col)
    how = (min_equal, min_share, broadcast_seeds)
    bad = settle(_good(rows, items, rare.unionByName(stand_ins), *how).select(F.col("__id").alias("__bad")).distinct())
    if hot.isEmpty():
        return bad
    open_ = rows.join(bad, F.col("__id").eqNullSafe(F.col("__bad")), "left_anti")
    others = seeds.join(hot.select("__hot"), F.col("__known") == F.col("__hot"), "left_semi")
    late = _good(open_, items, others, *how).select(F.col("__id").alias("__bad")).distinct()
    return bad.unionByName(late)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without those of :func:`contaminated_ids`; a null id with a contaminated row goes as well."""
    bad = contaminated_ids(docs, benchmark, id_col, **options)
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__bad")), "left_anti")
