"""Spellings of the same value: `Lyon`, `lyon `, `Lyons`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.table import Table
from .freq import frequencies, held, local

#: Columns with more different spellings are left out, as the rule below is meant for lists of names.
MAX_DISTINCT = 2500
#: Keys of this many characters may differ in one edit, of ``LONG_KEY`` in two, if one value is this much more frequent.
SHORT_KEY, LONG_KEY, FACTOR = 4, 9, 3


def _limit(key: Column) -> Column:
    return F.when(F.length(key) >= LONG_KEY, 2).otherwise(1)


def _candidates(table: Table, names: list[str] | None) -> DataFrame:
    """(column, raw, n, key) of the values that take part."""
    names = [c.name for c in table.columns if c.kind == "text" and c.stored == "raw" and (names is None or c.name in names)]
    raw = F.col("raw")
    f = frequencies(table, names).where(
        ~F.col("blank") & (F.length(X.js_trim(raw)) >= 2) & ~raw.rlike(r"\d") & X.fix_mojibake(raw).isNull()
    )
    return f.select("column", "raw", "n", X.loose_key(raw).alias("key")).where(F.length("key") >= 2)


def skipped_columns(table: Table, names: list[str] | None = None) -> DataFrame:
    """(column, spellings): the columns that :func:`similar_spellings` leaves out because they have too many."""
    sizes = _candidates(table, names).groupBy("column").agg(F.count(F.lit(1)).alias("spellings"))
    return sizes.where(F.col("spellings") > MAX_DISTINCT)


def _near_keys(keys: DataFrame) -> DataFrame:
    """(column, have, key): for each key the other ones of its column within its limit of edits.

    A key within k edits holds one of k + 1 pieces of the other one, moved by
    k places at most; only keys that meet in a piece are compared.
    """
    keys = keys.select("column", "key").where(F.length("key") >= SHORT_KEY)

    def piece(text: Column, length: Column, k: Column, limit: Column, move: Column | int) -> Column:
        start = F.floor(k * length / (limit + 1))
        return F.substring(text, (start + 1 + move).cast("int"), (F.floor((k + 1) * length / (limit + 1)) - start).cast("int"))

    size = F.length("key")
    own = keys.withColumn("k", F.explode(F.sequence(F.lit(0), _limit(F.col("key"))))).select(
        "column", "key", "k", size.alias("size"), piece(F.col("key"), size, F.col("k"), _limit(F.col("key")), 0).alias("piece")
    )
    # What a key of each possible length would find in this one.
    sizes = keys.withColumn("size", F.explode(F.sequence(F.length("key") - 2, F.length("key") + 2))).where(F.col("size") >= SHORT_KEY)
    sizes = sizes.withColumn("limit", F.when(F.col("size") >= LONG_KEY, 2).otherwise(1))
    tries = sizes.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("limit")))).withColumn("move", F.explode(F.sequence(-F.col("limit"), F.col("limit"))))
    place = F.floor(F.col("k") * F.col("size") / (F.col("limit") + 1)) + F.col("move")
    tries = tries.where(place >= 0).select(
        "column", F.col("key").alias("have"), "k", "size", piece(F.col("key"), F.col("size"), F.col("k"), F.col("limit"), F.col("move")).alias("piece")
    )
    met = own.join(tries.distinct(), ["column", "k", "size", "piece"]).where("have <> key").select("column", "have", "key").distinct()
    limit = F.when(F.length("key") >= LONG_KEY, F.levenshtein("have", "key", 2)).otherwise(F.levenshtein("have", "key", 1))
    return met.where(limit >= 0)  # -1: more than the limit


def similar_spellings(table: Table, names: list[str] | None = None) -> DataFrame:
    """(column, canonical, canonical_n, value, n): rarer spellings of more frequent values, per text column.

    Values with digits, of less than two characters or with damaged encoding
    take no part.  From the most frequent value down, each joins the first
    group whose key (no accents, capitals, punctuation) is the same, or, from
    four characters on, one or (from nine characters) two edits away if the
    group is three times as frequent; else it opens a group.  Columns with more
    than ``MAX_DISTINCT`` spellings are left out: :func:`skipped_columns`.

    Only the most frequent value of a key can open a group.  Whether it does
    depends on those before it, so this is settled in rounds: who has an open
    group before it joins, who has only joined ones before it opens.
    """
    by = W.partitionBy("column").orderBy(F.desc("n"), "raw")  # at most MAX_DISTINCT rows
    f = _candidates(table, names)
    few = f.groupBy("column").agg(F.count(F.lit(1)).alias("__d")).where(F.col("__d").between(2, MAX_DISTINCT))
    bounded = f.join(F.broadcast(few.select("column")), "column", "left_semi").withColumn("rank", F.row_number().over(by))
    with held(bounded) as v:
        first = F.struct("rank", "raw", "n")
        firsts = v.groupBy("column", "key").agg(F.min(first).alias("f")).select("column", "key", "f.*")
        groups = firsts.select("column", F.col("key").alias("have"), F.col("rank").alias("g"), F.col("raw").alias("canonical"), F.col("n").alias("canonical_n"))
        frequent = (F.col("canonical_n") >= FACTOR * F.col("n")) & (F.col("g") < F.col("rank"))
        near = groups.join(_near_keys(firsts), ["column", "have"]).join(v, ["column", "key"]).where(frequent)
        same = groups.withColumnRenamed("have", "key").join(v, ["column", "key"]).where("g < rank")
        cols = ["column", "g", "canonical", "canonical_n", "rank", "raw", "n"]
        with held(near.select(*cols).unionByName(same.select(*cols))) as edges:
            opens = _open(firsts.select("column", "rank"), edges.select("column", "g", "rank"))
            joined = edges.join(opens, ["column", "g"]).groupBy("column", "rank").agg(
                F.min(F.struct("g", "canonical", "canonical_n", F.col("raw").alias("value"), "n")).alias("h")
            )
            out = joined.select("column", "h.canonical", "h.canonical_n", "h.value", "h.n")
            return local(out.collect(), out)


def _open(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(column, g) of the values that open a group; at most MAX_DISTINCT a column pass between the rounds."""
    edges = edges.join(nodes, ["column", "rank"], "left_semi")
    state = nodes.select("column", "rank", F.lit(None).cast("boolean").alias("open"))
    state = local(state.collect(), state)
    while not state.where("open is null").isEmpty():
        before = edges.join(state.select("column", F.col("rank").alias("g"), F.col("open").alias("__open")), ["column", "g"])
        seen = before.groupBy("column", "rank").agg(F.bool_or("__open").alias("some"), F.count_if(F.col("__open").isNull()).alias("unknown"))
        now = F.coalesce("open", F.when(F.col("some"), F.lit(False)).when(F.coalesce("unknown", F.lit(0)) == 0, F.lit(True)))
        state = state.join(seen, ["column", "rank"], "left").select("column", "rank", now.alias("open"))
        state = local(state.collect(), state)
    return state.where("open").select("column", F.col("rank").alias("g"))


def spelling_report(table: Table, names: list[str] | None = None, shown: int = 8) -> DataFrame:
    """The ``shown`` columns with most variant rows: each variant made visible, and how it differs.

    Columns of equal variant rows go by name; a table without variants gives no rows.
    """
    found = similar_spellings(table, names)
    first = found.groupBy("column").agg(F.sum("n").alias("variants")).orderBy(F.desc("variants"), "column").limit(shown)
    return found.join(F.broadcast(first), "column").select(
        "column",
        "variants",
        X.js_trim(F.col("canonical")).alias("target"),
        X.visible_text(F.col("value")).alias("shown"),
        "n",
        X.difference(X.js_trim(F.col("canonical")), F.col("value")).alias("kinds"),
    )
