"""Types of raw columns, decided from the distinct values that are present."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.table import ColumnInfo, Table, is_identifier
from . import text as X


def readability(freq: DataFrame, decimal_comma: bool) -> DataFrame:
    """Per column, over present values: how many cells each reader reads, and whether it reads all of them.

    Columns: present, numbers, ymd, dmy, time (cells), all_numbers, all_ymd,
    all_dmy, all_time, day_above_12, leading_zero (booleans), date_with_time.
    """
    raw, n = F.col("raw"), F.col("n")
    number = X.parse_number(raw, decimal_comma).isNotNull()
    reads = {k: X.parse_temporal(raw, k).isNotNull() for k in ("ymd", "dmy", "time")}
    day = F.regexp_extract(X.js_trim(raw), r"^(\d{1,2})", 1).try_cast("int")
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    return freq.where("not blank").groupBy("column").agg(
        F.sum("n").alias("present"),
        total(number).alias("numbers"),
        *[total(c).alias(k) for k, c in reads.items()],
        F.bool_and(number).alias("all_numbers"),
        *[F.bool_and(c).alias(f"all_{k}") for k, c in reads.items()],
        F.bool_or(reads["dmy"] & (day > 12)).alias("day_above_12"),
        F.bool_or(X.js_trim(raw).rlike(r"^0\d")).alias("leading_zero"),
        F.bool_or(raw.contains(":")).alias("with_time"),
    )


def decide(row, header: str) -> tuple[str, str | None]:
    """(kind, order) from a row of :func:`readability`; None: a column without present values is text."""
    if row is None or not row["present"]:
        return "text", None
    if row["all_ymd"]:
        return "date", "ymd"
    if row["all_time"]:
        return "time", "time"
    if row["all_dmy"] and row["day_above_12"]:  # else days and months cannot be told apart
        return "date", "dmy"
    if is_identifier(header) or row["leading_zero"]:
        return "text", None
    return ("numeric", None) if row["all_numbers"] else ("text", None)


def infer(table: Table) -> Table:
    """The table with kinds for its raw columns; one job for all, pinned columns keep theirs."""
    from ..operators.freq import frequencies

    raw = [c for c in table.columns if c.stored == "raw" and not c.pinned]
    if not raw:
        return table
    as_text = table.with_columns(*[replace(c, kind="text", order=None) for c in raw])
    comma = table.delimiter == ";"
    rows = {r["column"]: r for r in readability(frequencies(as_text, [c.name for c in raw]), comma).collect()}  # one a column
    new = []
    for c in raw:
        kind, order = decide(rows.get(c.name), c.title)
        new.append(replace(c, kind=kind, order=order, decimal_comma=comma))
    return table.with_columns(*new)


def forced(table: Table, name: str, kind: str) -> ColumnInfo:
    """The column read as ``kind``; for a date the order that reads most cells (``ymd`` when equal)."""
    c = table[name]
    if c.stored != "raw" or kind != "date":
        return replace(c, kind=kind, order="time" if kind == "time" else None, decimal_comma=table.delimiter == ";", pinned=True)
    from ..operators.freq import frequencies

    as_text = table.with_columns(replace(c, kind="text", order=None))
    row = readability(frequencies(as_text, [name]), table.delimiter == ";").first()
    order = "dmy" if row and row["dmy"] > row["ymd"] else "ymd"
    return replace(c, kind="date", order=order, pinned=True)
