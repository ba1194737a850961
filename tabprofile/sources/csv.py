"""Delimited text to tables and back, by Spark's text reader and writer.

Lines are read in splits, wherever the file lies.  Which line starts a record
depends on all quotes before it; a line acts on "inside quotes or not" in one
of four ways (leaves it, flips it, or sets either), so the state before each
line follows from the last line that sets it and the number of flips since.
That is a running aggregate along lines, taken in blocks with a carry.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions.infer import infer
from ..functions.text import CP1252_BYTES, CP1252_SPECIALS, js_trim
from ..plans.table import ROW, ColumnInfo, Table

DELIMITERS = (",", ";", "\t", "|")
LINE = "_line"
#: Lines that a record may span.
MAX_RECORD_LINES = 100_000


def detect_encoding(spark: SparkSession, path: str) -> str:
    """``utf-16le`` or ``utf-16be`` by its mark, ``utf-8`` if all lines are valid, else ``windows-1252``."""
    mark = _head(spark, path, 2)
    if mark in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16le" if mark[0] == 0xFF else "utf-16be"
    raw = spark.read.text(path)  # lines of all kinds; a cut never parts a character
    valid = raw.agg(F.bool_and(F.is_valid_utf8("value")).alias("v")).first()["v"]
    return "utf-8" if valid is None or valid else "windows-1252"


def _counts(lines: list[str], delimiter: str) -> list[int]:
    counts, inside, now = [], False, 0
    for line in lines:
        for part in re.findall(r'"|[^"]+', line):
            if part == '"':
                inside = not inside
            elif not inside:
                now += part.count(delimiter)
        if not inside:
            counts.append(now)
            now = 0
    return counts + [now] if now else counts


def detect_delimiter(lines: list[str], most: int = 20) -> str:
    """The candidate that occurs, outside quotes, in the first line and most evenly in the next ones."""
    best, best_score = DELIMITERS[0], -1.0
    for d in DELIMITERS:
        counts = _counts(lines, d)[:most]
        if counts and counts[0]:
            score = counts[0] + 100 * counts.count(counts[0]) / len(counts)
            if score > best_score:
                best, best_score = d, score
    return best


def _head(spark: SparkSession, path: str, size: int = 1 << 20) -> bytes:
    """The first bytes of a file, through Spark's file systems; of the first file of a folder."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((f.getPath().toString() for f in files.globStatus(place) or [] if f.isFile()), key=str)
    if not found:
        found = sorted(f.getPath().toString() for f in files.listStatus(place) if f.isFile() and not f.getPath().getName().startswith(("_", ".")))
    if not found:
        return b""
    stream = files.open(jvm.org.apache.hadoop.fs.Path(found[0]))
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def _whole_units(rows: DataFrame, separator: str) -> DataFrame:
    """Lines of two-byte units, cut at a separator's two bytes: cuts that fell between two units are mended.

    ``rows`` has (``__b``, ``__i``, ``raw``).  A wrong cut leaves an odd number
    of bytes on both sides, so a line of odd length goes on to the next one of
    odd length.  Files without such lines stay as they are.
    """
    odd = F.octet_length("raw") % 2 == 1
    if rows.where(odd).isEmpty():
        return rows
    flips = rows.groupBy("__b").agg(F.count_if(odd).alias("__n"))
    before = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    flips = flips.select(F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    here = W.partitionBy("__b").orderBy("__i")
    seen = F.sum(odd.cast("int")).over(here.rowsBetween(W.unboundedPreceding, 0))
    placed = rows.withColumn("__k", seen).join(F.broadcast(flips), F.col("__b") == F.col("__c")).withColumn("__k", F.col("__k") + F.col("__o"))
    inside = (F.col("__k") - odd.cast("int")) % 2 == 1  # an odd line before has not ended
    parts = placed.where(inside | odd).withColumn("__g", F.floor((F.col("__k") - odd.cast("int") + 1 + (~inside).cast("int")) / 2))
    one = F.sort_array(F.collect_list(F.struct("__b", "__i", F.hex("raw").alias("x"))))
    mark = separator.encode().hex().upper()
    joined = parts.groupBy("__g").agg(one.alias("p")).select(
        F.col("p")[0]["__b"].alias("__b"), F.col("p")[0]["__i"].alias("__i"), F.unhex(F.array_join(F.transform("p", lambda x: x["x"]), mark)).alias("raw")
    )
    return placed.where(~inside & ~odd).select("__b", "__i", "raw").unionByName(joined)


def read_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(_line long from 1, text, end): the lines of a file in order, without the byte order mark.

    A line ends with a line feed or a lone carriage return, which ``end``
    tells; the carriage return of CRLF stays at the end of the text.  The
    file is read in splits at line feeds, or at carriage returns if its first
    megabyte has no line feed.
    """
    wide = {"utf-16le": "\n\0", "utf-16be": "\0\n"}.get(encoding)
    head = _head(spark, path)
    feed, back = ("\n\0", "\r\0") if encoding == "utf-16le" else ("\0\n", "\0\r") if wide else ("\n", "\r")
    lone = feed.encode() not in head and back.encode() in head
    cut, end, other = (back, "\r", "\n") if lone else (feed, "\n", "\r")
    raw = spark.read.option("lineSep", cut).text(path)
    block = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    placed = raw.select(block.alias("__b"), F.monotonically_increasing_id().alias("__i"), F.col("value").cast("binary").alias("raw"))
    if wide:
        text = F.decode("raw", encoding.upper())
        placed = _whole_units(placed, cut)
    elif encoding == "windows-1252":
        text = F.translate(F.decode("raw", "ISO-8859-1"), CP1252_BYTES, CP1252_SPECIALS)
    else:
        text = F.col("raw").cast("string")
    # Lines that end in the other way: several in a row of the reader.
    parts = F.split(text, r"\r(?!$)" if other == "\r" else r"\n")
    placed = placed.select("__b", "__i", parts.alias("parts"))
    sums = placed.groupBy("__b").agg(F.sum(F.size("parts")).alias("__n"))
    before = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # a row for each split of the file
    offsets = sums.select(F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    upto = F.sum(F.size("parts")).over(W.partitionBy("__b").orderBy("__i").rowsBetween(W.unboundedPreceding, 0))
    numbered = placed.withColumn("__r", upto - F.size("parts")).join(offsets, F.col("__b") == F.col("__c"))
    each = numbered.select((F.col("__o") + F.col("__r") + 1).alias("__f"), F.size("parts").alias("__k"), F.posexplode("parts").alias("p", "text"))
    line = (F.col("__f") + F.col("p")).cast("long")
    shown = F.when(line == 1, F.regexp_replace("text", r"^\x{FEFF}", "")).otherwise(F.col("text"))
    return each.select(line.alias(LINE), shown.alias("text"), F.when(F.col("p") < F.col("__k") - 1, other).otherwise(end).alias("end"))


def raw_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(_line, text): the file as it is, without carriage returns at line ends."""
    return read_lines(spark, path, encoding).select(LINE, F.regexp_replace("text", r"\r$", "").alias("text"))


def _field(d: str) -> str:
    """A field: quoted (what follows the closing quote belongs to it), or anything that does not begin with a quote."""
    e = re.escape(d)
    return rf'(?:"[^"]*+(?:""[^"]*+)*+"[^{e}]*+|[^"{e}][^{e}]*+|)'


def _along(df: DataFrame, size: int = 1 << 16) -> DataFrame:
    """Add ``__before``: whether the line begins inside quotes, from ``__set`` (0, 1 or null) and ``__flip`` (0 or 1)."""
    cut = df.withColumn("__s", F.floor(F.col(LINE) / size))
    here = W.partitionBy("__s").orderBy(LINE)
    cut = cut.withColumn("__f", F.sum("__flip").over(here.rowsBetween(W.unboundedPreceding, 0)))
    # State after a line: what the last setting line set, turned by the flips since.
    seed = F.when(F.col("__set").isNotNull(), (F.col("__set") + F.col("__f")) % 2)
    cut = cut.withColumn("__seed", F.last(seed, ignorenulls=True).over(here.rowsBetween(W.unboundedPreceding, -1)))
    cut = cut.withColumn("__g", F.coalesce(F.sum("__flip").over(here.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ends = cut.groupBy("__s").agg(
        F.sum("__flip").alias("__flips"), F.max(F.when(seed.isNotNull(), F.struct(F.col(LINE), seed.alias("v")))).alias("__e")
    )
    order = W.orderBy("__s")
    ends = ends.withColumn("__all", F.sum("__flips").over(order.rowsBetween(W.unboundedPreceding, 0)))
    # As if counted from the file's start: a block's setting, in terms of all flips so far.
    whole = F.when(F.col("__e").isNotNull(), (F.col("__e.v") + F.col("__all") - F.col("__flips")) % 2)
    prior = order.rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(
        F.col("__s").alias("__t"),
        ((F.coalesce(F.last(whole, ignorenulls=True).over(prior), F.lit(0)) + F.coalesce(F.sum("__flips").over(prior), F.lit(0))) % 2).alias("__carry"),
    )
    state = (F.coalesce("__seed", "__carry") + F.col("__g")) % 2
    return cut.join(ends, F.col("__s") == F.col("__t")).withColumn("__before", state == 1).drop("__s", "__t", "__f", "__g", "__seed", "__carry")


def read_records(lines: DataFrame, delimiter: str) -> DataFrame:
    """(_line, fields array<string>): records by RFC 4180, blank lines skipped, ``_line`` where each begins.

    A quote opens a field only at its start, a doubled quote inside quotes is
    one quote, text after the closing quote is appended.  A carriage return
    before the end of the record's line belongs to the line end.  A record of
    more than ``MAX_RECORD_LINES`` lines, as a quote that is never closed
    makes it, fails the job and names the line that it begins in.  ``lines``
    may have an ``end``; without one, lines end with a line feed.
    """
    if "end" not in lines.columns:
        lines = lines.withColumn("end", F.lit("\n"))
    f, e = _field(delimiter), re.escape(delimiter)
    text = F.col("text")
    tail = rf"{f}(?:{e}{f})*+\r?$"
    out_stays = text.rlike(rf"^{tail}")
    in_ends = text.rlike(rf'^[^"]*+(?:""[^"]*+)*+"[^{e}]*+(?:{e}{tail}|$)')
    set_ = F.when(out_stays & in_ends, 0).when(~out_stays & ~in_ends, 1)
    flip = F.when(~out_stays & in_ends, 1).otherwise(0)
    state = _along(lines.withColumn("__set", set_).withColumn("__flip", flip))
    # Lines inside quotes belong to the last line that is not.
    cut = state.withColumn("__s", F.floor(F.col(LINE) / (1 << 16)))
    here = W.partitionBy("__s").orderBy(LINE).rowsBetween(W.unboundedPreceding, 0)
    own = F.last(F.when(~F.col("__before"), F.col(LINE)), ignorenulls=True)
    carry = cut.groupBy("__s").agg(F.max(F.when(~F.col("__before"), F.col(LINE))).alias("__m"))
    prior = W.orderBy("__s").rowsBetween(W.unboundedPreceding, -1)
    carry = carry.select(F.col("__s").alias("__t"), F.max("__m").over(prior).alias("__c"))
    starts = cut.withColumn("__o", own.over(here)).join(carry, F.col("__s") == F.col("__t")).withColumn("__start", F.coalesce("__o", "__c"))
    long = F.concat(F.lit("the record of line "), F.col("__start").cast("string"), F.lit(f" has more than {MAX_RECORD_LINES} lines: is a quote not closed?"))
    start = F.when(F.col(LINE) - F.col("__start") < MAX_RECORD_LINES, F.col("__start")).otherwise(F.raise_error(long).cast("long"))
    starts = starts.withColumn("__start", start)  # told before anything is gathered
    whole = starts.groupBy("__start").agg(F.sort_array(F.collect_list(F.struct(F.col(LINE), "text", "end"))).alias("__l"))
    record = F.array_join(F.transform("__l", lambda x, k: F.when(k < F.size("__l") - 1, F.concat(x["text"], x["end"])).otherwise(x["text"])), "")
    record = F.regexp_replace(record, r"\r$", "")
    # A delimiter before each field: a match without any character would pass over what follows it.
    # A quote that is never closed holds what is left.
    open_ = rf'"[^"]*+(?:""[^"]*+)*+(?:"[^{e}]*+|$)'
    parts = F.regexp_extract_all(F.concat(F.lit(delimiter), record), F.lit(rf'{e}({open_}|[^"{e}][^{e}]*+|[^{e}]*)'), F.lit(1))

    def bare(x: Column) -> Column:
        quoted = F.regexp_extract(x, r'^"([^"]*+(?:""[^"]*+)*+)(?:"|$)', 1)
        rest = F.regexp_replace(x, r'^"[^"]*+(?:""[^"]*+)*+(?:"|$)', "")
        return F.when(x.startswith('"'), F.concat(F.replace(quoted, F.lit('""'), F.lit('"')), rest)).otherwise(x)

    fields = F.transform(parts, bare)
    out = whole.select(F.col("__start").alias(LINE), fields.alias("fields"))
    return out.where(~((F.size("fields") == 1) & (F.col("fields")[0] == "")))


def read_csv(
    spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, max_rows: int | None = None, types: bool = True
) -> Table:
    """A file as a table of raw text columns ``c0``, ``c1``, ... with ``_row`` (from 0) and inferred kinds.

    The first record has the headers: trimmed, ``column N`` where blank.
    Short records are filled up with empty cells, fields too many are left
    out.  ``max_rows`` cuts the table, which then says that it is ``truncated``
    if there were more rows; ``_line`` is the line of the file.  A file
    without records gives a table without columns.
    """
    from ..operators.order import positions

    encoding = encoding or detect_encoding(spark, path)
    lines = read_lines(spark, path, encoding)
    if delimiter is None:
        head = [r["text"] for r in lines.where(F.col(LINE) <= 60).orderBy(LINE).collect()]
        delimiter = detect_delimiter(head)
    records = read_records(lines, delimiter)
    first = records.orderBy(LINE).first()
    headers = [re.sub(r"^\s+|\s+$", "", h) or f"column {k + 1}" for k, h in enumerate(first["fields"])] if first else []
    body = records.where(F.col(LINE) > (first[LINE] if first else 0))
    cells = [F.coalesce(F.get("fields", F.lit(k)), F.lit("")).alias(f"c{k}") for k in range(len(headers))]
    rows = positions(body.select(*cells, F.col(LINE).alias(ROW), F.col(LINE).alias("__line")), "__pos")
    rows = rows.withColumn(ROW, F.col("__pos")).withColumnRenamed("__line", LINE).drop("__pos")
    truncated = max_rows is not None and not rows.where(F.col(ROW) == max_rows).isEmpty()
    if max_rows is not None:
        rows = rows.where(F.col(ROW) < max_rows)
    infos = tuple(ColumnInfo(f"c{k}", header=h, decimal_comma=delimiter == ";") for k, h in enumerate(headers))
    table = Table(rows, infos, delimiter, encoding, truncated)
    return infer(table) if types and headers else table


def raw_segments(line: Column, delimiter: str) -> Column:
    """A line in pieces, array<struct<text,column>>: fields by number, separators as column -1; joined they give the line."""
    e = re.escape(delimiter)
    both = rf'((?:[^"{e}]++|"(?:[^"]++|"")*+(?:"|$))*+)({e}|$)'
    fields, ends = (F.regexp_extract_all(line, F.lit(both), F.lit(k)) for k in (1, 2))
    piece = lambda text, column: F.struct(text.alias("text"), column.alias("column"))
    own = F.transform(fields, lambda x, k: piece(x, k.cast("int")))
    pairs = F.zip_with(own, ends, lambda x, y: F.array(x, piece(y, F.lit(-1))))
    return F.filter(F.flatten(pairs), lambda x: x["text"] != "")


def _quoted(cell: Column, delimiter: str) -> Column:
    needs = cell.contains(delimiter) | cell.rlike('["\r\n]') | (cell != js_trim(cell))
    return F.when(needs, F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def csv_lines(table: Table, delimiter: str | None = None, header: bool = True) -> DataFrame:
    """(_row, line): the rows as delimited text, the header as row -1; quoted only where needed."""
    d = delimiter or table.delimiter
    cells = [_quoted(c.raw(), d) for c in table.columns]
    lines = table.df.select(F.col(ROW), F.concat_ws(d, *cells).alias("line"))
    if not header:
        return lines
    spark = table.df.sparkSession
    top = spark.createDataFrame([(-1, [c.title for c in table.columns])], f"{ROW} long, h array<string>")
    top = top.select(ROW, F.array_join(F.transform("h", lambda x: _quoted(x, d)), d).alias("line"))
    return top.unionByName(lines)


def write_csv(table: Table, path: str, delimiter: str | None = None) -> None:
    """Write the rows in order; the part files, one after another, are one CSV file in UTF-8."""
    lines = csv_lines(table, delimiter).orderBy(ROW).select("line")
    lines.write.mode("errorifexists").option("lineSep", "\n").text(path)


def clean_copy_name(name: str, attempt: int = 1) -> str:
    """``name.clean.csv``, ``name.clean-2.csv``, ..."""
    base = re.sub(r"\.csv$", "", name, flags=re.IGNORECASE)
    return f"{base}.clean{f'-{attempt}' if attempt > 1 else ''}.csv"


def save_clean_copy(table: Table, path: str, attempts: int = 100) -> str:
    """Write beside the original under the first free name; nothing is overwritten."""
    for k in range(1, attempts + 1):
        target = clean_copy_name(path, k)
        try:
            write_csv(table, target)
            return target
        except AnalysisException as problem:
            if "ALREADY_EXISTS" not in (problem.getCondition() or ""):
                raise
    raise FileExistsError(path)


def selected_rows_text(table: Table, rows: list[int]) -> DataFrame:
    """(_row, line): chosen rows, tab separated, without a header."""
    listed = table.df.sparkSession.createDataFrame([(r,) for r in rows], f"{ROW} long")
    return csv_lines(replace(table, df=table.df.join(F.broadcast(listed), ROW, "left_semi")), "\t", header=False)
