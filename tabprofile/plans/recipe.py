"""Cleaning steps as data, and how a list of them is replayed on a table.

Nothing is removed while a recipe runs: a row that a step drops gets the
step's number, a cell that a step changes sets the step's flag.  One aggregate
over the result tells the effect of every step.  The columns for this get names
that no column of the table has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.infer import forced, infer
from ..operators.order import fill
from .table import ROW, ColumnInfo, Table

@dataclass(frozen=True)
class Rename:
    column: str
    to: str


@dataclass(frozen=True)
class Remove:
    """Hide a column; its cells still take part in comparing whole rows."""

    column: str


@dataclass(frozen=True)
class SetType:
    """Read the column as ``kind`` from here on; cells that cannot be read become empty (not for text)."""

    column: str
    kind: str


@dataclass(frozen=True)
class Trim:
    column: str


@dataclass(frozen=True)
class Clean:
    """Drop control and zero-width characters."""

    column: str


@dataclass(frozen=True)
class Case:
    """``lower``, ``upper`` or ``title``."""

    column: str
    how: str


@dataclass(frozen=True)
class Replace:
    """``whole`` cell, every place that ``contains`` the text, or every match of a ``regex`` ($1, $&, $<name>)."""

    column: str
    old: str
    new: str
    mode: str = "contains"


@dataclass(frozen=True)
class Empty:
    """Cells that, trimmed, are one of the tokens (capitals matter)."""

    column: str
    tokens: tuple[str, ...]


@dataclass(frozen=True)
class Merge:
    """Exact raw spellings to one."""

    column: str
    values: tuple[str, ...]
    to: str


@dataclass(frozen=True)
class FillValue:
    column: str
    value: str


@dataclass(frozen=True)
class FixEncoding:
    column: str


@dataclass(frozen=True)
class FillDown:
    column: str


@dataclass(frozen=True)
class FillUp:
    column: str


@dataclass(frozen=True)
class Round:
    column: str
    digits: int


@dataclass(frozen=True)
class RemoveDuplicates:
    """Keep the first row of each key: all columns, or the ones named."""

    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class DropEmpty:
    """Drop rows whose cell is blank."""

    column: str


@dataclass(frozen=True)
class RemoveBlankRows:
    """Drop rows of blank cells only, hidden columns included."""


@dataclass(frozen=True)
class DropRows:
    """Drop rows by ``_row``."""

    rows: tuple[int, ...]


Step = (
    Rename | Remove | SetType | Trim | Clean | Case | Replace | Empty | Merge | FillValue | FixEncoding
    | FillDown | FillUp | Round | RemoveDuplicates | DropEmpty | RemoveBlankRows | DropRows
)


def add_step(steps: tuple[Step, ...], step: Step) -> tuple[Step, ...]:
    """The list with one step more; a type set right after a type of the same column replaces it."""
    last = steps[-1] if steps else None
    if isinstance(step, SetType) and isinstance(last, SetType) and last.column == step.column:
        return (*steps[:-1], step)
    return (*steps, step)


def java_replacement(new: str) -> str:
    """A replacement written with $&, $$, $1 and $<name> for Java's regular expressions."""
    out, at = [], 0
    for m in re.finditer(r"\$(\$|&|<(\w+)>|\d+)|\\", new):
        out.append(new[at : m.start()])
        at = m.end()
        if m[0] == "\\":
            out.append("\\\\")
        elif m[1] == "$":
            out.append("\\$")
        elif m[1] == "&":
            out.append("$0")
        else:
            out.append(f"${{{m[2]}}}" if m[2] else m[0])
    return "".join(out) + new[at:]


def valid_regex(table: Table, step: Replace) -> bool:
    """Whether Spark takes the pattern and its replacement."""
    try:  # folded by the optimizer: an invalid pattern or group fails here
        probe = F.regexp_replace(F.lit("x"), step.old, java_replacement(step.new))
        table.df.sparkSession.range(1).select(probe).collect()
    except Exception:
        return False
    return True


def _regex(table: Table, c: Column, step: Replace) -> Column:
    """An invalid pattern is no change."""
    return F.regexp_replace(c, step.old, java_replacement(step.new)) if valid_regex(table, step) else c


def _rounded(decimal_comma: bool, digits: int):
    unit = Decimal(1).scaleb(-digits)

    @F.pandas_udf("string")
    def shown(raw: pd.Series, value: pd.Series) -> pd.Series:
        def one(text, v):
            if v is None or v != v:
                return text
            x = float(Decimal(v).quantize(unit, rounding=ROUND_HALF_UP)) if abs(v) < 1e21 else v
            s = str(int(x)) if x == int(x) and abs(x) < 1e21 else repr(x)
            return s.replace(".", ",") if decimal_comma and "," in text else s

        return pd.Series([one(t, v) for t, v in zip(raw, value)], dtype=object)

    return shown


def new_cell(table: Table, step: Step) -> Column | None:
    """The column after a step that changes cells one by one; None for other steps."""
    if not hasattr(step, "column") or isinstance(step, (Rename, Remove, DropEmpty, FillDown, FillUp)):
        return None
    info = table[step.column]
    c = info.raw() if info.stored == "raw" else info.cell
    if isinstance(step, FillValue):
        kept = F.lit(step.value) if info.stored == "raw" else F.lit(step.value).cast(table.df.schema[info.name].dataType)
        return F.when(info.blank(), kept).otherwise(c)
    if isinstance(step, Round) and info.stored == "number":
        return F.round(c, step.digits)
    if isinstance(step, Empty):
        hit = X.js_trim(info.raw()).isin(*step.tokens)
        return F.when(hit, F.lit("") if info.stored == "raw" else F.lit(None)).otherwise(c)
    if isinstance(step, SetType):
        if step.kind == "text" or info.stored != "raw":
            return c
        return F.when(~info.blank() & forced(table, info.name, step.kind).value().isNull(), F.lit("")).otherwise(c)
    if info.stored != "raw":
        return c
    if isinstance(step, Trim):
        return X.js_trim(c)
    if isinstance(step, Clean):
        return X.remove_controls(c)
    if isinstance(step, Case):
        return {"lower": F.lower, "upper": F.upper, "title": X.title_case}[step.how](c)
    if isinstance(step, Replace):
        if step.mode == "whole":
            return F.when(c == step.old, F.lit(step.new)).otherwise(c)
        if step.mode == "regex":
            return _regex(table, c, step)
        return F.replace(c, F.lit(step.old), F.lit(step.new)) if step.old else c
    if isinstance(step, Merge):
        return F.when(c.isin(*step.values), F.lit(step.to)).otherwise(c)
    if isinstance(step, FixEncoding):
        return F.coalesce(X.fix_mojibake(c), c)
    if isinstance(step, Round):
        return _rounded(info.decimal_comma, step.digits)(c, info.value())
    raise TypeError(f"unknown step {step}")


@dataclass(frozen=True)
class Cleaned:
    """A replayed recipe: all rows with flags, the columns' new state, and which are hidden."""

    table: Table
    steps: tuple[Step, ...]
    hidden: frozenset[str]
    mark: str

    def rows(self, visible_only: bool = True) -> Table:
        """The rows that are left; hidden columns are left out unless asked for."""
        shown = [c for c in self.table.columns if not (visible_only and c.name in self.hidden)]
        df = self.table.df.where(F.col(f"{self.mark}dropped").isNull()).select(*[F.col(f"`{c.name}`") for c in shown], ROW)
        return replace(self.table, df=df, columns=tuple(shown))

    def effects(self) -> DataFrame:
        """(step int, effect long): cells changed or rows dropped by each step, from one aggregate."""
        sums = []
        for k, step in enumerate(self.steps):
            own = f"{self.mark}e{k}"
            flag = F.count_if(F.col(own)) if own in self.table.df.columns else F.count_if(F.col(f"{self.mark}dropped") == k)
            sums.append(F.struct(F.lit(k).alias("step"), flag.alias("effect")))
        if not sums:
            return self.table.df.sparkSession.createDataFrame([], "step int, effect long")
        return self.table.df.agg(F.array(*sums).alias("a")).select(F.explode("a").alias("x")).select("x.*")

    def observed(self, seen: Observation) -> Table:
        """The rows that are left; the job that reads them collects the effects on its way, see :func:`observed_effects`."""
        flags = []
        for k in range(len(self.steps)):
            own = f"{self.mark}e{k}"
            hit = F.col(own) if own in self.table.df.columns else F.col(f"{self.mark}dropped") == k
            flags.append(F.count_if(hit).alias(f"e{k}"))
        df = self.table.df.observe(seen, F.count(F.lit(1)).alias("rows"), *flags)
        return replace(self, table=self.table.with_df(df)).rows()

    def output(self) -> DataFrame:
        """The visible columns under their headers."""
        left = self.rows()
        return left.df.select(*[F.col(f"`{c.name}`").alias(c.title) for c in left.columns])


def observed_effects(seen: Observation) -> tuple[int, list[int]]:
    """Rows that were read and the effect of each step, once a job has read :meth:`Cleaned.observed`; waits for it."""
    got = seen.get
    return got["rows"], [got[f"e{k}"] for k in range(len(got) - 1)]


def _drop(df: DataFrame, dropped: str, k: int, condition: Column) -> DataFrame:
    alive = F.col(dropped).isNull()
    return df.withColumn(dropped, F.when(alive & condition, F.lit(k)).otherwise(F.col(dropped)))


def apply_steps(table: Table, steps: tuple[Step, ...], infer_types: bool = False) -> Cleaned:
    """Replay all steps on the original table.

    ``infer_types`` decides the kinds of raw columns anew at the end, except
    those that a step has set.
    """
    mark = "_"
    while any(c.lower().startswith(mark) for c in table.df.columns):
        mark += "_"
    dropped, made = f"{mark}dropped", f"{mark}new"
    df = table.df.withColumn(dropped, F.lit(None).cast("int"))
    now, hidden = table.with_df(df), set()
    alive = F.col(dropped).isNull()
    for k, step in enumerate(steps):
        df = now.df
        if isinstance(step, Rename):
            now = now.with_columns(replace(now[step.column], header=step.to))
            df = df.withColumn(f"{mark}e{k}", F.lit(False))
        elif isinstance(step, Remove):
            hidden.add(step.column)
            df = df.withColumn(f"{mark}e{k}", F.lit(False))
        elif isinstance(step, DropEmpty):
            df = _drop(df, dropped, k, now[step.column].blank())
        elif isinstance(step, RemoveBlankRows):
            all_blank = F.lit(True)
            for c in now.columns:
                all_blank = all_blank & c.blank()
            df = _drop(df, dropped, k, all_blank)
        elif isinstance(step, DropRows):
            listed = df.sparkSession.createDataFrame([(r,) for r in set(step.rows)], f"{mark}gone long")
            df = df.join(listed, F.col(ROW) == F.col(f"{mark}gone"), "left")
            df = _drop(df, dropped, k, F.col(f"{mark}gone").isNotNull()).drop(f"{mark}gone")
        elif isinstance(step, RemoveDuplicates):
            key = [now[c].raw() if now[c].stored == "raw" else now[c].cell for c in (step.columns or now.names)]
            firsts = df.where(alive).groupBy(*[c.alias(f"{mark}k{i}") for i, c in enumerate(key)]).agg(F.min(ROW).alias(f"{mark}first"))
            df = df.join(firsts.select(f"{mark}first"), F.col(ROW) == F.col(f"{mark}first"), "left")
            df = _drop(df, dropped, k, F.col(f"{mark}first").isNull()).drop(f"{mark}first")
        elif isinstance(step, (FillDown, FillUp)):
            c = now[step.column]
            cell = c.raw() if c.stored == "raw" else c.cell
            df = fill(df, cell, c.blank(), alive, down=isinstance(step, FillDown), out=made)
            df = df.withColumn(f"{mark}e{k}", alive & ~F.col(made).eqNullSafe(cell))
            df = df.withColumn(c.name, F.col(made)).drop(made)
        else:
            c, new = now[step.column], new_cell(now, step)
            cell = c.raw() if c.stored == "raw" else c.cell
            if isinstance(step, SetType):
                typed = forced(now, step.column, step.kind) if step.kind != "text" else replace(c, kind="text", order=None, pinned=True)
            df = df.withColumn(made, F.when(alive, new).otherwise(cell))
            df = df.withColumn(f"{mark}e{k}", alive & ~F.col(made).eqNullSafe(cell)).withColumn(c.name, F.col(made)).drop(made)
            if isinstance(step, SetType):
                now = now.with_columns(typed)
        now = now.with_df(df)
    done = Cleaned(now, steps, frozenset(hidden), mark)
    if infer_types:
        kinds = infer(done.rows(visible_only=False))
        done = replace(done, table=replace(now, columns=kinds.columns))
    return done


def preview_effect(table: Table, step: Step) -> DataFrame:
    """What a single step would change or drop."""
    return apply_steps(table, (step,)).effects().select("effect")


def describe(step: Step) -> str:
    """A step in words."""
    on = f"“{step.column}”" if hasattr(step, "column") else ""
    words = {
        Rename: lambda s: f"Rename {on} to “{s.to}”",
        Remove: lambda s: f"Remove {on}",
        SetType: lambda s: f"Read {on} as {s.kind}",
        Trim: lambda s: f"Trim {on}",
        Clean: lambda s: f"Remove hidden characters in {on}",
        Case: lambda s: f"{s.how.capitalize()} case in {on}",
        Replace: lambda s: f"Replace {s.mode} “{s.old}” by “{s.new}” in {on}",
        Empty: lambda s: f"Treat {', '.join(s.tokens)} as empty in {on}",
        Merge: lambda s: f"Merge {len(s.values)} spellings into “{s.to}” in {on}",
        FillValue: lambda s: f"Fill empty cells of {on} with “{s.value}”",
        FixEncoding: lambda s: f"Repair the encoding of {on}",
        FillDown: lambda s: f"Fill {on} down",
        FillUp: lambda s: f"Fill {on} up",
        Round: lambda s: f"Round {on} to {s.digits} digits",
        RemoveDuplicates: lambda s: "Remove duplicate rows" + (f" by {', '.join(s.columns)}" if s.columns else ""),
        DropEmpty: lambda s: f"Drop rows without {on}",
        RemoveBlankRows: lambda s: "Remove blank rows",
        DropRows: lambda s: f"Drop {len(s.rows)} rows",
    }
    return words[type(step)](step)


def describe_effect(step: Step, effect: int) -> str:
    unit = "row" if isinstance(step, (RemoveDuplicates, DropEmpty, RemoveBlankRows, DropRows)) else "cell"
    return f"{effect:,} {unit}{'' if effect == 1 else 's'} {'dropped' if unit == 'row' else 'changed'}"
