"""A DataFrame whose columns have kinds, and the expressions that read their cells."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

ROW = "_row"
#: Headers with such a word hold identifiers, which stay text even if all cells are digits.
IDENTIFIER_WORDS = frozenset(
    "tel telephone téléphone phone mobile portable fax zip zipcode postal postcode cp siret siren iban ssn".split()
)


def is_identifier(header: str) -> bool:
    """Whether a whole word of the header names identifiers; any letter from a to z is part of a word."""
    low = header.lower()
    return any(w in IDENTIFIER_WORDS for w in re.split(r"[^a-z]+", low)) or "téléphone" in re.split(r"[^a-zé]+", low)


@dataclass(frozen=True)
class ColumnInfo:
    """Name and kind (``numeric``, ``text``, ``date``, ``time``) of a column.

    ``stored`` tells how cells are held: ``raw`` text that has to be read, or
    a ``number``, ``date`` or ``timestamp`` of Spark's own.  ``order`` is how
    raw dates are written.
    """

    name: str
    kind: str = "text"
    stored: str = "raw"
    order: str | None = None
    decimal_comma: bool = False
    header: str | None = None
    pinned: bool = False

    @property
    def title(self) -> str:
        return self.header if self.header is not None else self.name

    @property
    def cell(self) -> Column:
        return F.col(f"`{self.name}`")

    def raw(self) -> Column:
        """The cell as text, '' for null."""
        return F.coalesce(self.cell.cast("string"), F.lit(""))

    def blank(self) -> Column:
        return X.is_blank(self.cell) if self.stored == "raw" else self.cell.isNull()

    def value(self) -> Column:
        """The number a cell stands for (dates in ms since 1970, times in ms since midnight); null if it has none."""
        if self.stored == "number":
            v = self.cell.cast("double")
            return F.when(F.abs(v) < float("inf"), v)
        if self.stored == "date":
            return (F.datediff(self.cell, F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000).cast("double")
        if self.stored == "timestamp":
            return F.unix_millis(self.cell.cast("timestamp")).cast("double")
        if self.kind == "numeric":
            return X.parse_number(self.cell, self.decimal_comma)
        if self.kind in ("date", "time"):
            return X.parse_temporal(self.cell, self.order or ("time" if self.kind == "time" else "ymd"))
        return F.lit(None).cast("double")

    @property
    def measurable(self) -> bool:
        return self.kind != "text"


def _info(field: T.StructField) -> ColumnInfo | None:
    t = field.dataType
    if isinstance(t, T.NumericType):
        return ColumnInfo(field.name, "numeric", "number")
    if isinstance(t, T.DateType):
        return ColumnInfo(field.name, "date", "date", "ymd")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return ColumnInfo(field.name, "date", "timestamp", "ymd")
    if isinstance(t, (T.StringType, T.BooleanType)):
        return ColumnInfo(field.name, "text", "raw" if isinstance(t, T.StringType) else "number")
    return None


@dataclass(frozen=True)
class Table:
    """Rows with a unique, increasing long ``_row``, and what is known about each column.

    ``truncated`` says that the file has more rows than were asked for.
    """

    df: DataFrame
    columns: tuple[ColumnInfo, ...]
    delimiter: str = ","
    encoding: str = "utf-8"
    truncated: bool = False

    @classmethod
    def of(cls, df: DataFrame, row: Column | None = None, only: list[str] | None = None) -> Table:
        """A table over any DataFrame; arrays, maps and structs are outside the model and left out.

        ``row`` is a unique key in the order of the rows; without it, ``_row``
        must be a column of ``df`` wherever an operator asks for row order.
        """
        infos = [i for f in df.schema.fields if f.name != ROW and (only is None or f.name in only) and (i := _info(f))]
        keep = [F.col(f"`{i.name}`") for i in infos]
        if row is not None:
            keep.append(row.cast("long").alias(ROW))
        elif ROW in df.columns:
            keep.append(F.col(ROW))
        return cls(df.select(*keep), tuple(infos))

    def __getitem__(self, name: str) -> ColumnInfo:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(name)

    def with_df(self, df: DataFrame) -> Table:
        return replace(self, df=df)

    def with_columns(self, *changed: ColumnInfo) -> Table:
        new = {c.name: c for c in changed}
        return replace(self, columns=tuple(new.get(c.name, c) for c in self.columns))

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]
