"""Sessions as PySpark code that uses this package: reading, renames, cleaning, filters (whole sets last), sorting."""

from __future__ import annotations

from dataclasses import fields

from . import filters as FL
from .recipe import Remove, Rename


def call(module: str, item) -> str:
    """A step or filter as the call that makes it, default values left out."""
    args = [f"{f.name}={getattr(item, f.name)!r}" for f in fields(item) if f.init and f.repr and getattr(item, f.name) != f.default]
    return f"{module}.{type(item).__name__}({', '.join(args)})"


def read_lines(path: str, delimiter: str, encoding: str) -> list[str]:
    return [
        "from pyspark.sql import SparkSession",
        "from tabprofile.plans import filters as F, recipe as C",
        "from tabprofile.sources.csv import read_csv",
        "",
        "spark = SparkSession.builder.getOrCreate()",
        f"table = read_csv(spark, {path!r}, delimiter={delimiter!r}, encoding={encoding!r})",
    ]


def step_lines(steps) -> list[str]:
    """Renames, then removals, then cleaning, each in the order given; positions never shift, so the result is the same."""
    ordered = [s for s in steps if isinstance(s, Rename)] + [s for s in steps if isinstance(s, Remove)]
    ordered += [s for s in steps if not isinstance(s, (Rename, Remove))]
    if not ordered:
        return []
    return ["table = C.apply_steps(table, (", *[f"    {call('C', s)}," for s in ordered], "), infer_types=True).rows()"]


def filter_lines(filters) -> list[str]:
    ordered = [f for f in filters if not isinstance(f, FL.SET_FILTERS)] + [f for f in filters if isinstance(f, FL.SET_FILTERS)]
    if not ordered:
        return []
    return ["table = F.apply_filters(table, (", *[f"    {call('F', f)}," for f in ordered], "))"]


def session_lines(session, path: str) -> list[str]:
    t = session.original
    lines = read_lines(path, t.delimiter, t.encoding) + step_lines(session.steps) + filter_lines(session.filters)
    args = f", {session.sort[0]!r}, descending={session.sort[1]}" if session.sort else ""
    return [*lines, f"rows = F.sort_rows(table{args})"]
