"""A session as a PySpark script that needs nothing but PySpark.

A visitor over steps and filters writes each of them as DataFrame code; the
few helpers that the lines call (reading numbers and dates, trimming, filling
along rows) are copied into the script with all that they need.
"""

from __future__ import annotations

import ast
import inspect
from types import ModuleType

from ..functions import text as X
from ..operators import order
from . import filters as FL
from . import recipe as C
from .table import ROW, ColumnInfo, Table

#: Where helpers are taken from.
MODULES: tuple[ModuleType, ...] = (X, order, C)
IMPORTS = [
    "from __future__ import annotations",
    "",
    "from decimal import ROUND_HALF_UP, Decimal",
    "",
    "import pandas as pd",
    "from pyspark.sql import Column, DataFrame, SparkSession, Window as W",
    "from pyspark.sql import functions as F",
]


def helpers(code: str) -> list[str]:
    """The source of all helpers that ``code`` names, with those that they name, in an order in which each finds the others."""
    known: dict[str, tuple[str, set[str]]] = {}
    for module in MODULES:
        source = inspect.getsource(module)
        for node in ast.parse(source).body:
            names = [node.name] if isinstance(node, ast.FunctionDef) else []
            if isinstance(node, ast.Assign):
                names = [n.id for t in node.targets for n in ast.walk(t) if isinstance(n, ast.Name)]
            used = {n.id for n in ast.walk(node) if isinstance(n, ast.Name)}
            for name in names:
                known.setdefault(name, (ast.get_source_segment(source, node), used))
    known["ROW"] = (f"ROW = {ROW!r}", set())
    chosen: list[str] = []

    def take(names: set[str]) -> None:
        for name in sorted(names & known.keys()):
            if name not in chosen:
                chosen.append(name)
                take(known[name][1])

    take({n.id for n in ast.walk(ast.parse(code)) if isinstance(n, ast.Name)})
    rank = {name: k for k, name in enumerate(["ROW", *known])}
    out: list[str] = []
    for name in sorted(chosen, key=lambda n: rank[n]):
        if known[name][0] not in out:
            out.append(known[name][0])
    return out


def cell(name: str) -> str:
    return f"F.col({f'`{name}`'!r})"


def blank(c: ColumnInfo) -> str:
    return f"is_blank({cell(c.name)})"


def value(c: ColumnInfo, of: str | None = None) -> str:
    """The number a cell stands for."""
    of = of or cell(c.name)
    if c.kind == "numeric":
        return f"parse_number({of}, {c.decimal_comma})"
    if c.kind in ("date", "time"):
        return f"parse_temporal({of}, {c.order or ('time' if c.kind == 'time' else 'ymd')!r})"
    return "F.lit(None).cast('double')"


class Script:
    """Lines over a DataFrame ``df`` with raw columns (never null) and ``_row``; kinds are those of the cleaned table."""

    def __init__(self, original: Table) -> None:
        self.table = original
        self.hidden: set[str] = set()
        self.headers = {c.name: c.title for c in original.columns}
        self.lines: list[str] = []

    def set(self, name: str, expression: str) -> None:
        self.lines.append(f"df = df.withColumn({name!r}, {expression})")

    def keep(self, condition: str) -> None:
        self.lines.append(f"df = df.where({condition})")

    def firsts(self, keys: list[str], where: str = "", having: str = "") -> None:
        """Keep the first row of each key; counts come before the join back."""
        self.lines += [
            f"firsts = df{where}.groupBy({', '.join(keys)}).agg(F.min({ROW!r}).alias('first'), F.count(F.lit(1)).alias('n')){having}.select('first')",
            f"df = df.join(firsts, F.col({ROW!r}) == F.col('first'), 'left_semi')",
        ]

    def step(self, s: C.Step) -> None:
        """The lines of one step; see :mod:`recipe`."""
        name = getattr(s, "column", None)
        c = self.table[name] if name else None
        at = cell(name) if name else ""
        if isinstance(s, C.Rename):
            self.headers[name] = s.to
        elif isinstance(s, C.Remove):
            self.hidden.add(name)
        elif isinstance(s, C.SetType):
            if s.kind != "text":
                typed = C.forced(self.table, name, s.kind)
                self.set(name, f"F.when(~{blank(c)} & {value(typed)}.isNull(), '').otherwise({at})")
        elif isinstance(s, C.Trim):
            self.set(name, f"js_trim({at})")
        elif isinstance(s, C.Clean):
            self.set(name, f"remove_controls({at})")
        elif isinstance(s, C.Case):
            how = {"lower": "F.lower", "upper": "F.upper", "title": "title_case"}[s.how]
            self.set(name, f"{how}({at})")
        elif isinstance(s, C.Replace):
            self.replace(s, at)
        elif isinstance(s, C.Empty):
            self.set(name, f"F.when(js_trim({at}).isin({list(s.tokens)!r}), '').otherwise({at})")
        elif isinstance(s, C.Merge):
            self.set(name, f"F.when({at}.isin({list(s.values)!r}), {s.to!r}).otherwise({at})")
        elif isinstance(s, C.FillValue):
            self.set(name, f"F.when({blank(c)}, {s.value!r}).otherwise({at})")
        elif isinstance(s, C.FixEncoding):
            self.set(name, f"F.coalesce(fix_mojibake({at}), {at})")
        elif isinstance(s, (C.FillDown, C.FillUp)):
            filled = f"fill(df, {at}, {blank(c)}, F.lit(True), down={isinstance(s, C.FillDown)}, out='filled')"
            self.lines.append(f"df = {filled}.withColumn({name!r}, F.col('filled')).drop('filled')")
        elif isinstance(s, C.Round):
            self.set(name, f"_rounded({c.decimal_comma}, {s.digits})({at}, {value(c)})")
        elif isinstance(s, C.RemoveDuplicates):
            self.firsts([cell(n) for n in (s.columns or self.table.names)])
        elif isinstance(s, C.DropEmpty):
            self.keep(f"~{blank(c)}")
        elif isinstance(s, C.RemoveBlankRows):
            self.keep(f"~({' & '.join(blank(x) for x in self.table.columns)})")
        elif isinstance(s, C.DropRows):
            self.lines.append(f"gone = spark.createDataFrame({[(r,) for r in sorted(set(s.rows))]!r}, 'gone long')")
            self.lines.append(f"df = df.join(gone, F.col({ROW!r}) == F.col('gone'), 'left_anti')")
        else:
            raise TypeError(f"unknown step {s}")

    def replace(self, s: C.Replace, at: str) -> None:
        if s.mode == "whole":
            self.set(s.column, f"F.when({at} == {s.old!r}, {s.new!r}).otherwise({at})")
        elif s.mode == "regex":
            if C.valid_regex(self.table, s):
                self.set(s.column, f"F.regexp_replace({at}, {s.old!r}, {C.java_replacement(s.new)!r})")
            else:
                self.lines.append(f"# {s.old!r} is no valid pattern and changes nothing")
        elif s.old:
            self.set(s.column, f"F.replace({at}, F.lit({s.old!r}), F.lit({s.new!r}))")

    def filter(self, f: FL.Filter) -> None:
        """The lines of one filter; see :mod:`filters`."""
        if isinstance(f, FL.DuplicatesFilter):
            self.lines += [
                f"df = df.withColumn('digest', F.sha2(F.to_json(F.struct({', '.join(cell(n) for n in self.table.names)})), 256))",
                "twins = df.groupBy(F.col('digest').alias('twin')).agg(F.count(F.lit(1)).alias('n')).where('n > 1').select('twin')",
                "df = df.join(twins, F.col('digest') == F.col('twin'), 'left_semi').drop('digest')",
            ]
            return
        c = self.table[f.column]
        if isinstance(f, FL.DistinctFilter):
            self.firsts([f"F.when({blank(c)}, '').otherwise({cell(c.name)})"])
        elif isinstance(f, FL.UniqueFilter):
            self.firsts([cell(c.name)], f".where(~{blank(c)})", ".where('n = 1')")
        else:
            self.keep(self.condition(f, c))

    def condition(self, f: FL.Filter, c: ColumnInfo) -> str:
        at, v = cell(c.name), value(c)
        if isinstance(f, FL.TextFilter):
            low, want = f"F.lower({at})", f"F.lower(F.lit({f.text!r}))"
            tests = {
                "contains": f"{low}.contains({want})",
                "not_contains": f"~{low}.contains({want})",
                "starts": f"{low}.startswith({want})",
                "ends": f"{low}.endswith({want})",
                "equals": f"({low} == {want})",
                "not_equals": f"({low} != {want})",
            }
            return self.blanks(f, c, tests[f.op])
        if isinstance(f, FL.CompareFilter):
            one = self.bound(f.value, c)
            if f.op == "between":
                other = one if f.other is None else self.bound(f.other, c)
                test = f"F.coalesce(({v} >= F.least({one}, {other})) & ({v} <= F.greatest({one}, {other})), F.lit(False))"
            else:
                sign = "==" if f.op == "=" else f.op
                test = f"F.coalesce({v} {sign} {one}, F.lit({f.op == '!='}))"
            return self.blanks(f, c, test)
        if isinstance(f, FL.ValuesFilter):
            hit = f"{at}.isin({list(f.values)!r})"
            hit = f"({hit} | {blank(c)})" if "" in f.values else hit
            return f"~{hit}" if f.exclude else hit
        if isinstance(f, FL.RangeFilter):
            hit = f"F.coalesce(({v} >= {f.low!r}) & ({v} {'<=' if f.last else '<'} {f.high!r}), F.lit(False))"
            return f"({hit} | {blank(c)})" if f.blank else hit
        if isinstance(f, FL.OutsideFilter):
            return f"F.coalesce(({v} < {f.low!r}) | ({v} > {f.high!r}), F.lit(False))"
        raise TypeError(f"unknown filter {f}")

    def blanks(self, f: FL.TextFilter | FL.CompareFilter, c: ColumnInfo, test: str) -> str:
        return test if f.blanks is None else f"F.when({blank(c)}, F.lit({f.blanks == 'add'})).otherwise({test})"

    def bound(self, b: float | str, c: ColumnInfo) -> str:
        if not isinstance(b, str):
            return f"F.lit({float(b)!r})"
        of = f"F.lit({b!r})"
        if c.kind == "date" and (c.order or "ymd") != "ymd":
            return f"F.coalesce({value(c, of)}, parse_temporal({of}, 'ymd'))"
        return value(c, of) if c.measurable else f"parse_number({of}, {c.decimal_comma})"

    def sort(self, column: str | None, descending: bool) -> str:
        if column is None:
            return f"F.asc({ROW!r})"
        c = self.table[column]
        way = "desc" if descending else "asc"
        if c.measurable:
            return f"{value(c)}.{way}_nulls_last(), F.asc({ROW!r})"
        return f"F.collate(F.when({blank(c)}, '').otherwise({cell(c.name)}), 'UNICODE').{way}(), F.asc({ROW!r})"


def read_lines(table: Table, path: str) -> list[str]:
    """Reading with Spark's own reader: every cell as text, quotes doubled inside quotes, ``_row`` in the order of the file."""
    options = f"header=True, sep={table.delimiter!r}, encoding={table.encoding!r}, quote='\"', escape='\"', multiLine=True, inferSchema=False, maxColumns=100000"
    cells = ", ".join(f"F.coalesce(F.col({n!r}), F.lit('')).alias({n!r})" for n in table.names)
    return [
        "spark = SparkSession.builder.getOrCreate()",
        f"df = spark.read.csv({path!r}, {options}).toDF({', '.join(repr(n) for n in table.names)})",
        f"df = df.select({cells}).withColumn({ROW!r}, F.monotonically_increasing_id())",
    ]


def script(session, path: str) -> str:
    """The session over a delimited file as a script; ``rows`` is the view in its order, under its headers.

    Steps stand in the order in which they were made.  Kinds of columns are
    decided now, on the cleaned rows, and written down.  Spark's own CSV
    reader reads the file, which leaves out empty lines and cells beyond the
    header; a quoted cell may span lines, so a file is read by one task.
    """
    original = session.original
    if any(c.stored != "raw" for c in original.columns):
        raise ValueError("a script can be written for delimited text only")
    s = Script(original)
    table = original
    for step in session.steps:
        s.step(step)
        if isinstance(step, C.SetType):
            kind = C.forced(table, step.column, step.kind) if step.kind != "text" else C.replace(table[step.column], kind="text", order=None, pinned=True)
            table = table.with_columns(kind)
            s.table = table
    s.table = session.cleaned().table
    for f in session.filters:
        if not isinstance(f, FL.SET_FILTERS):
            s.filter(f)
    for f in session.filters:
        if isinstance(f, FL.SET_FILTERS):
            s.filter(f)
    keys = s.sort(*(session.sort or (None, False)))
    shown = ", ".join(f"{cell(n)}.alias({s.headers[n]!r})" for n in original.names if n not in s.hidden)
    body = [*read_lines(original, path), *s.lines, f"rows = df.orderBy({keys}).select({shown})"]
    code = "\n".join(body)
    return "\n".join([*IMPORTS, "", *helpers(code), "", code]) + "\n"
