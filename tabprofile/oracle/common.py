"""What the query modules share: tables by name, and SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.table import Table

Query = Callable[[SparkSession, str], DataFrame]

#: The row key of each table, in both engines' words.
ROW_KEYS = {
    "lineitem": ("l_orderkey * 8 + l_linenumber", "l_orderkey * 8 + l_linenumber"),
    "orders": ("o_orderkey", "o_orderkey"),
    "events": ("event_id", "event_id"),
    "customer": ("c_custkey", "c_custkey"),
    "part": ("p_partkey", "p_partkey"),
    "supplier": ("s_suppkey", "s_suppkey"),
    "documents": ("doc_id", "doc_id"),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str, only: list[str] | None = None, extra: dict[str, Column] | None = None) -> Table:
    """A driver table with its natural key as ``_row``; ``extra`` adds derived columns."""
    df = read(spark, sf_dir, name)
    if extra:
        df = df.withColumns(extra)
    return Table.of(df, F.expr(ROW_KEYS[name][0]), only)


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


class Registry:
    """Collects queries with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None):
        def take(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return take
