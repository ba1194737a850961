"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import re
import tempfile

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Where neither that
    setting nor a checkpoint folder exists, a folder of this machine is made
    and set, but only if all tasks run in this JVM; on a cluster it is an
    error, as the executors would not see it.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="llm-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which lost executors do not take along.

    Its files go when Spark finds that nothing refers to it any more, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as it should
    be on a cluster; :func:`forget` removes those of a round at once.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(*settled: DataFrame | None) -> None:
    """Remove the files of settled tables that nothing will read again."""
    for df in settled:
        place = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile() if df is not None else None
        if place is not None and place.isDefined():
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(place.get())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names an operator is about to produce (case-insensitive)."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def row_key(id_col: str, text_col: str) -> Column:
    """A string naming the row: its id; for a null id, a digest of its text."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("t"), F.md5(F.col(text_col))), F.lit("none"))


def hash52(*parts: Column | str) -> Column:
    """52 pseudo-random bits as a long: the first 13 hex digits of an MD5, as any SQL engine can compute them."""
    joined = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long")


def bits_for(rows: int, per_bucket: int, least: int = 8, most: int = 20) -> int:
    """Bits of a bucket number so that a bucket of ``rows`` evenly hashed rows holds about ``per_bucket``."""
    return max(least, min(most, math.ceil(math.log2(max(1, rows) / per_bucket))))


def each(values: pa.Array) -> Iterator:
    """The values one by one: a batch of long texts is never held as Python strings as a whole."""
    return (x.as_py() for x in values)


def as_batch(frame: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)
