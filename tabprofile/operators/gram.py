"""Correlations of all pairs of columns from mergeable moments of pairs.

A task keeps, for each two columns, the number of rows that have both values,
their means and the centred sums of squares and products: six square matrices
that matrix products of a batch bring up to date, whatever the blanks.  They
leave the task in blocks of columns and are merged block by block, so no task
adds up more than a block, and the plan does not grow with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a block: its six matrices are 200 KB.
BLOCK = 64
#: Rows that enter a matrix product at once.
ROWS = 8192
#: A sum of squares below this share of the one it is the difference from is rounding.
FLAT = 1e-13

Moments = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def moments(x: np.ndarray) -> Moments:
    """(n, mean of a, mean of b, squares of a, squares of b, products) of each pair of columns (a, b), over rows where both are no NaN."""
    have = ~np.isnan(x)
    m = have.astype(np.float64)
    some = np.maximum(m.sum(axis=0), 1)
    center = np.where(have, x, 0).sum(axis=0) / some  # near the data, so that sums of squares keep their digits
    d = np.where(have, x - center, 0)
    n = m.T @ m
    safe = np.maximum(n, 1)
    sa = d.T @ m  # of a, over the rows of the pair
    aa = (d * d).T @ m
    ab = d.T @ d
    left = aa - sa * sa / safe
    left = np.where(left <= FLAT * aa, 0, left)  # rounding of a column that is constant in the rows of the pair
    ma = center[:, None] + sa / safe
    return n, ma, ma.T, left, left.T, ab - sa * sa.T / safe


def merge(x: Moments, y: Moments) -> Moments:
    """The moments of two sets of rows together."""
    n = x[0] + y[0]
    safe = np.maximum(n, 1)
    share, weight = y[0] / safe, x[0] * y[0] / safe
    da, db = np.where(weight > 0, y[1] - x[1], 0), np.where(weight > 0, y[2] - x[2], 0)
    ma, mb = (np.where(x[0] > 0, x[k] + d * share, y[k]) for k, d in ((1, da), (2, db)))
    return n, ma, mb, x[3] + y[3] + da * da * weight, x[4] + y[4] + db * db * weight, x[5] + y[5] + da * db * weight


def pair_moments(values: DataFrame, k: int) -> DataFrame:
    """(i, j, six binary matrices) of each two blocks of columns, merged; ``values`` has ``v`` array<double> of ``k`` columns."""
    starts = range(0, k, BLOCK)
    schema = "i int, j int, m array<binary>"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Moments | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                cells = batch["v"].slice(at, ROWS).flatten()
                part = moments(cells.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, k))
                total = part if total is None else merge(total, part)
        for i in starts if total is not None else ():
            for j in starts:
                if j >= i:
                    block = [np.ascontiguousarray(t[i : i + BLOCK, j : j + BLOCK]).tobytes() for t in total]
                    yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "m": pa.array([block], pa.list_(pa.binary()))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], Moments] = {}
        for batch in batches:
            for r in batch.to_pylist():
                at = (r["i"], r["j"])
                shape = (min(BLOCK, k - at[0]), min(BLOCK, k - at[1]))
                part = tuple(np.frombuffer(b).reshape(shape) for b in r["m"])
                held[at] = merge(held[at], part) if at in held else part
        for (i, j), t in held.items():
            block = [np.ascontiguousarray(x).tobytes() for x in t]
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "m": pa.array([block], pa.list_(pa.binary()))})

    return values.mapInArrow(gather, schema).repartition("i", "j").mapInArrow(add, schema)


def correlations(values: DataFrame, names: list[str], least: int = 20) -> DataFrame:
    """(left_column, right_column, r) of each pair, in the order of the columns; see :func:`pair_moments`.

    ``r`` is null below ``least`` rows with both values or if one of the two
    is constant in them.
    """
    k = len(names)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, j, m in zip(frame["i"], frame["j"], frame["m"]):
                n, ma, mb, aa, bb, ab = (np.frombuffer(b).reshape(min(BLOCK, k - i), min(BLOCK, k - j)) for b in m)
                # Means of tasks may differ in their last bit, which is no variance.
                aa, bb = (np.where(x <= n * (1e-15 * y) ** 2, 0, x) for x, y in ((aa, ma), (bb, mb)))
                spread = np.sqrt(aa) * np.sqrt(bb)
                good = (n >= least) & (spread > 0)
                r = np.where(good, np.clip(ab / np.where(spread > 0, spread, 1), -1, 1), np.nan)
                a, b = np.meshgrid(range(i, i + r.shape[0]), range(j, j + r.shape[1]), indexing="ij")
                upper = a < b
                r = [None if np.isnan(x) else float(x) for x in r[upper]]
                yield pd.DataFrame({"left_column": [names[x] for x in a[upper]], "right_column": [names[x] for x in b[upper]], "r": pd.array(r, "Float64")})

    return pair_moments(values, k).mapInPandas(rows, "left_column string, right_column string, r double")


def as_array(columns: list[Column], out: str = "v") -> Column:
    """Numbers as one array of doubles; NaN stands for what is not there."""
    return F.array(*[F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in columns]).alias(out)
