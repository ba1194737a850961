"""Centroid clustering by exponion search, in whole numbers.

Each vector carries an upper bound of the distance to its centroid and a lower
bound of that to any other.  Where the bounds cannot tell, only the centroids
inside a ball around its own centroid are looked at: with the exact distance
``u`` and the distance ``2s`` from that centroid to its nearest other one, the
nearest and the second nearest centroid lie within ``2u + 2s`` of it.  For
each centroid the others are listed by their distance to it, so the ball is a
leading part of that list.  The radius is inclusive and bounds decide only if
they are strictly apart, so ties go to the smaller number, as in a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, settle, without

DIM, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Components up to this size keep every squared distance of up to 128 of them within 63 bits.
LARGEST = 1 << 27
#: Bounds are floats; each is moved outwards by this share, far more than its rounding.
SLACK = 1e-9
#: Vectors worked on at once in a task.
BLOCK = 4096


def whole(vector: Column, dim: int = DIM, scale: int = SCALE) -> Column:
    """array<long> of floor(scale * x); null for a vector of another length or with a null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    good = F.coalesce((F.size(vector) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
    return F.when(good, F.transform(x, lambda v: F.floor(v * scale)))


def _bounded(components: Column) -> Column:
    text = F.concat(F.lit(f"a scaled component is beyond {LARGEST}: "), F.array_join(components, ","))
    fits = F.forall(components, lambda v: F.abs(v) <= LARGEST)
    return F.when(fits, components).otherwise(F.raise_error(text).cast("array<bigint>"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The ``k`` vectors (``__id``, ``__v``) with the smallest SHA-256 of ``1:<id>``, in that order; ties by components.

    A null id counts as the text ``null``.  Fewer vectors give fewer centroids.
    """
    spot = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("__id").cast("string"), F.lit("null"))), 256)
    first = vectors.select(spot.alias("h"), "__v").orderBy("h", "__v").limit(k).collect()
    return np.array([r["__v"] for r in first], dtype=np.int64)


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid all by distance to it, itself first: their numbers, and lower bounds of the distances."""
    apart = np.sqrt(_squared(centroids[:, None, :], centroids[None, :, :]).astype(np.float64)) * (1 - SLACK)
    np.fill_diagonal(apart, -1.0)
    order = np.argsort(apart, axis=1, kind="stable")
    return order, np.take_along_axis(apart, order, axis=1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def search(v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray):
    """Nearest centroid of each vector: (own, upper, lower, scanned) after one assignment.

    ``upper`` and ``lower`` are bounds that hold for ``centroids``.
    ``scanned`` counts the distances that were computed for each vector.
    """
    own, upper, lower = own.copy(), upper.copy(), lower.copy()
    scanned = np.zeros(len(v), np.int32)
    if len(centroids) == 1:
        return own, upper, lower, scanned
    half = apart[:, 1] / 2
    open_ = np.flatnonzero(upper >= np.maximum(lower, half[own]))
    exact = np.sqrt(_squared(v[open_], centroids[own[open_]]).astype(np.float64)) * (1 + SLACK)
    upper[open_] = exact
    scanned[open_] += 1
    open_ = open_[exact >= np.maximum(lower[open_], half[own[open_]])]
    for c in np.unique(own[open_]):
        at = open_[own[open_] == c]
        ball = np.searchsorted(apart[c], (2 * upper[at] + 4 * half[c]) * (1 + SLACK), side="right")  # inclusive
        best = _squared(v[at], centroids[c])
        who = np.full(len(at), c)
        second = np.full(len(at), np.iinfo(np.int64).max)
        for place in range(1, int(ball.max())):
            inside = np.flatnonzero(ball > place)
            j = order[c, place]
            d = _squared(v[at[inside]], centroids[j])
            scanned[at[inside]] += 1
            closer = (d < best[inside]) | ((d == best[inside]) & (j < who[inside]))
            second[inside] = np.where(closer, best[inside], np.minimum(second[inside], d))
            best[inside] = np.where(closer, d, best[inside])
            who[inside] = np.where(closer, j, who[inside])
        own[at] = who
        upper[at] = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
        lower[at] = np.sqrt(second.astype(np.float64)) * (1 - SLACK)
    return own, upper, lower, scanned


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, part["__v"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def assign(state: DataFrame, centroids: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """The state after one assignment; ``moved`` (upper bounds of how far each centroid went) is None at the start."""
    k, dim = centroids.shape
    order, apart = neighbours(centroids) if k > 1 else (None, None)
    drift = None
    if moved is not None:  # the largest move among the others, for each centroid
        drift = np.array([max(np.delete(moved, c), default=0.0) for c in range(k)])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v in _blocks(batches, dim):
            own = part["__own"].to_numpy().astype(np.int64)
            if moved is None:
                upper, lower = np.full(len(v), np.inf), np.zeros(len(v))
            else:
                upper = (part["__upper"].to_numpy() + moved[own]) * (1 + SLACK)
                lower = part["__lower"].to_numpy() * (1 - SLACK) - drift[own]
            own, upper, lower, scanned = search(v, own, upper, lower, centroids, order, apart)
            new = {"__own": own.astype(np.int32), "__upper": upper, "__lower": lower, "__scanned": scanned + part["__scanned"].to_numpy()}
            yield pa.RecordBatch.from_arrays([pa.array(new[n]) if n in new else part[n] for n in part.schema.names], names=part.schema.names)

    return state.mapInArrow(step, state.schema)


def sums(state: DataFrame, k: int, dim: int) -> list[tuple[int, int, list[int]]]:
    """(cluster, count, sums of the components) of each cluster that has vectors, exact however many they are."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), object)
        for part, v in _blocks(batches, dim):
            own = part["__own"].to_numpy()
            for c in np.unique(own):
                mine = v[own == c]
                count[c] += len(mine)
                total[c] += mine.sum(axis=0)  # 4,096 times 2**27 fits; what is added up are Python's own integers
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict(
            {"c": pa.array(np.repeat(some, dim), pa.int32()), "i": pa.array(np.tile(np.arange(dim), len(some)), pa.int32()), "n": pa.array(np.repeat(count[some], dim), pa.int64()), "s": [str(x) for x in total[some].ravel()]}
        )

    parts = state.select("__own", "__v").mapInArrow(add, "c int, i int, n long, s string")
    total = parts.groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in total.collect():  # at most k * dim rows
        n, line = out.setdefault(r["c"], (r["n"], [0] * dim))
        line[r["i"]] = int(r["s"])
    return [(c, n, line) for c, (n, line) in sorted(out.items())]


def cluster(
    vectors: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    dim: int = DIM,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """Each vector with its cluster, and the final centroids (k x dim whole numbers).

    Columns: the id, ``vector`` array<long> (components in whole numbers),
    ``cluster`` int, ``distance`` long (squared) and ``scanned`` int, the
    distances that the search computed over all rounds.  Settled.

    Vectors that are null, of another length than ``dim`` or with a null or
    non-finite component are left out.  Centroids start as the ``k`` vectors
    of the least hash of the id (:func:`first_centroids`); each round assigns
    all vectors and replaces each centroid that has vectors by the floor of
    their mean; then all are assigned once more.  Ties go to the smaller
    number.  Repeated rows, ids and vectors count each; a null id is an id.
    With fewer vectors than ``k`` there are as many centroids as vectors; an
    empty table gives an empty result.  Extra columns are left out.  A
    component beyond 2**27 after scaling is an error, since squared distances
    would not fit a long.

    A round is one pass over the vectors with their bounds, whose result is
    settled, and one of sums, of which k * dim come from each task.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).alias("__id"), whole(F.col(vector_col), dim, scale).alias("__v")).where("__v is not null")
    kept = kept.select("__id", _bounded(F.col("__v")).cast("array<int>").alias("__v"))
    zero = [F.lit(0).alias("__own"), F.lit(0.0).alias("__upper"), F.lit(0.0).alias("__lower"), F.lit(0).alias("__scanned")]
    state = settle(kept.select("__id", "__v", *zero))
    centroids = first_centroids(state, k)
    if not len(centroids):
        schema = T.StructType([T.StructField(id_col, vectors.schema[id_col].dataType)])
        none = spark.createDataFrame([], schema)
        return none.select(id_col, *[F.lit(None).cast(t).alias(n) for n, t in (("vector", "array<bigint>"), ("cluster", "int"), ("distance", "long"), ("scanned", "int"))]), np.zeros((0, dim), np.int64)
    moved = None
    for at in range(rounds + 1):
        new = settle(assign(state, centroids, moved))
        forget(state)
        state = new
        if at < rounds:
            after = centroids.copy()
            for c, n, line in sums(state, len(centroids), dim):
                after[c] = [s // n for s in line]
            moved = np.sqrt(_squared(centroids, after).astype(np.float64)) * (1 + SLACK)
            centroids = after
    lines = F.array(*[F.array(*[F.lit(int(x)) for x in line]) for line in centroids])
    apart = F.zip_with(F.col("__v"), F.get(lines, F.col("__own")), lambda a, b: (a.cast("long") - b) * (a.cast("long") - b))
    distance = F.aggregate(apart, F.lit(0).cast("long"), lambda s, x: s + x)
    out = state.select(F.col("__id").alias(id_col), F.col("__v").cast("array<bigint>").alias("vector"), F.col("__own").alias("cluster"), distance.alias("distance"), F.col("__scanned").alias("scanned"))
    return out, centroids


def with_inertia(clustered: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add ``cluster_inertia`` and ``inertia`` long (sums of ``distance``) and ``centroid_sha256`` of the final components."""
    per = clustered.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    sums_ = {r["cluster"]: int(r["s"]) for r in per.collect()}  # a row a centroid
    names = [",".join(str(int(x)) for x in line) for line in centroids]
    rows = [(c, sums_.get(c, 0), sum(sums_.values()), names[c]) for c in range(len(names))]
    facts = clustered.sparkSession.createDataFrame(rows, "__c int, cluster_inertia long, inertia long, __line string")
    facts = facts.withColumn("centroid_sha256", F.sha2("__line", 256)).drop("__line")
    kept = without(clustered, "cluster_inertia", "inertia", "centroid_sha256")
    return kept.join(F.broadcast(facts), F.col("cluster") == F.col("__c")).drop("__c")  # a row a centroid
