"""SimHash near-duplicates with the generalised pigeonhole principle.

Fingerprints of 64 bits that differ in at most ``radius`` bits are linked.
The bits are grouped into a few partitions, correlated bits together.  If the
partitions' thresholds t_i (-1: not looked at) sum to ``radius - partitions +
1``, any linked pair agrees within t_i bits in some partition i.  Each
fingerprint gets thresholds of its own, by dynamic programming over the
estimated number of candidates that each choice would bring; it then probes
an index of partition values with all values within its thresholds, and the
pairs found are verified.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_batch, bits_for, each, forget, settle, without

BITS = 64
SEED = 42
#: Bits of a partition whose value frequencies are counted: at most 2**16 counts a partition reach the driver.
SKETCH_BITS = 16
#: Up to this many different fingerprints three partitions are cheapest, beyond it two.
THREE_PARTITIONS_UP_TO = 1 << 24
#: Ids (about 100 bytes each) up to which they are broadcast.
BROADCAST_IDS = 200_000
#: A probe costs about this many candidates.
PROBE_COST = 0.1
#: Texts beyond which a shingle is hot (counted by the leading bits of its hash), and longs of a parity map.
HOT_FROM, MAPS = 32, 8

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_CHUNK = 1 << 16
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, shingle: int = 3, distinct: bool = False) -> int:
    """The unsigned 64-bit SimHash of a text; 0 for a text without words.  ``distinct`` counts each shingle once."""
    words = (text or "").encode().translate(_LOWER).split()  # bytes.split: 0x20 and 0x09-0x0D
    if not words:
        return 0
    if distinct:
        grams = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [tuple(words)]
        h = np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in set(grams)], dtype="<u8")
        n_all, ones = len(h), np.zeros(BITS, dtype=np.int64)
        for at in range(0, n_all, _CHUNK):
            ones += np.unpackbits(h[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(np.packbits((2 * ones > n_all).astype(np.uint8), bitorder="little").view("<u8")[0])
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        part = words[at : min(at + _CHUNK, n) + shingle - 1]
        shingles = zip(*(part[k:] for k in range(shingle))) if len(words) >= shingle else [words]
        h = np.array([digest(b" ".join(s), SEED) for s in shingles], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def with_fingerprints(
    docs: DataFrame, text_col: str = "text", shingle: int = 3, out: str = "fp", distinct: bool = False
) -> DataFrame:
    """Add the fingerprint as a (signed) long column ``out``."""

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, shingle, distinct) for t in each(texts)], dtype=np.uint64).view(np.int64))

    return without(docs, out).withColumn(out, fp(F.col(text_col)))


def bit_groups(joint: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Group bits: start with the strongest pair left, then add the bit most correlated with the group."""
    share = np.diag(joint) / max(n, 1)
    cov = joint / max(n, 1) - np.outer(share, share)
    dev = np.sqrt(np.clip(share * (1 - share), 1e-12, None))
    corr = np.abs(cov / np.outer(dev, dev))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        inner = corr[np.ix_(free, free)]
        i, j = np.unravel_index(np.argmax(inner), inner.shape)
        group = [free[i]] + ([free[j]] if i != j else [])
        while len(group) < size:
            left = [b for b in free if b not in group]
            group.append(left[int(np.argmax(corr[np.ix_(left, group)].sum(axis=1)))])
        groups.append(sorted(group[:size]))
        free = [b for b in free if b not in groups[-1]]
    return groups


def gather_bits(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint, as an integer."""
    out = np.zeros(len(fps), dtype=np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def ball_counts(counts: np.ndarray, bits: int, radius: int) -> np.ndarray:
    """For each value v and t <= radius: how many items have a value at distance t of v, exactly."""
    at = np.zeros((radius + 1, 1 << bits))
    at[0] = counts
    values = np.arange(1 << bits)
    for b in range(bits):
        for t in range(radius, 0, -1):
            at[t] = at[t] + at[t - 1][values ^ (1 << b)]
    return at


def estimates(counts: np.ndarray, bits: int, width: int, radius: int) -> np.ndarray:
    """Candidates within t of a value, t = 0..radius, for each value of the ``bits`` counted ones of ``width`` bits.

    The bits that are not counted are taken to be evenly spread.
    """
    ball = ball_counts(counts, bits, radius)
    rest = width - bits
    shell = [1.0]
    for i in range(radius):
        shell.append(shell[-1] * (rest - i) / (i + 1))
    within = np.cumsum(shell) / 2.0**rest
    return np.stack([sum(ball[j] * within[t - j] for j in range(t + 1)) for t in range(radius + 1)])


def probes_within(width: int, radius: int) -> list[np.ndarray]:
    """Masks of at most t bits, t = 0..radius."""
    shells = [
        np.array([sum(1 << b for b in c) for c in combinations(range(width), t)], dtype=np.uint64)
        for t in range(radius + 1)
    ]
    return [np.concatenate(shells[: t + 1]) for t in range(radius + 1)]


def allocate(costs: list[np.ndarray], radius: int) -> np.ndarray:
    """Thresholds per fingerprint and partition with the least cost.

    ``costs[i][u, k]`` is the cost for fingerprint k of spending u units on
    partition i, that is of threshold u - 1 (0 units: not looked at); the
    units of all partitions add up to ``radius + 1``.  Dynamic programming
    over partitions and units spent so far, for all fingerprints at once.
    """
    n, units = costs[0].shape[1], radius + 1
    best = np.full((units + 1, n), np.inf)
    best[0] = 0
    choice = np.zeros((len(costs), units + 1, n), dtype=np.int8)
    for i, cost in enumerate(costs):
        new = np.full((units + 1, n), np.inf)
        for spent in range(units + 1):
            for u in range(spent + 1):
                total = best[spent - u] + cost[u]
                better = total < new[spent]
                new[spent] = np.where(better, total, new[spent])
                choice[i, spent] = np.where(better, u, choice[i, spent])
        best = new
    out, left, rows = np.zeros((len(costs), n), dtype=np.int8), np.full(n, units), np.arange(n)
    for i in range(len(costs) - 1, -1, -1):
        out[i] = choice[i, left, rows]
        left = left - out[i]
    return out - 1


def partitions_for(n: int, radius: int) -> int:
    """How many partitions cost least for ``n`` evenly spread fingerprints: a probe is shuffled, a candidate compared."""

    def cost(parts: int) -> float:
        widths = [BITS // parts + (k < BITS % parts) for k in range(parts)]
        spare = radius - parts + 1
        limits = [spare // parts + (k >= parts - spare % parts) for k in range(parts)]
        probes = [sum(math.comb(w, d) for d in range(t + 1)) for w, t in zip(widths, limits)]
        return sum(30 * p + n * p / 2.0**w for w, p in zip(widths, probes))

    return min(range(2, min(4, radius + 1) + 1), key=cost) if radius else 1


def links(
    fps: DataFrame,
    radius: int = 3,
    col: str = "fp",
    parts: int | None = None,
    order: str | None = None,
    of: DataFrame | None = None,
    firsts: bool = False,
) -> DataFrame:
    """Pairs (a, b), a before b, of different fingerprints that differ in at most ``radius`` bits; each pair once.

    ``fps`` holds each fingerprint once and is read several times, so it
    should be a settled table.  Before is by the unique long ``order``, or by
    the fingerprint itself.  ``of`` limits b to some of the fingerprints;
    with ``firsts`` only the first a of each index entry that b probes is looked at.
    """
    wanted = [F.col(col).alias("fp"), F.col(order or col).alias("o")]
    spark, fps = fps.sparkSession, fps.select(*wanted)
    of = fps if of is None else of.select(*wanted)
    n = fps.count()
    parts = parts or (3 if n <= THREE_PARTITIONS_UP_TO else 2)
    pack = lambda batch: batch["fp"].to_numpy(np.int64).view(np.uint64)

    def co_occurrence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        joint = np.zeros((BITS, BITS))
        for batch in batches:
            x = np.unpackbits(pack(batch).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            joint += x.T @ x
        yield pd.DataFrame({"cell": np.arange(BITS * BITS), "n": joint.astype(np.int64).ravel()})

    cells = fps.mapInPandas(co_occurrence, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    joint = np.zeros(BITS * BITS)
    joint[cells["cell"]] = cells["n"]
    groups = bit_groups(joint.reshape(BITS, BITS), n, parts)
    share = np.diag(joint.reshape(BITS, BITS)) / max(n, 1)
    counted = [sorted(sorted(g, key=lambda b: abs(share[b] - 0.5))[:SKETCH_BITS]) for g in groups]

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = pack(batch)
            for i, bits in enumerate(counted):
                v, c = np.unique(gather_bits(fp, bits), return_counts=True)
                yield pd.DataFrame({"part": np.full(len(v), i), "value": v.astype(np.int64), "n": c})

    seen = fps.mapInPandas(values, "part int, value int, n long").groupBy("part", "value").agg(F.sum("n").alias("n"))
    seen = seen.toPandas()  # at most parts * 2**16 rows
    tables = []
    for i, g in enumerate(groups):
        own = seen[seen["part"] == i]
        counts = np.zeros(1 << SKETCH_BITS)
        counts[own["value"].to_numpy()] = own["n"]
        tables.append(estimates(counts, SKETCH_BITS, len(g), radius).astype(np.float32))
    shared = spark.sparkContext.broadcast((groups, counted, tables))  # about parts MB, whatever the input

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups, counted, tables = shared.value
        masks = [probes_within(len(g), radius) for g in groups]
        for batch in batches:
            fp = pack(batch)
            costs = []
            for i in range(len(groups)):
                est = tables[i][:, gather_bits(fp, counted[i]).astype(np.int64)]
                work = np.array([PROBE_COST * len(m) for m in masks[i]])[:, None]
                costs.append(np.vstack([np.zeros((1, len(fp))), est + work]))
            chosen = allocate(costs, radius)
            for i, g in enumerate(groups):
                value = gather_bits(fp, g)
                for t in range(radius + 1):
                    for at in np.array_split(own := np.flatnonzero(chosen[i] == t), max(1, len(own_masks := masks[i][t]) * len(own) // 200_000)):
                        if len(at):
                            probes = (value[at, None] ^ own_masks[None, :]).ravel()
                            out = {"part": np.full(len(probes), i), "value": probes.astype(np.int64), "b": np.repeat(fp[at].view(np.int64), len(own_masks))}
                            yield pd.DataFrame(out | ({"bo": np.repeat(batch["o"].to_numpy()[at], len(own_masks))} if order else {}))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups = shared.value[0]
        for batch in batches:
            fp = pack(batch)
            for i, g in enumerate(groups):
                out = {"ipart": np.full(len(fp), i), "ivalue": gather_bits(fp, g).astype(np.int64), "a": fp.view(np.int64)}
                yield pd.DataFrame(out | ({"ao": batch["o"].to_numpy()} if order else {}))

    bo, ao = (", bo long", ", ao long") if order else ("", "")
    probes = of.mapInPandas(probe, "part int, value long, b long" + bo)
    stored = fps.mapInPandas(index, "ipart int, ivalue long, a long" + ao)
    if firsts:
        first = F.min(F.struct(F.col("ao" if order else "a").alias("o"), F.col("a").alias("v")))
        stored = stored.groupBy("ipart", "ivalue").agg(first.alias("m")).select("ipart", "ivalue", F.col("m.v").alias("a"), F.col("m.o").alias("ao"))
    earlier = F.col("ao") < F.col("bo") if order else F.col("a") < F.col("b")
    near = earlier & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    same = (F.col("part") == F.col("ipart")) & (F.col("value") == F.col("ivalue"))
    return probes.join(stored, same & near).select("a", "b").distinct()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest (label, node) reachable from each node that has an edge.

    ``edges`` (a, b) undirected; ``nodes`` (node long, label long).  Returns
    (node, root struct<label,node>).  Each round takes the least root among
    a node's neighbours and then that root's own root, until nothing
    changes; only minima are gathered, so a node with many neighbours is no
    burden.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = settle(both.where("a <> b").distinct())
    ends = both.select(F.col("a").alias("node")).distinct()
    last = root = settle(
        ends.join(nodes, "node").select("node", F.struct(F.col("label").alias("label"), F.col("node").alias("node")).alias("root"))
    )
    while True:
        near = (
            both.join(root.select(F.col("node").alias("b"), F.col("root").alias("r")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("r").alias("r"))
        )
        hooked = root.join(near, "node", "left").select(
            "node", F.col("root").alias("old"), F.least("root", "r").alias("root")
        )
        up = root.select(F.col("node").alias("p"), F.col("root").alias("up"))
        new = settle(
            hooked.join(up, F.col("root.node") == F.col("p"), "left").select(
                "node", "old", F.least("root", "up").alias("root")
            )
        )
        done = new.where(F.col("old") != F.col("root")).isEmpty()
        forget(last)
        root, last = new.select("node", "root"), new
        if done:
            forget(both)
            return root


def near_duplicates(
    docs: DataFrame, radius: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprint, component and number of linked fingerprints of each document.

    Columns: the id, ``fingerprint`` (16 lowercase hex digits), ``fp`` (the
    same as a signed long), ``component_id`` (the smallest id reachable over
    links, the document's own included) and ``n_links`` long (other
    fingerprints within ``radius`` bits).

    Equal fingerprints meet first by aggregation, so a group of copies of any
    size counts as one fingerprint from there on.  Null and empty texts have
    fingerprint zero and are linked like any other.  A row with a null id
    links others but is never the smallest; a component of such rows alone
    has a null ``component_id``.  Repeated rows stay repeated.  An empty table
    gives an empty result; extra columns are left out.
    """
    prints = settle(with_fingerprints(docs.select(id_col, text_col), text_col, shingle).select(id_col, "fp"))
    unique = settle(prints.groupBy("fp").agg(F.min(id_col).alias("first")))
    pairs = settle(links(unique, radius))
    last = (1 << 63) - 1
    nodes = unique.select(F.col("fp").alias("node"), F.coalesce(F.col("first"), F.lit(last)).alias("label"))
    roots = components(pairs, nodes).select(F.col("node").alias("fp"), F.col("root.label").alias("least"))
    degree = (
        pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    )
    classes = unique.join(roots, "fp", "left").join(degree, "fp", "left")
    classes = classes.select(
        "fp",
        F.nullif(F.coalesce("least", "first"), F.lit(last)).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    # Settled, so that the last join stands alone and may split the rows of a fingerprint that many texts share.
    return prints.join(settle(classes), "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "fp", "component_id", "n_links"
    )


def word_shingles(text: str, words: int = 5) -> set[tuple[str, ...]]:
    """The distinct word shingles of a text; a shorter text is one shingle, one without words has none."""
    w = text.encode().translate(_LOWER).split()
    return set(zip(*(w[k:] for k in range(words)))) or ({tuple(w)} if w else set())


def shingle_hashes(text: str, words: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of :func:`word_shingles`, sorted."""
    w = text.encode().translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(x, SEED) for x in w), np.uint64, len(w))
    size = min(words, len(w))
    out = np.zeros(len(w) - size + 1, np.uint64)
    for k in range(size):
        out = out * _FACTOR + h[k : len(w) - size + 1 + k]
    out = (out ^ (out >> np.uint64(32))) * _FACTOR
    return np.unique(out ^ (out >> np.uint64(29)))


def shingle_ranks(texts: DataFrame, n: int, words: int) -> np.ndarray:
    """About how many texts have a shingle, by the leading bits of its hash; ``n`` texts, rows (text).

    Each task counts in a table of at most 2**24 cells, in pieces of at most
    4 KB; pieces are added up one by one, and 32 MB at most reach the driver.
    """
    bits = bits_for(n * 16, 1, 16, 24)
    pieces = max(16, (1 << bits) >> 12)
    size = (1 << bits) // pieces

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        for batch in batches:
            for text in each(batch["text"]):
                np.add.at(counts, (shingle_hashes(text, words) >> np.uint64(64 - bits)).astype(np.int64), 1)
        counts = np.minimum(counts, 255).astype(np.uint8).reshape(pieces, -1)
        some = np.flatnonzero(counts.any(axis=1))
        for at in range(0, len(some), 1024):
            part = some[at : at + 1024]
            yield as_batch(pd.DataFrame({"piece": part, "counts": [counts[k].tobytes() for k in part]}), out)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch["piece"], batch["counts"]):
                totals.setdefault(piece, np.zeros(size, np.int64))
                totals[piece] += np.frombuffer(counts, np.uint8)
        if totals:
            sums = [np.minimum(t, 65535).astype("<u2").tobytes() for t in totals.values()]
            yield pd.DataFrame({"piece": list(totals), "counts": sums})

    schema, out = "piece int, counts binary", pa.schema([("piece", pa.int32()), ("counts", pa.binary())])
    ranks = np.zeros((pieces, size), np.uint16)
    for r in texts.select("text").mapInArrow(count, schema).repartition("piece").mapInPandas(add, schema).collect():
        ranks[r["piece"]] = np.frombuffer(r["counts"], "<u2")
    return ranks.ravel()


def parity_map(hashes: np.ndarray, longs: int = MAPS) -> np.ndarray:
    """64 bits a long, each the parity of the elements that fall on it: no more bits differ than elements do."""
    ones = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % (64 * longs), minlength=64 * longs) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").view("<i8")


def _prefixes(texts: DataFrame, n: int, similarity: float, words: int) -> DataFrame:
    """The prefix of each text: (key, root, n, cold, hot, hots, digest, parity maps f of all shingles and g of the hot ones).

    ``cold`` and ``hot`` are what the prefix holds of either kind, in order;
    ``hots`` counts all hot shingles of the text, ``digest`` names their set.
    """
    ranks = shingle_ranks(texts, n, words)
    shared = texts.sparkSession.sparkContext.broadcast(ranks)  # 32 MB at most
    bits = len(ranks).bit_length() - 1
    maps = [f"{m}{i}" for m in "fg" for i in range(MAPS)]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        rows, held = [], 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            arrays = [pa.array(c, t) for c, t in zip(columns[:-1], kinds)]
            table = np.stack(columns[-1])
            return pa.RecordBatch.from_arrays([*arrays, *[pa.array(table[:, i]) for i in range(2 * MAPS)]], names=[*names, *maps])

        for batch in batches:
            for key, text, root in zip(each(batch["key"]), each(batch["text"]), each(batch["root"])):
                h = shingle_hashes(text, words)
                if not (size := len(h)):
                    continue
                most = size - math.ceil(similarity * size - 1e-9) + 1
                rank = ranks[(h >> np.uint64(64 - bits)).astype(np.int64)]
                hot = h[rank > HOT_FROM]
                order = np.argsort(rank, kind="stable")[:most]
                first, cold = h[order].view(np.int64), int((rank[order] <= HOT_FROM).sum())
                rows.append((key, root, size, first[:cold], first[cold:], len(hot), hashlib.md5(hot.tobytes()).digest(), np.concatenate([parity_map(h), parity_map(hot)])))
                held += len(first) + 2 * MAPS
                if held >= _CHUNK:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    names = ["key", "root", "n", "cold", "hot", "hots", "digest"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary()]
    schema = "key long, root long, n int, cold array<long>, hot array<long>, hots int, digest binary, " + ", ".join(f"{m} long" for m in maps)
    return settle(texts.mapInArrow(prefixes, schema))


def sharing(texts: DataFrame, n: int, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """Pairs (a, b) of keys that connect all that may be at least ``similarity`` alike and have different roots; each pair once.

    ``texts`` holds about ``n`` different texts as (key long, text, root
    long).  Prefix filter: the shingles of each text are put in one order for
    all, rare ones first.  The first shingle that two similar texts share is,
    in both, among the first ``n - ceil(similarity * n) + 1`` of their n, and
    as many as the similarity asks for must be left from there on.

    Lists of at most ``HOT_FROM`` texts ("cold" shingles) meet in an equi-join,
    which makes rows in proportion to its input.  Two texts whose first shared
    shingle is hot share hot ones only, so their overlap follows from their
    sets of hot shingles.  Texts of one such set and one size are one class:
    if the set alone makes them alike, they are paired with the first of them,
    and only that one meets the others.  (A class that is not alike can only
    pair as the larger side, and its texts stay apart.)  So a group of texts
    around a few patterns costs rows in proportion to its size, whatever its
    classes have in common.  Both joins test sizes, places, roots and a parity
    map, which bounds the overlap from above, before a pair is a row.  No list
    is gathered, and Spark may split a shingle that many texts have.
    """
    rows = _prefixes(texts, n, similarity, words)
    share = similarity / (1 + similarity)  # of both sizes, which an overlap must reach

    def bounded(of: str, m: str) -> Column:
        """Whether the parity maps leave room for the overlap; ``of`` is the number of elements that they were made of."""
        odd = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"x.{m}{i}").bitwiseXOR(F.col(f"y.{m}{i}"))) for i in range(MAPS)])
        return odd <= F.col(f"x.{of}") + F.col(f"y.{of}") - 2 * share * (F.col("x.n") + F.col("y.n")) + 1e-6

    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.key") < F.col("y.key")))
    enough = F.least("x.left", "y.left") >= share * (F.col("x.n") + F.col("y.n")) - 1e-6
    pair = [F.col("x.key").alias("a"), F.col("y.key").alias("b")]

    f, g = ([f"{m}{i}" for i in range(MAPS)] for m in "fg")
    cold = rows.select("key", "root", "n", *f, F.posexplode("cold").alias("at", "h")).withColumn("left", F.col("n") - F.col("at"))
    x, y = cold.alias("x"), cold.alias("y")
    met = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.root") != F.col("y.root")) & smaller & enough & bounded("n", "f")).select(*pair)

    alike = F.col("hots") >= similarity * (2 * F.col("n") - F.col("hots")) - 1e-6
    some = rows.where(F.size("hot") > 0).withColumns({"alike": alike, "alone": F.when(~alike, F.col("key"))})
    body = F.struct("key", "root", "hot", *g)
    classes = some.groupBy("digest", "n", "hots", "alike", "alone").agg(F.min(body).alias("head"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("members"))
    classes = settle(classes)
    heads = classes.where("members > 1").select(F.col("digest").alias("d"), F.col("n").alias("m"), F.col("head.key").alias("first"), F.col("head.root").alias("own"))
    same = (F.col("digest") == F.col("d")) & (F.col("n") == F.col("m")) & F.col("alike")
    inside = some.select("key", "root", "digest", "n", "alike").join(heads, same).where("key <> first and root <> own").select(F.col("first").alias("a"), F.col("key").alias("b"))
    posts = classes.select("head.key", "n", "hots", "alike", "lo", "hi", *[F.col(f"head.{c}") for c in g], F.posexplode("head.hot").alias("at", "h"))
    posts = posts.withColumn("left", F.col("hots") - F.col("at"))  # nothing cold is shared
    x, y = posts.alias("x"), posts.alias("y")
    apart = ~((F.col("x.lo") == F.col("x.hi")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("y.lo") == F.col("y.hi")))
    between = x.join(y, (F.col("x.h") == F.col("y.h")) & smaller & F.col("x.alike") & apart & enough & bounded("hots", "g")).select(*pair)
    return met.unionByName(inside).unionByName(between).distinct()


def near_copy_classes(
    docs: DataFrame,
    similarity: float = 0.8,
    words: int = 5,
    radius: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Rows with texts, and the classes of near copies among their different texts; both settled.

    First: ``__me`` (struct of null, id and text digest, which orders the
    rows) of each row with a text.  Second: (``__me``, ``__root``) of the
    first row of each different text, ``__root`` being the first of its class.
    A class is what can be reached over pairs of texts whose sets of
    ``words``-word shingles have a Jaccard similarity of at least
    ``similarity``.

    Equal texts are found by digest.  SimHash over distinct single words,
    within ``radius`` bits by the generalised pigeonhole principle, pairs each
    text with the first text of its own fingerprint and with those of the
    first and the nearest fingerprint near it; verified pairs are links, which
    gather most of a large group around few texts.  A radius reaches only
    some of the pairs of 0.8 (about seven of eight), so :func:`sharing` pairs
    what else may be similar and has no common root yet, which leaves out
    nothing; these pairs are verified too.
    """
    me = F.struct(F.col(id_col).isNull().alias("null"), F.col(id_col).alias("id"), F.md5(text_col).alias("digest"))
    texts = docs.where(F.col(text_col).isNotNull()).select(me.alias("__me"), F.col(text_col).alias("__text"))
    wordy = F.rlike("__text", F.lit(r"[^\x20\x09-\x0D]")).alias("__wordy")
    # What follows works on ids and fingerprints, but for two passes over the texts that draw up the pairs.
    prints_of = with_fingerprints(texts, "__text", 1, "fp", distinct=True)
    all_ = settle(prints_of.select("__me", "fp", F.xxhash64("__text").alias("__key"), wordy))
    row = F.struct("__me", "fp", "__key", "__wordy")
    heads = settle(all_.groupBy(F.col("__me.digest").alias("__d")).agg(F.min(row).alias("r")).select("r.*"))
    prints = heads.where("__wordy")
    unique = prints.groupBy("fp").agg(F.min("__me").alias("__rep")).orderBy("__rep")
    unique = settle(unique.withColumn("__o", F.monotonically_increasing_id()))  # numbers in the order of the texts
    early = links(unique, radius, parts=partitions_for(unique.count(), radius), order="__o", firsts=True)
    early = _similar(_candidates(early, unique, prints), texts, similarity, words)
    roots = _roots(early)
    # Texts that are not the first of their digest take no part; those with a root carry its key.
    keys = prints.select(F.col("__me").alias("__root"), F.col("__key").alias("__rootkey"))
    rooted = roots.join(keys, "__root").select("__me", "__rootkey", F.lit(False).alias("__copy"))
    copies = all_.select("__me").distinct().join(heads, "__me", "left_anti")
    known = settle(rooted.unionByName(copies.select("__me", F.lit(None).cast("long").alias("__rootkey"), F.lit(True).alias("__copy"))))
    first = _only(texts, known, "left").where("__copy is null or not __copy")
    key = F.xxhash64("__text")
    first = first.select(key.alias("key"), F.col("__text").alias("text"), F.coalesce("__rootkey", key).alias("root"))
    pairs = sharing(first, prints.count(), similarity, words)
    ends = [prints.select(F.col("__key").alias(k), F.col("__me").alias(f"__{k}")) for k in ("a", "b")]
    tries = pairs.join(ends[0], "a").join(ends[1], "b")
    tries = tries.select(F.greatest("__a", "__b").alias("__me"), F.least("__a", "__b").alias("__rep"))
    late = _similar(tries, texts, similarity, words)
    if not late.isEmpty():
        roots = _roots(early.unionByName(late))
    return all_, heads.join(roots, "__me", "left").select("__me", F.coalesce("__root", "__me").alias("__root"))


def drop_near_copies(
    docs: DataFrame,
    similarity: float = 0.8,
    words: int = 5,
    radius: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One document of each class of equal and near-equal texts, the first by id; see :func:`near_copy_classes`.

    Null ids come last and null texts are kept.  Rows equal in id and text are
    kept or dropped together; texts without words equal each other only if
    they are the same.  An empty table gives an empty result; the columns are
    those of ``docs``.
    """
    rows, classes = near_copy_classes(docs, similarity, words, radius, id_col, text_col)
    keeps = classes.where(F.col("__me") == F.col("__root")).select("__me")
    gone = settle(rows.select("__me").distinct().join(keeps, "__me", "left_anti"))
    me = F.struct(F.col(id_col).isNull().alias("null"), F.col(id_col).alias("id"), F.md5(text_col).alias("digest"))
    return _only(docs.withColumn("__me", me), gone, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _candidates(pairs: DataFrame, unique: DataFrame, prints: DataFrame) -> DataFrame:
    """(__me, __rep): each text with earlier ones, at most three, however large the groups are.

    They are the first text of its own fingerprint, and those of the first
    and the nearest of the fingerprints that its own is paired with.
    """
    reps = pairs.join(unique.select(F.col("fp").alias("a"), "__rep"), "a")
    bits = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    near = reps.groupBy(F.col("b").alias("fp")).agg(F.min("__rep").alias("__first"), F.min(F.struct(bits, "__rep")).alias("__near"))
    each = unique.join(near, "fp", "left").select("fp", F.array("__rep", "__first", "__near.__rep").alias("__reps"))
    found = prints.join(each, "fp").select("__me", F.explode(F.array_distinct("__reps")).alias("__rep"))
    return found.where(F.col("__rep") < F.col("__me"))


def _similar(pairs: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """Those of the pairs (__me, __rep) whose texts are similar enough, settled."""

    @F.arrow_udf("boolean")
    def near_enough(mine: pa.Array, theirs: pa.Array) -> pa.Array:
        def one(a: set, b: set) -> bool:
            shared = len(a & b)
            return shared >= similarity * (len(a) + len(b) - shared)

        return pa.array([one(word_shingles(x, words), word_shingles(y, words)) for x, y in zip(each(mine), each(theirs))], pa.bool_())

    pairs = settle(pairs)
    ends = settle(pairs.select("__me").unionByName(pairs.select(F.col("__rep").alias("__me"))).distinct())
    some = settle(_only(texts, ends).dropDuplicates(["__me"]))  # settled, so that the joins may split a text with many partners
    mine = some.select("__me", F.col("__text").alias("__mine"))
    theirs = some.select(F.col("__me").alias("__rep"), F.col("__text").alias("__theirs"))
    found = settle(pairs.join(mine, "__me").join(theirs, "__rep").where(near_enough("__mine", "__theirs")).select("__me", "__rep"))
    forget(pairs, ends, some)
    return found


def _roots(edges: DataFrame) -> DataFrame:
    """(__me, __root) of every text with a link."""
    ends = edges.select("__me").unionByName(edges.select(F.col("__rep").alias("__me"))).distinct()
    nodes = ends.select(F.col("__me").alias("node"), F.col("__me").alias("label"))
    found = components(edges.select(F.col("__me").alias("a"), F.col("__rep").alias("b")), nodes)
    return found.select(F.col("node").alias("__me"), F.col("root.label").alias("__root"))


def _only(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose ``__me`` is (or is not) among settled ids, which are broadcast if they are few."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "__me", how)
