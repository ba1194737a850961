"""Near duplicates by an inverted join over MinHash signature coordinates.

Each different shingle set has a signature of ``K`` coordinates and is posted
under each coordinate-value pair.  Two sets whose signatures collide in at
least ``match`` coordinates are candidates, and links are confirmed on the
full sets.  Merging all lists is not needed: a list of one set is no
collision, and of the ``m`` posts that a set shares with any other, in one
order for all with short lists first, the longest ``match - 1`` are skipped,
as a pair that collides ``match`` times meets in the first ``m - match + 1``
of both.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each, forget, settle
from .simhash import BROADCAST_IDS, components, parity_map, shingle_hashes

#: Coordinates of a signature, bits of each that are compared inside the join, longs of a parity map of the set.
K, PLANES, MAPS = 64, 4, 8
#: The same where sets of different components meet: all bits of a coordinate, so that agreement is equality.
ALL_PLANES, LATE_MAPS = 32, 16
#: A pair of the least similarity may miss the threshold of matches with this probability.
MISS = 1e-6

_RNG = np.random.default_rng(12)
_A = _RNG.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, K, dtype=np.uint64)
_CHUNK = 4096
PARTS = [f"__s{i}" for i in range(PLANES)] + [f"__m{i}" for i in range(MAPS)]
LATE_PARTS = [f"__s{i}" for i in range(ALL_PLANES)] + [f"__m{i}" for i in range(LATE_MAPS)]


def match_threshold(percent: int, k: int = K, miss: float = MISS) -> int:
    """The most matches that a pair of ``percent`` similarity falls short of with a probability of at most ``miss``."""
    p, below = percent / 100, 0.0
    for t in range(k + 1):
        below += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        if below > miss:
            return max(1, t)
    return k


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's hash over a set, 32 bits each."""
    least = np.full(K, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        least = np.minimum(least, (hashes[at : at + _CHUNK, None] * _A + _B).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def planes(sig: np.ndarray, n: int = PLANES) -> np.ndarray:
    """Low bits of the coordinates as ``n`` words of K bits: equal coordinates agree in all of them."""
    bits = (sig[None, :] >> np.arange(n, dtype=np.uint32)[:, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view("<i8").ravel()


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(__id, __t, __n, __digest, __sig, parts) of each row; the digest is that of the whole set."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, sigs, parts = [], [], [], []
            for text in each(batch["__text"]):
                h = shingle_hashes(text or "", words)
                n.append(len(h))
                digests.append(hashlib.md5(h.tobytes()).digest() if len(h) else None)
                sig = signature(h)
                sigs.append(sig.view(np.int32) if len(h) else None)
                parts.append(np.concatenate([planes(sig), parity_map(h, MAPS)]))
            columns = [batch["__id"], batch["__t"], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))]
            table = np.array(parts, np.int64).reshape(-1, len(PARTS))
            columns += [pa.array(table[:, i]) for i in range(len(PARTS))]
            yield pa.RecordBatch.from_arrays(columns, names=["__id", "__t", "__n", "__digest", "__sig", *PARTS])

    kind = docs.schema["__id"].dataType.simpleString()
    schema = f"__id {kind}, __t string, __n long, __digest binary, __sig array<int>, " + ", ".join(f"{p} long" for p in PARTS)
    return docs.mapInArrow(made, schema)


def _prefixes(heads: DataFrame, match: int) -> DataFrame:
    """(__key, __n, parts, __central, __posts): the posts of each set that are not skipped.

    ``__central`` tells how much a set shares: the length of all its lists.
    """
    posts = heads.select("__key", F.posexplode("__sig").alias("__c", "__v"))
    posts = posts.select("__key", F.shiftleft(F.col("__c").cast("long"), 32).bitwiseOR(F.col("__v").cast("long").bitwiseAND((1 << 32) - 1)).alias("__post"))
    lists = posts.groupBy("__post").agg(F.count(F.lit(1)).alias("__df")).where("__df > 1")
    shared = posts.join(lists.select(F.col("__post").alias("__p"), "__df"), F.col("__post") == F.col("__p"))
    own = shared.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("__df", "__post"))).alias("__own"))  # K at most
    own = own.where(F.size("__own") >= match).select(
        F.col("__key").alias("__k"),
        F.aggregate("__own", F.lit(0).cast("long"), lambda s, x: s + x["__df"]).alias("__central"),
        F.slice("__own", 1, F.size("__own") - match + 1)["__post"].alias("__posts"),
    )
    return own.join(heads.drop("__sig"), F.col("__k") == F.col("__key")).drop("__k")


def _differing(x: str, y: str, parts: list[str]) -> Column:
    """Coordinates that differ in any of the planes ``parts``, as bits of a long."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}")) for p in parts])


def _alike(x: str, y: str, percent: int, match: int, parts: list[str] = PARTS, whole: int = PLANES) -> Column:
    """Whether two sets may be alike: sizes, matches (no fewer than there are), bits of the parity maps."""
    c = lambda side, name: F.col(f"{side}.{name}")
    sizes = F.least(c(x, "__n"), c(y, "__n")) * 100 >= percent * F.greatest(c(x, "__n"), c(y, "__n"))
    odd = reduce(lambda a, b: a + b, [F.bit_count(c(x, p).bitwiseXOR(c(y, p))) for p in parts[whole:]])
    matches = K - F.bit_count(_differing(x, y, parts[:whole]))
    return sizes & (matches >= match) & (odd * (100 + percent) <= (100 - percent) * (c(x, "__n") + c(y, "__n")))


def _across(shared: DataFrame, roots: DataFrame, names: DataFrame, docs: DataFrame, percent: int, words: int, match: int) -> DataFrame:
    """Pairs (a, b) of keys in different components that may be alike, each as one row.

    A semi-join keeps the posts under which a set of another component may be
    alike, which are no more than there were.  Only their sets, few, get whole
    coordinates and larger parity maps, and only these posts meet.  A pair is a
    row under the first coordinate that it has in common there, which whole
    coordinates tell without error: under each post that two sets share in
    their prefixes, either is the other's reason to stay.
    """
    known = roots.select(F.col("node").alias("__node"), F.col("root.node").alias("__r"))
    mine = shared.join(known, F.col("__key") == F.col("__node"), "left").withColumn("__root", F.coalesce("__r", "__key"))
    mine = mine.select(F.explode("__posts").alias("__post"), "__root", "__key", "__n", *PARTS)
    apart = (F.col("x.__post") == F.col("y.__post")) & (F.col("x.__root") != F.col("y.__root"))
    own = mine.alias("x").join(mine.alias("y"), apart & _alike("x", "y", percent, match), "left_semi")
    own = own.groupBy("__key", "__n", "__root").agg(F.collect_list("__post").alias("__posts"))  # K at most
    own = settle(own.join(names.select(F.col("__key").alias("__k"), "__t"), F.col("__key") == F.col("__k")).drop("__k"))
    forget(shared)
    ends = own.select("__key", "__t")
    few = F.broadcast(ends) if ends.count() <= BROADCAST_IDS else ends
    texts = docs.join(few, "__t").select("__key", "__text").dropDuplicates(["__key"])

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for text in each(batch["__text"]):
                h = shingle_hashes(text or "", words)
                parts.append(np.concatenate([planes(signature(h), ALL_PLANES), parity_map(h, LATE_MAPS)]))
            table = np.array(parts, np.int64).reshape(-1, len(LATE_PARTS))
            columns = [batch["__key"], *[pa.array(table[:, i]) for i in range(len(LATE_PARTS))]]
            yield pa.RecordBatch.from_arrays(columns, names=["__k", *LATE_PARTS])

    facts = texts.mapInArrow(parted, "__k long, " + ", ".join(f"{p} long" for p in LATE_PARTS))
    bit = lambda post, of=1: F.call_function("shiftleft", F.lit(of).cast("long"), F.shiftright(post, 32).cast("int"))  # noqa: E731  at its coordinate
    mask = F.aggregate("__posts", F.lit(0).cast("long"), lambda m, post: m.bitwiseOR(bit(post)))
    mine = settle(own.withColumn("__mask", mask).join(facts, F.col("__key") == F.col("__k")).drop("__k", "__t"))
    forget(own)
    mine = mine.select(F.explode("__posts").alias("__post"), "__key", "__n", "__root", "__mask", *LATE_PARTS).withColumn("__below", F.bitwise_not(bit(F.col("__post"), -1)))
    same = F.bitwise_not(_differing("x", "y", LATE_PARTS[:ALL_PLANES]))
    earlier = same.bitwiseAND(F.col("x.__mask")).bitwiseAND(F.col("y.__mask")).bitwiseAND(F.col("x.__below"))
    once = apart & (F.col("x.__key") < F.col("y.__key")) & (earlier == 0) & _alike("x", "y", percent, match, LATE_PARTS, ALL_PLANES)
    return mine.alias("x").join(mine.alias("y"), once).select(F.col("x.__key").alias("a"), F.col("y.__key").alias("b"))


def _confirmed(pairs: DataFrame, names: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """Those of the pairs (a, b) of keys whose full sets are alike, settled."""
    pairs = settle(pairs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("__key")).distinct()
    ends = settle(ends.join(names.select("__key", "__t"), "__key"))
    few = F.broadcast(ends) if ends.count() <= BROADCAST_IDS else ends
    texts = docs.join(few, "__t").select("__key", "__text").dropDuplicates(["__key"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t or "", words).tobytes() for t in each(batch["__text"])]
            yield pa.RecordBatch.from_arrays([batch["__key"], pa.array(sets, pa.binary())], names=["__key", "__set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(each(batch["x"]), each(batch["y"])):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # Settled, so that the joins may split a set with many partners.
    sets = settle(texts.mapInArrow(hashed, "__key long, __set binary"))
    sides = [sets.select(F.col("__key").alias(k), F.col("__set").alias(s)) for k, s in (("a", "x"), ("b", "y"))]
    found = settle(pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(compare, "a long, b long"))
    forget(pairs, ends, sets)
    return found


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Set size, component and whether it stays, for each document.

    Columns: the id, ``n_shingles`` long (size of the set of ``words``-word
    shingles; a text of fewer words is one shingle), ``component_id`` (the
    smallest id reachable over links, the document's own included), ``kept``
    boolean (the id is the component's) and ``n_links`` long (other sets that
    were linked directly; links inside a component that is known already need
    no comparison and are not counted).

    Documents are linked if 100 times the intersection of their sets is at
    least ``percent`` times the union.  Documents without words, null texts
    included, have an empty set and are linked with nothing.  Equal sets are
    one set from the start, so copies are never paired.  A row with a null id
    links others but is never the smallest; a component of such rows alone has
    a null ``component_id`` and ``kept`` is false.  Repeated rows stay
    repeated.  An empty table gives an empty result; extra columns are left
    out.

    First each set is compared with the set of each of its lists that shares
    most with others, which gathers most of a large group around few sets;
    then all pairs of a list that are not in one component yet meet in an
    equi-join that tests sizes, matches and a parity map (all without false
    dismissals but for ``MISS``) before a pair is a row, once.  No list is
    gathered.
    """
    match = match_threshold(percent)
    rows = docs.select(F.col(id_col).alias("__id"), F.md5(text_col).alias("__t"), F.col(text_col).alias("__text"))
    full = settle(_sets(rows, words))
    me = F.struct(F.col("__id").isNull().alias("null"), F.col("__id").alias("id"), F.col("__t").alias("t"))
    body = F.struct("__n", "__sig", *PARTS)
    heads = full.where("__n > 0").groupBy("__digest").agg(F.min(me).alias("__me"), F.first(body).alias("__b"))
    heads = settle(heads.select("__digest", F.struct("__me.null", "__me.id").alias("__label"), F.col("__me.t").alias("__t"), "__b.*", F.monotonically_increasing_id().alias("__key")))
    all_ = settle(full.select("__id", "__n", "__digest"))
    forget(full)
    shared = settle(_prefixes(heads.select("__key", "__n", "__sig", *PARTS), match))
    names = settle(heads.select("__digest", "__label", "__t", "__key"))
    forget(heads)
    facts = ["__key", "__n", *PARTS]
    posts = shared.select(F.explode("__posts").alias("__post"), "__central", *facts)

    # The leader of a list, for each size that others can be alike to: what is alike differs by a step at most.
    step = F.floor(F.log(F.col("__n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    order = F.struct((-F.col("__central")).alias("c"), F.col("__key").alias("k"))
    first = posts.groupBy("__post", step.alias("__step")).agg(F.min(F.struct(order, *facts)).alias("__f")).select("__post", "__f.*")
    pair = [F.least("x.__key", "y.__key").alias("a"), F.greatest("x.__key", "y.__key").alias("b")]
    met = (F.col("x.__post") == F.col("y.__post")) & (F.col("x.__key") != F.col("y.__key")) & _alike("x", "y", percent, match)
    early = _confirmed(posts.alias("x").join(first.alias("y"), met).select(*pair).distinct(), names, rows, percent, words)
    labels = names.select(F.col("__key").alias("node"), F.col("__label").alias("label"))
    roots = components(early, labels)

    late = _confirmed(_across(shared, roots, names, rows, percent, words, match), names, rows, percent, words)
    links = settle(early.unionByName(late).distinct())
    roots = components(links, labels).select(F.col("node").alias("__node"), F.col("root.label").alias("__least"))
    degree = links.select(F.explode(F.array("a", "b")).alias("__d")).groupBy("__d").agg(F.count(F.lit(1)).alias("__links"))
    classes = names.join(roots, F.col("__key") == F.col("__node"), "left").join(degree, F.col("__key") == F.col("__d"), "left")
    classes = settle(classes.select(F.col("__digest").alias("__set"), F.coalesce("__least", "__label").alias("__c"), F.coalesce("__links", F.lit(0)).alias("n_links")))
    # Settled, so that the join stands alone and may split the rows of a set that many documents have.
    out = all_.select("__id", "__n", "__digest").join(classes, F.col("__digest") == F.col("__set"), "left")
    least = F.when(F.col("__c").isNull(), F.col("__id")).otherwise(F.col("__c.id"))
    out = out.select(F.col("__id").alias(id_col), F.col("__n").alias("n_shingles"), least.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
