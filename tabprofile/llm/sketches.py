"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A sketch has ``HASHES`` parts of a power of two cells.  A cell sums up how
many digests fell into it, the digests, and a check of each.  Two sketches
subtract cell by cell; the larger is first folded to the size of the smaller,
as the cell of a digest is its hash modulo the size.  A cell of the difference
with a count of one and a fitting check gives a digest away, which is taken
out of its other cells, and so on: peeling.  If cells are left over, both
sketches are made anew with more cells, unless the texts are short: beside the
cells, the fingerprint of a text of up to ``LISTED`` paragraphs lists their
digests, so that two such texts which differ in everything are still told by
what the fingerprints hold.

Sketches of many texts lie end to end in the same arrays, so that building,
subtracting and peeling are a few array operations for a block of documents.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

#: A paragraph is a line, or a stretch of it: after so many code points it ends with the sentence, or after as many more.
PARAGRAPH_CHARS = 48
PARAGRAPH = re.compile(r"[^\n]{1,%d}[^.!?\n]{0,%d}[.!?]*\n*|\n+" % (PARAGRAPH_CHARS, PARAGRAPH_CHARS))
HASHES = 3
#: Cells of a part for each paragraph (then rounded up to a power of two), and the least.
CELLS_EACH, LEAST_CELLS = 0.75, 4
#: Paragraphs up to which a fingerprint lists the digests as well.
LISTED = 64
#: Texts are worked on in blocks of about so many code points.
BLOCK_CHARS = 1 << 20
#: Rounds of peeling; what is not peeled by then counts as a failure.
MOST_ROUNDS = 200
#: A range of ids holds about so many bytes of text.  There are at most ``MOST_RANGES``, whose heads (some MB) are
#: broadcast: beyond 4 TB they grow, which costs a task time but no memory, as it streams.
RANGE_BYTES, MOST_RANGES, LEAST_ROWS = 64 << 20, 1 << 16, 256
#: Ids looked at for each range to find its bounds.
SAMPLED = 16
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_CHECK = np.uint64(0xD6E8FEB86659FD93)


def paragraph_digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit digests of each text's paragraphs, end to end, and how many each has.

    A paragraph that a text repeats is told apart by its occurrence.
    """
    pieces = [PARAGRAPH.findall(t) for t in texts]
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    keys = np.fromiter((digest(p) for own in pieces for p in own), np.uint64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    keys = keys[np.lexsort((keys, owner))]
    at = np.arange(len(keys))
    again = np.zeros(len(keys), bool)
    again[1:] = (keys[1:] == keys[:-1]) & (owner[1:] == owner[:-1])
    return keys + (at - np.maximum.accumulate(np.where(again, 0, at))).astype(np.uint64) * _MIX[0], sizes


def part_sizes(paragraphs: np.ndarray) -> np.ndarray:
    """Cells of each part of the sketches of texts with so many paragraphs."""
    wanted = np.maximum(LEAST_CELLS, np.ceil(CELLS_EACH * paragraphs))
    return (1 << np.ceil(np.log2(wanted)).astype(np.int64)).astype(np.int64)


def _check(keys: np.ndarray) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(31))) * _CHECK
    return (mixed ^ (mixed >> np.uint64(28))).astype(np.uint32)


def _cell(keys: np.ndarray, k: int, part: np.ndarray) -> np.ndarray:
    """The cell of each key within part ``k`` of its sketch."""
    spread = keys * _MIX[k]
    return ((spread >> np.uint64(29)) & (part - 1).astype(np.uint64)).astype(np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size says, end to end."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Sketches:
    """Cells of several sketches: counts modulo 2**16, digests modulo 2**64, checks modulo 2**32."""

    part: np.ndarray
    start: np.ndarray
    count: np.ndarray
    keys: np.ndarray
    checks: np.ndarray

    @classmethod
    def empty(cls, part: np.ndarray) -> Sketches:
        ends = np.cumsum(HASHES * part)
        n = int(ends[-1]) if len(ends) else 0
        return cls(part, ends - HASHES * part, np.zeros(n, np.int16), np.zeros(n, np.uint64), np.zeros(n, np.uint32))

    @classmethod
    def of(cls, keys: np.ndarray, sizes: np.ndarray, part: np.ndarray | None = None) -> Sketches:
        """A sketch for each text whose digests are given end to end."""
        out = cls.empty(part_sizes(sizes) if part is None else part)
        out.add(np.repeat(np.arange(len(sizes)), sizes), keys, np.ones(len(keys), np.int16))
        return out

    def add(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Add each digest to the sketch ``owner``, or take it away where ``sign`` is -1; the cells that were touched."""
        part, start, minus = self.part[owner], self.start[owner], sign < 0
        check = _check(keys)
        signed, signed_check = np.where(minus, np.uint64(0) - keys, keys), np.where(minus, np.uint32(0) - check, check)
        touched = [start + k * part + _cell(keys, k, part) for k in range(HASHES)]
        for at in touched:
            np.add.at(self.count, at, sign)
            np.add.at(self.keys, at, signed)
            np.add.at(self.checks, at, signed_check)
        return np.concatenate(touched)

    def minus(self, a: np.ndarray, b: np.ndarray) -> Sketches:
        """For each pair of numbers: sketch ``a`` less sketch ``b``, at the smaller of their sizes."""
        out = Sketches.empty(np.minimum(self.part[a], self.part[b]))
        for side, sign in ((a, 1), (b, -1)):
            pair = np.repeat(np.arange(len(side)), HASHES * self.part[side])
            at = _ranges(self.start[side], HASHES * self.part[side])
            place, here = at - self.start[side][pair], self.part[side][pair]
            to = out.start[pair] + place // here * out.part[pair] + (place % here & (out.part[pair] - 1))
            for mine, theirs in ((out.count, self.count), (out.keys, self.keys), (out.checks, self.checks)):
                np.add.at(mine, to, theirs[at] if sign > 0 else (0 - theirs[at]).astype(theirs.dtype))
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sketch, digest, sign) of what could be peeled, and which sketches are empty after it.  Uses them up."""
        owner = np.repeat(np.arange(len(self.part)), HASHES * self.part)
        look, found = np.arange(len(self.count)), []
        for _ in range(MOST_ROUNDS):
            look = look[np.abs(self.count[look]) == 1]
            minus = self.count[look] < 0
            key = np.where(minus, np.uint64(0) - self.keys[look], self.keys[look])
            check = np.where(minus, np.uint32(0) - self.checks[look], self.checks[look])
            pure = check == _check(key)
            if not pure.any():
                break
            own, key, sign = owner[look[pure]], key[pure], self.count[look[pure]]
            order = np.lexsort((key, own))  # a digest may stand alone in several of its cells
            own, key, sign = own[order], key[order], sign[order]
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
            found.append((own[first], key[first], sign[first]))
            look = np.unique(self.add(own[first], key[first], -sign[first]))
        rest = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        empty = np.bincount(owner[rest], minlength=len(self.part)) == 0
        none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int16))
        return *(np.concatenate(x) for x in zip(none, *found)), empty

    def text(self, k: int, paragraphs: int, listed: np.ndarray | None = None) -> str:
        """Number of paragraphs, sketch ``k`` and listed digests as a string, which :func:`read` and :func:`listed_in` read."""
        at = slice(self.start[k], self.start[k] + HASHES * self.part[k])
        raw = self.count[at].astype("<i2").tobytes() + self.keys[at].astype("<u8").tobytes() + self.checks[at].astype("<u4").tobytes()
        more = b"" if listed is None else listed.astype("<u8").tobytes()
        return f"{paragraphs}:{base64.b64encode(raw).decode()}:{base64.b64encode(more).decode()}"


def read(*fingerprints: str) -> tuple[np.ndarray, Sketches]:
    """Paragraph counts and sketches of fingerprint strings."""
    heads, raws = zip(*[(int(n), base64.b64decode(coded)) for n, coded, _ in (f.split(":") for f in fingerprints)])
    out = Sketches.empty(np.array([len(r) // (14 * HASHES) for r in raws]))
    for k, raw in enumerate(raws):
        n = HASHES * out.part[k]
        at = slice(out.start[k], out.start[k] + n)
        out.count[at] = np.frombuffer(raw, "<i2", n)
        out.keys[at] = np.frombuffer(raw, "<u8", n, 2 * n)
        out.checks[at] = np.frombuffer(raw, "<u4", n, 10 * n)
    return np.array(heads), out


def listed_in(fingerprint: str) -> np.ndarray | None:
    """All digests of a text whose fingerprint lists them, else None."""
    n, _, coded = fingerprint.split(":")
    found = np.frombuffer(base64.b64decode(coded), "<u8")
    return found if len(found) == int(n) else None


def lists(keys: np.ndarray, sizes: np.ndarray) -> list[np.ndarray | None]:
    """For each text its digests if they are few enough to be listed."""
    ends = np.cumsum(sizes)
    return [keys[e - n : e] if n <= LISTED else None for e, n in zip(ends, sizes)]


def difference(a: str, b: str) -> tuple[set[int], set[int]] | None:
    """The digests only in the first and only in the second of two fingerprints; None if they hold too few cells for it."""
    _, sketches = read(a, b)
    _, key, sign, empty = sketches.minus(np.array([0]), np.array([1])).peel()
    return (set(key[sign > 0].tolist()), set(key[sign < 0].tolist())) if empty[0] else None


def likenesses(
    keys: np.ndarray, sizes: np.ndarray, sketches: Sketches, a: np.ndarray, b: np.ndarray, listed: list[np.ndarray | None] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The likeness of texts ``a[k]`` and ``b[k]``: shared paragraphs, twice over, per paragraphs of both; 1 without any.

    What differs is recovered from the two sketches.  Where that fails, two
    ``listed`` texts are compared by their lists; of the other pairs (the
    second result says which) both texts get larger sketches, first of the
    size of the larger one, then twice that each time.
    """
    todo, only = np.arange(len(a)), np.zeros(len(a), np.int64)
    ends = np.cumsum(sizes)
    part, made, failed = np.minimum(sketches.part[a], sketches.part[b]), sketches.minus(a, b), np.zeros(len(a), bool)
    while True:
        own, _, sign, empty = made.peel()
        only[todo] = np.bincount(own[sign > 0], minlength=len(todo))
        todo, part = todo[~empty], part[~empty]
        if listed and not failed.any():
            short = np.array([listed[a[k]] is not None and listed[b[k]] is not None for k in todo], bool)
            for k in todo[short]:
                only[k] = sizes[a[k]] - len(np.intersect1d(listed[a[k]], listed[b[k]], assume_unique=True))
            todo, part = todo[~short], part[~short]
        failed[todo] = True
        if not len(todo):
            break
        part = np.maximum(2 * part, np.maximum(sketches.part[a[todo]], sketches.part[b[todo]]))
        made = Sketches.empty(part)
        for side, sign in ((a[todo], 1), (b[todo], -1)):  # subtracted as they are made
            own = np.repeat(np.arange(len(todo)), sizes[side])
            made.add(own, keys[_ranges(ends[side] - sizes[side], sizes[side])], np.full(len(own), sign, np.int16))
    both = sizes[a] + sizes[b]
    return np.where(both > 0, 2.0 * (sizes[a] - only) / np.maximum(both, 1), 1.0), failed


def edited_text(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Rows dealt into ranges of ids, a partition each, with the head of the next range after them.

    Columns: ``__id`` (as given), ``__name`` (the id as a string), ``__text``
    string, ``__extra`` boolean (the row only serves as the next one of the
    row before it); sorted by extra, id and text.  Two passes over the ids
    come before: a few sampled by their hash bound the ranges, and the
    least id of each is its head.  Texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("__text"))
    sums = rows.agg(F.count("__id").alias("n"), F.sum(F.octet_length("__text")).alias("bytes")).first()
    n, total = sums["n"], sums["bytes"] or 0
    ranges = min(MOST_RANGES, max(-(-total // range_bytes), min(n // least_rows, 4 * spark.sparkContext.defaultParallelism), 1))
    every = max(1, n // (SAMPLED * ranges))
    some = rows.where(F.col("__id").isNotNull() & (F.pmod(F.xxhash64("__id"), F.lit(every)) == 0)) if ranges > 1 else rows.limit(0)
    picked = sorted(r["__id"] for r in some.select("__id").collect())  # about SAMPLED ids a range
    bounds = spark.sparkContext.broadcast(sorted({picked[k * len(picked) // ranges] for k in range(1, ranges)} if picked else ()))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, known: pd.Series) -> pd.Series:
        cuts = bounds.value
        return pd.Series([bisect_right(cuts, i) if k else 0 for i, k in zip(ids, known)], dtype="int32")

    known = F.col("__id").isNotNull()
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    shown = F.coalesce("__id", F.lit(0)) if whole else F.col("__id")  # whole numbers with nulls would reach Python as doubles
    dealt = rows.withColumn("__range", range_of(shown, known))  # nulls sort before all ids
    order = F.struct(known.alias("known"), F.col("__id").alias("id"))
    heads = dealt.groupBy("__range").agg(F.min(order).alias("__head"))
    by = W.orderBy("__range")  # a row for each range
    before = F.coalesce(F.lag("__range").over(by), F.last("__range").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    heads = heads.select(F.col("__range").alias("__of"), "__head", before.alias("__before"))
    is_head = (F.col("__range") == F.col("__of")) & (order == F.col("__head"))
    here = F.struct(F.col("__range").alias("r"), F.lit(False).alias("x"))
    there = F.when(F.col("__before").isNotNull(), F.struct(F.col("__before").alias("r"), F.lit(True).alias("x")))
    copies = dealt.join(F.broadcast(heads), is_head, "left").select("__id", "__text", F.explode(F.array_compact(F.array(here, there))).alias("__to"))
    name = F.col("__id").cast("string").alias("__name")
    copies = copies.select("__id", name, "__text", F.col("__to.r").alias("__range"), F.col("__to.x").alias("__extra"))
    placed = copies.repartitionById(int(ranges), F.col("__range"))
    return placed.sortWithinPartitions("__extra", "__id", "__text").drop("__range")


def sketch_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **ranges: int) -> DataFrame:
    """Fingerprint each document and its edited text, and compare both with it and with the next one.

    Columns: the id; ``n_chars`` long; ``edited_sha256``; ``fingerprint`` and
    ``edited_fingerprint`` (see :func:`read` and :func:`difference`);
    ``near_edited`` and ``near_next`` double; ``n_retried`` int, how many of
    the two comparisons needed larger sketches than the fingerprints have.
    The next document is the one after it by ascending id; after the last
    comes the first, so a single document is its own next.  A null text is
    empty; null ids come before all others; rows of equal id are ordered by
    text.  Ids may be of any type that has an order.  An empty table gives an
    empty result; extra columns are left out.

    Each task streams through its sorted rows and holds a block of them, so
    rows of one id, which are never split, cost time but no memory.
    """
    dealt = with_next(docs, id_col, text_col, **ranges)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, str, str]]:
        held, done = None, False
        for batch in batches:
            for extra, name, text in zip(batch["__extra"], batch["__name"], batch["__text"]):
                if held is not None and not done:
                    yield *held, text
                held, done = (name, text), done or extra  # further extra rows have the id of the next range's head

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, chars = [], 0
        for row in pairs(batches):
            rows.append(row)
            chars += len(row[1])
            if chars >= BLOCK_CHARS:
                yield _block(rows)
                rows, chars = [], 0
        if rows:
            yield _block(rows)

    out = dealt.select("__extra", "__name", "__text").mapInPandas(
        make,
        "id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_retried int",
    )
    given = F.col("id").cast(docs.schema[id_col].dataType).alias(id_col)
    return out.select(given, *out.columns[1:])


def _block(rows: list[tuple[str | None, str, str]]) -> pd.DataFrame:
    """The results for a block of (id, text, next text), mostly each the next text of the one before."""
    texts, own, following = [], [], []
    for _, text, then in rows:
        if not texts or texts[-1] != text:
            texts.append(text)
        own.append(len(texts) - 1)
        texts.append(then)
        following.append(len(texts) - 1)
    edits = [edited_text(text, then) for _, text, then in rows]
    edited = len(texts) + np.arange(len(rows))
    own, following = np.array(own), np.array(following)
    keys, sizes = paragraph_digests(texts + edits)
    sketches, listed = Sketches.of(keys, sizes), lists(keys, sizes)
    near, retried = [], np.zeros(len(rows), np.int32)
    for other in (edited, following):
        value, failed = likenesses(keys, sizes, sketches, own, other, listed)
        near.append(value)
        retried += failed
    prints = {int(k): sketches.text(k, sizes[k], listed[k]) for k in np.unique(np.concatenate([own, edited]))}
    return pd.DataFrame(
        {
            "id": [name for name, *_ in rows],
            "n_chars": [len(text) for _, text, _ in rows],
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edits],
            "fingerprint": [prints[int(k)] for k in own],
            "edited_fingerprint": [prints[int(k)] for k in edited],
            "near_edited": near[0],
            "near_next": near[1],
            "n_retried": retried,
        }
    )
