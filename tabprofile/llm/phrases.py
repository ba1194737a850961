"""Phrase collocations mined from vertical positional inverted lists.

A task numbers the word positions of a block of documents and keeps, for each
word, the sorted list of its positions.  Lists of frequent phrases are
extended by merging the position after each occurrence with the postings of
the words that follow; the length of a list is the frequency of its phrase in
the block, and blocks are added up.  A phrase can only be frequent if its
first and its last words' phrases are, so what the level before found rare is
not extended.  Which phrases are frequent is told to the tasks by a table of
bits of fixed size, which may let a rare one pass but stops no frequent one;
the sums decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import settle

#: Occurrences from which a phrase is a candidate, most words, per cent of its occurrences that a longer one must have to explain it, rows a language.
LEAST, WORDS, EXPLAINED, TOP = 10, 3, 50, 2000
#: Bits of the table of frequent phrases: 4 MB whatever the input.  It only spares work.
TABLE_BITS = 25
#: Words that a task holds at once, one document at least.
BLOCK_WORDS = 1 << 20
#: Stretches of a language in which the first rows are taken before they meet.
STRETCHES = 64

_BREAK = b"."
_TABLE = bytearray(range(256))
for _b in range(65, 91):
    _TABLE[_b] = _b + 32
for _b in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_b] = _BREAK[0]
_TABLE[9] = 32
_TABLE = bytes(_TABLE)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case, with ``b"."`` between pieces."""
    return (text or "").encode().translate(_TABLE).replace(_BREAK, b" . ").split()


def _word_hashes(lang: bytes, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _longer(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are one word longer."""
    h = (hashes ^ (hashes >> np.uint64(31))) * _FACTOR + more
    return (h ^ (h >> np.uint64(29))) * _FACTOR


def _set_bits(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    at = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[bytes], np.ndarray]]:
    """(language, words by number, the number at each position or -1): documents up to BLOCK_WORDS words at a time."""
    held: dict[bytes, tuple[dict[bytes, int], list[np.ndarray]]] = {}
    n = 0

    def flush():
        for lang, (numbers, parts) in held.items():
            yield lang, [w for w in numbers if w != _BREAK], np.concatenate(parts)

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            tokens = words_of(text.as_py())
            if not tokens:
                continue
            numbers, parts = held.setdefault(lang.as_py().encode(), ({_BREAK: -1}, []))
            parts.append(np.array([numbers.setdefault(t, len(numbers) - 1) for t in tokens] + [-1], np.int32))
            n += len(tokens)
            if n >= BLOCK_WORDS:
                yield from flush()
                held.clear()
                n = 0
    yield from flush()


def postings(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertical lists of single words, one after another: number of the word and position, by number then position."""
    order = np.argsort(at, kind="stable")
    order = order[np.searchsorted(at[order], 0) :]  # no breaks
    return at[order].astype(np.int64), order


def extend(lists: tuple[np.ndarray, np.ndarray], postings_: tuple[np.ndarray, np.ndarray]):
    """Lists of phrases one word longer: (number, last position), and the (phrase, word) behind each number.

    ``lists`` holds phrases by their last position.  The positions after them
    are merged with the postings in order of position; a position is in one
    list of each side at most.
    """
    phrase, last = lists
    word, at = postings_
    by, theirs = np.argsort(last, kind="stable"), np.argsort(at, kind="stable")
    at, word = at[theirs], word[theirs]
    want = last[by] + 1
    where = np.searchsorted(at, want)
    met = where < len(at)
    met[met] = at[where[met]] == want[met]
    width = int(word.max(initial=0)) + 1
    pairs, number = np.unique(phrase[by][met] * width + word[where[met]], return_inverse=True)
    order = np.argsort(number, kind="stable")
    return (number[order], want[met][order]), np.stack([pairs // width, pairs % width], axis=1)


def _only(lists: tuple[np.ndarray, np.ndarray], good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = good[lists[0]]
    return lists[0][keep], lists[1][keep]


def _counted(docs: DataFrame, length: int, tables: list) -> DataFrame:
    """(lang, phrase, n) of all phrases of ``length`` words that the bit tables of shorter ones let pass; sums of blocks."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(t.value, np.uint8) for t in tables]
        for lang, names, at in _blocks(batches):
            words = postings(at)
            if length > 1:
                hw = _word_hashes(lang, names)
                words = _only(words, _set_bits(bits[0], hw))
            lists, parts = words, [np.arange(len(names))]  # the words behind each number of a list
            for size in range(2, length + 1):
                lists, pairs = extend(lists, words)
                parts = [*(p[pairs[:, 0]] for p in parts), pairs[:, 1]]
                if size > 2:  # the words after the first must be a frequent phrase as well
                    lists = _only(lists, _set_bits(bits[size - 2], _folded(hw, parts[1:])))
                if size < length:
                    lists = _only(lists, _set_bits(bits[size - 1], _folded(hw, parts)))
            number, n = np.unique(lists[0], return_counts=True)
            text = pa.array(names, pa.binary()).cast(pa.string())
            for k in range(0, len(number), 1 << 16):
                some = number[k : k + (1 << 16)]
                phrase = text.take(pa.array(parts[0][some]))
                for p in parts[1:]:
                    phrase = pc.binary_join_element_wise(phrase, text.take(pa.array(p[some])), " ")
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang.decode()), len(some)), phrase, pa.array(n[k : k + (1 << 16)], pa.int64())], names=["lang", "phrase", "n"])

    found = docs.mapInArrow(mine, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _folded(hw: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    return reduce(_longer, [hw[p] for p in parts])


def _bit_table(frequent: DataFrame):
    """The broadcast bit table of (lang, phrase): tasks send the bytes that they set, at most 4 MB each and in pieces."""
    pieces, size = 1 << 10, (1 << TABLE_BITS) >> 13

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(pieces * size, np.uint8)
        for batch in batches:
            for lang, phrase in zip(batch["lang"].to_pylist(), batch["phrase"].to_pylist()):
                h = reduce(_longer, _word_hashes(lang.encode(), phrase.encode().split(b" ")).reshape(-1, 1))
                at = int(h[0] >> np.uint64(64 - TABLE_BITS))
                bits[at >> 3] |= 1 << (at & 7)
        some = np.flatnonzero(bits.reshape(pieces, size).any(axis=1))
        for k in range(0, len(some), 64):
            yield pa.RecordBatch.from_pydict({"piece": pa.array(some[k : k + 64], pa.int32()), "bits": [bits.reshape(pieces, size)[p].tobytes() for p in some[k : k + 64]]})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, bits in zip(batch["piece"].to_pylist(), batch["bits"]):
                held.setdefault(piece, np.zeros(size, np.uint8))
                held[piece] |= np.frombuffer(bits.as_py(), np.uint8)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(held), pa.int32()), "bits": pa.array([x.tobytes() for x in held.values()], pa.binary())})

    schema = "piece int, bits binary"
    out = np.zeros((pieces, size), np.uint8)
    for r in frequent.select("lang", "phrase").mapInArrow(mark, schema).repartition("piece").mapInArrow(join, schema).collect():
        out[r["piece"]] = np.frombuffer(r["bits"], np.uint8)  # 4 MB
    return frequent.sparkSession.sparkContext.broadcast(out.tobytes())


def _part(phrase: Column, first: int, n: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    words: int = WORDS,
    explained: int = EXPLAINED,
    top: int = TOP,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The phrases of 2 to ``words`` words of each language with the highest scores.

    Columns: ``lang``, ``rank`` int (from 1), ``phrase``, ``a`` (occurrences),
    ``l`` and ``r`` (occurrences of the two parts of the lowest-scoring cut),
    ``n`` (words of the language), ``score`` = floor(1,000,000 a a / (l r)),
    long each.

    Texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words
    at spaces and tabs, and phrases stay within a piece.  Candidates occur
    ``least`` times or more, overlaps included.  The cut with the lowest score
    counts, of equal ones the earliest.  A candidate goes if a longer one
    holds its words in a row and has ``explained`` per cent of its occurrences or
    more.
    Order: score and ``a`` descending, then the phrase by bytes; the first
    ``top`` of each language.

    A null text is empty, a null language is ``und``.  Repeated rows count
    each.  Words are whatever stands between spaces, marks and digits too.
    Empty tables give an empty result; extra columns are left out.

    Products are decimals of 38 digits, exact up to 10**15 occurrences.  Each
    length reads the texts once; what is shuffled is a row for each different
    phrase of a block.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    single = settle(_counted(rows, 1, []))
    total = single.groupBy("lang").agg(F.sum("n").alias("n"))
    levels, tables = [single.where(F.col("n") >= least)], []
    for length in range(2, words + 1):
        tables.append(_bit_table(levels[-1]))
        levels.append(settle(_counted(rows, length, tables).where(F.col("n") >= least)))
    longer = None
    scored = []
    for length in range(words, 1, -1):
        own = levels[length - 1].select("lang", "phrase", F.col("n").alias("a"))
        if longer is not None:
            own = own.join(longer.where(F.col("__size") == length).select("lang", "phrase", "__most"), ["lang", "phrase"], "left")
            own = own.where(F.col("__most").isNull() | (100 * F.col("__most") < explained * F.col("a"))).drop("__most")
        for k in range(1, length):
            left, right = levels[k - 1], levels[length - k - 1]
            own = own.withColumns({"__x": _part(F.col("phrase"), 1, k), "__y": _part(F.col("phrase"), k + 1, length - k)})
            own = own.join(left.select("lang", F.col("phrase").alias("__x"), F.col("n").alias("__l")), ["lang", "__x"])
            own = own.join(right.select("lang", F.col("phrase").alias("__y"), F.col("n").alias("__r")), ["lang", "__y"])
            wide = [F.col(c).cast("decimal(15,0)") for c in ("a", "__l", "__r")]
            own = own.withColumn(f"__cut{k}", F.struct(_floor_ratio(wide).alias("score"), F.lit(k).alias("k"), F.col("__l").alias("l"), F.col("__r").alias("r")))
            own = own.drop("__x", "__y", "__l", "__r")
        cut = F.least(*[F.col(f"__cut{k}") for k in range(1, length)]) if length > 2 else F.col("__cut1")
        scored.append(own.withColumn("__c", cut).select("lang", "phrase", "a", "__c.l", "__c.r", "__c.score"))
        inner = [
            levels[length - 1].select("lang", _part(F.col("phrase"), at, size).alias("phrase"), F.lit(size).alias("__size"), F.col("n").alias("__most"))
            for size in range(2, length)
            for at in range(1, length - size + 2)
        ]
        for part in inner:
            longer = part if longer is None else longer.unionByName(part)
        if inner:
            longer = longer.groupBy("lang", "phrase", "__size").agg(F.max("__most").alias("__most"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    all_ = reduce(DataFrame.unionByName, scored).withColumn("__s", F.pmod(F.xxhash64("phrase"), F.lit(STRETCHES)))
    first = all_.withColumn("rank", F.row_number().over(W.partitionBy("lang", "__s").orderBy(*best))).where(F.col("rank") <= top)
    first = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return first.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _floor_ratio(wide: list[Column]) -> Column:
    a, l, r = wide
    million = F.lit(1000000).cast("decimal(7,0)")
    return F.call_function("div", million * a * a, l * r)
