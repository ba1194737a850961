"""Token ids packed into fixed-length rows by best-fit decreasing.

Each document becomes token ids and one separator; a document longer than a
row is split without loss.  The pieces of a block of documents are packed by
best-fit decreasing: pieces by falling length, each into the row with the
least room that still holds it, found in logarithmic time in a segment tree
over remaining room.  A row comes out as binary ids, cumulative segment
lengths and positions that restart with each segment.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batch, each

#: Tokens of the pieces that are packed together: a task's memory is a small multiple of it.
BLOCK_TOKENS = 2_000_000
_ENCODERS: dict[str, tiktoken.Encoding] = {}


def default_ranks() -> str:
    """The byte-level vocabulary of 50,256 ids that the environment provides."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(ranks_path: str, pattern: str | None = None) -> tiktoken.Encoding:
    """The byte-pair encoder of a rank file, made once in each process."""
    if ranks_path not in _ENCODERS:
        if pattern is None:
            from public_tokenizers import PATTERN as pattern
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
        _ENCODERS[ranks_path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[ranks_path]


class RoomTree:
    """A segment tree over room sizes 0..capacity; leaf r lists the open rows with room r."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, row) with the least room of at least ``need``."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not self.count[2 * node])
        room = node - self.leaves
        row = self.rows[room].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, row


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Pieces (by index) of each row; pieces in falling length, equal ones in the given order."""
    rows: list[list[int]] = []
    tree = RoomTree(capacity)
    for piece in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[piece])
        found = tree.take(need)
        room, row = found if found else (capacity, len(rows))
        if not found:
            rows.append([])
        rows[row].append(piece)
        tree.add(room - need, row)
    return rows


@dataclass(frozen=True)
class PackSpec:
    """Row length, vocabulary and the id that ends a document and fills up a row."""

    row_tokens: int = 2048
    ranks_path: str | None = None
    end_id: int = 50256
    block_tokens: int = BLOCK_TOKENS

    @property
    def dtype(self) -> str:
        return "<u2" if self.end_id < 1 << 16 else "<u4"


def pack_block(names: list, ids: list[np.ndarray], spec: PackSpec) -> pd.DataFrame:
    """Packed rows of a block of documents (names and token ids, ends included)."""
    cap = spec.row_tokens
    doc = np.concatenate([np.full(-(-len(x) // cap), k) for k, x in enumerate(ids)])
    part = np.concatenate([np.arange(-(-len(x) // cap)) for x in ids])
    lengths = np.array([min(cap, len(ids[d]) - cap * p) for d, p in zip(doc, part)])
    out = []
    for pieces in best_fit_decreasing(lengths, cap):
        n = lengths[pieces]
        cum = np.concatenate([[0], np.cumsum(n)])
        row = np.full(cap, spec.end_id, dtype=spec.dtype)
        at = np.arange(cap)
        for k, p in enumerate(pieces):
            row[cum[k] : cum[k + 1]] = ids[doc[p]][cap * part[p] : cap * part[p] + n[k]]
        starts = np.repeat(cum, np.concatenate([n, [cap - cum[-1]]]))  # the filling is a segment of its own
        out.append(
            (
                [names[doc[p]] for p in pieces],
                part[pieces].tolist(),
                cum.tolist(),
                row.tobytes(),
                (at - starts).astype("<u2" if cap <= 1 << 16 else "<u4").tobytes(),
                int(cum[-1]),
            )
        )
    return pd.DataFrame(out, columns=["doc_ids", "parts", "cu_seqlens", "input_ids", "position_ids", "n_tokens"])


def pack_tokens(
    docs: DataFrame, spec: PackSpec | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokenize all documents and pack them into rows of ``spec.row_tokens`` ids.

    Columns: ``doc_ids`` array<long> and ``parts`` array<int> (document and
    part number of each segment), ``cu_seqlens`` array<int> (0, then the
    cumulative segment lengths), ``input_ids`` and ``position_ids`` binary
    (little-endian, ``row_tokens`` of them; 2 bytes each while ids and
    positions fit), ``n_tokens`` int (without the filling).  Parts of a
    document in order, put one after another, are its ids and the end id.

    A null or empty text is the end id alone, a null id a null in
    ``doc_ids``, repeated rows are packed again; text that looks like a
    special token is encoded as ordinary text.  An empty table gives an empty
    result; extra columns are left out.

    No shuffle: a task packs blocks of ``spec.block_tokens`` tokens of its
    own rows, so its memory is bounded and a lost task is simply run again.
    The vocabulary file must lie at the same path on all machines.
    """
    spec = spec or PackSpec()
    ranks = spec.ranks_path or default_ranks()
    integer = docs.schema[id_col].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(ranks).encode_ordinary, np.array([spec.end_id], dtype=spec.dtype)
        names, ids, held = [], [], 0
        for batch in batches:
            for name, text in zip(each(batch["__id"]), each(batch["__text"])):
                own = np.concatenate([np.array(encode(text), dtype=spec.dtype), end]) if text else end
                names.append(name)
                ids.append(own)
                held += len(own)
                if held >= spec.block_tokens:
                    yield from _in_slices(pack_block(names, ids, spec))
                    names, ids, held = [], [], 0
        if names:
            yield from _in_slices(pack_block(names, ids, spec))

    rows = docs.select(F.col(id_col).cast("string").alias("__id"), F.col(text_col).alias("__text"))
    packed = rows.mapInArrow(
        pack,
        "doc_ids array<string>, parts array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary, n_tokens int",
    )
    return packed.withColumn("doc_ids", F.transform("doc_ids", lambda x: x.cast(integer)))


_ROWS = pa.schema(
    [
        ("doc_ids", pa.list_(pa.string())),
        ("parts", pa.list_(pa.int32())),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("input_ids", pa.binary()),
        ("position_ids", pa.binary()),
        ("n_tokens", pa.int32()),
    ]
)


def _in_slices(frame: pd.DataFrame, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(frame), rows):
        yield as_batch(frame.iloc[at : at + rows], _ROWS)
