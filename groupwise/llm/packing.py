"""Packing documents into sequences by best-fit decreasing.

A document's ids (with its end id) are cut into full windows first; each full window is a
sequence by itself. What remains of the documents is written as a table of lengths and dealt by a
hash of the row, however the input was partitioned, to groups of about GROUP remainders. A group
is packed longest first: a segment tree indexed by remaining capacity finds the open sequence with
the tightest room. Only lengths are shuffled, no ids and no texts; a task holds one group.

Padding: no two open sequences of a group could be one, and a group of GROUP remainders leaves few
of them open, so padding is below two percent for any partitioning, unless the lengths themselves
don't fit together (documents that are all a little over half a sequence, say) or there are too
few of them to fill a sequence.

Defined results: null text packs as the empty text (its end id only); null or repeated doc_id
rows are packed like others, a piece row each; of equal lengths the earlier row is placed first; an
empty table gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupwise.llm.common import materialise
from groupwise.llm.tokens import encoder

GROUP = 8192
#: Bits of a sequence_id that count within a task or group, and the bit that marks groups.
WITHIN, GROUPED = 32, 1 << 62
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = ", ".join(f"{n} long" for n in NAMES)


class CapacityTree:
    """Open sequences by remaining capacity; find(n) takes one with the least room of n or more."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        k, count = room + self.leaves, self.count
        while k:
            count[k] += 1
            k >>= 1

    def find(self, n: int) -> tuple[int, int] | None:
        """(room, sequence), taken out of the tree; None if no open sequence has room."""
        count, k = self.count, n + self.leaves
        if not count[k]:
            while k & 1 or not count[k + 1]:  # climb to the next subtree on the right with one
                k >>= 1
                if k <= 1:
                    return None
            k += 1
            while k < self.leaves:
                k <<= 1
                if not count[k]:
                    k += 1
        room = k - self.leaves
        while k:
            count[k] -= 1
            k >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """(sequence, offset) of each piece, and the number of sequences; ties keep their order."""
    tree, made = CapacityTree(capacity), 0
    sequence, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        n = lengths[i]
        room, s = tree.find(n) or (capacity, made)
        made += s == made
        sequence[i], offset[i] = s, capacity - room
        if room > n:
            tree.add(room - n, s)
    return sequence, offset, made


def _pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Full windows, which are sequences, and remainders, whose sequence_id is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end = encoder(vocabulary), end_id.to_bytes(4, "little")
        sequence, window = TaskContext.get().partitionId() << WITHIN, 4 * capacity
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = e.encode(text.as_py()) + end
                n = len(ids) // 4
                whole = len(ids) - len(ids) % window
                for at in range(0, whole, window):
                    out.append((doc_id, at // 4, capacity, crc32(ids[at : at + window]), n, sequence, 0))
                    sequence += 1
                if whole < len(ids):
                    out.append((doc_id, whole // 4, n - whole // 4, crc32(ids[whole:]), n, None, None))
            if out:
                yield _rows(out)

    return docs.mapInArrow(run, SCHEMA)


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], NAMES)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: where its ids begin, their CRC-32, and its place."""
    pieces = _pieces(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), vocabulary, end_id, capacity)
    pieces = materialise(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    rest = pieces.where("sequence_id is null")
    groups = max(1, -(-rest.count() // GROUP))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for b in batches:
            for g, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != group and held:
                    yield place(group, held)
                    held = []
                group = g
                held.append(row)
        if held:
            yield place(group, held)

    def place(group: int, held: list[list]) -> pa.RecordBatch:
        sequence, offset, _ = best_fit_decreasing([r[2] for r in held], capacity)
        base = GROUPED + (group << WITHIN)
        return _rows([(*r, base + s, o) for r, s, o in zip(held, sequence, offset, strict=True)])

    dealt = rest.select(F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"), *NAMES[:5], "row")
    dealt = dealt.repartition("group").sortWithinPartitions("group", "row").drop("row")
    return pieces.where("sequence_id is not null").select(*NAMES).unionByName(dealt.mapInArrow(run, SCHEMA))
