"""Jaccard similarity join on word shingles with PartEnum signatures.

Sets of similar sizes share a band. Within a band two sets with a Jaccard similarity of at least
num/den differ in at most k elements. The hashed feature domain is cut into n1 parts, each into n2
smaller ones; at least one of the n1 parts holds at most k1 of the k differences, so some choice of
n2 - k1 of its smaller parts is equal in both sets. Every such choice is hashed to a signature:
similar sets share one, without exception. (n1 has `spare` parts more than needed, so more than `spare`
parts agree. A choice that is empty in a set is shared with a fixed share of all sets, so of its parts
with empty choices a set leaves out the last `spare`: sets that agree in more share an earlier one.)

Rows with one signature make a bucket. They are connected where an exact bound allows a link: hashed
to cells, two sets differ in at least as many elements as the counts of their cells do. A bucket with
more than SMALL rows is dealt to groups by a hash, and each two groups are compared. Only where a task
holds over HELD_SMALL rows of one signature are they connected through the smallest id, and all the
others of that signature with them, so that it leaves one row for each set of held signatures.
Neither way lists pairs. Connected rows form families. Buckets are compared in as many rounds as
keep a round's rows, each with its cells, below ROUND for a document.

A family's sets are compared exactly, in blocks; a comparison returns a spanning forest of the true
links. First each block is compared with itself, then one row of each component found stands for it
in new blocks. Families that are one component now are done: further links could not change the
result. The others are cut into blocks again, component by component, and pairs of blocks are
compared unless both lie in one component or their sizes exclude links. Pairs are dealt in tiles
of TILE x TILE, so that a block is sent once for TILE others. Equal sets are one node from the
start. Families are cut into blocks by counts, not by numbering their rows in one task.

Defined results: texts that are null or without words have the empty set and link with nothing;
rows with a null id link with nothing and keep a null component; rows that repeat an id are one
node, linked by any of their texts; other columns are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groupwise.llm.common import components, discard, materialise, one_by_id, split_by_ids
from groupwise.llm.shingles import U64, mix, set_hash, shingle_sets

BLOCK, TILE = 256, 8
#: Rows of a bucket that one task compares by their cells; rows of a signature that a task connects unseen.
SMALL, HELD_SMALL = 16384, 512
#: Rows of buckets compared at once, for each document.
ROUND = 16
#: Signatures that a task holds at once.
HELD = 1 << 20


@lru_cache(maxsize=None)
def bands(num: int, den: int, most: int) -> tuple[tuple[int, int], ...]:
    """Bands of set sizes (low, high): sets similar enough lie in one band or in neighbours."""
    out, low = [(0, 0)], 1
    while low <= most:
        high = low * den // num
        out.append((low, high))
        low = high + 1
    return tuple(out)


@lru_cache(maxsize=None)
def enumeration(low: int, high: int, num: int, den: int) -> tuple[int, int, int, int]:
    """(n1, n2, k1, spare) for sets of at least `low` and at most `high` elements.

    Of the ways to enumerate, the one with fewest signatures whose choices hold 8 elements on
    average; else, among those with at most k + 8 signatures, the one whose choices hold most.
    """
    k = 2 * high * (den - num) // (den + num)
    if not k:
        return 1, 1, 0, 0
    found = []
    for k1 in range(1, min(k, 3) + 1):
        for n2 in range(k1 + 1, k1 + 4):
            parts = k // (k1 + 1) + 1
            spare = 2 + parts // 20 if k >= 8 else 0
            found.append((parts + spare, n2, k1, spare, (parts + spare) * comb(n2, k1), low * (n2 - k1) / (n2 * (parts + spare))))
    full = [f for f in found if f[5] >= 8]
    if full:
        return min(full, key=lambda f: f[4])[:4]
    few = [f for f in found if f[4] <= 1.25 * k + 16]
    return max(few, key=lambda f: f[5])[:4]


@lru_cache(maxsize=None)
def _choices(n2: int, k1: int) -> np.ndarray:
    """0/1 matrix: smaller parts x choices of n2 - k1 of them."""
    m = np.zeros((n2, comb(n2, k1)), U64)
    for c, kept in enumerate(combinations(range(n2), n2 - k1)):
        m[list(kept), c] = 1
    return m


def band_signatures(s: np.ndarray, mixed: np.ndarray, band: int, params: tuple[int, int, int, int]) -> np.ndarray:
    n1, n2, k1, spare = params
    part = ((s >> U64(40)) * U64(n1)) >> U64(24)
    small = ((s & U64(0xFFFFFF)) * U64(n2)) >> U64(24)
    cell = (part * U64(n2) + small).astype(np.int64)
    low = np.bincount(cell, (mixed & U64(0xFFFFFFFF)).astype(float), n1 * n2)  # exact: below 2**53
    high = np.bincount(cell, (mixed >> U64(32)).astype(float), n1 * n2)
    sums = ((high.astype(U64) << U64(32)) + low.astype(U64)).reshape(n1, n2)
    choices = _choices(n2, k1)
    value = sums @ choices
    filled = ((np.bincount(cell, minlength=n1 * n2).reshape(n1, n2) > 0) @ (choices > 0)) > 0
    sig = mix(value ^ mix(U64(band << 40) + np.arange(value.size, dtype=U64).reshape(value.shape)))
    some_empty = np.flatnonzero(~filled.all(1))
    filled[some_empty[: max(0, len(some_empty) - spare)]] = True  # these keep all
    return sig[filled]


def signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """All signatures of a non-empty set: as a member of its own band and of the next one's pairs."""
    known = bands(num, den, 1 << 62)
    own = _band_of(len(s), num, den)
    mixed = mix(s)
    with np.errstate(over="ignore"):
        return np.concatenate([band_signatures(s, mixed, b, enumeration(max(known[b - 1][0], 1), known[b][1], num, den)) for b in (own, own + 1)])


def _band_of(n: int, num: int, den: int) -> int:
    lows = _lows(num, den)
    return int(np.searchsorted(lows, n, side="right")) - 1


@lru_cache(maxsize=None)
def _lows(num: int, den: int) -> np.ndarray:
    return np.array([b[0] for b in bands(num, den, 1 << 62)], np.int64)


def _text_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple]:
    for b in batches:
        yield b, shingle_sets((t.as_py() for t in b.column(1)), words)


def cell_counts(s: np.ndarray) -> bytes:
    """How many elements of a set each of its cells holds, a byte for each; empty if one has too many.

    There are a power of two of cells, at least a quarter of the set's size; the cells of a smaller
    set are pairs, fours and so on of those of a larger one.
    """
    bits = max(3, (len(s) // 4).bit_length())
    count = np.bincount((s >> U64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return count.astype(np.uint8).tobytes() if count.max() < 256 else b""


def may_link(sizes: list[int], cells: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of rows that connect all rows whose cells allow a similarity of num / den.

    Breadth first: each row in turn takes the rows not yet reached that may link to it.
    """
    unbounded = next((i for i, c in enumerate(cells) if not c), None)
    if unbounded is not None:  # it may link to any row, so it connects them all
        return [(unbounded, j) for j in range(len(cells)) if j != unbounded]
    out: list[tuple[int, int]] = []
    if len(cells) < 2:
        return out
    least = min(map(len, cells))
    table = np.stack([np.frombuffer(c, np.uint8).reshape(least, -1).sum(1, dtype=np.int32) for c in cells])
    if table.max() < 1 << 15:
        table = table.astype(np.int16)  # differences fit
    size = np.array(sizes, np.int64)
    rest, queue = np.arange(1, len(cells)), [0]
    far, far_size = table[1:], size[1:]  # of the rest
    while len(rest):
        if not queue:
            queue.append(int(rest[0]))
            rest, far, far_size = rest[1:], far[1:], far_size[1:]
            continue
        k = queue.pop()
        near = np.abs(far - table[k]).sum(1, dtype=np.int32) * (den + num) <= (far_size + size[k]) * (den - num)
        if near.any():
            found = rest[near].tolist()
            out += [(k, i) for i in found]
            queue += found
            rest, far, far_size = rest[~near], far[~near], far_size[~near]
    return out


def _set_rows(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, cells) of every row; set_id and cells are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _text_batches(batches, words):
            found = [(len(s), set_hash(s), cell_counts(s)) if len(s) else (0, None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary())))], ["doc_id", "n_shingles", "set_id", "cells"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_id long, cells binary")


def _candidates(docs: DataFrame, sets: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(a, b): pairs that connect the rows of each bucket. sets: rows of _set_rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, owners, seen, size = [], [], set(), 0  # equal sets among those held are one
        for b, sets in _text_batches(batches, words):
            for doc_id, s in zip(b.column(0).to_pylist(), sets, strict=True):
                if doc_id is None or not len(s) or (name := set_hash(s)) in seen:
                    continue
                seen.add(name)
                sigs.append(signatures(s, num, den))
                owners.append(np.full(len(sigs[-1]), doc_id, np.int64))
                size += len(sigs[-1])
                if size >= HELD:
                    yield from settle(sigs, owners)
                    sigs, owners, seen, size = [], [], set(), 0
        if sigs:
            yield from settle(sigs, owners)

    def settle(sigs: list[np.ndarray], owners: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sig, owner = np.concatenate(sigs).view(np.int64), np.concatenate(owners)
        order = np.lexsort((owner, sig))
        sig, owner = sig[order], owner[order]
        first = np.append(True, sig[1:] != sig[:-1])
        group = np.cumsum(first) - 1
        least = owner[first][group]
        large = np.bincount(group)[group] > HELD_SMALL
        pairs = np.unique(np.stack([owner[large], least[large]], 1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        keep = np.flatnonzero(first | ~large)
        for at in range(0, len(keep), 1 << 17):
            some = keep[at : at + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(sig[some]), pa.array(owner[some]), pa.nulls(len(some), pa.int64()), pa.array(large[some])], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.bool_())], names)

    names = ["sig", "a", "b", "large"]
    rows = docs.mapInArrow(run, "sig long, a long, b long, large boolean")
    # pairs made within a task pass with a signature of their own: one shuffle serves both
    rows = rows.withColumn("sig", F.coalesce(F.col("sig"), F.xxhash64("a", "b")))
    bucket = Window.partitionBy("sig")
    member = F.when(F.col("b").isNull(), F.col("a"))
    rows = rows.withColumns({"size": F.count(member).over(bucket), "some_large": F.max("large").over(bucket), "least": F.min(member).over(bucket)})
    star = F.coalesce("b", F.when(F.col("some_large"), F.col("least")))
    rows = rows.where("b is not null or size > 1").select("sig", "a", star.alias("b"), "size")
    # a bucket of more than SMALL rows is one for each two of its groups, so that each two rows meet
    groups = F.ceil(F.col("size") * 2 / SMALL).cast("int")
    own = F.pmod(F.xxhash64("a", "sig"), groups).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), groups - 1), lambda g: F.struct(F.least(g, own).alias("i"), F.greatest(g, own).alias("j")))
    rows = rows.withColumn("tile", F.explode(F.when(F.col("b").isNull() & (F.col("size") > SMALL), tiles).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))))
    # buckets become lists of members, so that those with the same rows are one; the rest are pairs
    rows = rows.groupBy("sig", "tile", "b", F.when(F.col("b").isNotNull(), F.col("a")).alias("a_of_pair")).agg(F.sort_array(F.collect_list(F.when(F.col("b").isNull(), F.col("a")))).alias("members"))
    buckets = materialise(rows.select("members", F.col("a_of_pair").alias("a"), "b").distinct(), "buckets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], set()
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != key:
                    settle_bucket(held, out)
                    key, held = row[0], []
                held.append(row)
            if len(out) >= 100_000:
                yield emit(out)
                out = set()
        settle_bucket(held, out)
        yield emit(out)

    def settle_bucket(held: list[tuple], out: set) -> None:
        if len(held) > 1:
            for i, j in may_link([h[2] for h in held], [h[3] for h in held], num, den):
                a, b = held[i][1], held[j][1]
                if a != b:
                    out.add((max(a, b), min(a, b)))

    def emit(out: set) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    met = buckets.where("b is null").select(F.xxhash64("members").alias("sig"), "members")
    rounds = -(-(met.agg(F.sum(F.size("members"))).first()[0] or 0) // max(1, ROUND * sets.count()))
    parts = []
    for k in range(rounds):
        here = met.where(F.pmod("sig", F.lit(rounds)) == k).select("sig", F.explode("members").alias("a"))
        here = here.join(sets.where("set_id is not null").select(F.col("doc_id").alias("a"), "n_shingles", "cells"), "a")
        here = here.repartition("sig").sortWithinPartitions("sig").select("sig", "a", "n_shingles", "cells").mapInArrow(check, "a long, b long")
        parts.append(materialise(here.distinct(), "alike"))
    found = buckets.where("a <> b").select("a", "b")
    for part in parts:
        found = found.unionByName(part)
    found = materialise(found.distinct(), "candidates")
    discard(buckets, *parts)
    return found


def _member_texts(docs: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """places (doc_id, n, ...) with the texts of the ids, and a table that this reads.

    Rows of an id with several texts have each of them. Texts are shuffled, not their shingles, which
    don't compress; and only those that a filter of the ids lets pass.
    """
    near, _, words = split_by_ids(docs.where("doc_id is not null and text is not null").select("doc_id", "text"), places, "doc_id")
    return near.join(places, "doc_id"), words


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is not in ids (long, not null); only rows that a filter finds possible are shuffled."""
    possible, kept, _ = split_by_ids(docs, ids, id_col)
    gone = ids.select(F.col(id_col).alias(id_col)).distinct()
    return kept.unionByName(possible.join(gone, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]))


def _blocked(rows: DataFrame, by: list[str], order: list[F.Column]) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, n, family, ...) with a block of about BLOCK rows, null in families that are one block.

    by: columns that rows of neighbouring blocks share, in `order` within a family. Only their counts
    are put in order; rows of one count are spread over its places by a hash. Also returns a table
    that the result reads.
    """
    counts = rows.groupBy("family", *by).agg(F.count("*").alias("here"), F.min("n").alias("least"))
    family = Window.partitionBy("family")
    earlier = family.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"base": F.coalesce(F.sum("here").over(earlier), F.lit(0)), "all": F.sum("here").over(family)})
    # families of several blocks only; written, so that its size is known
    counts = materialise(counts.where(F.col("all") > BLOCK).select("family", *by, "here", "base"), "counts")
    place = F.col("base") + F.pmod(F.xxhash64("doc_id"), F.col("here"))
    return rows.join(counts, ["family", *by], "left").withColumn("block", F.floor(place / BLOCK).cast("int")).drop("here", "base"), counts


def similar(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Boolean matrix of left x right: den * intersection >= num * union."""
    sets = left + right
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)  # exact below 2**24
    width, n_columns = 4096, int(column[-1]) + 1 if len(column) else 0
    cuts = np.searchsorted(column, np.arange(0, n_columns + width, width))
    for k in range(len(cuts) - 1):
        some = slice(cuts[k], cuts[k + 1])
        m = np.zeros((len(sets), width), np.float32)
        m[row[some], column[some] - k * width] = 1
        both += m[: len(left)] @ m[len(left) :].T
    size = np.array([len(s) for s in sets], np.int64)
    both = both.astype(np.int64)
    return den * both >= num * (size[: len(left), None] + size[None, len(left) :] - both)


def forest(ids_left: np.ndarray, ids_right: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what a matrix of links connects, at most one per row and column."""
    label = np.arange(len(ids_left))
    far = np.full(len(ids_right), len(label))
    while True:
        new_far = np.where(linked, label[:, None], len(label)).min(0, initial=len(label))
        new = np.minimum(label, np.where(linked, new_far[None, :], len(label)).min(1, initial=len(label)))
        if (new == label).all() and (new_far == far).all():
            break
        label, far = new, new_far
    out = [(int(ids_left[i]), int(ids_left[k])) for i, k in enumerate(label) if i != k]
    return out + [(int(ids_right[j]), int(ids_left[k])) for j, k in enumerate(far) if k < len(label) and ids_right[j] != ids_left[k]]


#: What a block gives: links; rows that stand for its components; or its sets, to be compared with those of other blocks.
BLOCK_OUT = "a long, b long, family long, several boolean, doc_id long, n long, text string, block int, least long, most long, first long, last long, ids binary, sizes binary, data binary"
_BLOCK_TYPES = [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 2 + [pa.string(), pa.int32()] + [pa.int64()] * 4 + [pa.binary()] * 3


def _within(texts: DataFrame, words: int, num: int, den: int, send: bool) -> DataFrame:
    """Links within blocks of texts (doc_id, n, text, family, block, component), and of families with
    several blocks the rows that stand for the components found or, with `send`, the blocks themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def settle():
            family, block = held[0][2:4]
            sets = list(shingle_sets((h[1] for h in held), words))
            held[:] = [(*h, s) for h, s in zip(held, sets, strict=True) if len(s) == h[5]]  # an id may have other texts
            if not held:
                return
            ids, found = np.array([h[0] for h in held]), [h[6] for h in held]
            pairs = forest(ids, ids, similar(found, found, num, den)) if len(ids) > 1 else []
            out.extend((a, b, family, block is not None, *[None] * 11) for a, b in pairs)
            if block is not None and send:
                sizes, parts = np.array([len(s) for s in found], np.int64), [h[4] for h in held]
                out.append((None, None, family, True, None, None, None, block, int(sizes.min()), int(sizes.max()), min(parts), max(parts), ids.tobytes(), sizes.tobytes(), b"".join(s.tobytes() for s in found)))
            elif block is not None:
                linked = {a for a, _ in pairs}  # every row but one of a component
                out.extend((None, None, family, True, h[0], h[5], h[1], *[None] * 8) for h in held if h[0] not in linked)
            held.clear()

        def batch():
            rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _BLOCK_TYPES, strict=True)], [c.split()[0] for c in BLOCK_OUT.split(", ")])
            out.clear()
            return rows

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and r[2:4] != held[0][2:4]:
                    settle()
                held.append(r)
            if out:
                yield batch()
        if held:
            settle()
        if out:
            yield batch()

    taken = texts.select("doc_id", "text", "family", "block", "component", "n")
    return taken.repartition("family", "block").sortWithinPartitions("family", "block").mapInArrow(run, BLOCK_OUT)


def _across(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links between blocks of a family, tile by tile."""
    tile = F.floor(F.col("block") / TILE).cast("int")
    slim = blocks.select("family", "block", tile.alias("tile"), "least", "most", "first", "last")
    left = slim.toDF("family", *[f"{c}_i" for c in slim.columns[1:]])
    right = slim.toDF("family", *[f"{c}_j" for c in slim.columns[1:]])
    one_component = (F.col("first_i") == F.col("last_i")) & (F.col("first_j") == F.col("last_j")) & (F.col("first_i") == F.col("first_j"))
    sizes_allow = (F.col("least_j") * num <= F.col("most_i") * den) & (F.col("least_i") * num <= F.col("most_j") * den)
    pairs = left.join(right, "family").where((F.col("block_i") < F.col("block_j")) & ~one_component & sizes_allow)
    tiles = materialise(pairs.groupBy("family", F.col("tile_i").alias("i"), F.col("tile_j").alias("j")).agg(F.collect_list(F.struct(F.col("block_i").alias("x"), F.col("block_j").alias("y"))).alias("pairs")), "tiles")
    data = blocks.withColumn("tile", tile).select("family", "tile", "block", "ids", "sizes", "data")
    lead = tiles.select("family", "i", "j", "pairs").withColumnRenamed("i", "tile").withColumn("i", F.col("tile"))
    other = tiles.where("i <> j").select("family", F.col("j").alias("tile"), "i", "j")
    met = data.join(lead, ["family", "tile"]).select("family", "i", "j", "block", "ids", "sizes", "data", "pairs")
    met = met.unionByName(data.join(other, ["family", "tile"]).select("family", "i", "j", "block", "ids", "sizes", "data"), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, pairs = None, {}, None

        def settle():
            found = [link for p in pairs or [] for link in forest(held[p["x"]][0], held[p["y"]][0], similar(held[p["x"]][1], held[p["y"]][1], num, den))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

        for b in batches:
            for family, i, j, block, ids, sizes, data, some in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (family, i, j) != key:
                    yield from settle()
                    key, held, pairs = (family, i, j), {}, None
                ends = np.cumsum(np.frombuffer(sizes, np.int64))
                held[block] = (np.frombuffer(ids, np.int64), np.split(np.frombuffer(data, U64), ends[:-1]))
                pairs = pairs or some
        yield from settle()

    links = materialise(met.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(run, "a long, b long"), "across")
    discard(tiles)
    return links


def _links(texts: DataFrame, members: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(a, b) that connect what the links of the families connect. members: (doc_id, n, family)."""
    none = F.lit(None).cast("long").alias("component")
    places, read = _blocked(members, ["n"], [F.col("n")])
    places = materialise(places, "places")
    members, bits = _member_texts(texts, places)
    first = materialise(_within(members.select("*", none), words, num, den, False), "within")
    discard(read, bits)
    found, waste = [first], [places, first]
    stand = first.where("doc_id is not null").select("doc_id", "n", "family", "text")
    if not stand.isEmpty():
        again, read = _blocked(stand, ["n"], [F.col("n")])
        second = materialise(_within(again.select("*", none), words, num, den, False).select("a", "b", "family", "several").where("a is not null"), "standing")
        found.append(second)
        large = first.where("several").select("a", "b", "family").unionByName(second.select("a", "b", "family")).where("a is not null")
        label = components(large)
        rows = places.where("block is not null").select("doc_id", "n", "family").join(label.toDF("doc_id", "component"), "doc_id", "left")
        rows = materialise(rows.withColumn("component", F.coalesce("component", "doc_id")), "labelled")
        open_ = rows.groupBy("family").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("family")
        open_ = materialise(open_, "open")
        waste += [read, second, label, rows, open_]
        if not open_.isEmpty():
            left, read = _blocked(rows.join(open_, "family", "left_semi"), ["component"], [F.col("least"), F.col("component")])
            left = materialise(left, "left")
            members, bits = _member_texts(texts, left)
            third = materialise(_within(members, words, num, den, True), "blocks")
            links = _across(third.where("block is not null"), num, den)
            found += [third, links]
            waste += [read, left, bits, third, links]
    out = found[0].where("a is not null").select("a", "b")
    for f in found[1:]:
        out = out.unionByName(f.where("a is not null").select("a", "b"))
    out = materialise(out, "links")
    discard(*waste)
    return out


def classes(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: links are Jaccard >= num / den."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialise(_set_rows(texts, words), "sets")
    named = rows.where("set_id is not null and doc_id is not null")
    reps = materialise(named.groupBy("set_id").agg(F.min("doc_id").alias("rep")), "reps")
    of = materialise(named.join(reps, "set_id").select("doc_id", "rep").distinct(), "of")
    pairs = _candidates(texts, rows, words, num, den)
    a, b = of.toDF("a", "rep_a"), of.toDF("b", "rep_b")
    families = components(pairs.join(a, "a").join(b, "b").where("rep_a <> rep_b").select("rep_a", "rep_b"), "rep_a", "rep_b")
    sizes = named.select("doc_id", F.col("n_shingles").alias("n")).distinct()
    links = _links(texts, families.toDF("doc_id", "family").join(sizes, "doc_id"), words, num, den)
    found = components(links.unionByName(one_by_id(of, "doc_id", "rep")))
    discard(pairs, families, links, of)
    named_rows = rows.join(reps, "set_id", "left").join(found.toDF("rep", "component"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    out = materialise(named_rows.select("doc_id", "n_shingles", component.alias("component_id")), "classes")
    discard(rows, reps, found)
    return out
