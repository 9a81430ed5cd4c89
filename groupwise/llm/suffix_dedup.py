"""Exact removal of repeated passages with suffix arrays over content-made shards.

A byte is removed if a WIDTH-byte string over it also starts in a document with a smaller id.
Every such string (window) is named by its minimiser, the least hash of the GRAM-byte strings in
it, so equal windows of any documents have one name. The steps:

1. names held by two different texts or more are found (one row per text and name);
2. of equal texts the one with the smallest id is cut into segments, the runs of windows that
   share such a name; equal segments are one, with the smallest document that has them;
3. segments are dealt to shards by name, and the suffix array of many shards at a time is built by
   induced sorting; permuted common prefixes of WIDTH or more join equal windows, and each window
   learns the smallest document that has it;
4. documents take back the windows that a smaller document has, merge them to spans, and drop them.

No shard grows with the corpus: a name with more than MANY_SEGMENTS segments is split by a finer
minimiser, and where a part still has more (a common line in many texts, with different neighbours),
its windows go one by one: each distinct window is aggregated to its smallest document, within
tasks first; answers that windows common themselves need are joined by broadcast, up to
COMMON_WINDOWS of them, and neighbours with one answer become one row again. A segment goes into an array only if one of its windows has a hash that
occurs twice among SHARD_BYTES of segments; what is left out has nothing to compare with, and an array
is built when what is left of several such lots fills it.

Each row is bounded by a document or a segment; a suffix array covers about SHARD_BYTES. Texts are
equal if their 64-bit hash and 128 bits of SHA-256 are; different texts with one 64-bit hash are
known and treated apart. Segments of one name are told apart by 64-bit digests. Hot names are
pre-aggregated within each task before the shuffle. Intermediate tables are written to the shared
folder, so a lost executor repeats one step only.

Defined results: null text is the empty one; a document with a null id neither removes nor loses
bytes; rows with the same id don't remove each other's bytes and are judged each by itself; texts
shorter than WIDTH lose nothing; other columns are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groupwise.llm.common import columns_as_row, discard, materialise, row_as_columns, slices
from groupwise.llm.shingles import U64, mix
from groupwise.llm.suffix_array import permuted_common_prefixes, suffix_array

GRAM, FINE_GRAM = 16, 40
SHARD_BYTES = 2_000_000
#: Bytes of texts whose names or segments a task holds at once.
SLICE = 1 << 23
#: Bytes of texts that are named at once.
CHUNK = 1 << 18
#: Windows of a segment; segments of a name (or of its finer part) from which on it is split.
SEGMENT_WINDOWS, MANY_SEGMENTS = 256, 5_000
#: Answers of common windows that are broadcast at most; windows beyond are joined by shuffling.
COMMON_WINDOWS = 50_000
ODD = 0x9E3779B97F4A7C15


def window_names(raw: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The minimiser's hash of every window of a byte array, by doubling minima."""
    n, count = len(raw), len(raw) - width + 1
    if count <= 0:
        return np.empty(0, U64)
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    words = np.empty((n + 7) // 8 * 8, U64)  # eight bytes from each position
    for k in range(8):
        words[k::8] = np.frombuffer(padded, "<u8", len(words) // 8, k)
    with np.errstate(over="ignore"):
        h = mix(words[: n - gram + 1])
        for at in range(8, gram - 7, 8):
            h = mix(h * U64(ODD) + words[at : at + n - gram + 1])
        if gram % 8:
            h = mix(h * U64(ODD) + words[gram - 8 : n - 7])
    span, s = width - gram + 1, 1
    while 2 * s <= span:
        h, s = np.minimum(h[:-s], h[s:]), 2 * s
    return np.minimum(h[: len(h) - (span - s)], h[span - s :]) if s < span else h


def named_runs(texts: list[bytes], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, text, start, windows, name) of the runs of equally named windows, chunk by chunk.

    Texts are joined up to CHUNK bytes and named together; windows across two texts are left out.
    """
    at = 0
    while at < len(texts):
        last, size = at + 1, len(texts[at])
        while last < len(texts) and size + len(texts[last]) <= CHUNK:
            size += len(texts[last])
            last += 1
        sizes = np.array([len(t) for t in texts[at:last]])
        begins = np.cumsum(sizes) - sizes
        name = window_names(np.frombuffer(b"".join(texts[at:last]), np.uint8), width, GRAM)
        windows = np.maximum(sizes - width + 1, 0)
        some = np.flatnonzero(windows)
        if len(some):
            place = np.arange(windows.sum()) + np.repeat((begins - np.cumsum(windows) + windows)[some], windows[some])
            own, name = np.repeat(some, windows[some]), name[place]
            change = np.append(True, (name[1:] != name[:-1]) | (own[1:] != own[:-1]))
            label = np.cumsum(change)
            start, length = runs(label, SEGMENT_WINDOWS)
            yield at, own[start], place[start] - begins[own[start]], length, name[start]
        at = last


def runs(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal values, cut at `most`."""
    start = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    length = np.diff(np.append(start, len(values)))
    pieces = -(-length // most)
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(start, pieces) + within * most, np.minimum(most, np.repeat(length, pieces) - within * most)


def _shared_names(docs: DataFrame, twins: DataFrame, width: int) -> DataFrame:
    """(text_hash, names) of the texts with windows named like a window of another text.

    twins: hashes that different texts have; all names of those texts count as shared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, SLICE):
            hashes, twin = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            _, at = np.unique(hashes, return_index=True)  # equal texts are one
            at = np.union1d(at, np.flatnonzero(twin))
            hashes, twin = hashes[at], twin[at]
            texts = [(b.column(1)[k].as_py() or "").encode() for k in at.tolist()]
            names, owners = [], []
            for first, own, _, _, name in named_runs(texts, width):
                names.append(name)
                owners.append(own + first)
            if not names:
                continue
            name, owner = np.concatenate(names).view(np.int64), np.concatenate(owners)
            order = np.lexsort((owner, name))
            name, owner = name[order], owner[order]
            first = np.append(True, name[1:] != name[:-1])
            row = np.append(True, (name[1:] != name[:-1]) | (owner[1:] != owner[:-1]))
            group = np.cumsum(first) - 1
            begins = np.flatnonzero(first)
            several = ((np.add.reduceat(row.astype(np.int64), begins) > 1) | np.maximum.reduceat(twin[owner], begins))[group]
            # one row stands for a name in this batch; the others' answer is known already
            for kind, some in ((False, np.flatnonzero(first)), (True, np.flatnonzero(row & ~first))):
                for k in range(0, len(some), 1 << 17):
                    part = some[k : k + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([pa.array(name[part]), pa.array(hashes[owner[part]]), pa.array(several[part]), pa.array(np.full(len(part), kind))], ["name", "text_hash", "several", "known"])

    texts = docs.where("doc_id is not null and text is not null").select("text_hash", "text")
    if twins.isEmpty():
        texts = texts.withColumn("twin", F.lit(False))
    else:
        texts = texts.join(twins.withColumn("twin", F.lit(True)), "text_hash", "left").select("text_hash", "text", F.coalesce("twin", F.lit(False)).alias("twin"))
    rows = texts.mapInArrow(run, "name long, text_hash long, several boolean, known boolean")
    # names known to be shared pass with keys of their own, so that a hot name is not one group
    rows = rows.withColumn("key", F.when(F.col("known"), F.xxhash64("name", "text_hash")).otherwise(F.col("name")))
    same = Window.partitionBy("key", "known")
    rows = rows.withColumn("shared", F.max("several").over(same) | (F.min("text_hash").over(same) != F.max("text_hash").over(same)))
    return rows.where("shared").groupBy("text_hash").agg(F.collect_set("name").alias("names"))


def _segments(docs: DataFrame, shared: DataFrame, width: int) -> DataFrame:
    """A row for every run of shared windows: (name, seg_hash, doc_id, text_hash, start).

    The first row of a segment in a batch has its bytes and the batch's smallest document with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, SLICE):
            texts = [t.as_py().encode() for t in b.column(2)]
            ids, lists = b.column(0).to_numpy(), b.column(3)
            known = lists.flatten().to_numpy().view(U64)
            of = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
            order = np.lexsort((known, of))
            known, of = known[order], of[order]
            bounds = np.searchsorted(of, np.arange(len(texts) + 1))
            table: dict[bytes, int] = {}
            pieces: list[bytes] = []
            least: list[int] = []
            columns: list[list] = [[], [], [], []]
            for first, own, start, length, name in named_runs(texts, width):
                own = own + first
                hit = np.zeros(len(own), bool)
                for k in np.unique(own).tolist():
                    mine = slice(*np.searchsorted(own, [k, k + 1]))
                    there = known[bounds[k] : bounds[k + 1]]
                    at = np.searchsorted(there, name[mine])
                    hit[mine] = there[np.minimum(at, len(there) - 1)] == name[mine]
                own, start, length, name = own[hit], start[hit], length[hit], name[hit]
                number = []
                for k, s, e in zip(own.tolist(), start.tolist(), (start + length + width - 1).tolist(), strict=True):
                    piece = texts[k][s:e]
                    n = table.setdefault(piece, len(pieces))
                    if n == len(pieces):
                        pieces.append(piece)
                        least.append(ids[k])
                    elif ids[k] < least[n]:
                        least[n] = ids[k]
                    number.append(n)
                for c, x in zip(columns, (name.view(np.int64), own, start, np.array(number, np.int64)), strict=True):
                    c.append(x)
            if not pieces:
                continue
            name, own, start, number = map(np.concatenate, columns)
            _, lead = np.unique(number, return_index=True)
            bytes_of, owner = np.full(len(number), None, object), np.full(len(number), None, object)
            bytes_of[lead], owner[lead] = pieces, least
            # digests of eight bytes join the rows of a segment to what is found for it
            seg_hash = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=8).digest() for p in pieces), np.int64)[number]
            hashes = b.column(1).to_numpy()[own]
            for k in range(0, len(number), 1 << 17):
                p = slice(k, k + (1 << 17))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[p]) for x in (name, seg_hash, ids[own], hashes, start)] + [pa.array(bytes_of[p], pa.binary()), pa.array(owner[p], pa.int64())],
                    ["name", "seg_hash", "doc_id", "text_hash", "start", "segment", "owner"],
                )

    joined = docs.where("text is not null").join(shared, ["doc_id", "text_hash", "digest"]).select("doc_id", "text_hash", "text", "names")
    return joined.mapInArrow(run, "name long, seg_hash long, doc_id long, text_hash long, start long, segment binary, owner long")


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A rolling hash of every window of a byte array; equal windows have equal ones."""
    powers = np.full(len(data) + 1, ODD, U64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inverse = np.full(len(data) + 1, pow(ODD, -1, 1 << 64), U64)
    inverse[0] = 1
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(data + U64(1)) * powers[:-1], dtype=U64)])
    return (total[width:] - total[:-width]) * np.multiply.accumulate(inverse)[: len(data) - width + 1]


def comparable(segments: list[bytes], width: int) -> np.ndarray:
    """Which segments have a window whose hash occurs twice, here or in another segment."""
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes)
    windows = sizes - width + 1
    segment = np.repeat(np.arange(len(segments)), windows)
    place = np.arange(len(segment)) + np.repeat(ends - sizes - np.cumsum(windows) + windows, windows)
    hashes = window_hashes(np.frombuffer(b"".join(segments), np.uint8), width)[place]
    order = hashes.argsort()
    hashes = hashes[order]
    twice = np.append(False, hashes[1:] == hashes[:-1])
    twice[:-1] |= twice[1:]
    out = np.zeros(len(segments), bool)
    out[segment[order[twice]]] = True
    return out


def shard_first_documents(segments: list[bytes], owners: np.ndarray, width: int) -> list[np.ndarray]:
    """For each segment, the smallest owner of each of its windows, over all segments."""
    sizes = np.array([len(s) for s in segments])
    data = np.frombuffer(b"\x00".join(segments) + b"\x00\x00", np.uint8)
    ends = np.cumsum(sizes + 1)
    symbols = data.astype(np.int64) + 2
    symbols[ends - 1] = 1
    symbols[-1] = 0
    sa = suffix_array(symbols)
    common = permuted_common_prefixes(data, sa, width)
    segment = np.repeat(np.arange(len(segments)), sizes + 1)
    segment = np.append(segment, len(segments) - 1)
    valid = np.append(ends, len(data))[segment] - 1 - np.arange(len(data)) >= width
    valid[-1] = False
    is_valid = valid[sa]
    before_valid = np.append(False, is_valid[:-1])
    begins = ~(is_valid & before_valid & (common[sa] >= width))
    at = np.flatnonzero(begins)
    least = np.minimum.reduceat(owners[segment[sa]], at)
    first = np.empty(len(data), np.int64)
    first[sa] = np.repeat(least, np.diff(np.append(at, len(sa))))
    return [first[e - n - 1 : e - width] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


FIRST = "name long, seg_hash long, at long, windows long, first long"
PIECES = "shard long, name long, seg_hash long, at long, segment binary, owner long"


def _settled(dealt: DataFrame, width: int) -> DataFrame:
    """(name, seg_hash, at, windows, first) from pieces (shard, name, seg_hash, at, segment, owner)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # distinct segments of whole shards, each with its smallest owner
        rows: list[pa.RecordBatch] = []  # not judged yet; the last shard may go on
        ready: list[pa.RecordBatch] = []  # those of them that an array is for
        size = waiting = for_array = 0
        for b in itertools.chain(batches, [None]):
            if b is not None:
                rows.append(b)
                waiting += b.column(4).nbytes
                if waiting < SHARD_BYTES:
                    continue
            if not rows:
                break
            block = pa.concat_batches(rows)
            shard = block.column(0).to_numpy()
            end = len(shard) if b is None else int(np.searchsorted(shard, shard[-1]))
            rows, waiting = [block.slice(end)], 0
            if end:
                lone, several = distinct(block.slice(0, end))
                if lone.num_rows:
                    yield alone(lone)
                at, sizes = 0, pc.binary_length(several.column(4)).to_numpy().cumsum()
                cuts = np.append(np.flatnonzero(np.diff(several.column(0).to_numpy())) + 1, several.num_rows)  # between shards
                while at < several.num_rows:
                    before = int(sizes[at - 1]) if at else 0
                    full = int(np.searchsorted(sizes, before + SHARD_BYTES - size))
                    to = int(cuts[min(np.searchsorted(cuts, full, side="right"), len(cuts) - 1)])
                    held.append(several.slice(at, to - at))
                    size += int(sizes[to - 1]) - before
                    at = to
                    if size >= SHARD_BYTES:
                        rest, some = compared(pa.concat_batches(held))
                        yield rest
                        held, size = [], 0
                        more = pc.sum(pc.binary_length(some.column(4))).as_py() or 0
                        if for_array and for_array + more > SHARD_BYTES:
                            yield settle(pa.concat_batches(ready))
                            ready, for_array = [], 0
                        ready.append(some)
                        for_array += more
        if held:
            rest, some = compared(pa.concat_batches(held))
            yield rest
            ready.append(some)
        if any(r.num_rows for r in ready):
            yield settle(pa.concat_batches(ready))

    def distinct(block: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        """A row for each segment with its smallest owner: those alone in their shard, and the others."""
        shard, name, seg_hash, at = (block.column(k).to_numpy() for k in range(4))
        order = np.lexsort((at, seg_hash, name, shard))
        new = np.zeros(len(order), bool)
        new[0] = True
        for c in (shard, name, seg_hash, at):
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
        begin = np.flatnonzero(new)
        least = np.minimum.reduceat(block.column(5).to_numpy()[order], begin)
        one = block.take(pa.array(order[begin])).set_column(5, "owner", pa.array(least))
        shard = shard[order[begin]]
        other = np.append(False, shard[1:] == shard[:-1])
        other[:-1] |= other[1:]
        return one.filter(pa.array(~other)), one.filter(pa.array(other))

    def alone(rows: pa.RecordBatch) -> pa.RecordBatch:
        windows = pc.binary_length(rows.column(4)).to_numpy().astype(np.int64) - width + 1
        return pa.RecordBatch.from_arrays([*(rows.column(k) for k in (1, 2, 3)), pa.array(windows), rows.column(5)], [c.split()[0] for c in FIRST.split(", ")])

    def compared(held: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        """The answers of segments without a window that occurs twice, and the other segments."""
        some = comparable(held.column(4).to_pylist(), width)
        return alone(held.filter(pa.array(~some))), held.filter(pa.array(some))

    def settle(held: pa.RecordBatch) -> pa.RecordBatch:
        firsts = shard_first_documents(held.column(4).to_pylist(), held.column(5).to_numpy(), width)
        first = np.concatenate(firsts)
        sizes = np.array([len(f) for f in firsts])
        own = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(first)) - np.repeat(sizes.cumsum() - sizes, sizes)
        start = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (own[1:] != own[:-1])))
        name, seg_hash, offset = (held.column(k).to_numpy()[own[start]] for k in (1, 2, 3))
        length = np.diff(np.append(start, len(first)))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (name, seg_hash, offset + at[start], length, first[start])], [c.split()[0] for c in FIRST.split(", ")])

    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, FIRST)


def _finer(pieces: DataFrame, width: int) -> DataFrame:
    """Pieces of segments by a finer minimiser, which with the name is their shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, seg_hash, piece, owner in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fine = window_names(np.frombuffer(piece, np.uint8), width, FINE_GRAM)
                for s, n in zip(*(x.tolist() for x in runs(fine, SEGMENT_WINDOWS)), strict=True):
                    out.append((int(mix(fine[s : s + 1] ^ U64(name % (1 << 64)))[0].view(np.int64)), name, seg_hash, s, piece[s : s + n + width - 1], owner))
            yield _pieces(out)

    return pieces.select("name", "seg_hash", "segment", "owner").mapInArrow(run, PIECES)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in PIECES.split(", ")])


def _by_window(pieces: DataFrame, width: int) -> tuple[DataFrame, list[DataFrame]]:
    """What _settled gives, for pieces of shards with very many of them; and the tables it reads.

    Every piece has its smallest owner as the first document of all its windows; where a window is in
    other pieces too, and one of them has a smaller owner, further rows say so.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for shard, name, seg_hash, at, piece, owner in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out += [(shard, name, seg_hash, at + k, piece[k : k + width], owner) for k in range(len(piece) - width + 1)]
                if len(out) >= 1 << 16:
                    yield _pieces(out)
                    out = []
            yield _pieces(out)

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, []
        for b in batches:
            for name, seg_hash, at, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last and (name, seg_hash, first) == (last[0], last[1], last[4]) and at == last[2] + last[3]:
                    last[3] += 1
                else:
                    last = [name, seg_hash, at, 1, first]
                    out.append(last)
            if len(out) > 1 << 16:
                yield _runs(out[:-1])
                out = [last]
        if out:
            yield _runs(out)

    # a segment has a row for each batch that it was met in; from here on one, with its smallest owner
    one = pieces.groupBy("name", "seg_hash", "at").agg(F.first("shard").alias("shard"), F.first("segment").alias("segment"), F.min("owner").alias("owner"))
    pieces = materialise(one.select(*pieces.columns), "pieces")
    each = materialise(pieces.mapInArrow(cut, PIECES).drop("shard"), "windows")
    several = each.groupBy("segment").agg(F.min("owner").alias("first"), F.max("owner").alias("most"), F.count("*").alias("n")).where("first < most")
    answers = materialise(several.drop("most"), "answers")
    common = answers.where(F.col("n") > MANY_SEGMENTS).orderBy(F.desc("n"), "segment").limit(COMMON_WINDOWS).select("segment", "first")
    common = materialise(common, "common")
    known = F.broadcast(common)  # at most COMMON_WINDOWS rows
    rest = each.join(known, "segment", "left_anti").join(answers.select("segment", "first"), "segment")
    found = rest.unionByName(each.join(known, "segment")).where("first < owner")
    ordered = found.repartition("name", "seg_hash").sortWithinPartitions("name", "seg_hash", "at").select("name", "seg_hash", "at", "first")
    own = pieces.select("name", "seg_hash", "at", (F.length("segment") - width + 1).cast("long").alias("windows"), F.col("owner").alias("first"))
    return own.unionByName(ordered.mapInArrow(join_up, FIRST)), [pieces, each, answers, common]


def _runs(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [c.split()[0] for c in FIRST.split(", ")])


def _many(pieces: DataFrame, column: str) -> DataFrame:
    """The values with over MANY_SEGMENTS pieces. Written, so that its size is known: a small table spares the pieces a shuffle."""
    return materialise(pieces.groupBy(column).count().where(F.col("count") > MANY_SEGMENTS).select(column, F.lit(True).alias("many")), "many")


def _first_documents(segments: DataFrame, width: int) -> DataFrame:
    """(name, seg_hash, at, windows, first): the smallest document of runs of a segment's windows."""
    pieces = segments.where("segment is not null").select(F.col("name").alias("shard"), "name", "seg_hash", F.lit(0).cast("long").alias("at"), "segment", "owner")
    many = _many(pieces, "shard")
    if many.isEmpty():
        discard(many)
        return materialise(_settled(pieces, width), "first")
    fine = materialise(_finer(pieces.join(many, "shard", "left_semi"), width), "fine")
    still = _many(fine, "shard")
    plain = pieces.join(many, "shard", "left_anti").unionByName(fine.join(still, "shard", "left_anti"))
    found, read = _settled(plain.select(*pieces.columns), width), []
    if not still.isEmpty():
        more, read = _by_window(fine.join(still, "shard", "left_semi").select(*pieces.columns), width)
        found = found.unionByName(more)
    out = materialise(found, "first")
    discard(many, fine, still, *read)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal spans of overlapping or touching ones."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def spans(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, text_hash, digest, spans array<struct<a,b>>, whole) for rows that lose bytes.

    docs: (doc_id, text, text_hash, digest). Of equal texts only the one with the smallest id is cut
    into segments; the others are `whole`, and have a digest here: every window of theirs is in an
    earlier document.
    """
    rows = materialise(docs.where("doc_id is not null").select("doc_id", "text_hash", "digest"), "rows")
    reps = rows.groupBy("text_hash", "digest").agg(F.min("doc_id").alias("rep"))
    twins = materialise(reps.groupBy("text_hash").count().where("count > 1").select("text_hash"), "twins")
    names = materialise(_shared_names(docs, twins, width), "names")
    segments = materialise(_segments(docs, names.join(reps.withColumnRenamed("rep", "doc_id"), "text_hash"), width), "segments")
    first = _first_documents(segments, width)
    taken = segments.select("name", "seg_hash", "doc_id", "text_hash", "start").join(first, ["name", "seg_hash"]).where("first < doc_id")
    begin = F.col("start") + F.col("at")
    each = taken.select("doc_id", "text_hash", F.struct(begin.alias("a"), (begin + F.col("windows") + width - 1).alias("b")).alias("span"))
    found = each.groupBy("doc_id", "text_hash").agg(F.collect_list("span").alias("spans"), F.lit(False).alias("whole"))
    copies = rows.join(reps, ["text_hash", "digest"]).where("doc_id > rep").select("doc_id", "text_hash", "digest", F.lit(True).alias("whole")).distinct()
    out = materialise(found.unionByName(copies, allowMissingColumns=True), "spans")
    discard(rows, twins, names, segments, first)
    return out


def _gone(raw: bytes, found: list[dict] | None, whole: bool | None, width: int) -> list[tuple[int, int]]:
    """The spans that a row loses."""
    if whole:
        return [(0, len(raw))] if len(raw) >= width else []
    return merged([(s["a"], s["b"]) for s in found or []])


def _marked(rows: DataFrame, width: int) -> DataFrame:
    """rows, with the columns doc_id, text, text_hash and digest, and what each one loses."""
    found = spans(rows.select("doc_id", "text", "text_hash", "digest"), width)
    same = (rows["doc_id"] == found["doc_id"]) & (rows["text_hash"] == found["text_hash"]) & (found["digest"].isNull() | (rows["digest"] == found["digest"]))
    return rows.join(found, same, "left").select(*[rows[c] for c in rows.columns], found["spans"], found["whole"])


def _keys(id_col: str, text_col: str) -> list[F.Column]:
    text = F.col(text_col)
    digest = F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))
    return [F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), digest.alias("digest")]


def digests(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    joined = _marked(docs.select(*_keys(id_col, text_col)), width).select("doc_id", "text", "spans", "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, found, whole in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                raw, at, kept = (text.as_py() or "").encode(), 0, hashlib.sha256()
                gone = _gone(raw, found, whole, width)
                for a, e in gone:
                    kept.update(raw[at:a])
                    at = e
                kept.update(raw[at:])
                out.append((doc_id, len(raw), sum(e - a for a, e in gone), len(gone), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, whatever their names, with the repeated passages cut out of the text.

    A cut that falls inside a UTF-8 character widens to the whole character, so the text stays valid.
    """
    rest = columns_as_row(docs, without=text_col)
    joined = _marked(docs.select(*_keys(id_col, text_col), rest.alias("rest")), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, some, whole in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text = text.as_py()
                if text and (some or whole):
                    raw, at, kept = text.encode(), 0, []
                    for a, e in _gone(raw, some, whole, width):
                        kept.append(raw[at:a])
                        at = e
                    text = b"".join([*kept, raw[at:]]).decode("utf-8", "ignore")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), b.column(3)], ["text", "rest"])

    taken = joined.select("text", "spans", "whole", "rest")
    out = taken.mapInArrow(run, taken.select("text", "rest").schema).withColumnsRenamed({"text": text_col})
    return out.select(*row_as_columns(docs.columns, "rest", without=text_col))
