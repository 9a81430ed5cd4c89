"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A unit vector is rotated (random signs and a Walsh-Hadamard transform) and cut into two parts; each
part has random unit codewords, and a filter is one codeword for each part, so few codewords give
their number squared as directions. A vector is list-decoded to all directions whose inner product
exceeds a threshold (branch and bound over the parts), and to its LEAST best ones at least. Vectors
of one label that share a filter are compared exactly, in double precision.

The filters grow with the input: there are as many codewords as keep a filter at about BUCKET
vectors of a label, between LEAST_CODEWORDS and MOST_CODEWORDS. For these, the number of filters
that a random vector exceeds is the least of EXPECTED at which at most LOST of simulated pairs, just
at the limit, share none; the threshold follows from it. What is broadcast is these codewords, for
each length of vector.

Equal vectors of a label are one class with a weight. A filter with more than ROWS classes is cut
into blocks by a hash, each a task's unit of work; pairs of blocks are compared as matrices and
return, not pairs, but each class's number of links (a pair counts at the smallest filter it shares)
and a spanning forest of its links. Vectors travel as 4-byte floats where these are exact.

Recall against brute force is tested to be above 0.95 at cosine 0.98; nothing below the limit is
linked. Defined results: rows whose vector is null, empty, zero or holds null or non-finite
components, or whose label is null, have no links and are their own component; a null id has no
links, no component and null kept; rows repeating an id are one node of the components; vectors
of different lengths are not compared; other columns are ignored, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groupwise.llm.common import components, discard, materialise, one_by_id
from groupwise.llm.jaccard_join import forest
from groupwise.llm.topk import usable

LEAST_CODEWORDS, MOST_CODEWORDS, BUCKET = 192, 8192, 64
EXPECTED, LEAST = (10, 14, 20, 28, 40, 56, 80), 6
#: Share of simulated pairs at the limit that may share no filter, and the number of pairs.
LOST, PAIRS = 0.01, 1000
ROWS = 512


class ProductCode:
    """The filters for vectors of one length."""

    def __init__(self, dim: int, codewords: int = LEAST_CODEWORDS, limit: float = 0.98):
        r = np.random.default_rng(dim)
        self.codewords, size = codewords, max(2, 1 << max(0, dim - 1).bit_length())
        h = np.ones((1, 1))
        while len(h) < size:
            h = np.block([[h, h], [h, -h]])
        self.turn = (r.choice([-1.0, 1.0], dim)[:, None] * h[:dim]) / np.sqrt(len(h))
        self.cut, self.codes = size // 2, []
        for width in (self.cut, size - self.cut):
            c = r.normal(size=(codewords, width))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(2))
        x, y = r.normal(size=(2, PAIRS, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(1, keepdims=True) * x
        far = np.linalg.norm(y, axis=1, keepdims=True)
        y = np.where(far > 1e-9, limit * x + sqrt(max(0.0, 1 - limit * limit)) * y / np.maximum(far, 1e-9), x)
        some = [np.sort(s[:200], axis=1) for s in self._sums(x)]
        for expected in EXPECTED:
            self.threshold = self._threshold(some, min(expected, codewords * codewords))
            lost = sum(not len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(self.filters(x), self.filters(y), strict=True))
            if lost <= LOST * PAIRS:
                break

    @staticmethod
    def _threshold(sums: list[np.ndarray], expected: int) -> float:
        """The bar that `expected` pairs of codewords exceed on average; rows of both sums ascend."""
        low, high = -2.0, 2.0
        for _ in range(30):
            middle = (low + high) / 2
            above = sum(b.size * 1.0 - np.searchsorted(b, middle - a).mean() for a, b in zip(*sums, strict=True)) * sums[0].shape[1] / len(sums[0])
            low, high = (middle, high) if above > expected else (low, middle)
        return low

    def _sums(self, unit: np.ndarray) -> list[np.ndarray]:
        turned = unit @ self.turn
        return [turned[:, : self.cut] @ self.codes[0].T, turned[:, self.cut :] @ self.codes[1].T]

    def _decode(self, sums: list[np.ndarray], rows: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, filter, inner product) of all directions above each row's threshold."""
        best = sums[1].max(1)
        i, c = np.nonzero(sums[0][rows] + best[rows][:, None] >= threshold[rows][:, None])
        row, value = rows[i], sums[0][rows[i], c]
        total = value[:, None] + sums[1][row]
        j, d = np.nonzero(total >= threshold[row][:, None])
        return row[j], c[j] * self.codewords + d, total[j, d]

    def filters(self, unit: np.ndarray) -> list[np.ndarray]:
        """Sorted filters of every row of unit vectors."""
        out: list[np.ndarray] = []
        for at in range(0, len(unit), 64):
            sums = self._sums(unit[at : at + 64])
            n = len(sums[0])
            limit = np.full(n, self.threshold)
            row, code, value = self._decode(sums, np.arange(n), limit)
            count = np.bincount(row, minlength=n)
            while len(few := np.flatnonzero(count < min(LEAST, self.codewords**2))):  # lower the bar for these alone
                limit[few] -= 0.1 * abs(self.threshold) + 1e-3
                more = self._decode(sums, few, limit)
                keep = ~np.isin(row, few)
                row, code, value = (np.concatenate([a[keep], b]) for a, b in zip((row, code, value), more, strict=True))
                count = np.bincount(row, minlength=n)
            order = np.lexsort((-value, row))
            row, code, value = row[order], code[order], value[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            keep = (value >= self.threshold) | (place < LEAST)
            order = np.lexsort((code[keep], row[keep]))
            row, code = row[keep][order], code[keep][order]
            out += np.split(code, np.cumsum(np.bincount(row, minlength=n))[:-1])
        return out


def codewords_for(n: int) -> int:
    """How many codewords keep a filter of a label with n classes at about BUCKET of them."""
    return min(MOST_CODEWORDS, max(LEAST_CODEWORDS, ceil(sqrt(n * EXPECTED[0] / BUCKET))))


def _filter_rows(classes: DataFrame, limit: float) -> DataFrame:
    """classes with their vector as bytes and their filters, as a list and as bytes."""
    dim = F.size("embedding").alias("dim")
    most = classes.groupBy(dim, "label").count().groupBy("dim").agg(F.max("count").alias("n"))
    codes = {r["dim"]: ProductCode(r["dim"], codewords_for(r["n"]), limit) for r in most.collect()}  # a row for each length of vector
    codes = classes.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid, rep, weight, label = (b.column(k).to_numpy() for k in range(4))
            lists = b.column(4)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *lists.value_lengths().to_pylist()])
            dims = np.diff(ends)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                for at in range(0, len(rows), 1024):
                    some = rows[at : at + 1024]
                    v = flat[ends[some][:, None] + np.arange(dim)]
                    found = [f.astype(np.int32) for f in codes.value[int(dim)].filters(unit(v))]
                    columns = [pa.array(x[some]) for x in (uid, rep, weight, label)] + [pa.array(np.full(len(some), dim, np.int32))]
                    columns += [pa.array([packed(x) for x in v], pa.binary()), pa.array([f.tobytes() for f in found], pa.binary()), pa.array([f.tolist() for f in found], pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, ["uid", "rep", "weight", "label", "dim", "vector", "names", "filters"])

    return classes.select("uid", "rep", "weight", "label", "embedding").mapInArrow(run, "uid long, rep long, weight long, label long, dim int, vector binary, names binary, filters array<int>")


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so that squares stay finite."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def packed(x: np.ndarray) -> bytes:
    """A vector's bytes: four a component where that is exact, else eight."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return (short if (short == x).all() else x).tobytes()


def unpacked(x: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(x, np.float32 if len(x) == 4 * dim else np.float64).astype(np.float64)


class Block:
    """Rows of one filter, as arrays."""

    def __init__(self, name: int, dim: int, uids, reps, weights, vectors: list[bytes], filters: list[bytes]):
        self.name, self.uids, self.reps, self.weights = name, np.asarray(uids, np.int64), np.asarray(reps, np.int64), np.asarray(weights, np.int64)
        self.units = unit(np.stack([unpacked(v, dim) for v in vectors]))
        self.filters = [np.frombuffer(f, np.int32) for f in filters]

    def earlier(self, known: np.ndarray) -> np.ndarray:
        """0/1 matrix of the filters before this one that each row has."""
        m = np.zeros((len(self.uids), len(known)), np.float32)
        for i, f in enumerate(self.filters):
            m[i, np.searchsorted(known, f[f < self.name])] = 1
        return m


def compare(a: Block, b: Block, limit: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(uid, links counted here) and forest links of a block with itself or another of its filter."""
    linked = a.units @ b.units.T >= limit
    if a is b:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return [], []
    known = np.unique(np.concatenate([*a.filters, *b.filters]))
    known = known[known < a.name]
    counted = linked & ~((a.earlier(known) @ b.earlier(known).T) > 0) if len(known) else linked
    counts = list(zip(a.uids.tolist(), (counted @ b.weights).tolist(), strict=True))
    if a is not b:
        counts += list(zip(b.uids.tolist(), (counted.T @ a.weights).tolist(), strict=True))
    return [c for c in counts if c[1]], forest(a.reps, b.reps, linked)


OUT = "uid long, links long, a long, b long, label long, dim int, filter int, block int, uids binary, reps binary, weights binary, vectors array<binary>, filters array<binary>"
_TYPES = [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.binary()] * 3 + [pa.list_(pa.binary())] * 2


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], [c.split()[0] for c in OUT.split(", ")])


def _answers(counts: list[tuple], links: list[tuple]) -> list[tuple]:
    return [(u, n, *[None] * 11) for u, n in counts] + [(None, None, a, b, *[None] * 9) for a, b in links]


def links(classes: DataFrame, limit: float) -> DataFrame:
    """Rows of (uid, links) and of (a, b), from all blocks of all filters."""
    names, data = ["label", "dim", "filter"], ["uids", "reps", "weights", "vectors", "filters"]
    decoded = materialise(_filter_rows(classes, limit), "decoded")
    each = decoded.withColumn("filter", F.explode("filters")).drop("filters")
    large = decoded.select("label", "dim", F.explode("filters").alias("filter")).groupBy(*names).count().where(F.col("count") > ROWS)
    # at most a row for ROWS rows of `each`; written, so that its size is known
    large = materialise(large.select(*names, F.ceil(F.col("count") / ROWS).alias("blocks")), "large")
    block = F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("uid"), F.col("blocks"))).cast("int")
    rows = each.join(large, names, "left").select(*names, block.alias("block"), "uid", "rep", "weight", "vector", "names")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def settle():
            key = held[0][:4]
            columns = [[h[k] for h in held] for k in range(4, 9)]
            if len(held) > 1:
                made = Block(key[2], key[1], *columns)
                out.extend(_answers(*compare(made, made, limit)))
            if key[3] is not None:
                out.append((None, None, None, None, *key, *(np.array(c, np.int64).tobytes() for c in columns[:3]), *columns[3:]))
            held.clear()

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and r[:4] != held[0][:4]:
                    settle()
                held.append(r)
            if out:
                yield _emit(out)
                out.clear()
        if held:
            settle()
        if out:
            yield _emit(out)

    dealt = rows.repartition(*names, "block").sortWithinPartitions(*names, "block")
    first = materialise(dealt.mapInArrow(within, OUT), "filters")
    blocks = first.where("block is not null").select(*names, "block", *data)
    slim = blocks.select(*names, "block")
    met = slim.withColumnRenamed("block", "i").join(slim.withColumnRenamed("block", "j"), names).where("i < j")
    for x in "ij":
        met = met.join(blocks.toDF(*names, x, *[f"{c}_{x}" for c in data]), [*names, x])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                a, c = (Block(r["filter"], r["dim"], *(np.frombuffer(r[f"{n}_{x}"], np.int64) for n in data[:3]), r[f"vectors_{x}"], r[f"filters_{x}"]) for x in "ij")
                if found := _answers(*compare(a, c, limit)):
                    yield _emit(found)

    more = met.select("filter", "dim", *[f"{c}_{x}" for x in "ij" for c in data]).mapInArrow(across, OUT)
    out = materialise(first.select("uid", "links", "a", "b").where("block is null").unionByName(more.select("uid", "links", "a", "b")), "links")
    discard(decoded, large, first)
    return out


def near_duplicates(vectors: DataFrame, limit: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    clean = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    # a hash leads the join of rows to classes; the vectors themselves settle it
    rows = rows.withColumn("hash", F.when(clean, F.xxhash64("label", "embedding")))
    grouped = rows.where("hash is not null").groupBy("hash", "label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = materialise(grouped.withColumn("uid", F.monotonically_increasing_id()), "classes")
    of = rows.where("hash is not null").join(classes, ["hash", "label", "embedding"]).select("vec_id", "uid", "rep", "weight")
    of = materialise(of.unionByName(rows.where("hash is null").select("vec_id"), allowMissingColumns=True), "of")
    found = links(classes, limit)
    component = components(found.where("a is not null").select("a", "b").unionByName(one_by_id(of, "vec_id", "rep")))
    counts = found.where("uid is not null").groupBy("uid").agg(F.sum("links").alias("links"))
    joined = of.join(counts, "uid", "left").join(component.toDF("rep", "component"), "rep", "left")
    n = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))
    joined = joined.select("vec_id", n.cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "rep", "vec_id")).alias("component_id"))
    out = materialise(joined.withColumn("kept", F.col("vec_id") == F.col("component_id")), "answer")
    discard(classes, of, found, component)
    return out
