"""Exact top-k by inner product with vector-approximation files.

Two tables are written: the exact vectors, a row each, and the approximation file, blocks of one
byte a component. A byte names the cell of a component of the quantised vector; the cells of a
block's component are equally wide intervals of integers over its range. The search scans cells
alone: every query block meets every approximation block, and a lower and an upper bound of each
score leave the rows that may be among a query's k best of the block. Over all blocks, the k-th
best lower bound of a query drops what can't reach it. Then exact vectors are read, joined by row,
in order of bounds: first those of the k best upper bounds, then those whose bound the k-th exact
score so far doesn't exceed, after which the result is certain.

Query blocks meet approximation blocks over a grid of cells joined on the cell's number, so neither
side is broadcast nor collected; work is the stated query set times all rows, what is shuffled for
it a byte a component, and memory is two blocks. Rows of a block with equal vectors score alike, so
only the k + 1 first of them by vec_id can matter, and only they are in the file.

Defined results: null vectors, vectors with null or non-finite components, empty vectors and rows
with a null id take no part; vectors of different lengths are not compared; a query's own row is
no candidate, but another row that repeats its id is; scores beyond a long are clipped to its
range, and clipped ones are ties; rows with components beyond WILD have no bounds and are read
exactly for each query; other columns are ignored, whatever their names; without queries or
candidates the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groupwise.llm.common import discard, materialise

BLOCK, QUERY_BLOCK = 8192, 256
#: Blocks of either kind in a cell of the grid.
CELL_BLOCKS, CELL_QUERIES = 4, 16
#: Cells of a component in a block.
CELLS = 256
WILD = 1e140
LONG = np.iinfo(np.int64)


def usable(embedding) -> F.Column:
    """True for non-null, non-empty vectors with finite components only."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~bad


def quantise(values: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x) as doubles; infinite where a double can't hold it."""
    with np.errstate(over="ignore"):
        return np.floor(values.astype(np.float64) * scale)


def exact_scores(queries: np.ndarray, vectors: np.ndarray, scale: int) -> list[int]:
    """Integer inner products of rows with rows; Python integers where doubles can't be exact."""
    q, v = quantise(queries, scale), quantise(vectors, scale)
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q * v).sum(1).astype(np.int64).tolist()

    def whole(x: float) -> int:
        return math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale

    return [min(max(sum(whole(x) * whole(y) for x, y in zip(a, b, strict=True)), int(LONG.min)), int(LONG.max)) for a, b in zip(queries.tolist(), vectors.tolist(), strict=True)]


def _vectors(b: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) for each length of vector in a list column."""
    lists = b.column(column)
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *lists.value_lengths().to_pylist()])
    dims = np.diff(ends)
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        yield rows, flat[ends[rows][:, None] + np.arange(dim)]


def _blocks(rows: DataFrame, scale: int, size: int, make, schema: str) -> DataFrame:
    """make(uids, ids, quantised vectors) of blocks of at most `size` rows (uid, id, v) of one length.

    Rows with components beyond WILD make blocks of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId() << 32, 0
        waiting: dict[tuple, list] = {}

        def emit(key: tuple) -> pa.RecordBatch:
            nonlocal made
            held = waiting.pop(key)
            made += 1
            more = make(*(np.concatenate([h[c] for h in held]) for c in range(3)), key[1])
            return pa.RecordBatch.from_pydict({"block": [part + made], "dim": [key[0]], "wild": [key[1]]} | {k: [v] for k, v in more.items()})

        for b in batches:
            uid, ids = (b.column(k).to_numpy() for k in (0, 1))
            for at, values in _vectors(b, 2):
                values = quantise(values, scale) + 0.0  # no negative zeros
                wild = np.abs(values).max(1) > WILD
                for w in np.unique(wild).tolist():
                    some, key = np.flatnonzero(wild == w), (values.shape[1], w)
                    for k in range(0, len(some), size):
                        s = some[k : k + size]
                        waiting.setdefault(key, []).append((uid[at[s]], ids[at[s]], values[s]))
                        if sum(len(h[0]) for h in waiting[key]) >= size:
                            yield emit(key)
        for key in list(waiting):
            yield emit(key)

    return rows.mapInArrow(run, "block long, dim long, wild boolean, " + schema)


def cells_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, width, cells): a component x lies in [low + width * cell, low + width * cell + width - 1]."""
    low, high = values.min(0), values.max(0)
    width = np.maximum(np.ceil((high - low + 1) / CELLS), 1)
    return low, width, np.clip(np.floor((values - low) / width), 0, CELLS - 1).astype(np.uint8)


def bounds(queries: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """(lower, upper, exact): bounds of all scores from cells alone; exact where they are the scores."""
    middle = (queries @ low)[:, None] + (queries * width) @ cells.astype(np.float64).T
    size = np.abs(queries) @ (np.abs(low) + width * CELLS)
    small = bool((size < 2**52).all())
    slack = 0 if small else 1e-9 * (size + 1)  # doubles round beyond 2**53
    lower = middle + (np.minimum(queries, 0) @ (width - 1) - slack)[:, None]
    upper = middle + (np.maximum(queries, 0) @ (width - 1) + slack)[:, None]
    most = float(2**63)
    return np.clip(lower, -most, most), np.clip(upper, -most, most), small and bool((width == 1).all())


def may_be_best(q_uids: np.ndarray, uids: np.ndarray, ids: np.ndarray, lower: np.ndarray, upper: np.ndarray, exact: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of what may be among the k best of a block; a query's own row is none of them."""
    own = np.minimum(np.searchsorted(uids, q_uids), len(uids) - 1)
    mine = np.flatnonzero(uids[own] == q_uids)
    for side in (lower, upper):
        side[mine, own[mine]] = -np.inf
    kth = np.partition(lower, len(uids) - k, axis=1)[:, len(uids) - k] if len(uids) > k else np.full(len(q_uids), -np.inf)
    query, row = np.nonzero((upper >= kth[:, None]) & (upper > -np.inf))
    if exact:  # ties are settled here
        order = np.lexsort((ids[row], -upper[query, row], query))
        query, row = query[order], row[order]
        best = np.arange(len(query)) - np.searchsorted(query, query) < k
        query, row = query[best], row[best]
    return query, row


def search(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by query_every, the k best others."""
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    exact = materialise(clean.select(F.monotonically_increasing_id().alias("uid"), "id", "v"), "vectors")
    asked = exact.where(F.col("id") % query_every == 0)

    def approximate(uids: np.ndarray, ids: np.ndarray, values: np.ndarray, wild: bool) -> dict:
        if wild:  # infinite here, so not known to be equal
            return {"uids": uids.tobytes(), "ids": ids.tobytes(), "low": b"", "width": b"", "cells": b""}
        same = np.unique(np.ascontiguousarray(values).view(f"V{8 * values.shape[1]}").ravel(), return_inverse=True)[1].ravel()
        order = np.lexsort((uids, ids, same))
        place = np.arange(len(order)) - np.searchsorted(same[order], same[order])
        keep = np.sort(order[place <= k])  # uids ascend in a block
        low, width, cells = cells_of(values[keep])
        return {"uids": uids[keep].tobytes(), "ids": ids[keep].tobytes(), "low": low.tobytes(), "width": width.tobytes(), "cells": cells.tobytes()}

    def query_block(uids: np.ndarray, ids: np.ndarray, values: np.ndarray, wild: bool) -> dict:
        return {"uids": uids.tobytes(), "ids": ids.tobytes(), "data": b"" if wild else values.tobytes()}

    blocks = materialise(_blocks(exact, scale, BLOCK, approximate, "uids binary, ids binary, low binary, width binary, cells binary"), "cells")
    queries = materialise(_blocks(asked, scale, QUERY_BLOCK, query_block, "uids binary, ids binary, data binary"), "queries")
    n_cells = max(1, -(-blocks.count() // CELL_BLOCKS))
    n_query_cells = max(1, -(-queries.count() // CELL_QUERIES))
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(n_cells)).cast("int")).withColumn("q_cell", grid(n_query_cells))
    right = queries.toDF("q_block", "dim", "q_wild", "q_uids", "q_ids", "q_data")
    right = right.withColumn("q_cell", F.pmod(F.xxhash64("q_block"), F.lit(n_query_cells)).cast("int")).withColumn("cell", grid(n_cells))
    met = left.join(right, ["cell", "q_cell", "dim"]).select("dim", F.col("wild") | F.col("q_wild"), "uids", "ids", "low", "width", "cells", "q_uids", "q_ids", "q_data")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, wild, uids, ids, low, width, cells, q_uids, q_ids, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                uids, ids, q_uids, q_ids = (np.frombuffer(x, np.int64) for x in (uids, ids, q_uids, q_ids))
                if wild:
                    query, row = np.nonzero(q_uids[:, None] != uids[None, :])
                    low_bound, high_bound = np.full(len(row), -np.inf), np.full(len(row), np.inf)
                else:
                    lower, upper, exactly = bounds(np.frombuffer(data).reshape(-1, dim), np.frombuffer(low), np.frombuffer(width), np.frombuffer(cells, np.uint8).reshape(-1, dim))
                    query, row = may_be_best(q_uids, uids, ids, lower, upper, exactly, k)
                    low_bound, high_bound = lower[query, row], upper[query, row]
                if len(query):
                    columns = [q_uids[query], q_ids[query], uids[row], ids[row], low_bound, high_bound]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q_uid", "query_id", "uid", "vec_id", "lower", "upper"])

    found = met.mapInArrow(scan, "q_uid long, query_id long, uid long, vec_id long, lower double, upper double")
    of_query = Window.partitionBy("q_uid")
    ranked = found.withColumn("by_lower", F.row_number().over(of_query.orderBy(F.desc("lower"), "vec_id")))
    kth = F.max(F.when(F.col("by_lower") == k, F.col("lower"))).over(of_query)
    near = ranked.withColumn("kth", kth).where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))
    near = near.withColumn("by_upper", F.row_number().over(of_query.orderBy(F.desc("upper"), "vec_id"))).drop("by_lower", "kth", "lower")
    near = materialise(near, "near")

    def read(pairs: DataFrame) -> DataFrame:
        """(q_uid, query_id, vec_id, score) from the exact vectors."""
        got = pairs.join(exact.select("uid", "v"), "uid").join(asked.select(F.col("uid").alias("q_uid"), F.col("v").alias("q")), "q_uid")
        return got.select("q_uid", "query_id", "vec_id", "v", "q").mapInArrow(score, "q_uid long, query_id long, vec_id long, score long")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows, np.int64)
            for (rows, v), (_, q) in zip(_vectors(b, 3), _vectors(b, 4), strict=True):
                out[rows] = exact_scores(q, v, scale)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out)], ["q_uid", "query_id", "vec_id", "score"])

    best = materialise(read(near.where(F.col("by_upper") <= k)), "first")
    certain = best.groupBy("q_uid").agg(F.min("score").alias("kth"))
    rest = near.where(F.col("by_upper") > k).join(certain, "q_uid").where(F.col("upper") >= F.col("kth")).drop("kth")
    ranked = best.unionByName(read(rest)).withColumn("rank", F.row_number().over(of_query.orderBy(F.desc("score"), "vec_id")))
    out = materialise(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top")
    discard(exact, blocks, queries, near, best)
    return out
