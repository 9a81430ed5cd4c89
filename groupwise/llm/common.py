"""Helpers shared by the operators: cut lineage, shared scratch folder, links to components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings while a table is written: shuffle files go when the query has ended (not when the
#: driver's garbage does), and what passes to Python at once is bounded in bytes, not only in rows.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset and the master is local (tests), a temporary folder of this process is
    used; elsewhere that is an error, as a machine-local folder would lose files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _local:
        _local["dir"] = "file://" + tempfile.mkdtemp(prefix="groupwise-")
    return _local["dir"]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/groupwise/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there.

    The table's path is kept in ``df.scratch_path`` so that ``discard`` can remove it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame | None) -> None:
    """Remove materialised tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "scratch_path", None)
        if path:
            remove_path(t.sparkSession, path)


def discard_inputs(df: DataFrame) -> None:
    """Remove the materialised tables that df reads, once it has been written itself."""
    spark = df.sparkSession
    own = f"{shared_dir(spark).split(':', 1)[-1].rstrip('/')}/groupwise/".lstrip("/")
    found = (re.match(r"(.*/groupwise/[a-z0-9_]+-[0-9a-f]{32})/", f) for f in df.inputFiles())
    for path in sorted({m[1] for m in found if m}):
        if path.split(":", 1)[-1].lstrip("/").startswith(own):
            remove_path(spark, path)


def columns_as_row(df: DataFrame, without: str | None = None) -> F.Column:
    """A struct of df's columns by position, so that their names can't clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns) if c != without], F.lit(0).alias("none"))


def row_as_columns(names: list[str], row: str, without: str | None = None) -> list[F.Column]:
    """The columns of such a struct under their names; the one left out is a column of its own."""
    return [(F.col(f"`{c}`") if c == without else F.col(f"{row}.c{k}")).alias(c) for k, c in enumerate(names)]


#: Bits of a filter of ids: eight an id between these bounds; beyond, it lets more rows pass.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def split_by_ids(df: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of df whose id may be among ids, rows whose id is not, the filter's table): no row is shuffled.

    A bit for each hash of an id is set in words of 64, a table of at most MOST_BITS / 64 rows, which
    is broadcast.
    """
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * ids.count()).bit_length()))

    def bit_of(column: str) -> F.Column:
        return F.pmod(F.xxhash64(F.col(f"`{column}`").cast("long")), F.lit(size))

    bit = ids.select(bit_of(id_col).alias("bit")).selectExpr("cast(bit div 64 as int) as word", "shiftleft(1L, cast(bit % 64 as int)) as bits")
    words = materialise(bit.groupBy("word").agg(F.bit_or("bits").alias("bits")), "words")
    word, bits, at = (f"__{x}_{uuid.uuid4().hex}" for x in ("word", "bits", "at"))
    marked = df.withColumn(at, bit_of(id_col)).withColumn(word, F.expr(f"cast({at} div 64 as int)"))
    marked = marked.join(F.broadcast(words.toDF(word, bits)), word, "left")
    hit = F.expr(f"coalesce(shiftright({bits}, cast({at} % 64 as int)) & 1L, 0L) = 1L")
    columns = [F.col(f"`{c}`") for c in df.columns]
    return marked.where(hit).select(*columns), marked.where(~hit).select(*columns), words


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about `most` bytes of a string column, to bound what is made of one."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < b.num_rows:
            end = int(np.searchsorted(size, (size[at - 1] if at else 0) + most))
            yield b.slice(at, max(1, end - at))
            at = max(at + 1, end)
        pa.default_memory_pool().release_unused()


#: Links of a node from which on it is joined by broadcast, and the most nodes that are.
HUB, HUBS = 512, 50_000


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): edges with the smallest v of their u. Hubs are joined by broadcast, so no task holds one's edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > HUB).orderBy(F.desc("n"), "u").limit(HUBS).select("u", "m"))  # at most HUBS rows
    calm = edges.join(hubs.select("u"), "u", "left_anti").join(least.select("u", "m"), "u")
    return calm.unionByName(edges.join(hubs, "u"))


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    links: two columns of long node ids; nulls, loops and repeats are ignored. Returns
    (node, component) for every node with a link, component being its smallest reachable id.
    Each round is two equi-joins on a node id, in which hubs are broadcast; no round holds a
    component in one task, and each round's edges are a written table.
    """
    edge = links.select(F.col(left).cast("long").alias("x"), F.col(right).cast("long").alias("y"))
    edge = edge.where(F.col("x") != F.col("y"))
    now = materialise(edge.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = materialise(large.distinct(), "large")
        small = _with_least(large).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = materialise(small.distinct(), "edges")
        now_state = _state(after)
        discard(now, large)
        now, done, state = after, now_state == state, now_state
        if done:
            break
    node = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = node.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out.scratch_path = now.scratch_path
    return out


def one_by_id(nodes: DataFrame, id_col: str, node_col: str) -> DataFrame:
    """(a, b): links that make one of all nodes with an id; no row holds an id's nodes."""
    least = nodes.groupBy(id_col).agg(F.min(node_col).alias("a"), F.max(node_col).alias("__most")).where(F.col("a") < F.col("__most"))
    return nodes.join(least.drop("__most"), id_col).where(F.col(node_col) > F.col("a")).select("a", F.col(node_col).alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the edges; two equal rounds mean a fixed point."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
