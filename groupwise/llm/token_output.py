"""Token ids in Arrow files of fixed-size lists.

Documents are put in ascending id order (range partitions, sorted within), encoded, joined into
one stream for each partition and cut into equal-length sequences. A part is an Arrow IPC file
whose record batches hold `ids` and `mask` as fixed-size lists (the last sequence is padded and
masked), so any sequence of a memory-mapped part can be read without a copy; beside it lies an
index file with each document's start and length. Ids are stored as 16 bits where the vocabulary
allows. Each write makes a folder of its own below the given one, and touches nothing outside it.
Files in it are named by task attempt and only those in the manifest count, so a repeated task does
no harm; what lost attempts left there is removed. Range partitions are bounded by id, text hash and
row, so one repeated or null id is spread over tasks.

The folder is a path that all executors see, or a URI of a file system that PyArrow reaches (file,
s3, s3a, s3n, gs, gcs, hdfs, viewfs, abfs, abfss); others raise ValueError before anything is encoded.

Defined results: null text is the empty one (its end id only); null doc_ids come first; rows of
one doc_id are in an order of their own that is the same in every file; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groupwise.llm.common import materialise
from groupwise.llm.tokens import encoder

BATCH_SEQUENCES = 256
INDEX_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "part int, name string, n_ids long, n_docs long"
# Names that Hadoop gives to stores, and PyArrow's for the same ones.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "s3": "s3", "file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "abfs": "abfs", "abfss": "abfss"}


def _open(folder: str):
    """(file system, path) of a folder; ValueError where PyArrow doesn't reach it."""
    from pyarrow import fs

    scheme, colon, rest = folder.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), folder
    if scheme not in SCHEMES:
        raise ValueError(f"token files can't be written to {folder}: schemes are {', '.join(sorted(SCHEMES))}")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    try:
        return fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")
    except (OSError, pa.ArrowException) as e:
        raise ValueError(f"PyArrow doesn't reach {folder}: {e}") from e


class _Part:
    """Writer of one part: sequences and the documents' index."""

    def __init__(self, store, path: str, kind, length: int):
        self.kind, self.length = np.dtype(kind), length
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.streams = [store.open_output_stream(f"{path}.arrow"), store.open_output_stream(f"{path}.docs.arrow")]
        self.sequences = pa.ipc.new_file(self.streams[0], self.schema)
        self.index = pa.ipc.new_file(self.streams[1], INDEX_SCHEMA)
        self.waiting, self.n_waiting, self.n_ids, self.n_docs, self.docs = [], 0, 0, 0, []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs.append((doc_id, self.n_ids, n))
        self.waiting.append(np.frombuffer(ids, "<u4").astype(self.kind))
        self.n_ids, self.n_waiting, self.n_docs = self.n_ids + n, self.n_waiting + n, self.n_docs + 1
        if self.n_waiting >= self.length * BATCH_SEQUENCES:
            self._flush(False)
        if len(self.docs) >= 65_536:
            self._flush_index()

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, self.kind)
        step = self.length * BATCH_SEQUENCES
        whole = len(ids) if last else len(ids) - len(ids) % step
        for at in range(0, whole, step):
            block = ids[at : min(at + step, whole)]
            pad = -len(block) % self.length
            mask = np.concatenate([np.ones(len(block), bool), np.zeros(pad, bool)])
            block = np.concatenate([block, np.zeros(pad, self.kind)]) if pad else block
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (block, mask)]
            self.sequences.write_batch(pa.record_batch(lists, schema=self.schema))
        self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def _flush_index(self) -> None:
        if self.docs:
            self.index.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*self.docs, strict=True)], schema=INDEX_SCHEMA))
            self.docs = []

    def close(self) -> None:
        self._flush(True)
        self._flush_index()
        for x in (self.sequences, self.index, *self.streams):
            x.close()


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents under folder (seen by all executors); returns the manifest of parts.

    manifest: part, name (below folder), n_ids, n_docs, start (ids of all earlier parts). One row per part.
    """
    _open(folder)
    own = f"tokens-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        store.create_dir(f"{root}/{own}")
        e, end = encoder(vocabulary), end_id.to_bytes(4, "little")
        largest = max(e.tokenizer.get_vocab_size() - 1, end_id)
        part, name, out = TaskContext.get().partitionId(), f"{own}/{uuid.uuid4().hex}", None
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out = out or _Part(store, f"{root}/{name}", "<u2" if largest < 1 << 16 else "<u4", length)
                out.add(doc_id, e.encode(text.as_py()) + end)
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "n_ids": out.n_ids, "n_docs": out.n_docs}], schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))

    taken = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = [F.xxhash64("text"), F.monotonically_increasing_id()]
    taken = taken.select("doc_id", "text", tie[0].alias("hash"), tie[1].alias("row"))
    ordered = taken.repartitionByRange("doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row").select("doc_id", "text")
    manifest = materialise(ordered.mapInArrow(run, MANIFEST), "manifest")
    _remove_lost(manifest, folder, own)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))


def _remove_lost(manifest: DataFrame, folder: str, own: str) -> None:
    """Removes files that task attempts left which did not end well, in the folder of this write alone.

    The names read are as many as there are parts.
    """
    from pyarrow import fs

    store, root = _open(folder)
    good = {r["name"] for r in manifest.select("name").collect()}
    for f in store.get_file_info(fs.FileSelector(f"{root}/{own}", allow_not_found=True)):
        if f.type == fs.FileType.File and f"{own}/{f.base_name.split('.')[0]}" not in good:
            store.delete_file(f.path)


def open_part(folder: str, name: str):
    """(sequences, index) readers of a part; memory-mapped, without copies, where it is local."""
    from pyarrow import fs

    store, root = _open(folder)
    local = isinstance(store, fs.LocalFileSystem)
    return [pa.ipc.open_file(pa.memory_map(p) if local else store.open_input_file(p)) for p in (f"{root}/{name}.arrow", f"{root}/{name}.docs.arrow")]


def sequence(reader, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (a view, not a copy) and mask of a part's k-th sequence."""
    b = reader.get_batch(k // BATCH_SEQUENCES)
    ids, mask = (b.column(c)[k % BATCH_SEQUENCES].values for c in (0, 1))
    return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)


def documents(folder: str, name: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the part, its unmasked ids) of a part's documents, in order."""
    sequences, index = open_part(folder, name)
    blocks = (sequences.get_batch(k) for k in range(sequences.num_record_batches))
    block, used = np.empty(0), 0
    for k in range(index.num_record_batches):
        for doc_id, start, n in zip(*(c.to_pylist() for c in index.get_batch(k).columns), strict=True):
            got, need = [], n
            while need:
                if used == len(block):
                    b, used = next(blocks), 0
                    ids, mask = (c.flatten() for c in b.columns)
                    block = ids.to_numpy(zero_copy_only=True)
                    block = block[: mask.true_count]
                got.append(block[used : used + need])
                used, need = used + len(got[-1]), need - len(got[-1])
            yield doc_id, start, got[0] if len(got) == 1 else np.concatenate(got)


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: global start, ids with the end id, their CRC-32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [(d, base + s, len(ids), crc32(ids.astype("<u4").tobytes())) for d, s, ids in documents(folder, name)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = manifest.select("name", "start").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2)
    return parts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
