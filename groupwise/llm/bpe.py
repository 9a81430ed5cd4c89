"""BPE encoding and decoding with a priority queue of merge ranks over a doubly linked list.

Each pre-token starts as a linked list of byte symbols. A heap holds (rank, position) of every
adjacent pair that can merge; the best entry is taken, skipped if stale (its pair has changed
meanwhile), else merged, and the two new neighbour pairs are pushed. Decoding concatenates the
vocabulary's byte strings. Work is row by row: no shuffle, no state beyond a bounded cache of
pre-tokens in each Python worker, so a lost executor only repeats its own splits.

Defined results: null text encodes like the empty one (no ids); null or repeated doc_id rows are
encoded like any other row, one output row each; special tokens' strings become their ids, as in
the library's default; other columns of the input are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from groupwise.llm.tokens import BEYOND_LATIN1, BYTE_LETTERS, LATIN1_SPLIT

#: Split of texts beyond Latin-1, the same classes in full Unicode.
UNICODE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CACHE_ENTRIES = 500_000
_SHIFT = 20


class Codec:
    """Encoder and decoder for one byte-level vocabulary file (tokenizers JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {chr(c): b for b, c in BYTE_LETTERS.items()}
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.first = [vocab[chr(BYTE_LETTERS[b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left] << _SHIFT | vocab[right]] = (rank, vocab[left + right])
        self.special_split = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.cache: dict[str, list[int]] = {}
        self._unicode = None

    def merge(self, symbols: list[int]) -> list[int]:
        """Ids of one pre-token, given its byte symbols."""
        n = len(symbols)
        if n < 2:
            return symbols
        merges = self.merges
        heap = []
        for i in range(n - 1):
            found = merges.get(symbols[i] << _SHIFT | symbols[i + 1])
            if found:
                heap.append((found[0], i, found[1]))
        if not heap:
            return symbols
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i, made = pop(heap)
            j = after[i]
            if j >= n or symbols[i] < 0:
                continue
            found = merges.get(symbols[i] << _SHIFT | symbols[j])
            if not found or found[0] != rank:  # stale: the pair here is another one now
                continue
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get(made << _SHIFT | symbols[k])
                if found:
                    push(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get(symbols[h] << _SHIFT | made)
                if found:
                    push(heap, (found[0], h, found[1]))
        return [s for s in symbols if s >= 0]

    def _pieces(self, text: str) -> list[str]:
        if not BEYOND_LATIN1.search(text):
            return LATIN1_SPLIT.findall(text)
        if self._unicode is None:
            import regex

            self._unicode = regex.compile(UNICODE_SPLIT)
        return self._unicode.findall(text)

    def _piece(self, piece: str) -> list[int]:
        ids = self.cache.get(piece)
        if ids is None:
            first = self.first
            ids = self.merge([first[b] for b in piece.encode()])
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            if len(piece) <= 64:
                self.cache[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        parts = self.special_split.split(text) if self.special_split else [text]
        out: list[int] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out += chain.from_iterable(map(self._piece, self._pieces(part)))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each vocabulary file and Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            ids = [c.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) from encode()'s rows; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for b in batches:
            texts = [c.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text in one pass, returning counts and SHA-256 digests.

    (doc_id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256)
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        decimal, bytes_of = c.decimal.__getitem__, c.bytes_of.__getitem__
        for b in batches:
            n, x, y = [], [], []
            for text in b.column(1):
                ids = c.encode(text.as_py())
                n.append(len(ids))
                x.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                raw = b"".join(map(bytes_of, ids))
                y.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
