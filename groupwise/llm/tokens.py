"""Byte-level BPE texts: pre-token split and a cached encoder over the tokenizers library.

A byte-level BPE encodes each pre-token by itself, so the ids of a text are the ids of its
pre-tokens in order. The encoder therefore asks the library once for each distinct pre-token a
worker meets and joins cached bytes. Texts holding a special token's string or a character
beyond Latin-1 go to the library whole, which keeps the split rules of the library authoritative.
"""

from __future__ import annotations

import re
from array import array

# The GPT-2 split pattern restricted to Latin-1, where its classes are these sets
# (letters are tried first, which no other branch can start with).
LETTER = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
NUMBER = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
SPACE = "\\t-\\r \\x85\\xa0"
LATIN1_SPLIT = re.compile(
    f" ?[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
BEYOND_LATIN1 = re.compile("[^\\x00-\\xff]")
CACHE_ENTRIES = 600_000


def byte_letters() -> dict[int, int]:
    """byte -> the printable code point that stands for it in a byte-level vocabulary.

    Printable Latin-1 stands for itself; the others get code points from 256 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


BYTE_LETTERS = byte_letters()


class _Pieces(dict):
    """pre-token -> its ids as little-endian uint32 bytes; emptied when full, so memory is bounded."""

    def __init__(self, tokenizer):
        self.tokenize = tokenizer.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        found = array("I", [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(BYTE_LETTERS))]).tobytes()
        if len(piece) <= 64:
            self[piece] = found
        return found


class Encoder:
    """encode(text) -> ids as uint32 little-endian bytes, equal to the library's encode()."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([BEYOND_LATIN1.pattern, *map(re.escape, special)]))
        self.pieces = _Pieces(self.tokenizer)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.whole.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.pieces.__getitem__, LATIN1_SPLIT.findall(text)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    """Where the public byte-level vocabulary lies on this machine (callers may pass another path)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
