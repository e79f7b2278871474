"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import zlib

import tiktoken
from pyspark.sql import SparkSession

TOKENIZER = os.environ.get("CORPUSMILL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
"""Default rank file (byte-level BPE, one base64 token and its rank per line)."""
# Fixed value: the pattern that goes with the public rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE_CHARS = 20_000
"""A longer text is encoded in parts of about this length, cut before a space, so that memory and time stay bounded."""


class Tokenizer:
    """A tokenizer whose rank file is read once on the driver and broadcast; each worker builds it at first use."""

    def __init__(self, spark: SparkSession, path: str = TOKENIZER):
        with open(path, "rb") as f:
            data = f.read()
        self._held, self._key = spark.sparkContext.broadcast(data), zlib.crc32(data)

    def count(self, text: str | None) -> int:
        """Tokens of ``text``; 0 for null."""
        if not text:
            return 0
        encoding = _built(self._key, self._held)
        if len(text) <= PIECE_CHARS:
            return len(encoding.encode_ordinary(text))
        return sum(len(encoding.encode_ordinary(part)) for part in parts(text))


def parts(text: str) -> list[str]:
    """``text`` cut before single spaces that stand between letters, where no token of the pattern crosses."""
    out, start = [], 0
    while len(text) - start > PIECE_CHARS:
        at = start + PIECE_CHARS
        while True:
            at = text.find(" ", at)
            if at < 0 or at + 1 >= len(text):
                at = -1
                break
            if text[at + 1].isalpha() and not text[at - 1].isspace():
                break
            at += 1
        if at < 0:
            break
        out.append(text[start:at])
        start = at
    out.append(text[start:])
    return out


_encodings: dict[int, tiktoken.Encoding] = {}


def _built(key: int, held) -> tiktoken.Encoding:
    if key not in _encodings:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, held.value.splitlines())}
        _encodings[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]
