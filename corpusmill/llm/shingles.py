"""Word shingles as arrays of 64-bit codes, built for whole Arrow batches at once, and what joins on them need.

A *set* is the set of distinct runs of ``k`` consecutive words of a text. A *class* is all texts with equal sets; its
key is a 64-bit hash of the sorted set. Sets are compared by the 64-bit codes of their members; two different shingles
of a pair of texts share a code with a probability of about 1e-13.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, WORD, sized_join

SKETCH_BITS = (20, 24)
"""log2 of the least and the greatest number of counters of the frequency sketch; between them it follows the size of the data."""
BYTES_PER_COUNTER = 1
UNKNOWN_BYTES = 1 << 60
SKETCH_BLOCKS = 64
SKETCH_TASKS = 4
"""Tasks a core that count shingles: each returns a sketch, so their number must not follow the data."""
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class WordCodes(dict):
    """Word -> 64-bit hash, remembered for up to ``limit`` words and then started anew."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def word_codes(texts: list[str | None], known: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words of all texts, flat, and the number of words of each text."""
    flat, lens = array("Q"), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            w = WORD.findall(t.lower())
            lens[i] = len(w)
            flat.extend(map(known.__getitem__, w))
    return np.frombuffer(flat, np.uint64) if len(flat) else np.empty(0, np.uint64), lens


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit codes."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def runs(codes: np.ndarray, k: int) -> np.ndarray:
    """Codes of the runs of ``k`` consecutive words, by first word."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = (acc ^ codes[j : j + n]) * np.uint64(_ODD[j % len(_ODD)])
        acc ^= acc >> np.uint64(31)
    return mix(acc)


def split_docs(codes: np.ndarray, lens: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, word codes, run codes) of each text of at least ``k`` words."""
    all_runs, at = runs(codes, k), 0
    for i, n in enumerate(lens.tolist()):
        if n >= k:
            yield i, codes[at : at + n], all_runs[at : at + n - k + 1]
        at += n


def class_key(members: np.ndarray) -> int:
    """The class of a sorted array of distinct shingle codes, as a signed 64-bit number."""
    return xxhash.xxh3_64_intdigest(members.tobytes()) - (1 << 63)


def sketch_bits(texts: DataFrame) -> int:
    """log2 of the counters for ``texts``: one for so many bytes of the data as planned, within ``SKETCH_BITS``; the least if the size is unknown."""
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return SKETCH_BITS[0] if size >= UNKNOWN_BYTES else min(max((size // BYTES_PER_COUNTER).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])


def doc_frequency(texts: DataFrame, k: int, bits: int | None = None) -> np.ndarray:
    """Over all rows: in how many texts a shingle occurs, as a sketch of ``2 ** bits`` counters of 16 bits (32 MB at most).

    A shingle's counter is the low bits of its code; counters are shared, so a count is an upper bound, up to 65,535. Each
    task counts several splits and returns its counters in compressed blocks, which are summed by block. The sketch orders
    shingles from rare to frequent and tells which are hot, so that any rounding in it changes speed and never results.
    """
    size = 1 << (bits or sketch_bits(texts))
    step = size // SKETCH_BLOCKS
    mask = np.uint64(size - 1)
    schema = "block int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, packer = WordCodes(), np.zeros(size, np.uint32), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                codes, lens = word_codes(batch.column(0).slice(at, SLICE_ROWS).to_pylist(), known)
                got = [np.unique(r) for _, _, r in split_docs(codes, lens, k)]
                if got:
                    np.add.at(total, (np.concatenate(got) & mask).astype(np.int64), np.uint32(1))
        small = np.minimum(total, 255).astype(np.uint8)
        for b in range(SKETCH_BLOCKS):
            part = slice(b * step, (b + 1) * step)
            over = np.flatnonzero(total[part] > 255).astype(np.uint32)
            body = small[part].tobytes() + over.tobytes() + total[part][over].tobytes()  # bytes, then the places and values above them
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([packer.compress(body)], pa.binary())], ["block", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, unpacker = np.zeros(step, np.uint64), zstandard.ZstdDecompressor()
        for batch in batches:
            for part in batch.column("counts"):
                body = unpacker.decompress(part.as_py())
                own, over = np.frombuffer(body[:step], np.uint8).astype(np.uint64), np.frombuffer(body[step:], np.uint32).reshape(2, -1)
                own[over[0]] = over[1]
                total += own
        held = np.minimum(total, np.uint64(0xFFFF)).astype(np.uint16).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(held)], pa.binary())], ["block", "counts"])

    out = np.zeros(size, np.uint16)
    spread = texts.coalesce(SKETCH_TASKS * texts.sparkSession.sparkContext.defaultParallelism)
    for block, counts in spread.mapInArrow(count, schema).groupBy("block").applyInArrow(add, schema).collect():
        out[block * step : (block + 1) * step] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(counts)), np.uint16)
    return out


def rarest(members: np.ndarray, counts: np.ndarray, keep: int) -> np.ndarray:
    """The ``keep`` members that are first by (frequency, code): the same global order for every text."""
    seen = counts[(members & np.uint64(len(counts) - 1)).astype(np.int64)]
    return members[np.lexsort((members, seen))[:keep]]


def prefix_size(n: int, t: float) -> int:
    """So many of the first members of a set of ``n`` must hold one that any set with ``t * n`` of them shares."""
    return n - int(np.ceil(t * n - 1e-9)) + 1


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as signed numbers, as Spark's BIGINT has them."""
    return x.view(np.int64) if x.dtype == np.uint64 else x


def class_sets(texts: DataFrame, reps: DataFrame, k: int, salt_rows: int | None = None) -> DataFrame:
    """(cls, members) of the classes in ``reps`` (cls, example_id): the sorted shingle codes of that record's text.

    ``texts`` has (example_id, text). The texts are found by a join whose small side is broadcast only after a count. Where
    an id was delivered with several texts, the one that is of the class is taken.
    """
    wanted = sized_join(texts, reps, ["example_id"], "inner", salt_rows).select("cls", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCodes()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                codes, lens = word_codes(part.column("text").to_pylist(), known)
                keys, sets = part.column("cls").to_pylist(), {}
                for i, _, r in split_docs(codes, lens, k):
                    members = np.unique(r)
                    if class_key(members) == keys[i]:
                        sets[keys[i]] = signed(members)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(sets), pa.int64()), pa.array(list(sets.values()), pa.list_(pa.int64()))], ["cls", "members"]
                )

    return wanted.mapInArrow(make, "cls bigint, members array<bigint>").groupBy("cls").agg(F.first("members").alias("members"))


def overlap(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``n_a``, ``n_b`` and ``shared``: exact sizes of both sets and of what they share."""
    left = sets.select(F.col("cls").alias(a), F.col("members").alias("_a"))
    right = sets.select(F.col("cls").alias(b), F.col("members").alias("_b"))
    return (
        pairs.join(left, a)
        .join(right, b)
        .withColumn("shared", F.size(F.array_intersect("_a", "_b")))
        .withColumn("n_a", F.size("_a"))
        .withColumn("n_b", F.size("_b"))
        .drop("_a", "_b")
    )
