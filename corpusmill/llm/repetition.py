"""Problem 1: repetition inside a single document, by compression bands and an exact count.

Zstandard ratios of the normalised words of a text, whole and in fixed chunks, put it into a band whose limits depend
on its length. The band describes a text and decides nothing: ratios weigh bytes and depend on the vocabulary, the share
weighs words, so no limit on a ratio bounds the share. The exact share of repeated words is counted for every text.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, arrow_map, read
from .shingles import WordCodes, runs

RUN = 5
"""Words in a run that counts as repeated when it starts at an earlier word too."""
MAX_SHARE = 0.30
CHUNK_BYTES = 2048
LEVEL = 3
FAR_BYTES, FAR_WINDOW = 1 << 20, 27
"""From this size on, repeats are looked for across 2 ** FAR_WINDOW bytes by long-distance matching."""
#: (bytes below which it holds, whole ratio up to which a text is in the repetitive band). Natural prose compresses less
#: and less for shorter texts, so the limits rise; under 512 bytes the ratio says nothing and every text is in the band.
WHOLE_LIMITS = ((512, 9.0), (1024, 0.52), (2048, 0.50), (4096, 0.45), (8192, 0.40), (1 << 62, 0.36))
#: Limit for the best compressed full chunk: strong repetition in one part of a long text.
CHUNK_LIMIT = 0.36
#: Ratios above this are noise or encoded data, again only where the text is long enough to tell.
INCOMPRESSIBLE = ((512, 9.0), (2048, 0.80), (1 << 62, 0.72))


def _limit(table: tuple, n: int) -> float:
    return next(limit for below, limit in table if n < below)


def ratios(words: list[str], packer: zstandard.ZstdCompressor) -> tuple[int, float, float]:
    """Bytes of the normalised text, compressed share of the whole, and the least such share of its full chunks."""
    data = " ".join(words).encode("utf-8", "replace")
    if not data:
        return 0, 0.0, 1.0
    far = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(LEVEL, window_log=FAR_WINDOW, enable_ldm=True)) if len(data) >= FAR_BYTES else packer
    whole = len(far.compress(data)) / len(data)
    least = whole if len(data) <= 2 * CHUNK_BYTES else min(
        len(packer.compress(data[at : at + CHUNK_BYTES])) / CHUNK_BYTES for at in range(0, len(data) - CHUNK_BYTES + 1, CHUNK_BYTES)
    )
    return len(data), whole, least


def band(n: int, whole: float, least: float) -> str:
    """``repetitive``, ``incompressible``, ``normal``, or ``empty`` for a text without words."""
    if n == 0:
        return "empty"
    if whole <= _limit(WHOLE_LIMITS, n) or (n > 2 * CHUNK_BYTES and least <= CHUNK_LIMIT):
        return "repetitive"
    return "incompressible" if whole > _limit(INCOMPRESSIBLE, n) else "normal"


def repeated_words(words: list[str], known: WordCodes, run: int = RUN) -> int:
    """Words that lie in a run of ``run`` consecutive words which also starts at an earlier word."""
    if len(words) <= run:
        return 0
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    r = runs(codes, run)
    ordered = np.sort(r)
    if not np.any(ordered[1:] == ordered[:-1]):  # no run comes twice, as in most texts
        return 0
    _, first = np.unique(r, return_index=True)
    again = np.ones(len(r), np.int8)
    again[first] = 0
    marks = np.zeros(len(words) + 1, np.int32)
    marks[: len(r)] += again
    marks[run : run + len(r)] -= again
    return int(np.count_nonzero(np.cumsum(marks)[:-1]))


def repetition(records: DataFrame, max_share: float = MAX_SHARE) -> DataFrame:
    """One row per row of ``records`` (example_id, text): sizes, ratios, band, repeated words and their share.

    ``repeated_words`` is counted in every band. A null text has null measures and band ``null``; a text without words
    has band ``empty``, no repeated words and a share of 0. Other columns are ignored.
    """
    packer, known = [], WordCodes()

    def measure(c: dict[str, list]) -> dict[str, list]:
        if not packer:
            packer.append(zstandard.ZstdCompressor(level=LEVEL))
        out: dict[str, list] = {k: [] for k in ("example_id", "n_words", "n_bytes", "ratio", "chunk_ratio", "band", "repeated_words", "share", "is_repetitive")}
        for key, text in zip(c["example_id"], c["text"]):
            if text is None:
                row = (key, None, None, None, None, "null", None, None, False)
            else:
                words = WORD.findall(text.lower())
                n, whole, least = ratios(words, packer[0])
                count = repeated_words(words, known)
                share = count / max(1, len(words))
                row = (key, len(words), n, whole, least, band(n, whole, least), count, share, share > max_share)
            for column, value in zip(out.values(), row):
                column.append(value)
        return out

    return arrow_map(
        records.select("example_id", "text"),
        measure,
        "example_id bigint, n_words int, n_bytes int, ratio double, chunk_ratio double, band string, repeated_words int, share double, is_repetitive boolean",
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which more than 0.30 of the words are repeated; each once."""
    return repetition(read(spark, sf_dir, "example")).filter("is_repetitive").select("example_id").distinct()


def p1_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, repeated words and mean ratio by source and band, each record once."""
    base = read(spark, sf_dir, "example").select("example_id", "source", "text")
    measured = repetition(base).dropDuplicates(["example_id"])
    source = base.groupBy("example_id").agg(F.max("source").alias("source"))
    return (
        measured.join(source, "example_id")
        .groupBy("source", "band")
        .agg(
            F.count("*").alias("records"),
            F.sum(F.col("is_repetitive").cast("int")).alias("over_limit"),
            F.sum("repeated_words").alias("repeated_words"),
            F.round(F.avg("ratio"), 6).alias("mean_ratio"),
        )
    )


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, repeated words and their share of every record with a text, each once."""
    rows = repetition(read(spark, sf_dir, "example").filter("example_id is not null and text is not null")).dropDuplicates(["example_id"])
    return rows.select("example_id", "n_words", "repeated_words", F.round("share", 8).alias("share"))
