"""Problem 6: the same or near-same records across splits, by similarity-hash bit fingerprints.

1. A passage is a window of six consecutive words; its fingerprint is the similarity hash of its five word pairs: each of
   64 bits is what most of their hashes have there. Texts that a text of fewer words than a passage could hold are fingerprinted by
   their three-word windows, of each word with its place.
2. A code is split into ``RADIUS + 1`` segments; codes within the Hamming radius share a whole segment, so a join on
   (tier, segment number, segment) with a check of the distance finds all of them. A train code that a validation text has
   as it is (distance 0) is joined whole instead, by one row in place of one for each segment.
3. Train texts have the codes of all their passages. Validation texts have those of some passages that have no word in
   common, the rarest of them, so many that an edited copy cannot miss them: whatever breaks one of them costs a text two
   three-word shingles that are in no other, and a copy lacks at most a share of 1 - T of the shingles (``apart``). Texts
   that repeat themselves too much for it have the codes of their rarest passages, where two shingles are lost for every
   ``CUT`` passages (``posted_passages``).
4. Train codes are dropped early by a bitmap of the codes and segments that validation texts have, and validation codes by
   one of those that train texts kept. A bitmap has up to 128 MB and no false negatives; when it fills up, more rows are
   shuffled and the result is the same.
5. Keys held by many texts are split by salts. Candidates are verified on their exact sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import cut
from .common import HOT_ROWS, SLICE_ROWS, read, sized_join, threshold
from .shingles import WordCodes, class_key, class_sets, doc_frequency, mix, overlap, runs, signed, split_docs, word_codes

K = 3
PAIRS = 5
"""Word pairs of a passage; odd, so that no bit is tied."""
WORDS = PAIRS + 1
CUT = WORDS - 1
"""Passages that a cut between two words runs through, where it runs through two shingles."""
RADIUS = 1
PASSAGES_PER_MATCH = 16
APART_PER_MATCH = 8
APART_SPARE = 4
"""Passages apart that a text must have beyond those that a copy may lack, so that its commonest ones need not be posted."""
BITS_PER_KEY, PROBES = 16, 4
BITMAP_BITS = (22, 30)
"""log2 of the least and the greatest size of the bitmap in bits; between them it follows the number of keys."""
COUNTER_BITS = 20
"""log2 of the counters that bound how many rows a key has."""
BLOCKS = 64


class Bitmap(NamedTuple):
    """The bits of a set of keys, and how many of them each key has; keys of short texts have twice as many."""

    bits: np.ndarray
    probes: int


def run_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, phase) of each run: ``val`` or ``train``, whatever the spelling; runs without a usable phase are absent."""
    said = F.lower(F.regexp_replace("phase", r"[^A-Za-z]", ""))
    phase = F.when(said.startswith("val"), "val").when(said.startswith("train"), "train")
    return read(spark, sf_dir, "checkpoints").select("run_id", phase.alias("phase")).filter("run_id is not null and phase is not null").groupBy("run_id").agg(F.min("phase").alias("phase"))


def needed(n: int) -> int:
    """How many codes of a validation text that posts ``n`` passages beyond those an edited copy may lack must be shared."""
    return max(1, n // PASSAGES_PER_MATCH)


def posted_passages(passages: int, shingles: int, t: float) -> int:
    """How many of a validation text's passages are posted: those that a copy may lack, and ``needed`` more.

    A copy may lack the passages of ``lost`` shingles, and those that a text has only because it repeats shingles.
    """
    lost = shingles - int(np.ceil(t * shingles - 1e-9))
    again = max(0, passages - max(0, shingles - (WORDS - K)))
    return min(passages, again + -(-CUT * lost // (K - 1)) + needed(passages))


def apart(shingles: np.ndarray) -> np.ndarray:
    """First words of passages without a common word, of which an edited copy lacks at most one for every two lost shingles.

    Whatever parts two words of a passage parts the two shingles that run through both. Only passages count whose shingles,
    and the one before and after them, the text has once: then no other place keeps them, and no other passage counts them.
    """
    _, which, times = np.unique(shingles, return_inverse=True, return_counts=True)
    near = WORDS - K + 3  # shingles that run through two words of a passage
    if len(shingles) < near:
        return np.empty(0, np.int64)
    clean = 1 + np.flatnonzero(np.lib.stride_tricks.sliding_window_view(times[which], near).max(axis=1) == 1)
    return clean[clean % WORDS == np.bincount(clean % WORDS, minlength=WORDS).argmax()]


def is_short(words: int, shingles: int, t: float) -> bool:
    """Whether a validation text is fingerprinted by three-word windows: a text shorter than a passage could hold it."""
    return words < WORDS or t * shingles <= WORDS - K


def majority(words: np.ndarray, width: int) -> np.ndarray:
    """Similarity hashes of all windows of ``width`` words: bit-sliced counters, then a comparison with half of it."""
    n = len(words) - width + 1
    planes = [np.zeros(n, np.uint64) for _ in range(width.bit_length())]
    for j in range(width):
        carry = words[j : j + n]
        for p in range(len(planes)):
            planes[p], carry = planes[p] ^ carry, planes[p] & carry
    need, more, equal = width // 2 + 1, np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for p in reversed(range(len(planes))):
        if need >> p & 1:
            equal &= planes[p]
        else:
            more |= equal & planes[p]
            equal &= ~planes[p]
    return more | equal


def short_codes(words: np.ndarray) -> np.ndarray:
    """Similarity hashes of all three-word windows, of each word with its place."""
    n = len(words) - K + 1
    a, b, c = (mix(words[j : j + n] + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF)) for j in range(K))
    return a & b | a & c | b & c


def _tag(tier: int, part: int) -> np.uint64:
    return np.uint64((tier * 8 + part) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def _marked(keys: np.ndarray, tier: int, whole: int) -> np.ndarray:
    return keys & ~np.uint64(3) | np.uint64(2 * tier + whole)


def whole_keys(codes: np.ndarray, tier: int) -> np.ndarray:
    """A key of each code as it is; its lowest bit is set, the next one is the tier."""
    return _marked(mix(codes ^ _tag(tier, 0)), tier, 1)


def segments(codes: np.ndarray, tier: int, radius: int) -> np.ndarray:
    """Keys of the segments of codes, scrambled together with tier and segment number, one row a segment; lowest bit clear, the next one is the tier."""
    parts, width = radius + 1, 64 // (radius + 1)
    low = np.uint64((1 << width) - 1 if width < 64 else 0xFFFFFFFFFFFFFFFF)
    return np.stack([_marked(mix((codes >> np.uint64(s * width) & low) ^ _tag(tier, s + 1)), tier, 0) for s in range(parts)])


def slot(keys: np.ndarray, probe: int, size: int) -> np.ndarray:
    """The ``probe``-th bit of a bitmap of ``size`` bits that a key has."""
    return ((keys >> np.uint64(2)) + np.uint64(probe) * (keys >> np.uint64(33) | np.uint64(1))) & np.uint64(size - 1)


def slots(keys: np.ndarray, size: int, probes: int) -> np.ndarray:
    """All bits of a bitmap of ``size`` bits that some keys have."""
    short = keys[keys & np.uint64(2) != 0]
    return np.concatenate([slot(keys if p < probes else short, p, size) for p in range(2 * probes)])


def may_hold(bitmap: Bitmap, keys: np.ndarray, tier: int) -> np.ndarray:
    """Whether a bitmap may hold each key; a bit is looked up only for keys that have those before it."""
    flat = keys.reshape(-1)
    at = None
    for p in range(bitmap.probes * (1 + tier)):
        where = slot(flat if at is None else flat[at], p, 8 * len(bitmap.bits))
        hit = np.flatnonzero(bitmap.bits[(where >> np.uint64(3)).astype(np.int64)] >> (where & np.uint64(7)).astype(np.uint8) & 1)
        at = hit if at is None else at[hit]
    out = np.zeros(len(flat), bool)
    out[at] = True
    return out.reshape(keys.shape)


def kept(codes: np.ndarray, tier: int, radius: int, bits: Bitmap | None, near: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, codes, places) that a bitmap may hold (all without one): whole ones, and segments, with the places of their codes.

    If ``near`` is false, a code that is there whole, as are all of its segments, has no rows for segments.
    """
    whole, parts = whole_keys(codes, tier), segments(codes, tier, radius)
    some = np.ones(parts.shape, bool) if bits is None else may_hold(bits, parts, tier)
    equal = np.ones(whole.shape, bool) if bits is None else may_hold(bits, whole, tier)
    if not near:
        equal &= some.all(axis=0)
        some &= ~equal
    places = np.concatenate([np.flatnonzero(equal), np.nonzero(some)[1]])
    return np.concatenate([whole[equal], parts[some]]), codes[places], places


def passages(words: np.ndarray) -> np.ndarray:
    """Fingerprints of all passages of a text, by first word."""
    return majority(runs(words, 2), PAIRS)


def rarest_passages(codes: np.ndarray, shingles: np.ndarray, counts: np.ndarray, keep: int, at: np.ndarray | None = None) -> np.ndarray:
    """The ``keep`` distinct codes (of those ``at`` some places) whose rarest shingle is the rarest by the frequency sketch of the validation texts; ties by code."""
    seen = counts[(shingles & np.uint64(len(counts) - 1)).astype(np.int64)]
    rare = np.lib.stride_tricks.sliding_window_view(seen, WORDS - K + 1).min(axis=1)
    if at is not None:
        codes, rare = codes[at], rare[at]
    distinct, first = np.unique(codes, return_index=True)
    return distinct[np.lexsort((mix(distinct), rare[first]))[:keep]]


def posted(codes: np.ndarray, shingles: np.ndarray, counts: np.ndarray, members: int, t: float) -> tuple[int, np.ndarray]:
    """(least, codes): what a validation text with ``members`` distinct shingles posts, and how many of it a copy has at least."""
    at = apart(shingles)
    there, lacks = len(np.unique(codes[at])), (members - int(np.ceil(t * members - 1e-9))) // (K - 1)
    if there >= lacks + APART_SPARE:
        keep = min(there, lacks + max(1, there // APART_PER_MATCH))
        return keep - lacks, rarest_passages(codes, shingles, counts, keep, at)
    there = len(np.unique(codes))
    return needed(there), rarest_passages(codes, shingles, counts, posted_passages(there, members, t))


def held_out_codes(records: DataFrame, counts: np.ndarray, t: float) -> DataFrame:
    """(example_id, cls, n, least, tier, codes): validation ``records`` with a shingle and the codes that they post.

    ``least`` is how many codes a train text must share; ``tier`` is 1 for short texts.
    """
    held = records.sparkSession.sparkContext.broadcast(counts)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordCodes(), held.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                ids, rows = part.column("example_id").to_pylist(), []
                flat, lens = word_codes(part.column("text").to_pylist(), known)
                for i, w, r in split_docs(flat, lens, K):
                    members = np.unique(r)
                    if not is_short(len(w), len(members), t):
                        least, codes = posted(passages(w), r, seen, len(members), t)
                        rows.append((ids[i], class_key(members), len(members), least, 0, signed(codes)))
                    else:
                        rows.append((ids[i], class_key(members), len(members), 1, 1, signed(np.unique(short_codes(w)))))
                a, b, c, d, e, f = zip(*rows) if rows else ((), (), (), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(e, pa.int32()), pa.array(list(f), pa.list_(pa.int64()))],
                    ["example_id", "cls", "n", "least", "tier", "codes"],
                )

    return records.select("example_id", "text").mapInArrow(make, "example_id bigint, cls bigint, n int, least int, tier int, codes array<bigint>")


def train_codes(records: DataFrame, bitmap: Bitmap, radius: int = RADIUS) -> DataFrame:
    """(example_id, cls, n, keys, codes): train ``records`` with a shingle, and the keys of their passages that ``bitmap`` may hold.

    The code of a whole key says nothing new and is 0. The passages of a slice of records are made and tested at once.
    """
    held = records.sparkSession.sparkContext.broadcast(bitmap)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = WordCodes(), held.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                ids, rows = part.column("example_id").to_pylist(), []
                flat, lens = word_codes(part.column("text").to_pylist(), known)
                for i, _, r in split_docs(flat, lens, K):
                    members = np.unique(r)
                    rows.append((i, ids[i], class_key(members), len(members)))
                of, ends = np.repeat(np.arange(len(lens)), lens), np.repeat(np.cumsum(lens), lens)
                keys, codes, texts = [], [], []
                for tier, width, made in ((0, WORDS, passages), (1, K, short_codes)):
                    if len(flat) < width:
                        continue
                    inside = np.flatnonzero(np.arange(len(flat) - width + 1) + width <= ends[: len(flat) - width + 1])  # windows within one text
                    k, c, w = kept(made(flat)[inside], tier, radius, bits, near=False)
                    keys.append(k)
                    codes.append(np.where(k & np.uint64(1) == 1, np.uint64(0), c))
                    texts.append(of[inside[w]])
                key, code, text = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (keys, codes, texts))
                _, once = np.unique(mix(key ^ mix(code)) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
                once = once[np.argsort(text[once], kind="stable")]
                bounds = np.searchsorted(text[once], np.arange(len(lens) + 1))
                at_row = np.array([x[0] for x in rows], np.int64)
                # records without a shingle have no windows, so the lists of the others follow each other
                offsets = pa.array(np.append(bounds[at_row], bounds[-1]) if len(rows) else np.zeros(1, np.int64), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(signed(x[once]))) if len(rows) else pa.array([], pa.list_(pa.int64())) for x in (key, code)]
                yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.int64()), pa.array([x[3] for x in rows], pa.int32()), *lists], ["example_id", "cls", "n", "keys", "codes"])

    return records.select("example_id", "text").mapInArrow(make, "example_id bigint, cls bigint, n int, keys array<bigint>, codes array<bigint>")


def _salts(keys: np.ndarray, counts: np.ndarray | None, hot: int) -> np.ndarray:
    """Over how many salts the rows of each key are spread."""
    return np.ones(len(keys), np.int64) if counts is None else 1 + counts[(keys >> np.uint64(2)).astype(np.int64) & (len(counts) - 1)].astype(np.int64) // hot


def asked_rows(classes: DataFrame, bitmap: Bitmap | None, counts: np.ndarray | None = None, radius: int = RADIUS, hot: int = HOT_ROWS) -> DataFrame:
    """(cls, n, least, key, salt, code): keys of the rows of ``held_out_codes`` that ``bitmap`` may hold, one row for each of a key's salts."""
    held = classes.sparkSession.sparkContext.broadcast((bitmap, counts))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, rows = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                tier = part.column("tier").to_numpy()
                lists = part.column("codes")
                sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy().view(np.uint64)
                of = np.repeat(np.arange(part.num_rows), sizes)
                keys, codes, texts = [], [], []
                for t in (0, 1):
                    some = np.flatnonzero(tier[of] == t)
                    k, c, w = kept(flat[some], t, radius, bits)
                    keys.append(k)
                    codes.append(c)
                    texts.append(of[some[w]])
                key, code, text = map(np.concatenate, (keys, codes, texts))
                times = _salts(key, rows, hot)
                salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                key, code, text = (np.repeat(x, times) for x in (key, code, text))
                own = [pa.array(part.column(c).to_numpy()[text]) for c in ("cls", "n", "least")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(signed(key)), pa.array(salt, pa.int32()), pa.array(signed(code))], ["cls", "n", "least", "key", "salt", "code"])

    return classes.select("cls", "n", "least", "tier", "codes").mapInArrow(make, "cls bigint, n int, least int, key bigint, salt int, code bigint")


def train_rows(classes: DataFrame, counts: np.ndarray, hot: int = HOT_ROWS) -> DataFrame:
    """(cls, n, key, salt, code): one row for each key of the rows of ``train_codes``, with one of the key's salts."""
    held = classes.sparkSession.sparkContext.broadcast(counts)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                of = np.repeat(np.arange(part.num_rows), part.column("keys").value_lengths().to_numpy())
                key = part.column("keys").flatten().to_numpy().view(np.uint64)
                cls = part.column("cls").to_numpy()[of]
                salt = (mix(cls.view(np.uint64)) >> np.uint64(8)).astype(np.int64) % _salts(key, held.value, hot)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls), pa.array(part.column("n").to_numpy()[of]), pa.array(signed(key)), pa.array(salt, pa.int32()), part.column("codes").flatten()], ["cls", "n", "key", "salt", "code"]
                )

    return classes.select("cls", "n", "keys", "codes").mapInArrow(make, "cls bigint, n int, key bigint, salt int, code bigint")


def key_summary(keys: DataFrame, count: int) -> tuple[Bitmap, np.ndarray]:
    """(bitmap, counts) of all values of ``key``.

    The bitmap has ``BITS_PER_KEY`` bits for each of ``count`` keys, within ``BITMAP_BITS``, ``PROBES`` of them set for each key,
    fewer if that would fill it. Counters are shared by keys, so a count is an upper bound, up to 65,535. Tasks return places and counts in compressed
    blocks, which are merged by block.
    """
    wide = min(max((count * BITS_PER_KEY).bit_length(), BITMAP_BITS[0]), BITMAP_BITS[1])
    size, step, each = 1 << wide, (1 << wide) // BLOCKS, (1 << COUNTER_BITS) // BLOCKS
    probes = min(max(round(np.log(2) * size / max(count, 1)), 1), PROBES)
    schema = "block int, body binary"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, some, total = zstandard.ZstdCompressor(level=1), [np.empty(0, np.uint64)], np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in batches:
            key = batch.column("key").to_numpy().view(np.uint64)
            np.add.at(total, (key >> np.uint64(2)).astype(np.int64) & (len(total) - 1), np.uint32(1))
            some.append(np.unique(slots(key, size, probes)))
            if sum(map(len, some)) > 4_000_000:
                some = [np.unique(np.concatenate(some))]
        places = np.unique(np.concatenate(some))
        bounds = np.searchsorted(places, np.arange(BLOCKS + 1).astype(np.uint64) * np.uint64(step))
        for b in range(BLOCKS):
            low = np.diff((places[bounds[b] : bounds[b + 1]] - np.uint64(b * step)).astype(np.uint32), prepend=np.uint32(0))
            yield pa.RecordBatch.from_arrays([pa.array([b, BLOCKS + b], pa.int32()), pa.array([packer.compress(low.tobytes()), packer.compress(np.minimum(total[b * each : (b + 1) * each], 0xFFFF).astype(np.uint16).tobytes())], pa.binary())], ["block", "body"])

    def merge(group: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, unpacker = group[0].as_py(), zstandard.ZstdDecompressor()
        bodies = (unpacker.decompress(body.as_py()) for batch in batches for body in batch.column("body"))
        if block < BLOCKS:
            bits = np.zeros(step, np.uint8)
            for body in bodies:
                bits[np.cumsum(np.frombuffer(body, np.uint32), dtype=np.uint32)] = 1
            out = np.packbits(bits, bitorder="little").tobytes()
        else:
            total = np.zeros(each, np.uint64)
            for body in bodies:
                total += np.frombuffer(body, np.uint16)
            out = np.minimum(total, np.uint64(0xFFFF)).astype(np.uint16).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(out)], pa.binary())], ["block", "body"])

    bitmap, counts = np.zeros((BLOCKS, step // 8), np.uint8), np.zeros((BLOCKS, each), np.uint16)
    for block, body in keys.select("key").mapInArrow(partial, schema).groupBy("block").applyInArrow(merge, schema).collect():
        data = zstandard.ZstdDecompressor().decompress(bytes(body))
        if block < BLOCKS:
            bitmap[block] = np.frombuffer(data, np.uint8)
        else:
            counts[block - BLOCKS] = np.frombuffer(data, np.uint16)
    return Bitmap(bitmap.reshape(-1), probes), counts.reshape(-1)


def split_links(records: DataFrame, phases: DataFrame, t: float, radius: int = RADIUS, hot: int = HOT_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(val members, train members, links): members are (cls, example_id); links (cls_v, cls_r, containment).

    A link joins the class of a validation record with 3-set V and the class of a train record with 3-set R where
    ``|V and R| / |V| >= t``; a class may be on both sides. Rows with a null text, id or run, or of a run without a phase,
    and texts of fewer than three words are in no link. Repeated rows count once.
    """
    texts = records.select("example_id", "run_id", "text").filter("example_id is not null and text is not null and run_id is not null")
    phases = cut(phases)
    val_runs, train_runs = phases.filter("phase = 'val'").select("run_id"), phases.filter("phase = 'train'").select("run_id")
    held_out = sized_join(texts, val_runs, ["run_id"], "left_semi")
    val = cut(held_out_codes(held_out, doc_frequency(held_out.select("text"), K), t))
    codes = val.agg(F.sum(F.size("codes"))).first()[0] or 0
    wanted, _ = key_summary(asked_rows(val, None, radius=radius), codes * (radius + 2))
    train = cut(train_codes(sized_join(texts, train_runs, ["run_id"], "left_semi"), wanted, radius))

    def one_each(side: DataFrame) -> DataFrame:
        firsts = cut(side.groupBy("cls").agg(F.min("example_id").alias("example_id"))).select("example_id")  # one record of each class
        return sized_join(side, firsts, ["example_id"], "left_semi")

    keyed = one_each(train)
    keys = keyed.agg(F.sum(F.size("keys"))).first()[0] or 0
    found, rows = key_summary(keyed.select(F.explode("keys").alias("key")), keys)
    there = train_rows(keyed, rows, hot).select(F.col("cls").alias("cls_r"), F.col("n").alias("n_r"), "key", "salt", F.col("code").alias("code_r"))
    asked = asked_rows(one_each(val), found, rows, radius, hot).select(F.col("cls").alias("cls_v"), F.col("n").alias("n_v"), "least", "key", "salt", F.col("code").alias("code_v"))
    near = (F.col("key").bitwiseAND(F.lit(1)) == 1) | (F.bit_count(F.col("code_v").bitwiseXOR(F.col("code_r"))) <= radius)
    pairs = cut(
        asked.join(there, ["key", "salt"])
        .filter(near & (F.col("n_r") >= t * F.col("n_v") - 1e-9))
        .groupBy("cls_v", "cls_r")
        .agg(F.count("*").alias("shared"), F.max("least").alias("least"))  # a code may count for several segments: that only keeps more pairs
        .filter("shared >= least")
        .select("cls_v", "cls_r")
    )
    members = val.select("cls", "example_id").unionByName(train.select("cls", "example_id"))
    ends = pairs.select(F.explode(F.array("cls_v", "cls_r")).alias("cls")).distinct()
    reps = cut(ends.join(members, "cls").groupBy("cls").agg(F.min("example_id").alias("example_id")))
    sets = class_sets(texts.select("example_id", "text"), reps, K)
    links = overlap(pairs, sets, "cls_v", "cls_r").withColumn("containment", F.col("shared") / F.col("n_a")).filter(F.col("containment") >= t)
    return val.select("cls", "example_id").distinct(), train.select("cls", "example_id").distinct(), cut(links.select("cls_v", "cls_r", "containment"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs (a < b) of a validation and a train record of which the former stands, wholly or nearly, in the latter."""
    val, train, links = split_links(read(spark, sf_dir, "example"), run_phases(spark, sf_dir), threshold(spark, sf_dir))
    v = val.select(F.col("cls").alias("cls_v"), F.col("example_id").alias("x"))
    r = train.select(F.col("cls").alias("cls_r"), F.col("example_id").alias("y"))
    both = links.join(v, "cls_v").join(r, "cls_r").filter("x <> y")
    return both.select(F.least("x", "y").alias("example_id_a"), F.greatest("x", "y").alias("example_id_b")).distinct()


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source: records, and those that are in an overlap; classes are not expanded to pairs."""
    records, phases = read(spark, sf_dir, "example"), run_phases(spark, sf_dir)
    val, train, links = split_links(records, phases, threshold(spark, sf_dir))
    hit = (
        val.join(links.select(F.col("cls_v").alias("cls")), "cls", "left_semi").select("example_id")
        .unionByName(train.join(links.select(F.col("cls_r").alias("cls")), "cls", "left_semi").select("example_id"))
        .distinct()
        .withColumn("hit", F.lit(1))
    )
    told = records.select("example_id", "run_id", "source").filter("example_id is not null").groupBy("example_id").agg(F.max("source").alias("source"), F.max("run_id").alias("run_id"))
    return (
        told.join(phases, "run_id")
        .join(hit, "example_id", "left")
        .groupBy(F.col("phase").alias("split"), "source")
        .agg(F.count("*").alias("records"), F.count("hit").alias("overlapping"))
        .withColumn("share", F.round(F.col("overlapping") / F.col("records"), 6))
    )
