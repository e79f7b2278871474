"""Tokenizing, packing into one token stream, and reading it back."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import running

MODEL = os.environ.get("CORPUSMILL_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
UNK, BOS, EOS, PAD = 0, 1, 2, 3
_loaded: dict[int, object] = {}


def _processor(held):
    import sentencepiece

    key = id(held)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = sentencepiece.SentencePieceProcessor(model_proto=held.value)
    return _loaded[key]


def encode(df: DataFrame, text: str, path: str = MODEL) -> DataFrame:
    """``df`` without ``text`` and with ``ids``: subword ids by a SentencePiece model, in Arrow batches.

    The model file is read once on the driver and broadcast (half a megabyte). A null text has null ids.
    """
    with open(path, "rb") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(held)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            ids = iter(sp.encode([t for t in texts if t is not None], out_type=int, num_threads=1))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array([None if t is None else next(ids) for t in texts], pa.list_(pa.int32()))], [*keep, "ids"])

    schema = df.drop(text).schema.add("ids", T.ArrayType(T.IntegerType()))
    return df.select(*keep, text).mapInArrow(run, schema)


def decode(df: DataFrame, path: str = MODEL) -> DataFrame:
    """``df`` without ``ids`` and with ``text``: pieces joined back."""
    with open(path, "rb") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in df.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(held)
        for batch in batches:
            texts = [None if i is None else sp.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], [*keep, "text"])

    return df.select(*keep, "ids").mapInArrow(run, df.drop("ids").schema.add("text", "string"))


def code_points(df: DataFrame, text: str) -> DataFrame:
    """``df`` without ``text`` and with ``ids``: the code points of a text as ids, whole Arrow batches at once; null for null."""
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            texts = batch.column(text).to_pylist()
            sizes = np.array([0 if t is None else len(t) for t in texts], np.int64)
            flat = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.int32)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            mask = pa.array([t is None for t in texts], pa.bool_())
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat), mask=mask) if len(texts) else pa.array([], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], ids], [*keep, "ids"])

    return df.select(*keep, text).mapInArrow(run, df.drop(text).schema.add("ids", T.ArrayType(T.IntegerType())))


def pack(df: DataFrame, order: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``packed`` (ids and a closing EOS), ``n_tokens`` of it and ``start``, its place in the stream, in the order of ``order``.

    Rows with null ids are dropped. Only sizes are ordered, not the arrays.
    """
    packed = df.withColumn("packed", F.concat(F.col(ids), F.array(F.lit(EOS)))).filter(F.col("packed").isNotNull())
    return running(packed.withColumn("n_tokens", F.size("packed").cast("bigint")), [order], {"start": "n_tokens"})


def stream(packed: DataFrame) -> DataFrame:
    """(pos, token): one row per token of the packed stream."""
    return packed.select("start", F.posexplode("packed").alias("_i", "token")).select((F.col("start") + F.col("_i")).alias("pos"), "token")


def head(packed: DataFrame, most: int) -> DataFrame:
    """(pos, token) of the first ``most`` tokens; texts that start later are not opened."""
    return stream(packed.filter(F.col("start") < most)).filter(F.col("pos") < most)


def eos_places(packed: DataFrame) -> DataFrame:
    """(end): the place of each EOS of the stream, found inside the arrays."""
    marks = F.filter(F.transform("packed", lambda t, i: F.when(t == EOS, F.col("start") + i)), lambda p: p.isNotNull())
    return packed.select(F.explode(marks).alias("end"))


def _part(first: Column, last: Column) -> Column:
    """The tokens of a packed text from place ``first`` of the stream up to and with ``last``."""
    low = F.greatest(first, F.col("start"))
    return F.slice("packed", (low - F.col("start") + 1).cast("int"), F.greatest(F.least(last, F.col("start") + F.size("packed") - 1) - low + 1, F.lit(0)).cast("int"))


def _joined(parts: DataFrame, key: str) -> DataFrame:
    """(key, _t): the tokens of the parts (key, at, part) of each key in order; it has at most as many rows as a block has texts."""
    return parts.groupBy(key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda s: s["part"])).alias("_t"))


def blocks(packed: DataFrame, size: int) -> DataFrame:
    """(block, x, y) of all sequential blocks of ``size`` tokens; y is x moved on by one; a last, shorter block is dropped.

    A text sends one row, a slice of its tokens, to each block that it reaches into, the token after the block included; a
    block gathers ``size + 1`` tokens at most.
    """
    end = F.col("start") + F.size("packed") - 1
    reach = F.sequence(F.greatest(F.floor((F.col("start") - 1) / size), F.lit(0)).cast("bigint"), F.floor(end / size).cast("bigint"))
    rows = packed.select("start", "packed", F.explode(reach).alias("block"))
    parts = rows.select("block", F.greatest(F.col("block") * size, F.col("start")).alias("at"), _part(F.col("block") * size, (F.col("block") + 1) * size).alias("part"))
    full = _joined(parts, "block").filter(F.size("_t") == size + 1)
    return full.select("block", F.slice("_t", 1, size).alias("x"), F.slice("_t", 2, size).alias("y"))


def slices(packed: DataFrame, starts: DataFrame, size: int) -> DataFrame:
    """(start, x): ``size`` tokens from each of ``starts``; an equi-join of texts' slices and starts on buckets of ``size`` places."""
    first = F.floor(F.col("start") / size).cast("bigint")
    wanted = starts.select(F.col("start").alias("_from"), F.explode(F.array(first, first + 1)).alias("b"))
    end = F.col("start") + F.size("packed") - 1
    rows = packed.select("start", "packed", F.explode(F.sequence(first, F.floor(end / size).cast("bigint"))).alias("b"))
    held = rows.select("b", F.greatest(F.col("b") * size, F.col("start")).alias("start"), _part(F.col("b") * size, (F.col("b") + 1) * size - 1).alias("packed"))
    hit = held.join(wanted, "b").filter((F.col("start") < F.col("_from") + size) & (F.col("start") + F.size("packed") > F.col("_from")))
    parts = hit.select("_from", F.greatest("start", "_from").alias("at"), _part(F.col("_from"), F.col("_from") + size - 1).alias("part"))
    return _joined(parts, "_from").filter(F.size("_t") == size).select(F.col("_from").alias("start"), F.col("_t").alias("x"))


def random_starts(total: Column, size: int, samples: int, seed: int, inclusive: bool = False) -> Column:
    """An array of ``samples`` pseudo-random starts in ``[0, total - size - 1)``, with its end if ``inclusive``.

    A stream of at most ``size + 1`` tokens (of at most ``size`` if ``inclusive``) is an error.
    """
    least = size if inclusive else size + 1
    u = lambda i: (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), i.cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    good = F.when(total > least, total).otherwise(F.raise_error(F.concat(F.lit("stream of "), total.cast("string"), F.lit(f" tokens is too short for samples of {size}"))).cast("bigint"))
    return F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.floor(u(i) * (good - least)).cast("bigint"))


def until_eos(ids: Column, eos: int = EOS, special: tuple[int, ...] = (UNK, BOS, EOS, PAD)) -> Column:
    """Ids before the first EOS, without special ones."""
    at = F.array_position(ids, eos)
    return F.filter(F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids), lambda t: ~t.isin(*special))


def dtype_of(vocab_size: int) -> str:
    """Width of the binary format: two bytes below 65,536 ids, else four."""
    return "uint16" if vocab_size < 65536 else "uint32"


def _file_system(path: str):
    """(file system, path on it) of a folder that all executors reach, by its address or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def write_binary(packed: DataFrame, path: str, vocab_size: int) -> int:
    """Write the stream as little-endian files, one per partition and named by its first position; returns the tokens.

    Every task writes its own part of the order through the file system of ``path`` (shared, not a machine's own), under a
    temporary name that is moved when it is whole; exactly as many tokens are written as there are.
    """
    wide = 2 if dtype_of(vocab_size) == "uint16" else 4
    ordered = packed.select("start", "packed").repartitionByRange("start").sortWithinPartitions("start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        system, folder = _file_system(path)
        out, temporary, first, n = None, "", 0, 0
        for batch in batches:
            for start, ids in zip(batch.column("start").to_pylist(), batch.column("packed").to_pylist()):
                if out is None:
                    first, temporary = start, f"{folder}/_tmp-{start:020d}-{uuid.uuid4().hex}"
                    system.create_dir(folder)
                    out = system.open_output_stream(temporary)
                out.write(np.asarray(ids, dtype=f"<u{wide}").tobytes())
                n += len(ids)
        if out is not None:
            out.close()
            system.move(temporary, f"{folder}/part-{first:020d}.bin")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return int(ordered.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0)


def read_binary(spark: SparkSession, path: str, wide: int = 2, most: int | None = None) -> DataFrame:
    """(pos, token) of the files of ``write_binary``, or of any folder of such files named in order.

    ``most`` cuts a padded tail: only the first ``most`` tokens are kept.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    sized = running(files, ["path"], {"start": F.floor(F.col("length") / wide).cast("bigint")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for start, content in zip(batch.column("start").to_pylist(), batch.column("content").to_pylist()):
                ids = np.frombuffer(content, dtype=f"<u{wide}", count=len(content) // wide)
                for at in range(0, len(ids), 1 << 16):
                    part = ids[at : at + (1 << 16)].astype("int32")
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(start + at, start + at + len(part))), pa.array(part)], ["pos", "token"])

    out = sized.select("start", "content").mapInArrow(run, "pos bigint, token int")
    return out if most is None else out.filter(F.col("pos") < most)


def marked(df: DataFrame, path: str = MODEL, mark: str = "\n[EOS]\n") -> DataFrame:
    """``df`` (with ``ids``) without it and with ``documents`` and ``text``: the parts between EOS tokens, decoded and joined by ``mark``.

    Empty parts count as documents but are left out of the text, so consecutive EOS tokens make no empty passages.
    """
    with open(path, "rb") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in df.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(held)
        for batch in batches:
            counts, texts = [], []
            for ids in batch.column("ids").to_pylist():
                if ids is None:
                    counts.append(None)
                    texts.append(None)
                    continue
                parts: list[list[int]] = [[]]
                for token in ids:
                    if token == EOS:
                        parts.append([])
                    else:
                        parts[-1].append(token)
                counts.append(len(parts))
                texts.append(mark.join(sp.decode([p for p in parts if p])))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(counts, pa.int32()), pa.array(texts, pa.string())], [*keep, "documents", "text"])

    schema = df.drop("ids").schema.add("documents", T.IntegerType()).add("text", T.StringType())
    return df.select(*keep, "ids").mapInArrow(run, schema)


def vocabulary(spark: SparkSession, path: str = MODEL) -> DataFrame:
    """(token, piece) of a SentencePiece model: a fixed table of its ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return spark.createDataFrame([(i, sp.id_to_piece(i)) for i in range(sp.get_piece_size())], "token int, piece string")


def step_start(start: Column, size: int, total: Column, forward: bool) -> Column:
    """The start of the next or previous sample of ``size`` tokens, kept within ``[0, total - size - 1]``."""
    last = F.greatest(total - size - 1, F.lit(0))
    return F.least(start + size, last) if forward else F.greatest(start - size, F.lit(0))


def listed(ids: Column, most: int) -> Column:
    """The first ``most`` ids as text, and ``...`` if there are more."""
    return F.concat(F.array_join(F.transform(F.slice(ids, 1, most), lambda t: t.cast("string")), ", "), F.when(F.size(ids) > most, F.lit(", ...")).otherwise(F.lit("")))


def sample_header(start: Column, ids: Column, total: Column, most: int = 50, eos: int = EOS) -> Column:
    """One line on a sample: place, share of the stream, places of EOS, documents, first ids."""
    places = F.filter(F.transform(ids, lambda t, i: F.when(t == eos, i)), lambda i: i.isNotNull())
    return F.format_string(
        "offset %d (%.2f%%), eos at [%s], %d documents, ids %s", start, 100.0 * start / total, F.array_join(F.transform(places, lambda i: i.cast("string")), ", "), F.size(places) + 1, listed(ids, most)
    )
