"""Problem 7: filling containers of fixed capacity, by bounded-space online packing.

Each scan partition keeps at most ``WINDOWS`` open containers. An item goes to the open container that it fills best;
when it fits none, the fullest one is emitted and a new one opened. What is still open at the end of a partition is
packed again as whole containers, by the same rule, first in groups of partitions and then over all of them.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import cut
from .common import SLICE_ROWS, read, sized_join
from .tokens import TOKENIZER, Tokenizer

WINDOWS = 128
EOS = 1
"""Tokens that close each item in its container."""
OPEN = -1
"""Piece number of the rows by which a partition reports its open containers."""
GROUP = 64
"""Partitions (or groups of them) whose leftovers are merged in one task."""


class Packer:
    """Open containers by free space; ``put`` returns the container that takes an item, ``closed`` those emitted."""

    def __init__(self, capacity: int, windows: int = WINDOWS, first: int = 0):
        self.capacity, self.windows, self.next = capacity, windows, first
        self.open: list[tuple[int, int]] = []  # (free, container), ascending

    def put(self, size: int) -> int:
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            free, container = self.open.pop(at)
        else:
            if len(self.open) >= self.windows:
                self.open.pop(0)
            free, container = self.capacity, self.next
            self.next += 1
        if free > size:
            insort(self.open, (free - size, container))
        return container


def pieces(tokens: int, capacity: int) -> list[int]:
    """Sizes, EOS included, of the items that a text of ``tokens`` tokens makes: one, or full ones and a rest."""
    if tokens + EOS <= capacity:
        return [tokens + EOS]
    whole, rest = divmod(tokens, capacity - EOS)
    return [capacity] * whole + ([rest + EOS] if rest else [])


def pack(documents: DataFrame, capacity: int, tokenizer: Tokenizer, windows: int = WINDOWS) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, container, is_cut): the container of each text or piece.

    ``n_tokens`` includes the item's EOS token. A text is cut only if it alone exceeds the capacity. Null and empty texts
    make no item; equal texts under different ids are separate items. ``capacity`` must be at least 2.
    """
    if capacity < 2:
        raise ValueError("capacity must hold a token and its EOS")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer = Packer(capacity, windows, part << 32)
        names = ["doc_id", "piece", "start_token", "n_tokens", "container", "is_cut"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                cols: list[list] = [[] for _ in names]
                some = batch.slice(at, SLICE_ROWS)
                for doc, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist()):
                    n = tokenizer.count(text)
                    sizes = pieces(n, capacity) if n else []
                    for k, size in enumerate(sizes):
                        for c, v in zip(cols, (doc, k, k * (capacity - EOS), size, packer.put(size), len(sizes) > 1)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
        rest = [(None, OPEN, 0, capacity - free, container, False) for free, container in packer.open]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rest], t) for i, t in enumerate(types)], names)

    placed = cut(documents.select("doc_id", "text").mapInArrow(fill, "doc_id bigint, piece int, start_token bigint, n_tokens int, container bigint, is_cut boolean"))
    leftovers = placed.filter(F.col("piece") == OPEN).select("container", F.col("n_tokens").cast("bigint").alias("used"))
    moved = merge(leftovers, capacity, windows)
    placed = placed.filter(F.col("piece") != OPEN)
    return sized_join(placed, moved, ["container"], "left").select("doc_id", "piece", "start_token", "n_tokens", F.coalesce("target", "container").alias("container"), "is_cut")


def merge(leftovers: DataFrame, capacity: int, windows: int = WINDOWS) -> DataFrame:
    """(container, target) of containers left open (container, used) and the container that takes their whole content.

    They are merged in groups of ``GROUP`` partitions, fullest first, until one group is left. Each level keeps ``windows``
    containers open and passes only those on, so that a task gets at most ``GROUP * windows`` rows.
    """
    group = F.shiftright("container", 32).cast("bigint")
    moved, current, level = None, leftovers, 0
    while True:
        level += 1

        def again(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer, ids, size = Packer(capacity, windows), {}, {}
            rows = sorted(((u, c) for b in batches for c, u in zip(b.column("container").to_pylist(), b.column("used").to_pylist())), reverse=True)
            slots = []
            for used, container in rows:
                slot = packer.put(used)
                ids.setdefault(slot, container)
                size[slot] = size.get(slot, 0) + used
                slots.append(slot)
            still = {slot for _, slot in packer.open}
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for _, c in rows], pa.int64()), pa.array([ids[s] for s in slots], pa.int64()), pa.array([size[s] for s in slots], pa.int64()), pa.array([s in still for s in slots], pa.bool_())],
                ["container", "target", "used", "open"],
            )

        keyed = current.withColumn("g", F.floor(group / GROUP**level).cast("bigint"))
        step = cut(keyed.groupBy("g").applyInArrow(again, "container bigint, target bigint, used bigint, open boolean"))
        links = step.select("container", "target")
        if moved is None:
            moved = links
        else:
            moved = cut(moved.join(links.select(F.col("container").alias("target"), F.col("target").alias("to")), "target", "left").select("container", F.coalesce("to", "target").alias("target")))
        current = step.filter("open").groupBy(F.col("target").alias("container")).agg(F.first("used").alias("used"))
        top = step.agg(F.max(group)).first()[0]
        if top is None or top < GROUP**level:
            return moved


def profile(spark: SparkSession, sf_dir: str, name: str) -> dict:
    """The row of ``data_meta`` named ``name`` (the one with the largest ``created_at``)."""
    row = read(spark, sf_dir, "data_meta").filter(F.col("meta_name") == name).orderBy(F.desc_nulls_last("created_at"), F.desc("meta_id")).first()
    if row is None:
        raise ValueError(f"no profile {name}")
    return row.asDict()


def _packed(spark: SparkSession, sf_dir: str, name: str, path: str = TOKENIZER) -> tuple[DataFrame, int]:
    capacity = int(profile(spark, sf_dir, name)["block_size"])
    return pack(read(spark, sf_dir, "documents"), capacity, Tokenizer(spark, path)), capacity


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document under profile ``three_way``."""
    return _packed(spark, sf_dir, "three_way")[0]


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For two profiles: items, cut texts, tokens, containers, and the share of the containers' space that is used."""
    out = None
    for name in ("three_way", "short_blocks"):
        placed, capacity = _packed(spark, sf_dir, name)
        one = placed.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"), F.count_if(F.col("is_cut") & (F.col("piece") == 0)).alias("cut_texts")).agg(
            F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("cut_texts").alias("cut_texts"), F.sum("used").alias("tokens"), F.max("used").alias("fullest")
        )
        one = one.select(F.lit(name).alias("profile"), F.lit(capacity).alias("capacity"), "*", F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("used_share"))
        out = one if out is None else out.unionByName(one)
    return out


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For two profiles, what must hold: every text with a character is placed, and how many are lost, repeated or wrongly cut, and containers overfull (none)."""
    texts = read(spark, sf_dir, "documents").filter("text is not null and text <> ''").select("doc_id")
    out = None
    for name in ("three_way", "short_blocks"):
        placed, capacity = _packed(spark, sf_dir, name)
        placed = cut(placed)
        per = placed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.countDistinct("piece").alias("different"), F.sum("n_tokens").alias("size"), F.max("is_cut").alias("is_cut"))
        needed = F.when(F.col("is_cut"), F.ceil((F.col("size") - F.col("pieces") * EOS) / (capacity - EOS))).otherwise(F.lit(1))
        bad = F.col("is_cut") & (F.col("size") - (F.col("pieces") - 1) * EOS <= capacity) | (F.col("pieces") != needed)
        one = texts.join(per, "doc_id", "left").agg(
            F.count("*").alias("documents"), F.count_if(F.col("pieces").isNull()).alias("lost"), F.count_if(F.col("pieces") > F.col("different")).alias("repeated"), F.count_if(bad).alias("badly_cut")
        )
        full = placed.groupBy("container").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > capacity).alias("overfull"))
        one = one.crossJoin(full).select(F.lit(name).alias("profile"), "documents", "lost", "repeated", "overfull", "badly_cut").filter("documents > 0")  # one row each
        out = one if out is None else out.unionByName(one)
    return out
