"""Problem 2: near-duplicate records, by Bayesian candidate pruning.

1. A frequency sketch of the word shingles gives one global order from rare to frequent.
2. Texts with equal shingle sets form classes. Of each class the rarest members that any similar set must share one of
   (a prefix of about 1 - T of the set) are posted; classes that share a posted member and fit by size and position are
   candidates. Of the smaller set of a pair a shorter prefix is enough. This loses no pair of similarity T or more.
   Members that the sketch calls hot are posted by ranges of size and spread over salts, so that only classes of fitting
   sizes meet, in many tasks.
3. MinHash values of a candidate pair are compared in steps. With a uniform prior, m agreements of n leave the
   similarity with a Beta(m + 1, n - m + 1) posterior; a pair is dropped as soon as the probability of reaching T is
   below the tolerance.
4. The survivors' sets are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import cut
from .common import BROADCAST_ROWS, HOT_ROWS, SLICE_ROWS, hot_keys, read, salted_join, sized_join, threshold
from .shingles import WordCodes, class_key, class_sets, doc_frequency, overlap, prefix_size, rarest, signed, split_docs, word_codes

K = 3
HASHES = 64
STEP = 16
TOLERANCE = 1e-7
POSTED_PER_TASK = 250_000
"""Posted members that one task joins, so that its share doesn't grow with the data."""


def least_agreements(t: float, tolerance: float, hashes: int = HASHES, step: int = STEP) -> dict[int, int]:
    """For each step of compared values: the fewest agreements with which a pair stays.

    P(Beta(m + 1, n - m + 1) >= t) equals P(Binomial(n + 1, t) <= m).
    """
    out = {}
    for n in range(step, hashes + 1, step):
        below, m = 0.0, -1
        while below < tolerance and m < n:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def _minhash(members: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """8 bits of the least of each random function of the members: unequal ones agree by chance in 1 of 256, which only keeps pairs."""
    x = (members >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        h = x[None, at : at + 2048] * a[:, None] + b[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        low = np.minimum(low, h.min(axis=1))
    return (low ^ (low >> np.uint32(16)) ^ (low >> np.uint32(8))).astype(np.uint8).view(np.int8)


def describe(records: DataFrame, counts: np.ndarray, t: float, hot: int = HOT_ROWS) -> DataFrame:
    """(example_id, cls, n, sketch, prefix, parts) of each record with a shingle: its class, size, MinHash values, posted members.

    ``parts`` is null if no posted member is hot; else it has for each the salts it is spread over, 0 if it isn't hot.
    """
    held = records.sparkSession.sparkContext.broadcast(counts)
    rng = np.random.default_rng(7)
    a = rng.integers(1, 1 << 32, HASHES, np.uint64).astype(np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordCodes(), held.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                keys = part.column("example_id").to_pylist()
                codes, lens = word_codes(part.column("text").to_pylist(), known)
                rows = []
                for i, _, r in split_docs(codes, lens, K):
                    m = np.unique(r)
                    first = rarest(m, seen, prefix_size(len(m), t))
                    heat = seen[(first & np.uint64(len(seen) - 1)).astype(np.int64)].astype(np.int32) // hot
                    rows.append((keys[i], class_key(m), len(m), _minhash(m, a, b), signed(first), np.where(heat > 0, heat + 1, 0) if heat.any() else None))
                ids, cls, n, sketch, prefix, parts = zip(*rows) if rows else ((), (), (), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(cls, pa.int64()), pa.array(n, pa.int32()), pa.array(list(sketch), pa.list_(pa.int8())), pa.array(list(prefix), pa.list_(pa.int64())), pa.array(list(parts), pa.list_(pa.int32()))],
                    ["example_id", "cls", "n", "sketch", "prefix", "parts"],
                )

    return records.select("example_id", "text").mapInArrow(make, "example_id bigint, cls bigint, n int, sketch array<tinyint>, prefix array<bigint>, parts array<int>")


def candidates(classes: DataFrame, t: float) -> DataFrame:
    """(big, small): pairs of records of ``classes`` that share a posted member and fit by size and position, with repeats.

    The records are named by their ids, one of each class. ``big`` has the larger set, or as large a one and the larger id.
    """
    posted = classes.select(F.col("example_id").alias("x"), "n", F.posexplode("prefix").alias("at", "token"), "parts").withColumn("parts", F.coalesce(F.get("parts", F.col("at")), F.lit(0)))
    side = lambda df, name: df.select(*[c for c in ("token", "range", "salt") if c in df.columns], *[F.col(c).alias(f"{c}_{name}") for c in ("x", "n", "at")])
    fits = (
        ((F.col("n_big") > F.col("n_small")) | ((F.col("n_big") == F.col("n_small")) & (F.col("x_big") > F.col("x_small"))))
        & (F.col("n_small") >= t * F.col("n_big") - 1e-9)
        & ((F.col("at_small") <= F.col("n_small") - F.ceil(2 * t / (1 + t) * F.col("n_small") - 1e-9)) | (F.col("n_big") < 0))  # on both sides, or it would be pushed below one and they'd no longer share a shuffle
        & (F.least(F.col("n_big") - F.col("at_big"), F.col("n_small") - F.col("at_small")) >= t / (1 + t) * (F.col("n_big") + F.col("n_small")) - 1e-9)
    )
    rows = classes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    cold = posted.filter("parts = 0").drop("parts").repartition(rows // POSTED_PER_TASK + 1, "token")
    pairs = side(cold, "big").join(side(cold, "small"), "token").filter(fits)
    warm = posted.filter("parts > 0")
    span = F.floor(F.log(F.col("n").cast("double")) / -np.log(t)).cast("int")  # sizes in a range differ by a factor of T at most
    big = warm.withColumn("range", F.explode(F.array(span, span - 1))).withColumn("salt", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int"))
    small = warm.withColumn("range", span).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    hot = side(big, "big").join(side(small, "small"), ["token", "range", "salt"]).filter(fits)
    return pairs.select("x_big", "x_small").unionByName(hot.select("x_big", "x_small")).toDF("big", "small")


def _agreements(a: str, b: str, upto: int) -> Column:
    return F.size(F.filter(F.zip_with(F.slice(a, 1, upto), F.slice(b, 1, upto), lambda x, y: x == y), lambda same: same))


def class_links(records: DataFrame, t: float, tolerance: float = TOLERANCE, hot: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(members, links): (cls, example_id) of every record with a shingle, and (cls_a, cls_b, similarity) with cls_a < cls_b.

    ``links`` has one row per pair of different sets with a similarity of at least ``t``; copies (equal sets) are in one
    class of ``members``. Null texts and texts of fewer than three words are in neither. Rows repeated with the same
    example_id count once.
    """
    texts = records.select("example_id", "text").filter("example_id is not null and text is not null")
    docs = cut(describe(texts, doc_frequency(texts.select("text"), K), t, hot))
    firsts = cut(docs.groupBy("cls").agg(F.min("example_id").alias("example_id"))).select("example_id")
    many = firsts.count()
    classes = sized_join(docs, firsts, ["example_id"], "left_semi", many)  # a record delivered twice stays twice
    if many > BROADCAST_ROWS:
        classes = cut(classes)
    stays = F.lit(True)
    for n, m in sorted(least_agreements(t, tolerance).items(), reverse=True):
        stays = F.when(_agreements("_a", "_b", n) < m, False).otherwise(stays)
    sketches = classes.select("example_id", "cls", "sketch")
    one = sketches.select(F.col("example_id").alias("big"), F.col("cls").alias("cls_big"), F.col("sketch").alias("_a"))
    two = sketches.select(F.col("example_id").alias("small"), F.col("cls").alias("cls_small"), F.col("sketch").alias("_b"))
    pairs = cut(
        candidates(classes, t).distinct().join(one, "big").join(two, "small").filter(stays)
        .select(F.least("cls_big", "cls_small").alias("cls_a"), F.greatest("cls_big", "cls_small").alias("cls_b")).filter("cls_a <> cls_b").distinct()
    )
    ends = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    reps = cut(ends.join(classes.select("cls", "example_id").distinct(), "cls"))
    sets = class_sets(texts, reps, K)
    links = (
        overlap(pairs, sets, "cls_a", "cls_b")
        .withColumn("similarity", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")))
        .filter(F.col("similarity") >= t)
        .select("cls_a", "cls_b", "similarity")
    )
    return docs.select("cls", "example_id").distinct(), cut(links)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs (a < b) of records whose 3-sets have a similarity of at least T, links of classes expanded to their members."""
    t = threshold(spark, sf_dir)
    members, links = class_links(read(spark, sf_dir, "example"), t)
    return expanded(cut(members), links)


def expanded(members: DataFrame, links: DataFrame) -> DataFrame:
    """(example_id_a, example_id_b), a < b: pairs of records of linked classes, and of one class. Large classes are salted."""
    hot = cut(hot_keys(members, "cls"))
    one = members.select(F.col("cls").alias("cls_a"), F.col("example_id").alias("x"))
    two = members.select(F.col("cls").alias("cls_b"), F.col("example_id").alias("y"))
    across = salted_join(links.select("cls_a", "cls_b"), one, "cls_a", hot.withColumnRenamed("cls", "cls_a"))
    across = salted_join(across, two, "cls_b", hot.withColumnRenamed("cls", "cls_b")).select("x", "y")
    copies = members.groupBy("cls").agg(F.count("*").alias("n")).filter("n > 1").select("cls")
    many = members.join(copies, "cls")
    within = salted_join(many.select("cls", F.col("example_id").alias("x")), many.select("cls", F.col("example_id").alias("y")), "cls", hot).filter("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("example_id_a"), F.greatest("x", "y").alias("example_id_b"))


def components(links: DataFrame, a: str, b: str, rounds: int = 100, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, root) of every node in ``links``: the least node of its connected component.

    Alternates large-star and small-star steps until nothing changes; every round is checkpointed. A step finds the least
    neighbour of each node by partial aggregation and joins it back to the edges, those of a hub spread over salts. The
    steps converge in a number of rounds that grows with the logarithm of the nodes; after ``rounds`` it is an error.
    """

    def with_least(edges: DataFrame) -> DataFrame:
        least = cut(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_n")))
        hubs = least.filter(F.col("_n") > hot_rows).select("u", F.ceil(F.col("_n") / hot_rows).cast("int").alias("parts"))
        return salted_join(least.select("u", "m"), edges, "u", hubs)

    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = cut(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        after = cut(with_least(down).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        if after.join(edges, ["u", "v"], "left_anti").isEmpty() and edges.join(after, ["u", "v"], "left_anti").isEmpty():
            break
        edges = after
    else:
        raise RuntimeError(f"components did not converge in {rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).join(roots.select("node"), "node", "left_anti").distinct())


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, group_id, links, copies) of every record in a group: least example_id of its group, linked classes, copies."""
    t = threshold(spark, sf_dir)
    members, links = class_links(read(spark, sf_dir, "example"), t)
    sizes = members.groupBy("cls").agg(F.count("*").alias("copies"), F.min("example_id").alias("first_id"))
    degree = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    roots = components(links, "cls_a", "cls_b").withColumnRenamed("node", "cls")
    known = sizes.join(roots, "cls", "left").join(degree, "cls", "left").filter("root is not null or copies > 1").withColumn("root", F.coalesce("root", "cls"))
    group = known.groupBy("root").agg(F.min("first_id").alias("group_id"))
    named = known.join(group, "root").select("cls", "group_id", F.coalesce("links", F.lit(0)).alias("links"), "copies")
    return members.join(named, "cls").select("example_id", "group_id", "links", "copies")
