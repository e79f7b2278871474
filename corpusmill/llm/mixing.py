"""Problem 8: mixing sources to target weights, by hash-random keys and distributed prefix sums.

Each usable document gets a hash-random key. Keys are uniform, so ranges of their high bits are even buckets of every
source, however large it is. Token sums by (source, bucket) and their running sums give each bucket's offset; within a
bucket a window adds the rest. Whole epochs of a source and a prefix of one more make up its exact budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import cut
from .common import arrow_map, read, sized_join
from .packing import profile
from .tokens import TOKENIZER, Tokenizer

SOURCES = ("c4", "wiki", "gutenberg")
BUCKET_BITS = (12, 24)
"""log2 of the least and the greatest number of buckets of a source; between them it follows the number of documents."""
ROWS_PER_BUCKET = 4096


def token_sizes(documents: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(doc_id, source, n_tokens) of the usable documents: with a known source and at least one token."""

    def measure(c: dict[str, list]) -> dict[str, list]:
        return {"doc_id": c["doc_id"], "source": c["source"], "n_tokens": [tokenizer.count(t) for t in c["text"]]}

    usable = documents.select("doc_id", "source", "text").filter(F.col("source").isin(*SOURCES) & F.col("text").isNotNull())
    return arrow_map(usable, measure, "doc_id bigint, source string, n_tokens bigint").filter("n_tokens > 0")


def keyed(sizes: DataFrame, seed: int) -> DataFrame:
    """``sizes`` with ``before``: tokens of the same source whose documents come earlier in hash-random order."""
    bits = min(max((sizes.count() // ROWS_PER_BUCKET).bit_length(), BUCKET_BITS[0]), BUCKET_BITS[1])
    order = F.xxhash64(F.lit(seed), "doc_id")
    rows = sizes.withColumn("_key", order).withColumn("_bucket", F.shiftrightunsigned("_key", 64 - bits).cast("int")).withColumn("_key", F.shiftleft("_key", bits))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("_sum"))
    offsets = sums.select("source", "_bucket", (F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_sum")).alias("_offset"))
    inner = Window.partitionBy("source", "_bucket").orderBy(F.shiftrightunsigned("_key", 1), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.withColumn("_within", F.sum("n_tokens").over(inner) - F.col("n_tokens"))
    return sized_join(within, offsets, ["source", "_bucket"], "inner", 3 << bits).select("doc_id", "source", "n_tokens", (F.col("_offset") + F.col("_within")).alias("before"))


def budgets(sizes: DataFrame, meta: dict) -> dict[str, dict]:
    """Per source: tokens there are, target share and tokens, whole epochs and the rest to be cut from one more.

    Weights are normalised. A source without weight or documents has a budget of 0. The size of the mix is
    ``size_factor`` times the tokens of all usable documents. Where ``max_repeats`` epochs don't reach the budget, all of
    them are used and the actual share is smaller; other sources don't make up for it.
    """
    there = {r["source"]: int(r["t"]) for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # three rows
    weights = {s: max(0.0, float(meta[f"{s}_weight"] or 0.0)) for s in SOURCES}
    total, norm = int(float(meta["size_factor"]) * sum(there.values())), sum(weights.values())
    out = {}
    for s in SOURCES:
        have, share = there.get(s, 0), weights[s] / norm if norm else 0.0
        budget = int(round(share * total))
        epochs, rest = divmod(budget, have) if have else (0, 0)
        if epochs >= meta["max_repeats"]:
            epochs, rest = int(meta["max_repeats"]), 0
        out[s] = {"have": have, "share": share, "budget": budget, "epochs": epochs, "rest": rest}
    return out


def mix(sizes: DataFrame, meta: dict) -> tuple[DataFrame, dict[str, dict]]:
    """(doc_id, source, n_tokens, uses) of every usable document, and the budgets.

    A document is in a source's last, partial epoch if at least half of it lies before the cut; so a source misses its
    budget by at most half of one document.
    """
    plan = budgets(sizes, meta)

    def of(name: str):
        chain = F.lit(0)
        for s, p in plan.items():
            chain = F.when(F.col("source") == s, F.lit(p[name])).otherwise(chain)
        return chain.cast("bigint")

    partial = (F.col("before") * 2 + F.col("n_tokens") <= of("rest") * 2).cast("int")
    uses = keyed(sizes, int(meta["seed"] or 0)).withColumn("uses", (of("epochs") + partial).cast("int"))
    return uses.select("doc_id", "source", "n_tokens", "uses"), plan


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uses of every usable document under profile ``three_way``."""
    sizes = cut(token_sizes(read(spark, sf_dir, "documents"), Tokenizer(spark, TOKENIZER)))
    return mix(sizes, profile(spark, sf_dir, "three_way"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per profile and source: target and actual share and tokens of the mix, documents used and most uses of one."""
    sizes = cut(token_sizes(read(spark, sf_dir, "documents"), Tokenizer(spark, TOKENIZER)))
    names = [r[0] for r in read(spark, sf_dir, "data_meta").select("meta_name").distinct().orderBy("meta_name").collect()]  # a fixed, small table
    out = None
    for name in names:
        uses, plan = mix(sizes, profile(spark, sf_dir, name))
        tokens = F.sum(F.col("n_tokens") * F.col("uses"))
        one = uses.groupBy("source").agg(tokens.alias("tokens"), F.count_if(F.col("uses") > 0).alias("documents"), F.max("uses").alias("most_uses"))
        target = F.create_map(*[x for s, p in plan.items() for x in (F.lit(s), F.struct(F.lit(p["share"]).alias("share"), F.lit(p["budget"]).cast("bigint").alias("budget")))])
        one = one.withColumn("_t", target[F.col("source")]).select(
            F.lit(name).alias("profile"), "source", F.round("_t.share", 6).alias("target_share"), F.col("_t.budget").alias("target_tokens"), "tokens",
            F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(name))), 6).alias("actual_share"), "documents", "most_uses",
        )
        out = one if out is None else out.unionByName(one)
    return out


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per profile and source, what must hold: usable documents, and how many are used too often or unevenly, and budgets missed (none)."""
    sizes = cut(token_sizes(read(spark, sf_dir, "documents"), Tokenizer(spark, TOKENIZER)))
    names = [r[0] for r in read(spark, sf_dir, "data_meta").select("meta_name").distinct().orderBy("meta_name").collect()]  # a fixed, small table
    out = None
    for name in names:
        meta = profile(spark, sf_dir, name)
        uses, plan = mix(sizes, meta)
        per = uses.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("uses") > meta["max_repeats"]).alias("over_cap"), (F.max("uses") - F.min("uses") > 1).cast("bigint").alias("uneven"), F.sum(F.col("n_tokens") * F.col("uses")).alias("_got"), F.max("n_tokens").alias("_most"))
        want = F.create_map(*[x for s, p in plan.items() for x in (F.lit(s), F.lit(min(p["budget"], int(meta["max_repeats"]) * p["have"])))])
        one = per.select(F.lit(name).alias("profile"), "source", "documents", "over_cap", "uneven", (F.abs(F.col("_got") - want[F.col("source")]) * 2 > F.col("_most")).cast("bigint").alias("off_budget"))
        out = one if out is None else out.unionByName(one)
    return out
