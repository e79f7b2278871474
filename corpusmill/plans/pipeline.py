"""Whole pipelines as one declarative plan: verdict, clean-up, chunks, duplicates, order, tokens, budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import cut
from ..operators import clean, filters
from ..operators.chunk import explode_chunks
from ..operators.dedup import keep_first
from ..operators.order import interleave, joined_back, places

WEIGHTS = {"c4": 0.4, "wiki": 0.6, "gutenberg": 0.0}
BOOK_RULES = {False: [], True: ["GUT2_poetry_heavy"]}


def cleaned(source: Column, t: Column) -> Column:
    """The text after the clean-up of its source's profile."""
    wiki = clean.strip_wiki_markup(clean.strip_wiki_sections(t))
    book = clean.merge_wrapped(clean.strip_toc(clean.strip_book_marks(t)))
    return F.when(t.isNull(), F.lit(None).cast("string")).when(source == "wiki", wiki).when(source == "gutenberg", book).when(source == "c4", t)


def verdicts(documents: DataFrame, limits: filters.Limits = filters.BASE) -> DataFrame:
    """``documents`` of known sources with ``clean`` and ``reason``, the first rule broken ('' if none)."""
    known = documents.filter(F.col("source").isin("c4", "wiki", "gutenberg"))
    c = F.col("clean")
    rules = {
        "c4": filters.WEB + filters.GLOBAL,
        "wiki": filters.WIKI + filters.GLOBAL,
        "gutenberg": BOOK_RULES[limits.gutenberg_filter_poetry] + filters.GLOBAL,
    }
    out = F.when(F.col("source") == "c4", filters.reason(c, rules["c4"], limits)).when(F.col("source") == "wiki", filters.reason(c, rules["wiki"], limits)).otherwise(filters.reason(c, rules["gutenberg"], limits))
    return known.withColumn("clean", cleaned(F.col("source"), F.col("text"))).withColumn("reason", out)


def outcomes(documents: DataFrame, limits: filters.Limits = filters.BASE) -> DataFrame:
    """(source, outcome, n): ``pass``, ``empty`` (passed, but no chunk is long enough) or the rule broken."""
    v = verdicts(documents, limits)
    from ..operators.chunk import chunks

    empty = F.size(chunks(F.col("clean"), limits.max_chunk_chars, limits.min_chunk_chars)) == 0
    outcome = F.when(F.col("reason") != "", F.col("reason")).when(empty, "empty").otherwise("pass")
    return v.select("source", outcome.alias("outcome")).groupBy("source", "outcome").agg(F.count("*").alias("n"))


def corpus(documents: DataFrame, limits: filters.Limits = filters.BASE, weights: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """(doc_id, source, chunk_idx, chunk, draw): chunks of the passing documents, first-wins deduplicated, in mixed order.

    Sources are merged before filtering, so a rejected document uses up its draw.
    """
    judged = verdicts(documents, limits).select("doc_id", "source", F.when(F.col("reason") == "", F.col("clean")).alias("text"))
    passing = cut(judged).filter("text is not null")  # stored first: a filter pushed below would clean each text anew for every rule
    drawn = interleave(documents.select("doc_id", "pos", "source"), weights or WEIGHTS, seed).select("doc_id", "draw")
    ordered = passing.join(drawn, "doc_id")
    pieces = explode_chunks(ordered, "text", limits.max_chunk_chars, limits.min_chunk_chars).withColumn("_at", F.struct("draw", "doc_id", "chunk_idx"))
    return keep_first(pieces, "chunk", "_at").select("doc_id", "source", "chunk_idx", "chunk", "draw")


def packed_corpus(pieces: DataFrame, target: int | None, encode) -> DataFrame:
    """Chunks encoded and packed in mixed order until ``target`` tokens, or all if it is None; the chunk that crosses it is kept."""
    coded = cut(encode(pieces.select("doc_id", "chunk_idx", "draw", "chunk")))  # ordered by its keys and sizes, then read again
    packed = coded.withColumn("packed", F.concat("ids", F.array(F.lit(2))))
    keys = ["draw", "doc_id", "chunk_idx"]
    placed = places(packed, keys, {"start": F.size("packed").cast("bigint")}, [])
    kept = placed if target is None else placed.filter(F.col("start") < target)
    return joined_back(packed, kept, keys)


def split_of(text: Column, val_share: float = 0.01) -> Column:
    """``val`` or ``train`` by a hash of the normalised prefix, so that copies are never in both."""
    from ..functions.text import dedup_key

    h = F.conv(F.substring(F.md5(dedup_key(text)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return F.when(h < val_share, "val").otherwise("train")


def overlap_report(a: DataFrame, b: DataFrame, text: str = "text") -> DataFrame:
    """One row: distinct keys of two splits and how many they share."""
    from ..functions.text import dedup_key

    ka, kb = (d.filter(F.col(text).isNotNull()).select(dedup_key(F.col(text)).alias("key")).distinct() for d in (a, b))
    both = ka.withColumn("in_a", F.lit(1)).join(kb.withColumn("in_b", F.lit(1)), "key", "full")
    return both.agg(F.count("in_a").alias("keys_a"), F.count("in_b").alias("keys_b"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("shared"))
