"""Counts and reports over verdicts, tokens and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_stats(verdicts: DataFrame) -> DataFrame:
    """(source, total, passed, rejected, pass_rate) of rows (source, reason); a rate of nothing is 0."""
    out = verdicts.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("reason") == "").alias("passed"))
    return out.withColumn("rejected", F.col("total") - F.col("passed")).withColumn("pass_rate", F.round(F.coalesce(F.try_divide("passed", "total"), F.lit(0.0)), 6))


def filter_report(verdicts: DataFrame) -> DataFrame:
    """(source, reason, n, percent, place) of the rejected rows; percent of all rows of the source, place by number of rows, ties by reason."""
    counted = verdicts.groupBy("source", "reason").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("source"))
    order = Window.partitionBy("source").orderBy(F.desc("n"), "reason")  # a row for each rule
    return counted.withColumn("percent", F.round(100.0 * F.col("n") / total, 4)).filter("reason <> ''").withColumn("place", F.row_number().over(order))


def char_histogram(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ch, n) for each character of each text."""
    return df.select(key, F.explode(F.split(text, "")).alias("ch")).filter("ch <> ''").groupBy(key, "ch").agg(F.count("*").alias("n"))


def token_histogram(tokens: DataFrame, vocab_size: int | None = None) -> DataFrame:
    """(token, n), of the ids below ``vocab_size`` if it is given."""
    rows = tokens if vocab_size is None else tokens.filter(F.col("token").between(0, vocab_size - 1))
    return rows.groupBy("token").agg(F.count("*").alias("n"))


def token_range(tokens: DataFrame, vocab_size: int) -> DataFrame:
    """One row: least and largest id (0 for no tokens), tokens, those out of range, their share, and whether counts add up."""
    ok = F.col("token").between(0, vocab_size - 1)
    out = tokens.agg(
        F.coalesce(F.min("token"), F.lit(0)).alias("min_id"), F.coalesce(F.max("token"), F.lit(0)).alias("max_id"), F.count("*").alias("total"),
        F.count_if(~ok).alias("out_of_range"), F.count_if(ok).alias("in_range"),
    )
    return out.withColumn("out_share", F.round(F.col("out_of_range") / F.greatest("total", F.lit(1)), 8)).withColumn("consistent", F.col("in_range") + F.col("out_of_range") == F.col("total"))


def special_shares(tokens: DataFrame, ids: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """(token, n, share) of each of ``ids``, also of those that don't occur."""
    total = tokens.agg(F.count("*").alias("total"), *[F.count_if(F.col("token") == i).alias(f"c{i}") for i in ids])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("token"), F.col(f"c{i}").alias("n")) for i in ids])).alias("r")
    return total.select("total", rows).select("r.token", "r.n", F.round(F.col("r.n") / F.greatest("total", F.lit(1)), 8).alias("share"))


def top_tokens(tokens: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent tokens; ties by smaller id."""
    return token_histogram(tokens).orderBy(F.desc("n"), "token").limit(k)


def perplexity(losses: DataFrame, group: str, loss: str, cap: float = 20.0) -> DataFrame:
    """(group, loss, perplexity): mean loss and its exponential, capped."""
    out = losses.groupBy(group).agg(F.avg(loss).alias("_m"))
    return out.select(group, F.round("_m", 6).alias("loss"), F.round(F.exp(F.least(F.col("_m"), F.lit(cap))), 6).alias("perplexity"))


def steps_within_budget(target_tokens: Column, tokens_per_second: Column, price_per_hour: Column, max_cost: Column, tokens_per_step: Column) -> tuple[Column, Column, Column]:
    """(cost, whether it is within the maximum, steps): null where an input is missing or not positive."""
    good = F.lit(True)
    for c in (target_tokens, tokens_per_second, price_per_hour, max_cost, tokens_per_step):
        good = good & c.isNotNull() & (c > 0)
    cost = F.when(good, target_tokens / tokens_per_second / 3600.0 * price_per_hour)
    fits = F.when(good, cost <= max_cost)
    return cost, fits, F.when(fits, F.ceil(target_tokens / tokens_per_step))


def best(df: DataFrame, group: str, by: str, tie: str, k: int) -> DataFrame:
    """The ``k`` rows of each group with the least ``by``; ties by ``tie``."""
    w = Window.partitionBy(group).orderBy(F.asc_nulls_last(by), tie)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def to_delete(files: DataFrame, protected: DataFrame, limit: int) -> DataFrame:
    """Names of the oldest unprotected files (name, size) to delete until the total is at most ``limit``; none if it is not positive.

    Protected files count but stay, so the total may remain above. The list is one of checkpoints of a run, a few hundred
    names, so one ordered window is enough.
    """
    if limit <= 0:
        return files.select("name").filter("false")
    total = files.agg(F.sum("size").alias("total"))
    loose = files.join(protected.select("name"), "name", "left_anti")
    before = F.coalesce(F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return loose.withColumn("_b", before).join(F.broadcast(total)).filter(F.col("total") - F.col("_b") > limit).select("name")
