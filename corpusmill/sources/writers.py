"""Sinks: tokens, metadata, tokenizer text, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.order import within_budget


def one_line(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``line``: line breaks as spaces, stripped; rows without one are dropped."""
    return df.withColumn("line", T.strip(F.replace(F.col(text), F.lit("\n"), F.lit(" ")))).filter("line <> ''")


def tokenizer_text(df: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, line) in the order of ``key`` until ``budget`` characters are taken; the line that crosses it is kept."""
    return within_budget(one_line(df).select(key, "line"), key, F.length("line").cast("bigint"), budget)


def write_lines(df: DataFrame, key: str, path: str) -> None:
    """Write ``line`` as text, ordered by ``key`` over files and within them."""
    df.select(key, F.col("line").alias("value")).repartitionByRange(key).sortWithinPartitions(key).select("value").write.mode("overwrite").text(path)


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Write (pos, token) as Parquet, ordered by position."""
    tokens.repartitionByRange("pos").sortWithinPartitions("pos").write.mode("overwrite").parquet(path)


def metadata(sizes: DataFrame, stats: DataFrame, settings: dict) -> DataFrame:
    """One row: tokens of both splits from (split, n_tokens), 0 for none, the settings, counts by source and reason, the time."""
    counts = stats.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("_", "source", F.when(F.col("reason") == "", "passed").otherwise(F.col("reason"))), "n"))).alias("train_stats"))
    of = lambda split: F.coalesce(F.sum(F.when(F.col("split") == split, F.col("n_tokens"))), F.lit(0)).alias(f"{split}_tokens")
    known = [F.lit(v).alias(k) for k, v in settings.items()]
    return counts.join(sizes.agg(of("train"), of("val"))).select("train_tokens", "val_tokens", *known, "train_stats", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))


def write_samples(df: DataFrame, path: str, form: str) -> None:
    """Write samples as ``text``, ``json`` (one array a file) or ``jsonl``."""
    if form == "jsonl":
        df.write.mode("overwrite").json(path)
    elif form == "json":
        df.select(F.to_json(F.struct("*")).alias("j")).groupBy(F.spark_partition_id()).agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value")).select("value").write.mode("overwrite").text(path)
    elif form == "text":
        df.select("text").write.mode("overwrite").text(path, lineSep="\n\n")
    else:
        raise ValueError(f"no format {form}")
