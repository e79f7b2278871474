"""First-wins duplicate removal by normalised prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def keep_first(df: DataFrame, text: str, order: str, chars: int = 200) -> DataFrame:
    """Of the rows whose texts share their first ``chars`` normalised characters, the one first by ``order``.

    A minimum per key with partial aggregation: a hot key sends one row per task, not all of its rows. Texts that agree in
    500 characters agree in 200, so the shorter prefix decides. Rows with a null text are dropped; ``order`` must be unique.
    """
    rows = df.filter(F.col(text).isNotNull())
    first = rows.select(F.col(order), F.md5(T.dedup_key(F.col(text), chars)).alias("_k")).groupBy("_k").agg(F.min(order).alias("_first"))
    return rows.join(first.select(F.col("_first").alias(order)), order, "left_semi")


def not_seen(df: DataFrame, seen: DataFrame, text: str, chars: int = 200) -> DataFrame:
    """Rows whose key is not in ``seen`` (column ``key``): removal against earlier runs."""
    return df.withColumn("key", T.dedup_key(F.col(text), chars)).join(seen.select("key").distinct(), "key", "left_anti").drop("key")
