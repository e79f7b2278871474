"""What the operators of this subpackage share: reading tables, Arrow row functions, joins by checked size."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..durable import cut

WORD = re.compile(r"[^\W_]+")
"""A word: a maximal run of letters or digits; apply it to lower-cased text."""

BROADCAST_ROWS = int(os.environ.get("CORPUSMILL_BROADCAST_ROWS", 500_000))
"""A side of up to this many rows of ids (about 32 MB in an executor's hash table) may be broadcast; a larger one is shuffled."""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table ``table`` of the folder ``sf_dir``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def arrow_map(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch as columns of Python values; it returns the columns of ``schema``."""
    parsed = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, parsed)


SLICE_ROWS = 1000
"""Rows handed to a row function at once; bounds a Python worker's memory whatever the Arrow batch size."""


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str, rows: int | None = None) -> DataFrame:
    """Join ``big`` with ``small``, broadcasting ``small`` only if a count shows at most ``BROADCAST_ROWS`` rows.

    Beyond that both sides are shuffled on the key. ``rows`` is the count if the caller knows it.
    """
    n = small.count() if rows is None else rows
    return big.join(F.broadcast(small) if n <= BROADCAST_ROWS else small.hint("merge"), on, how)


HOT_ROWS = 2_000
"""Rows of one key beyond which the key is split by a salt, on the side that has them."""


def hot_keys(df: DataFrame, key: str, rows: int = HOT_ROWS) -> DataFrame:
    """(key, parts) of the keys with more than ``rows`` rows in ``df``: at most one for so many of its rows."""
    return df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows).select(key, F.ceil(F.col("_n") / rows).cast("int").alias("parts"))


def salted_join(a: DataFrame, b: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """``a.join(b, key)``, with the rows of a key that has more than ``HOT_ROWS`` of them in ``b`` spread over salts.

    The rows of ``b`` take one salt each, by a hash of their columns, those of ``a`` every salt of their key; other keys have
    one salt. The keys to split are counted with partial aggregates, unless the caller has them as ``hot`` (key, parts), and
    their list is joined by its checked size.
    """
    hot = cut(hot_keys(b, key) if hot is None else hot)
    n = hot.count()
    if n == 0:
        return a.join(b, key)
    parts = F.coalesce("parts", F.lit(1))
    left = sized_join(a, hot, [key], "left", n).withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    right = sized_join(b, hot, [key], "left", n).withColumn("_salt", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*b.columns), F.col("parts"))).cast("int")).drop("parts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def valid_config(spark: SparkSession, sf_dir: str, name: str = "base") -> DataFrame:
    """The row of ``filter_config`` with the largest ``updated_at`` of the versions of ``name``."""
    return (
        read(spark, sf_dir, "filter_config")
        .filter((F.col("config_name") == name) & F.col("updated_at").isNotNull())
        .orderBy(F.desc("updated_at"), F.desc("config_id"))
        .limit(1)
    )


def threshold(spark: SparkSession, sf_dir: str, default: float = 0.8) -> float:
    """T of the data: ``dedup_threshold`` of the valid ``base`` version, or ``default`` where there is none."""
    row = valid_config(spark, sf_dir).select("dedup_threshold").first()
    return default if row is None or row[0] is None or row[0] != row[0] else float(row[0])
