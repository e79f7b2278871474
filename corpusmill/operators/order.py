"""Global order without a single-partition sort: two-level prefix sums, budgets, shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durable import cut


def running(df: DataFrame, keys: list[str], values: dict[str, Column | str], within: list[str] | None = None) -> DataFrame:
    """``df`` with, for each entry of ``values``, the sum of its expression over all rows before, in the order of ``keys``.

    ``keys`` must be unique per ``within`` group; sums restart for each group. Only keys, summands and columns of a fixed
    width are ordered; texts, arrays and the like are joined back, so ``df`` is then read twice: store it first if it is
    dear to make.
    """
    on = [*(within or []), *keys]
    wide = [f.name for f in df.schema if f.name not in on and isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    placed = places(df, keys, values, within or [], [c for c in df.columns if c not in on and c not in wide])
    if not wide:
        return placed.select(*df.columns, *values)
    return joined_back(df.select(*on, *wide), placed, on).select(*df.columns, *values)


def joined_back(df: DataFrame, placed: DataFrame, on: list[str]) -> DataFrame:
    """``df`` with the other columns of ``placed``, joined on equal (or both null) ``on``."""
    named = placed.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in placed.columns if c not in on])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return df.join(named, cond).drop(*[f"_on_{c}" for c in on])


def places(df: DataFrame, keys: list[str], values: dict[str, Column | str], within: list[str], carried: list[str] | None = None) -> DataFrame:
    """(within, keys, carried, sums before) of the rows of ``df``.

    Rows are range-partitioned by ``within + keys`` and stored once, so that the ranges stay fixed; totals per range (one
    row each, and per ``within`` group) give the offsets, and a window inside each range the rest.
    """
    named = {f"_v{i}": F.expr(v) if isinstance(v, str) else v for i, v in enumerate(values.values())}
    held = [*within, *keys, *(carried or [])]
    slim = df.select(*held, *[v.alias(n) for n, v in named.items()])
    parts = cut(slim.repartitionByRange(*within, *keys).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy("_part", *within).agg(*[F.sum(v).alias(f"_t{v}") for v in named])
    earlier = Window.partitionBy(*within).orderBy("_part") if within else Window.partitionBy(F.lit(0)).orderBy("_part")
    offsets = totals.select("_part", *within, *[(F.sum(f"_t{v}").over(earlier) - F.col(f"_t{v}")).alias(f"_o{v}") for v in named])
    inner = Window.partitionBy("_part", *within).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumns({f"_w{v}": F.coalesce(F.sum(v).over(inner), F.lit(0)) for v in named})
    cond = out["_part"] == offsets["_part"]
    for w in within:
        cond = cond & out[w].eqNullSafe(offsets[w])
    joined = out.join(F.broadcast(offsets), cond)  # one row per range: bounded by the number of partitions
    return joined.select(*[out[c] for c in held], *[(F.col(f"_o{v}") + F.col(f"_w{v}")).alias(name) for v, name in zip(named, values)])


def uniform(seed: int, *parts: str) -> Column:
    """A number in (0, 1) from the md5 of a seed and columns; the same in every engine."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))
    return (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def uniform_sql(seed: int, *parts: str) -> str:
    """The same in SQL."""
    return f"((('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'{p}::varchar' for p in parts)})), 1, 12))::bigint::double + 0.5) / {float(1 << 48)})"


def within_budget(df: DataFrame, key: str, size: Column | str, budget: int) -> DataFrame:
    """The rows before which, in the order of ``key``, less than ``budget`` was taken; the row that crosses it is kept.

    Keys and sizes are summed and cut; only the keys that are left are joined with the rows.
    """
    taken = places(df, [key], {"taken_before": size}, []).filter(F.col("taken_before") < budget)
    return joined_back(df, taken, [key])


def interleave(df: DataFrame, weights: dict[str, float], seed: int, key: str = "pos") -> DataFrame:
    """``df`` with ``draw``: the order of a weighted random merge of its sources, each kept in the order of ``key``.

    An exponential race: within a source the draws are sums of exponential steps of rate ``weight``. Merging them has the
    distribution of drawing sources by weight, renormalised when one runs out. Sources without a positive weight are
    never drawn.
    """
    used = {s: w for s, w in weights.items() if w > 0}
    rate = F.create_map(*[x for s, w in used.items() for x in (F.lit(s), F.lit(float(w)))])
    rows = df.filter(F.col("source").isin(*used)).withColumn("_step", -F.log(uniform(seed, "source", key)) / rate[F.col("source")])
    return running(rows, [key], {"_before": "_step"}, ["source"]).withColumn("draw", F.col("_before") + F.col("_step")).drop("_before", "_step")


def shuffle_key(seed: int, key: str = "doc_id") -> Column:
    """Sort key of a full pseudo-random shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def displaced_key(seed: int, size: int, key: str = "pos") -> Column:
    """Sort key of a shuffle that moves a row back by less than ``size`` places, as a buffer of that size does."""
    return F.col(key) + uniform(seed, key) * size
