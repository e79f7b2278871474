"""Chunking of long texts at paragraph and sentence boundaries, as one native fold over a text's parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

JOIN = "\n\n"


def chunks(t: Column, most: int = 8000, least: int = 500) -> Column:
    """Array of chunks of a text.

    A text of up to ``most`` characters is one chunk if it has ``least``. A longer one is split at blank lines; parts are
    collected while they fit, and a part longer than ``most`` is split after sentences. Chunks under ``least`` are dropped;
    one long sentence may exceed ``most``. Null for a null text.
    """
    parts = F.filter(F.transform(F.split(t, JOIN), T.strip), lambda p: p != "")

    def atom(in_long: Column, first: Column, x: Column) -> Column:
        return F.struct(in_long.alias("s"), first.alias("first"), x.alias("x"))

    atoms = F.flatten(
        F.transform(
            parts,
            lambda p: F.when(F.length(p) > most, F.transform(F.split(p, rf"(?<=[.!?]){T.WS}+"), lambda x, i: atom(F.lit(True), i == 0, x))).otherwise(F.array(atom(F.lit(False), F.lit(False), p))),
        )
    )
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), none.alias("cur"), F.lit(0).alias("n"))

    def put(out: Column, cur: Column, joiner: Column) -> Column:
        whole = F.array_join(cur, "\n\n") if isinstance(joiner, str) else F.when(joiner, F.array_join(cur, " ")).otherwise(F.array_join(cur, JOIN))
        return F.when(F.length(whole) >= least, F.concat(out, F.array(whole))).otherwise(out)

    def step(a: Column, x: Column) -> Column:
        size = F.length(x["x"]) + F.when(x["s"], 0).otherwise(len(JOIN))
        flush = (F.size(a["cur"]) > 0) & (x["first"] | (a["n"] + size > most))
        out = F.when(flush, put(a["out"], a["cur"], x["s"] & ~x["first"])).otherwise(a["out"])
        cur = F.when(flush, F.array(x["x"])).otherwise(F.concat(a["cur"], F.array(x["x"])))
        return F.struct(out.alias("out"), cur.alias("cur"), F.when(flush, size).otherwise(a["n"] + size).alias("n"))

    def finish(a: Column) -> Column:
        return F.when(F.size(a["cur"]) > 0, put(a["out"], a["cur"], JOIN)).otherwise(a["out"])

    short = F.when(F.length(t) >= least, F.array(t)).otherwise(none)
    return F.when(F.length(t) <= most, short).otherwise(F.aggregate(atoms, start, step, finish))


def explode_chunks(df: DataFrame, text: str = "text", most: int = 8000, least: int = 500) -> DataFrame:
    """One row per chunk: the other columns, ``chunk_idx`` from 0 and ``chunk``."""
    return df.select(*[c for c in df.columns if c != text], F.posexplode(chunks(F.col(text), most, least)).alias("chunk_idx", "chunk"))
