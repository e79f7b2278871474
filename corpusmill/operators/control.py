"""The control side of runs: settings by dotted path, commands, prompts, slots, saved states.

Commands and states of many runs are tables; a single run's settings and manifest are small dictionaries on the driver.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = ("phase", "tokens_written", "docs_processed", "c4_docs", "wiki_docs", "gutenberg_docs", "dedup_rejects", "elapsed_seconds", "timestamp")
DEFAULT_PROMPT = "The quick brown fox"
SECTIONS = ("training", "checks")


def setting(config: dict, path: str, default: Any = None) -> Any:
    """The value at a dotted path; ``default`` where a step is missing or no dictionary."""
    at: Any = config
    for step in path.split("."):
        if not isinstance(at, dict) or step not in at:
            return default
        at = at[step]
    return at


def with_setting(config: dict, path: str, value: Any) -> dict:
    """A copy of ``config`` with ``value`` at a dotted path; missing steps are made, other values in their place replaced."""
    head, _, rest = path.partition(".")
    inner = config.get(head)
    return config | {head: with_setting(inner if isinstance(inner, dict) else {}, rest, value) if rest else value}


def updates(commands: DataFrame, keys: list[str], order: str, allowed: list[str] | None = None) -> DataFrame:
    """(keys, path, value): of the ``set`` commands of each run, the last value of each path by ``order``; null paths are dropped.

    With ``allowed``, only those paths. One maximum a key with partial aggregation, however many commands a run gets.
    """
    sets = commands.filter((F.col("cmd") == "set") & F.col("path").isNotNull())
    if allowed:
        sets = sets.filter(F.col("path").isin(allowed))
    return sets.groupBy(*keys, "path").agg(F.max_by("value", order).alias("value"))


def applied(config: dict, changed: list[tuple[str, Any]]) -> dict:
    """``config`` with the changes whose paths lie in the changeable sections; the three intervals are whole numbers from 1."""
    for path, value in changed:
        if path.split(".")[0] in SECTIONS and "." in path:
            config = with_setting(config, path, max(1, int(value)) if path in ("training.eval_interval", "training.save_interval", "training.log_interval") else float(value) if path == "training.learning_rate" else value)
    return config


def actions(commands: DataFrame, keys: list[str], slots: list[str], order: str) -> DataFrame:
    """(keys, prompts, pins, stop, save): what the other commands ask of a run, in order; a stop saves unless it says not to."""
    stop = F.col("cmd") == "stop_training"
    ordered = lambda which: F.transform(F.sort_array(F.collect_list(F.when(which[0], F.struct(F.col(order), which[1].alias("x"))))), lambda s: s["x"])
    slot = F.coalesce("slot", F.lit("good_1"))
    return commands.groupBy(*keys).agg(
        ordered((F.col("cmd") == "sample_prompt", F.col("prompt"))).alias("prompts"),
        ordered(((F.col("cmd") == "pin_checkpoint") & slot.isin(slots), slot)).alias("pins"),
        F.coalesce(F.bool_or(stop), F.lit(False)).alias("stop"),
        F.coalesce(F.max_by(F.coalesce("save", F.lit(True)), F.when(stop, F.col(order))), F.lit(False)).alias("save"),
    )


def prompts(fixed: dict, listed: Any = None) -> list[str]:
    """Prompts of a configuration: those of a file's content (a list, or a dictionary with one), then its own list, else its one prompt."""
    listed = listed.get("prompts", []) if isinstance(listed, dict) else listed
    found = [str(p) for p in (listed if isinstance(listed, list) else []) if p is not None] + [str(p) for p in fixed.get("prompt_list") or []]
    return found or [str(fixed.get("prompt", DEFAULT_PROMPT))]


def slot_step(manifest: dict, slot: str) -> str | None:
    """The checkpoint that a slot names: ``last``, ``best`` (the first of the best), or a pinned one."""
    best = manifest.get("best") or [{}]
    return {"last": manifest.get("last"), "best": best[0].get("step")}.get(slot) if slot in ("last", "best") else (manifest.get("good_slots") or {}).get(slot)


def protected_steps(manifest: dict) -> set[str]:
    """Checkpoints that must not be deleted."""
    return {s for s in (manifest.get("last"), *(b.get("step") for b in manifest.get("best") or []), *(manifest.get("good_slots") or {}).values()) if s}


def commands_from(spark: SparkSession, path: str, offset: int = 0) -> tuple[DataFrame, int]:
    """(lines after a byte offset of a command file, the next offset). A missing file has no lines and keeps the offset."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(target):
        return spark.createDataFrame([], "at int, value string"), offset
    end = system.getFileStatus(target).getLen()
    tail = F.decode(F.substring("content", offset + 1, max(0, end - offset)), "UTF-8")
    rows = spark.read.format("binaryFile").load(path).select(F.posexplode(F.split(tail, "\n")).alias("at", "value"))
    return rows.filter(F.trim("value") != ""), end


def save_state(spark: SparkSession, path: str, state: dict) -> None:
    """Save a run's state as JSON through the session's file systems; every key of ``STATE`` must be there."""
    body = json.dumps({k: state[k] for k in STATE}, indent=2).encode()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(body))
    out.close()
