"""Sources: record tables, whole-file books, vocabularies, configurations, command files."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC = "doc_id bigint, pos bigint, source string, text string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has too few splits, as one file with one row group has; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def records(spark: SparkSession, path: str, form: str = "parquet", text: str = "text") -> DataFrame:
    """(text) of web or encyclopedia records; the only column that is read."""
    return spark.read.format(form).load(path).select(F.col(text).alias("text"))


def empty(spark: SparkSession) -> DataFrame:
    """A source without documents."""
    return spark.createDataFrame([], DOC)


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    """A source in pseudo-random order: a range sort by a hash of its key."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))))


def books(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of one whole book per file; bad bytes become replacement marks, unreadable and empty files are skipped."""
    files = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").load(path)
    import pyarrow as pa

    def run(batches):
        for b in batches:
            texts = [c.decode("utf-8", "replace") for c in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(texts, pa.string())], ["path", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, text string").filter("text <> ''")


def book_files(spark: SparkSession, listing: str, root: str, seed: int) -> DataFrame:
    """(place, path) of the books of a listing (one relative path a line), in an order drawn by the seed; blank lines are skipped."""
    from ..operators.order import running, uniform

    rows = spark.read.text(listing).select(F.trim("value").alias("name")).filter("name <> ''").distinct().withColumn("k", uniform(seed, "name"))
    placed = running(rows, ["k", "name"], {"place": F.lit(1).cast("bigint")})
    return placed.select("place", F.concat(F.lit(root.rstrip("/") + "/"), "name").alias("path"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece, score) of a tab-separated vocabulary, ids by line."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("id", "_line"))
    cells = F.split("_line", "\t")
    return whole.select("id", F.get(cells, F.lit(0)).alias("piece"), F.get(cells, F.lit(1)).try_cast("double").alias("score"))


def config(path: str) -> dict:
    """A YAML or JSON file; an empty one gives no settings. The key ``dedup_similarity_threshold`` means ``dedup_threshold``."""
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    try:
        found = json.loads(raw)
    except ValueError:
        import yaml

        found = yaml.safe_load(raw)
    found = dict(found or {})
    if "dedup_similarity_threshold" in found:
        found["dedup_threshold"] = found.pop("dedup_similarity_threshold")
    return found


COMMAND = "cmd string, path string, value string, slot string, step string, prompt string, prompts array<string>, params map<string,string>, tag string, save boolean"


def commands(lines: DataFrame, column: str = "value") -> DataFrame:
    """Commands from JSON lines; blank and malformed lines and those without ``cmd`` are skipped. Works on streams."""
    parsed = lines.select(F.from_json(F.col(column), COMMAND).alias("c")).select("c.*")
    return parsed.filter(F.col("cmd").isNotNull())


def load_state(path: str) -> dict | None:
    """A saved JSON state; null where it is missing, broken or lacks a key."""
    try:
        with open(path, encoding="utf-8") as f:
            state = json.load(f)
        return {k: state[k] for k in ("phase", "tokens_written", "docs_processed", "c4_docs", "wiki_docs", "gutenberg_docs", "dedup_rejects", "elapsed_seconds", "timestamp")}
    except (OSError, ValueError, KeyError, TypeError):
        return None
