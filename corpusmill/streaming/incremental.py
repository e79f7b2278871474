"""Incremental ingestion: the same column expressions on a file stream."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import cut, remove, shared_folder
from ..functions.text import dedup_key
from ..operators import filters, order
from ..operators.chunk import explode_chunks


def document_stream(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A stream over a table that is one Parquet file or a folder of them, 64 files a trigger."""
    path = os.path.join(sf_dir, f"{table}.parquet")
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    return reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def _finished(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there, into a folder that all executors share, and read it back."""
    spark = stream.sparkSession
    base = shared_folder(spark, "stream")
    out = f"{base}/out"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", out).outputMode("append").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{base}/state").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    try:
        return cut(spark.read.schema(stream.schema).parquet(out))
    finally:
        remove(spark, base)


def stats_so_far(documents: DataFrame) -> DataFrame:
    """Streaming counts by source and first broken global rule; the state is one row per source and rule."""
    reason = filters.reason(F.col("text"), filters.GLOBAL)
    return documents.select("source", reason.alias("reason")).groupBy("source", "reason").agg(F.count("*").alias("n"))


def first_seen(documents: DataFrame) -> DataFrame:
    """Keys of the stream, each once. The state holds a hash per distinct key; use a RocksDB state store for large ones."""
    return documents.filter("text is not null").select(F.md5(dedup_key(F.col("text"))).alias("key")).dropDuplicates(["key"])


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stats_so_far`` over all documents that are there now."""
    return _finished(stats_so_far(document_stream(spark, sf_dir)), "complete")


def run_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``first_seen`` over all documents that are there now."""
    return _finished(first_seen(document_stream(spark, sf_dir)), "append")


def budgeted_chunks(stream: DataFrame, target: int, base: str, limits: filters.Limits = filters.BASE) -> tuple[DataFrame, DataFrame]:
    """(chunks, progress) of a document stream: chunks of the passing documents until ``target`` characters are taken.

    Each batch is judged, chunked and placed in the order of ``pos`` after what the batches before took; the chunk that
    crosses the target is kept, and the stream is stopped. Batches write to folders of their own number, so a batch that is
    run again changes nothing. ``progress`` has one row a batch.
    """
    spark = stream.sparkSession
    done = "batch bigint, documents bigint, passed bigint, chunks bigint, chars bigint"
    kept = "batch bigint, doc_id bigint, pos bigint, chunk_idx int, n_chars bigint, start bigint"
    spark.createDataFrame([], done).write.parquet(f"{base}/progress/batch_none")
    spark.createDataFrame([], kept).write.parquet(f"{base}/chunks/batch_none")
    read = lambda name, schema: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/{name}")

    def taken() -> int:
        return read("progress", done).agg(F.sum("chars")).first()[0] or 0

    def step(batch: DataFrame, number: int) -> None:
        before = read("progress", done).filter(F.col("batch") < number).agg(F.sum("chars")).first()[0] or 0
        if before >= target:
            return
        judged = cut(batch.select("doc_id", "pos", F.when(filters.reason(F.col("text"), filters.GLOBAL, limits) == "", F.col("text")).alias("text")))
        sizes = cut(explode_chunks(judged.filter("text is not null"), "text", limits.max_chunk_chars, limits.min_chunk_chars).select("doc_id", "pos", "chunk_idx", F.length("chunk").cast("bigint").alias("n_chars")))
        placed = order.running(sizes, ["pos", "chunk_idx"], {"start": "n_chars"}).withColumn("start", F.col("start") + before).filter(F.col("start") < target)
        placed.select(F.lit(number).cast("bigint").alias("batch"), "doc_id", "pos", "chunk_idx", "n_chars", "start").write.mode("overwrite").parquet(f"{base}/chunks/batch_{number}")
        got = read("chunks", kept).filter(F.col("batch") == number).agg(F.count("*").alias("chunks"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))
        judged.agg(F.count("*").alias("documents"), F.count("text").alias("passed")).crossJoin(got).select(F.lit(number).cast("bigint").alias("batch"), "documents", "passed", "chunks", "chars").write.mode("overwrite").parquet(f"{base}/progress/batch_{number}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    while not query.awaitTermination(2):
        if taken() >= target:
            query.stop()
    return read("chunks", kept), read("progress", done)


def run_chunks(spark: SparkSession, sf_dir: str, target: int = 1_000_000_000) -> DataFrame:
    """Chunks of the documents that are there now, by the stream."""
    base = shared_folder(spark, "stream")
    try:
        return cut(budgeted_chunks(document_stream(spark, sf_dir), target, base)[0].select("doc_id", "chunk_idx", "n_chars", "start"))
    finally:
        remove(spark, base)
