"""Incremental postings: chunks that arrive as a stream are added to a stored index in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import bm25


def append_batch(chunks: DataFrame, batch_id: int, folder: str) -> None:
    """Postings of a micro-batch under its number; a batch that is run again replaces its own output."""
    index = bm25.of_chunks(chunks)
    index.postings.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/postings/batch={batch_id}")
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks/batch={batch_id}")


def start(stream: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Feeds a stream of (chunk_idx, file_path, start_line, end_line, content) into ``folder``."""
    writer = stream.writeStream.foreachBatch(lambda df, n: append_batch(df, n, folder)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def load(spark: SparkSession, folder: str, k1: float = 1.5, b: float = 0.75) -> tuple[DataFrame, bm25.Bm25]:
    """(chunks, statistics) over all batches so far."""
    postings = spark.read.parquet(f"{folder}/postings").drop("batch")
    chunks = spark.read.parquet(f"{folder}/chunks").drop("batch")
    lengths = chunks.select("chunk_idx").join(postings.groupBy("chunk_idx").agg(F.first("doc_len").alias("doc_len")), "chunk_idx", "left")
    corpus = lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(F.coalesce("doc_len", F.lit(0))), F.lit(0.0)).alias("avg_len"))
    return chunks, bm25.Bm25(postings, postings.groupBy("term").agg(F.count("*").alias("df")), corpus, k1, b)
