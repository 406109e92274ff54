"""Corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, source mixing and sharding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; other columns of any name pass through. :func:`run` writes every stage's result as Parquet into the
shared folder and reads it again as the next stage's ``docs``. All stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from sonde.llm.common import table
from sonde.llm.decontaminate import decontaminate
from sonde.llm.language_id import keep_identified
from sonde.llm.mixing import keep_mixed
from sonde.llm.near_dup import drop_near_duplicates
from sonde.llm.sharding import shard


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a probability of 0.4 at least, the found one in ``lang``.

    Null and empty texts have no language and go. Rows of a null or repeated id are judged by their texts, each for itself. The network
    learns from rows that have a ``lang``; without any, no language can be found and nothing stays.
    """
    return keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id.

    Texts without a word, null or empty, are no copies of each other and stay, as do rows of a null id. Rows of the same id are one document.
    """
    return drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the table ``benchmark``, with their new lengths in ``n_chars``.

    Those of which more than 80 % is benchmark go. Null and empty texts, and rows without a passage, stay as they are; null and repeated ids make no difference.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), chars="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the blocks that the sources' quotas select, nine tenths of all blocks.

    A null source is one of its own. Null and empty texts go with the block of the document before them; a source without any token goes.
    Rows of a source that share an id, null too, stay or go together.
    """
    return keep_mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with shard_id, shard_depth and n_bytes, in shards of 64 MB of text.

    Null and empty texts have 0 bytes; rows of a null id are placed by their text, rows of the same id share a shard.
    """
    return shard(docs)


STAGES = [("language ID", language), ("SimHash near-dedup", near_copies), ("benchmark decontamination", benchmark), ("mixing sources", mixture), ("sharding", shards)]

#: Language ID, near-dedup and decontamination have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only a local session without that setting gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sonde-pipeline-")
    return f"{folder}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result. Each stage is written before the next begins, and removed when the next is written."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if n:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n - 1}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return docs
