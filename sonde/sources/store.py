"""Chunk store: chunks of unchanged files are read, others made and added."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.chunking import FIELDS, VERSION, chunk_files
from .walk import listing, read_sources

KEY = ["path", "mtime_ms", "size", "chunker_version"]
CHUNKS = "array<struct<" + ",".join(f.replace(" ", ":") for f in FIELDS.split(", ")) + ">>"
SCHEMA = f"path_key string, path string, mtime_ms long, size long, chunker_version int, chunks {CHUNKS}"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local session without that setting gets a temporary one, removed with the process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sonde-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


class ChunkStore:
    """Parquet files, one row for each source file: its key and its chunks. Each write adds a generation; the newest row of a key counts, if its path wasn't removed since."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def read(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(SCHEMA + ", generation string").option("ignoreCorruptFiles", "true").parquet(self.folder)
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)
        rows = rows.withColumn("made", F.concat(*(F.substring("generation", at, n) for at, n in ((13, 4), (9, 4), (1, 8)))))  # a uuid1 has its low digits first
        gone = F.max(F.when(F.col("size") == -1, F.col("made"))).over(Window.partitionBy("path"))
        n = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("made"), F.desc("generation")))
        kept = rows.withColumn("gone", gone).where("size >= 0 and (gone is null or made > gone)")
        return kept.withColumn("n", n).where("n = 1").drop("n", "generation", "made", "gone")

    def split(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(hits with their chunks, misses) of a listing; a hit has the same path, time, size and chunker version."""
        now = files.withColumn("chunker_version", F.lit(VERSION))
        held = self.read()
        return now.join(held.drop("path_key"), KEY), now.join(held.select(*KEY), KEY, "left_anti").drop("chunker_version")

    def add(self, files: DataFrame, version: int = VERSION) -> None:
        """Writes (path, mtime_ms, size, chunks) as a generation of its own."""
        rows = files.select(F.sha2("path", 256).alias("path_key"), "path", "mtime_ms", "size", F.lit(version).alias("chunker_version"), "chunks")
        rows.write.mode("append").parquet(f"{self.folder}/generation={uuid.uuid1().hex}")

    def remove(self, paths: list[str]) -> None:
        """Marks paths as gone; what was added of them before never matches a listing."""
        gone = self.spark.createDataFrame([(p,) for p in paths], "path string")
        self.add(gone.select("path", F.lit((1 << 62)).cast("long").alias("mtime_ms"), F.lit(-1).cast("long").alias("size"), F.array().cast(CHUNKS).alias("chunks")))


def to_json(chunks: DataFrame) -> DataFrame:
    """Chunks as JSON with snake_case names."""
    return chunks.select(F.to_json(F.struct(*(f.split()[0] for f in FIELDS.split(", ")))).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.from_json("json", FIELDS).alias("c")).select("c.*")


def _per_file(files: DataFrame, chunks: DataFrame) -> DataFrame:
    held = chunks.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("start_byte", F.struct(*(f.split()[0] for f in FIELDS.split(", "))).alias("c")))).alias("x"))
    rows = files.join(held, "file_path", "left")
    return rows.withColumn("chunks", F.coalesce(F.transform("x", lambda s: s["c"]), F.array().cast(CHUNKS))).drop("x")


def chunk_tree(spark: SparkSession, root: str, provider=None, store: ChunkStore | None = None) -> DataFrame:
    """Chunks of a tree with ``chunk_idx``, the position by path and place. Files that can't be read are left out."""
    files = listing(spark, root)
    if store is None:
        chunks = chunk_files(read_sources(files).where("error is null"), provider)
    else:
        hits, misses = store.split(files)
        if not misses.isEmpty():
            sources = read_sources(misses).where("error is null")
            store.add(_per_file(sources.drop("source", "error"), chunk_files(sources, provider)))
            hits, _ = store.split(files)
        at = hits.select(F.col("file_path").alias("rel"), F.explode("chunks").alias("c"))
        chunks = at.select("c.*", "rel").withColumn("file_path", F.col("rel")).drop("rel")
    return number(chunks)


def number(chunks: DataFrame) -> DataFrame:
    """``chunk_idx`` in the order of (file_path, start_byte): the place within the file, after all chunks of earlier files.

    Only (path, count) of each file goes through one task; chunks are numbered file by file.
    """
    counts = chunks.groupBy("file_path").count()
    before = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file_path", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__o"))
    nth = F.row_number().over(Window.partitionBy("file_path").orderBy("start_byte", "end_byte")) - 1
    return chunks.withColumn("__n", nth).join(offsets, "file_path").withColumn("chunk_idx", F.col("__n") + F.col("__o")).drop("__n", "__o")
