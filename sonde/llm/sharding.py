"""Operator 6: sharding by extendible hashing under a byte limit."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, small_join, table

#: Bits of the hash, and the depths at which bucket sizes are counted; a deeper count only covers what is oversized.
DEPTH = 32
LEVELS = (16, 22, 28, 32)


def directory(sizes, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(depth, prefix) of the leaves under the root, in the order of their prefixes.

    ``sizes(level, prefixes)`` gives arrays of prefixes, ascending, with bytes and rows at LEVELS[level], below the given prefixes of the level before.
    """
    depths, prefixes = [], []
    todo = np.zeros(1, np.int64)
    for level, deep in enumerate(LEVELS):
        start = LEVELS[level - 1] if level else 0
        if not len(todo):
            break
        tree = {deep: sizes(level, todo if level else None)}
        for d in range(deep - 1, start - 1, -1):
            p, b, n = tree[d + 1]
            first = np.flatnonzero(np.append(True, p[1:] >> 1 != p[:-1] >> 1)) if len(p) else np.zeros(0, np.int64)
            tree[d] = (p[first] >> 1, np.add.reduceat(b, first), np.add.reduceat(n, first)) if len(p) else tree[d + 1]
        for d in range(start, deep + 1):
            p, b, n = tree[d]
            at = np.minimum(np.searchsorted(p, todo), max(0, len(p) - 1))
            big = (p[at] == todo) & (b[at] > limit) & (n[at] > 1) & (d < DEPTH) if len(p) else np.zeros(len(todo), bool)
            depths.append(np.full((~big).sum(), d))
            prefixes.append(todo[~big])
            todo = todo[big] if d == deep else np.sort(np.concatenate([2 * todo[big], 2 * todo[big] + 1]))
            if not len(todo):
                break
    depth, prefix = np.concatenate(depths), np.concatenate(prefixes)
    order = np.argsort(prefix << (DEPTH - depth), kind="stable")
    return depth[order], prefix[order]


def _keyed(docs: DataFrame, doc_id: str, text: str, h: str, size: str) -> DataFrame:
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("#"), F.coalesce(F.col(text).cast("string"), F.lit(""))))
    bits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")
    return docs.withColumns({h: bits, size: F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long")})


def shard(docs: DataFrame, limit: int = 64 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with shard_id, shard_depth (bits of its bucket) and n_bytes; every row is in one shard.

    The directory is indexed by the first bits of the id's MD5. It begins with one bucket; each bucket of more than
    ``limit`` UTF-8 bytes of text splits on its next bit, others stay. A bucket of one row can't split, nor can one of rows of
    the same 32 bits (repeated ids): such a shard may exceed the limit. Shards are numbered in the order of their prefixes, those
    left empty by a split too. Bucket sizes are aggregated in Spark; what the driver gathers is 65,536 counts, and more only
    below oversized prefixes, in proportion to the number of shards. The directory is sent out as 16 bytes a shard (24 MB for 100 TB) and
    looked up by a row's hash alone; the texts aren't moved.

    Null and empty texts have 0 bytes. Rows of a null id are hashed by their text. Other columns stay, but for older ones of the three names. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c.lower() not in ("shard_id", "shard_depth", "n_bytes")]
    h, size, p = free(docs, "hash_bits"), free(docs, "text_bytes"), free(docs, "prefix")
    rows = _keyed(docs, doc_id, text, h, size)

    def sizes(level: int, under: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = rows.select(F.col(h).alias("h"), F.col(size).alias("size"))
        if under is not None:
            prefixes = spark.createDataFrame(pa.table({"p0": under}))
            part = small_join(part.withColumn("p0", F.shiftright("h", DEPTH - LEVELS[level - 1])), prefixes, ["p0"], "left_semi")
        counts = part.groupBy(F.shiftright("h", DEPTH - LEVELS[level]).alias("p")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).toArrow()
        p, b, n = (counts.column(c).to_numpy() for c in ("p", "b", "n"))
        order = np.argsort(p)
        return p[order], b[order], n[order]

    depth, prefix = directory(sizes, limit)
    leaves = spark.sparkContext.broadcast((prefix << (DEPTH - depth), depth))

    @F.pandas_udf("long")
    def leaf(bits: pd.Series) -> pd.Series:
        first, deep = leaves.value
        at = np.searchsorted(first, bits.to_numpy(), side="right") - 1
        return pd.Series(at << 6 | deep[at])

    found = rows.withColumn(p, leaf(F.col(h)))
    return found.select(*own, F.shiftright(p, 6).cast("int").alias("shard_id"), F.col(p).bitwiseAND(63).cast("int").alias("shard_depth"), F.col(size).alias("n_bytes"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "shard_id", "shard_depth", "n_bytes")


def in_small_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 with shards of 64 kB, so that even the smallest tables split many times."""
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 64 << 10).select("doc_id", "shard_id", "shard_depth", "n_bytes")


def op6_sql(limit: int = 64 << 20) -> str:
    return f"""
WITH keyed AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '#' || coalesce(text, ''))), 1, 8) AS BIGINT) AS h,
         coalesce(strlen(text), 0) AS n_bytes FROM documents),
levels AS (SELECT unnest(range(0, 33)) AS d),
sized AS (
  SELECT d, h >> (32 - d) AS p, sum(n_bytes) AS b, count(*) AS n FROM keyed, levels GROUP BY 1, 2),
inner_nodes AS (SELECT d, p FROM sized WHERE b > {limit} AND n > 1 AND d < 32),
all_inner AS (
  SELECT d, p FROM inner_nodes),
root AS (SELECT 0 AS d, CAST(0 AS BIGINT) AS p WHERE NOT EXISTS (SELECT 1 FROM all_inner WHERE d = 0)),
leaves AS (
  SELECT d, p FROM root UNION ALL
  SELECT c.d, c.p FROM (SELECT d + 1 AS d, 2 * p AS p FROM all_inner UNION ALL SELECT d + 1, 2 * p + 1 FROM all_inner) c
  WHERE NOT EXISTS (SELECT 1 FROM all_inner i WHERE i.d = c.d AND i.p = c.p)),
numbered AS (SELECT d, p, row_number() OVER (ORDER BY p << (32 - d)) - 1 AS shard_id FROM leaves)
SELECT k.doc_id, CAST(shard_id AS INTEGER) AS shard_id, CAST(d AS INTEGER) AS shard_depth, CAST(n_bytes AS BIGINT) AS n_bytes
FROM keyed k JOIN numbered l ON k.h >> (32 - l.d) = l.p
"""
