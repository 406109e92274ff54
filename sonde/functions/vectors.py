"""Vector functions: pooling of static embeddings and dot products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """V3: plain dot product in double precision; vectors are taken as normalized."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rows(ids: DataFrame, model: DataFrame, dim: int) -> DataFrame:
    """V1: (id, embedding) of ids; zeros where the model has no such row."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return ids.join(model.select(F.col("token_id").alias("id"), "embedding"), "id", "left").select("id", F.coalesce("embedding", zero).alias("embedding"))


def encode(bags: DataFrame, model: DataFrame, dim: int) -> DataFrame:
    """V2 in SQL: (key, vector) of bags (key, ids) under model (token_id, embedding[, mapping, sif]).

    Ids without a model row are skipped; ``mapping`` names the row to use, ``sif`` weighs by the id itself. The mean over kept
    ids is normalized; zeros where nothing is kept.
    """
    has = set(model.columns)
    lookup = model.select(F.col("token_id").alias("id"), (F.col("mapping") if "mapping" in has else F.col("token_id")).alias("row"), (F.col("sif") if "sif" in has else F.lit(1.0)).alias("w"))
    used = bags.select("key", F.explode("ids").alias("id")).join(lookup, "id")
    parts = used.join(model.select(F.col("token_id").alias("row"), "embedding"), "row").select("key", F.struct("w", "embedding").alias("x"))
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate("x", zero, lambda s, e: F.zip_with(s, e["embedding"], lambda a, b: a + e["w"] * b.cast("double")))
    # the rows of a bag, which is one chunk's tokens, come together whole
    vec = parts.groupBy("key").agg(F.collect_list("x").alias("x")).select("key", F.transform(total, lambda v: v / F.size("x")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.when(norm > 0, F.transform("v", lambda x: x / norm)).otherwise(F.array_repeat(F.lit(0.0), dim))
    return bags.select("key").distinct().join(vec, "key", "left").select("key", F.coalesce(unit, F.array_repeat(F.lit(0.0), dim)).alias("vector"))


def encode_arrow(bags: DataFrame, matrix: np.ndarray, mapping: np.ndarray | None = None, sif: np.ndarray | None = None, most_mb: int = 512) -> DataFrame:
    """V2 in bulk: the same over a model matrix that is broadcast after a check of its size; map-only."""
    if matrix.nbytes > most_mb << 20:
        raise ValueError("the matrix is too large to broadcast; use encode() over a model table")
    shared = bags.sparkSession.sparkContext.broadcast((matrix, mapping, sif))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, to, w = shared.value
        for b in batches:
            out = np.zeros((b.num_rows, m.shape[1]))
            for i, ids in enumerate(b.column(1).to_pylist()):
                keep = np.array([x for x in ids or () if x is not None and 0 <= x < len(m)], int)
                at = keep if to is None else to[keep]
                ok = (at >= 0) & (at < len(m))
                keep, at = keep[ok], at[ok]
                if len(keep):
                    v = (m[at].astype(float) * (1.0 if w is None else w[keep][:, None])).sum(0) / len(keep)
                    n = np.linalg.norm(v)
                    out[i] = v / n if n > 0 else 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(out), pa.list_(pa.float64()))], ["key", "vector"])

    kind = bags.schema["key"].dataType.simpleString()
    return bags.select("key", "ids").mapInArrow(run, f"key {kind}, vector array<double>")


def nearest(vectors: DataFrame, query: list[float], most_block: int = 8192) -> DataFrame:
    """J9 in bulk: (chunk_idx, score) by blocks of numpy products over Arrow batches of (chunk_idx, embedding); map-only."""
    q = np.asarray(query, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, most_block):
                part = b.slice(lo, most_block)
                col = part.column(1)
                m = col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(q)) if len(col) else np.zeros((0, len(q)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m @ q)], ["chunk_idx", "score"])

    return vectors.where(F.size("embedding") == len(q)).select("chunk_idx", "embedding").mapInArrow(run, "chunk_idx long, score double")


def _blocks(vectors: DataFrame, name: str, size: int) -> DataFrame:
    """Vectors (chunk_idx, embedding) as rows of about ``size`` ids and their numbers, row after row."""
    n = max(1, -(-vectors.count() // size))
    block = F.pmod(F.xxhash64("chunk_idx"), F.lit(n))
    each = vectors.select(block.alias("b"), F.struct("chunk_idx", F.transform("embedding", lambda x: x.cast("double")).alias("v")).alias("r"))
    return each.groupBy("b").agg(F.collect_list("r").alias("r")).select(F.transform("r", lambda x: x["chunk_idx"]).alias(f"{name}_ids"), F.flatten(F.transform("r", lambda x: x["v"])).alias(f"{name}_v"))


def nearest_to_all(vectors: DataFrame, queries: DataFrame, k: int, places: int = 9, size: int = 1024) -> DataFrame:
    """J6, J9 for many queries: (query_id, chunk_idx, score, rank) of the ``k`` highest positive products, the query's own id left out.

    Both sides are put in blocks; each pair of blocks is one numpy product, of which only ``k`` rows a query are kept. Nothing is
    gathered on the driver.
    """
    from pyspark.sql import Window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q_ids, x_ids = (np.asarray(b.column(c)[i].values) for c in ("q_ids", "x_ids"))
                q, x = (np.asarray(b.column(c)[i].values).reshape(len(ids), -1) for c, ids in (("q_v", q_ids), ("x_v", x_ids)))
                s = np.round(q @ x.T, places)
                s[q_ids[:, None] == x_ids[None, :]] = 0
                order = np.lexsort((np.broadcast_to(x_ids, s.shape), -s), axis=1)[:, :k]
                best = np.take_along_axis(s, order, 1)
                ok = best > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, order.shape[1])[ok.ravel()]), pa.array(x_ids[order][ok]), pa.array(best[ok])], ["query_id", "chunk_idx", "score"])

    pairs = _blocks(queries, "q", size).crossJoin(_blocks(vectors, "x", size))
    found = pairs.mapInArrow(run, "query_id long, chunk_idx long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_idx")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
