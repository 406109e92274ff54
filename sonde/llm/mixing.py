"""Operator 7: mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, free, is_small, small_join, table

#: A token is a run of anything but blanks, tabs and line ends.
TOKEN = "[^ \\t\\n\\r]+"


def _base(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), key.alias("k"), F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(TOKEN)), F.lit(0)).cast("long").alias("tokens"))


def quotas(totals: DataFrame, weights: dict[str, float] | None, block_tokens: int, shards: int, share: float = 0.9) -> DataFrame:
    """(source, blocks, quota): blocks of each source that every shard takes.

    A shard has as many seats as ``share`` of all blocks come to, at least one. The quotients weight / (2 q + 1) are served from the
    highest, ties by source, until the seats are out; a source that has given all its blocks (its last seat may be short:
    blocks that are left over go to the first shards) leaves the others to go on.
    Without weights a source's weight is its tokens to the power 3/4. A source that ``weights`` leaves out gets nothing.

    The quotient at which the seats run out is searched by sums over the sources, on a grid that narrows; what lies within a
    seat of it is ranked. So no quotient is listed but for a few of each source.
    """
    w = F.sqrt("total") * F.sqrt(F.sqrt("total"))
    if weights is not None:
        w = F.coalesce(F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v))))[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0)
    rows = cut(totals.select("source", F.ceil(F.col("total") / block_tokens).alias("blocks"), w.alias("w")).where("w > 0 and blocks > 0").withColumn("cap", F.ceil(F.col("blocks") / shards)))
    n, all_blocks, caps, lo, hi = rows.agg(F.count("*"), F.sum("blocks"), F.sum("cap"), F.min(F.col("w") / (2 * F.col("cap") + 1)), F.max("w")).first()
    if not n:
        return rows.select("source", "blocks", F.lit(0).cast("long").alias("quota"))
    seats = min(caps, max(1, math.floor(share * all_blocks / shards)))

    def won(least: float):
        """Seats of a source whose quotients are at least ``least``, but for rounding."""
        return F.least(F.col("cap"), F.floor((F.col("w") / least + 1) / 2))

    hi = 2.0 * hi  # no seat is won at hi, all are at lo
    while hi > lo * (1 + 1e-12):
        grid = [lo * (hi / lo) ** (k / 65) for k in range(1, 65)]
        counts = rows.agg(*(F.sum(won(g)) for g in grid)).first()
        low, high, below, above = lo, hi, caps, 0
        for g, c in zip(grid, counts, strict=True):
            if c >= seats:
                low, below = g, c
            else:
                high, above = g, c
                break
        if (low, high) == (lo, hi):
            break
        lo, hi = low, high
        if below - above <= 4 * n:
            break
    x = rows.withColumns({"base": F.greatest(won(hi) - 1, F.lit(0)), "top": F.least(won(lo) + 1, F.col("cap"))})
    free_seats = seats - x.agg(F.sum("base")).first()[0]
    each = x.where("top > base").select("source", F.explode(F.sequence(F.col("base"), F.col("top") - 1)).alias("q"), "w")
    last = each.select("source", (F.col("w") / (2 * F.col("q") + 1)).alias("value"), "q").orderBy(F.desc("value"), "source", "q").limit(free_seats)
    more = last.groupBy("source").agg(F.count("*").alias("more"))
    return x.join(more, "source", "left").select("source", "blocks", (F.col("base") + F.coalesce("more", F.lit(0))).alias("quota"))


#: Blocks that one row stands for on the way to a row for each block.
RUN = 4096


def _drawn(quota: DataFrame, seed: int, shards: int) -> DataFrame:
    """(source, block, shard): the quota * shards blocks of each source with the least seeded MD5, dealt to the shards in turn.

    A block's rank is its place among those of the same first 16 bits, after the counts of lesser ones; so a source is ranked in many tasks.
    """
    runs = quota.where("quota > 0").select("source", "quota", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / RUN))).alias("run")).repartition("source", "run")
    first = F.col("run") * RUN
    blocks = runs.select("source", "quota", F.explode(F.sequence(first, F.least(first + RUN, F.col("blocks")) - 1)).alias("block"))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), "source", F.col("block").cast("string")).cast("binary"))
    blocks = blocks.withColumn("draw", draw).withColumn("part", F.substring("draw", 1, 4))
    parts = blocks.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("source", "part").orderBy("draw", "block")) - 1
    ranked = blocks.join(parts, ["source", "part"]).withColumn("nth", F.col("before") + within)
    return ranked.where(F.col("nth") < F.col("quota") * shards).select("source", "block", F.pmod("nth", F.lit(shards)).cast("int").alias("shard"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, block_tokens: int = 1024, shards: int = 4, seed: int = 17, share: float = 0.9, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, block, shard) of the documents in the blocks that are selected.

    A source's documents, in the order of a seeded MD5 of the id, are laid end to end and cut every ``block_tokens``
    tokens; a document belongs to the block that holds its last token. :func:`quotas` says how many blocks of each
    source a shard gets; the blocks with the least seeded MD5 are taken and dealt to the shards in turn. Positions come from a
    two-level prefix sum, so no task holds a whole source.

    A null source is the source ''. Null and empty texts have no token and go with the tokens before them; a source
    without a token gets no block. Rows of a source that share an id stay together; a null id counts as an id. Other
    columns are ignored. An empty table gives no rows.
    """
    base = _base(docs, doc_id, text, source, seed).withColumn("part", F.substring("k", 1, 4))
    base = cut(base)
    parts = base.groupBy("source", "part").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("sum").over(before), F.lit(0))).drop("sum")
    upto = Window.partitionBy("source", "part").orderBy("k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("offset") + F.sum("tokens").over(upto)
    placed = base.join(parts, ["source", "part"]).select("doc_id", "source", F.greatest(F.floor((end - 1) / block_tokens), F.lit(0)).alias("block"))
    quota = cut(quotas(base.groupBy("source").agg(F.sum("tokens").alias("total")), weights, block_tokens, shards, share))
    return small_join(placed, cut(_drawn(quota, seed, shards)), ["source", "block"], "inner").select("doc_id", "source", "block", "shard")


def keep_mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` in selected blocks; the columns stay."""
    a, b, s = free(docs, "mix_id"), free(docs, "mix_source"), free(docs, "own_source")
    chosen = cut(mix_sources(docs, doc_id=doc_id, source=source, **how).select(F.col("doc_id").alias(a), F.col("source").alias(b)).distinct())
    keyed = docs.withColumn(s, F.coalesce(F.col(source).cast("string"), F.lit("")))
    on = F.col(doc_id).eqNullSafe(F.col(a)) & (F.col(s) == F.col(b))
    return keyed.join(F.broadcast(chosen) if is_small(chosen) else chosen, on, "left_semi").select(*docs.columns)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS source, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS tokens FROM documents),
placed AS (
  SELECT doc_id, source, greatest(0, CAST(floor((sum(tokens) OVER (PARTITION BY source ORDER BY k RANGE UNBOUNDED PRECEDING) - 1) / 1024) AS BIGINT)) AS block FROM base),
totals AS (
  SELECT source, CAST(ceil(sum(tokens) / 1024) AS BIGINT) AS blocks, sqrt(sum(tokens)) * sqrt(sqrt(sum(tokens))) AS w
  FROM base GROUP BY source HAVING sum(tokens) > 0),
seats AS (SELECT greatest(1, CAST(floor(0.9 * sum(blocks) / 4) AS BIGINT)) AS seats FROM totals),
quotients AS (SELECT source, unnest(range(0, CAST(ceil(blocks / 4) AS BIGINT))) AS q, w FROM totals),
served AS (SELECT source, row_number() OVER (ORDER BY w / (2 * q + 1) DESC, source, q) AS nth FROM quotients),
quotas AS (SELECT source, count(*) AS quota FROM served, seats WHERE nth <= seats GROUP BY source),
blocks AS (SELECT source, quota, unnest(range(0, blocks)) AS block FROM totals JOIN quotas USING (source)),
ranked AS (
  SELECT source, block, quota, row_number() OVER (PARTITION BY source ORDER BY md5('17:' || source || ':' || block), block) - 1 AS nth FROM blocks)
SELECT doc_id, source, block, CAST(nth % 4 AS INTEGER) AS shard FROM placed JOIN ranked USING (source, block) WHERE nth < quota * 4
"""
