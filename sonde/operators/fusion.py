"""Reciprocal rank fusion of lexical and dense hits, and code-aware reranking.

Hit lists are (chunk_idx, score, rank). Candidates are keyed by (file_path, start_line). All windows run over at most the fetched
hits and the chunks that a definition promotes, so they sit in one small partition.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PLACES = 9
KEY = ["file_path", "start_line"]


@dataclass(frozen=True)
class FusionOptions:
    """Constants of a fusion; ``alpha`` is the dense list's weight and must be from 0 to 1."""

    top_k: int = 8
    rrf_k: int = 60
    query: str | None = None
    alpha: float | None = None
    rerank: bool = True

    def __post_init__(self) -> None:
        if self.alpha is not None and not 0 <= self.alpha <= 1:
            raise ValueError("alpha must be from 0 to 1")

    @property
    def weight(self) -> float:
        return self.alpha if self.alpha is not None else 0.3 if is_symbol(self.query) else 0.5


def is_symbol(query: str | None) -> bool:
    return bool(query) and re.fullmatch(T.SYMBOL, query.strip()) is not None


def _rrf(hits: DataFrame, chunks: DataFrame, k: int, name: str) -> DataFrame:
    own = hits.join(chunks.select("chunk_idx", *KEY), "chunk_idx")
    return own.select("chunk_idx", *KEY, (1.0 / (k + F.col("rank"))).alias(name), F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"))


def blend(lexical: DataFrame, dense: DataFrame, chunks: DataFrame, alpha: float, rrf_k: int = 60) -> DataFrame:
    """(file_path, start_line, chunk_idx, s, dense_rank, lex_rank) of the union of both lists.

    A key's contributions add up, also within a list. ``chunk_idx`` is the key's hit with the highest sum of scores; ties go to
    the lexical list and the better rank. The smallest ranks order equal scores later.
    """
    a, b = _rrf(lexical, chunks, rrf_k, "lex"), _rrf(dense, chunks, rrf_k, "den")
    both = a.unionByName(b, allowMissingColumns=True)
    per = both.groupBy("chunk_idx", *KEY).agg(F.sum("lex").alias("lex"), F.sum("den").alias("den"), (F.coalesce(F.sum("lex_score"), F.lit(0.0)) + F.coalesce(F.sum("den_score"), F.lit(0.0))).alias("total"), F.min("lex_rank").alias("lex_rank"), F.min("den_rank").alias("den_rank"))
    first = F.struct((-F.col("total")).alias("t"), F.coalesce("lex_rank", F.lit(1 << 30)).alias("l"), F.coalesce("den_rank", F.lit(1 << 30)).alias("d"), F.col("chunk_idx").alias("chunk_idx"))
    keyed = per.groupBy(*KEY).agg(F.min(first).alias("top"), F.coalesce(F.sum("lex"), F.lit(0.0)).alias("lex"), F.coalesce(F.sum("den"), F.lit(0.0)).alias("den"), F.coalesce(F.min("den_rank"), F.lit(1 << 30)).alias("den_rank"), F.coalesce(F.min("lex_rank"), F.lit(1 << 30)).alias("lex_rank"))
    s = F.round(alpha * F.col("den") + (1 - alpha) * F.col("lex"), 12)
    return keyed.select(*KEY, F.col("top.chunk_idx").alias("chunk_idx"), s.alias("s"), "den_rank", "lex_rank")


def _all():
    """One window over all candidates."""
    return Window.partitionBy(F.lit(0))


def _tie(*more: Column | str) -> list:
    return [F.col("start_line"), F.col("den_rank"), F.col("lex_rank"), F.col("chunk_idx"), *more]


def coherence(c: DataFrame) -> DataFrame:
    """The best chunk of each file gains 0.2 of the best score by its file's share of the best file's sum."""
    file = Window.partitionBy("file_path")
    x = c.withColumns({"top": F.max("s").over(_all()), "sum": F.sum("s").over(file), "n": F.row_number().over(file.orderBy(F.desc("s"), *_tie()))})
    x = x.withColumn("most", F.max("sum").over(_all()))
    gain = F.when((F.col("n") == 1) & (F.col("most") > 0), 0.2 * F.col("top") * F.col("sum") / F.col("most")).otherwise(F.lit(0.0))
    return x.withColumn("s", F.col("s") + gain).select(*c.columns)


def tier(content: Column, path: Column, names: list[str]) -> Column:
    """1.5 where a chunk defines a name that its file is called after, 1 where it defines one, else 0."""
    stem = F.lower(T.path_stem(path))
    named = F.lit(False)
    for n in names:
        named = named | T.stem_matches(stem, F.lit(n.lower()))
    return F.when(T.defines(content, names), F.when(named, F.lit(1.5)).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))


def _define_boost(c: DataFrame, chunks: DataFrame, names: list[str], unit: float, near: Column, promote: DataFrame) -> DataFrame:
    """Candidates gain their tier; other chunks of ``promote`` in files that ``near`` (over ``stem``) accepts enter with it.

    Candidates and defining chunks are put together and told apart by a window over the key, so that the plan has the
    candidates once.
    """
    text = chunks.select("chunk_idx", F.col("content").alias("__text"))
    own = text.join(F.broadcast(c), "chunk_idx").withColumn("tier", tier(F.col("__text"), F.col("file_path"), names)).drop("__text")
    stemmed = promote.withColumn("stem", F.lower(T.path_stem(F.col("file_path")))).where(near)
    found = stemmed.select(*KEY, "chunk_idx", tier(F.col("content"), F.col("file_path"), names).alias("tier")).where("tier > 0")
    last = F.lit(1 << 30)
    fresh = found.select(*KEY, "chunk_idx", F.lit(0.0).alias("s"), last.alias("den_rank"), last.alias("lex_rank"), F.lit(None).cast("double").alias("top"), F.lit(1).alias("promoted"), "tier")
    key = Window.partitionBy(*KEY)
    both = own.select(*fresh.columns).unionByName(fresh).withColumns({"top": F.max("top").over(_all()), "n": F.row_number().over(key.orderBy("promoted", "chunk_idx"))})
    return both.where("n = 1").withColumn("s", F.col("s") + F.lit(unit) * F.col("top") * F.col("tier")).where("promoted = 0 or s > 0").select(*c.columns)


def symbol_names(query: str) -> tuple[list[str], Column]:
    """Names that a symbol query may be defined by, and which files (over ``stem``) are called after it."""
    q = query.strip()
    name = next((q.split(sep)[-1] for sep in ("::", "\\", "->", ".") if sep in q), q)
    return sorted({name, q}), T.stem_matches(F.col("stem"), F.lit(name.lower()))


def path_words(query: str) -> list[str]:
    """T16 of a query that the driver knows."""
    words = [w.lower() for w in re.findall(T.IDENTIFIER, query) if len(w) > 2]
    return sorted({w for w in words if w not in T.STOPWORDS})


def embedded(query: str) -> tuple[list[str], Column | None]:
    """Camel-case words of a query, and which files (over ``stem``) are called after one."""
    symbols = sorted(set(re.findall(T.EMBEDDED, query)))
    return symbols, T.embedded_stem_matches(F.col("stem"), F.array(*(F.lit(s) for s in sorted({s.lower() for s in symbols})))) if symbols else None


def query_boost(c: DataFrame, chunks: DataFrame, query: str | None, promote: DataFrame | None = None) -> DataFrame:
    """Definition, path and embedded-symbol boosts for a query that the driver knows.

    ``promote`` has the chunks that a definition may add, where ``chunks`` are the candidates' only.
    """
    promote = chunks if promote is None else promote
    c = c.withColumns({"top": F.max("s").over(_all()), "promoted": F.lit(0)})
    if not query or not query.strip():
        return c
    if is_symbol(query):
        names, near = symbol_names(query)
        return _define_boost(c, chunks, names, 3.0, near, promote)
    keep = path_words(query)
    if keep:
        arr = F.array(*(F.lit(w) for w in keep))
        ratio = T.keyword_matches(arr, T.path_parts(F.col("file_path"))) / float(len(keep))
        c = c.withColumn("s", F.col("s") + F.when(ratio >= 0.1, F.col("top") * ratio).otherwise(F.lit(0.0)))
    symbols, near = embedded(query)
    if symbols:
        c = _define_boost(c, chunks, symbols, 1.5, near, promote)
    return c


def saturate(c: DataFrame, penalize: bool) -> DataFrame:
    """Scores after path penalties, halved for every better chunk of the file. Scores must not be negative."""
    pen = F.col("s") * T.path_penalty(F.col("file_path")) if penalize else F.col("s")
    x = c.withColumn("pen", F.round(pen, 12))
    order = [F.desc("pen"), F.col("promoted"), *_tie()]
    n = F.row_number().over(Window.partitionBy("file_path").orderBy(*order))
    return x.withColumn("score", F.round(F.col("pen") * F.pow(F.lit(0.5), n - 1), PLACES))


def ranking(lexical: DataFrame, dense: DataFrame, chunks: DataFrame, options: FusionOptions, promote: DataFrame | None = None) -> DataFrame:
    """(rank, chunk_idx, score) of the best ``options.top_k``.

    Equal scores are ordered by start line, dense rank, lexical rank and chunk; promoted chunks come last.
    """
    c = blend(lexical, dense, chunks, options.weight, options.rrf_k)
    if options.rerank:
        c = saturate(query_boost(coherence(c), chunks, options.query, promote), options.weight < 1)
        order = [F.desc("score"), F.desc("pen"), F.col("promoted"), *_tie()]
    else:
        c = c.withColumn("score", F.round("s", PLACES))
        order = [F.desc("score"), *_tie()]
    best = c.orderBy(*order).limit(options.top_k)
    return best.withColumn("rank", F.row_number().over(_all().orderBy(*order))).select("rank", "chunk_idx", "score")


def fuse(lexical: DataFrame, dense: DataFrame, chunks: DataFrame, options: FusionOptions) -> DataFrame:
    """(rank, chunk_idx, file_path, start_line, end_line, score, content), best first; content joins after the limit."""
    best = ranking(lexical, dense, chunks, options)
    rest = chunks.select("chunk_idx", "file_path", "start_line", "end_line", "content")
    return rest.join(F.broadcast(best), "chunk_idx").select("rank", "chunk_idx", "file_path", "start_line", "end_line", "score", "content").orderBy("rank")
