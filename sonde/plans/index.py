"""The code index: BM25 statistics and vectors over chunks, with the two query verbs."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T
from ..functions import vectors as V
from ..functions.wordpiece import WordPiece, token_ids
from ..operators import at_once, bm25, fusion
from ..sources.model_files import StaticModel

CHUNK = S.StructType(
    [S.StructField("file_path", S.StringType()), S.StructField("language", S.StringType()), *(S.StructField(c, S.IntegerType()) for c in ("start_line", "end_line", "start_byte", "end_byte")), S.StructField("content", S.StringType()), S.StructField("node_type", S.StringType()), S.StructField("is_definition", S.BooleanType())]
)
COLUMNS = ["file_path", "start_line", "end_line", "score", "content"]
#: Results up to which a search is answered on the driver once its hits are known.
AT_ONCE = 1000
RESULT = "file_path string, start_line int, end_line int, score double, content string"


def _hits(spark: SparkSession) -> DataFrame:
    return spark.range(0, 0, 1, 1).select(F.col("id").alias("chunk_idx"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))


def _one(spark: SparkSession, **values) -> DataFrame:
    """A row of literals: a plan that the optimizer folds, without a Python list behind it."""
    return spark.range(0, 1, 1, 1).select(*(F.lit(v).alias(k) for k, v in values.items()))


@dataclass
class CodeIndex:
    """Chunks with their postings, term statistics and, with a model, vectors."""

    spark: SparkSession
    chunks: DataFrame
    lexical: bm25.Bm25
    vectors: DataFrame | None = None
    model: StaticModel | None = None
    tokenizer: WordPiece | None = None

    @classmethod
    def from_chunks(cls, spark: SparkSession, chunks: DataFrame, model: StaticModel | None = None, tokenizer: WordPiece | None = None, vectors: DataFrame | None = None, k1: float = 1.5, b: float = 0.75) -> CodeIndex:
        """Over (chunk_idx, file_path, start_line, end_line, content). Model and tokenizer come as a pair."""
        if (model is None) != (tokenizer is None):
            raise ValueError("give both a model and its tokenizer, or neither")
        if vectors is None and model is not None:
            bags = chunks.select(F.col("chunk_idx").alias("key"), token_ids(F.col("content"), tokenizer).alias("ids"))
            vectors = V.encode_arrow(bags, model.embeddings, model.mapping, model.sif).select(F.col("key").alias("chunk_idx"), F.col("vector").alias("embedding"))
        return cls(spark, chunks, bm25.of_chunks(chunks, k1, b), vectors, model, tokenizer)

    @classmethod
    def from_path(cls, spark: SparkSession, root: str, provider=None, store=None, model: StaticModel | None = None, tokenizer: WordPiece | None = None) -> CodeIndex:
        """Walks, reads and chunks a source tree, through a chunk store where one is given."""
        from ..sources.store import chunk_tree

        return cls.from_chunks(spark, chunk_tree(spark, root, provider, store), model, tokenizer)

    def cache(self) -> CodeIndex:
        """Keeps chunks, statistics and vectors, and computes them now; the corpus's one row becomes literals."""
        for df in self._tables():
            df.cache().count()
        row = self.lexical.corpus.first()
        self.lexical = replace(self.lexical, corpus=_one(self.spark, n_docs=row["n_docs"], avg_len=row["avg_len"]))
        return self

    def unpersist(self) -> None:
        for df in self._tables():
            df.unpersist()

    def save(self, path: str) -> None:
        """Persists the index. Postings and terms are sorted by term, chunks and vectors by chunk, so that the filters of a query skip most row groups.

        Terms lie in files by their hash, which needs no sample, so the postings are made once; the statistics are those of the written postings.
        """
        self.lexical.postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        postings = self.spark.read.parquet(f"{path}/postings")
        bm25.frequencies(postings).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        for name, df in (("chunks", self.chunks), ("vectors", self.vectors)):
            if df is not None:
                df.repartitionByRange("chunk_idx").sortWithinPartitions("chunk_idx").write.mode("overwrite").parquet(f"{path}/{name}")
        corpus = self.lexical.corpus if self.lexical.counted is None else bm25.statistics(self.lexical.counted, postings)
        corpus.write.mode("overwrite").parquet(f"{path}/corpus")

    @classmethod
    def load(cls, spark: SparkSession, path: str, vectors: bool = False, k1: float = 1.5, b: float = 0.75) -> CodeIndex:
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return cls(spark, read("chunks"), bm25.Bm25(read("postings"), read("terms"), read("corpus"), k1, b), read("vectors") if vectors else None)

    def _tables(self) -> list[DataFrame]:
        return [x for x in (self.chunks, self.lexical.postings, self.lexical.terms, self.lexical.corpus, self.vectors) if x is not None]

    def _within(self, paths: list[str] | None) -> DataFrame | None:
        if paths is None:
            return None
        return self.chunks.where(self._at(paths)).select("chunk_idx")

    @staticmethod
    def _at(paths: list[str]) -> Column:
        """Whether a chunk's path is one of ``paths``, backslashes being slashes on both sides."""
        wanted = [p.replace("\\", "/") for p in paths]
        return T.slashes(F.col("file_path")).isin(wanted) if wanted else F.lit(False)

    def lexical_hits(self, query: str, k: int, only: DataFrame | None = None) -> DataFrame:
        return bm25.top(self.lexical, T.tokens_of(query), k, only)

    def dense_hits(self, vector: list[float] | None, k: int, only: DataFrame | None = None, but: int | None = None) -> DataFrame:
        """K3: the ``k`` chunks with the highest positive dot product, ``but`` left out."""
        if self.vectors is None or vector is None or not any(vector):
            return _hits(self.spark)
        v = self.vectors if only is None else self.vectors.join(only, "chunk_idx", "left_semi")
        v = v if but is None else v.where(F.col("chunk_idx") != but)
        return bm25.best(V.nearest(v, vector).select("chunk_idx", F.round("score", bm25.PLACES).alias("score")).where("score > 0"), k)

    def encode(self, query: str) -> list[float] | None:
        if self.model is None:
            return None
        text = query.lower() if self.tokenizer.lower else query
        import re

        from ..functions import wordpiece as W

        blanks = "\\t-\\r \\u2000-\\u200a\\u2028\\u2029"
        ids = [i for w in re.findall(f"[{W.PUNCTUATION}]|[^{blanks}{W.PUNCTUATION}]+", text) for i in self.tokenizer.word_ids(w)]
        return self.model.encode(ids).tolist()

    def _fused(self, lex: DataFrame, den: DataFrame, scope: DataFrame, options: fusion.FusionOptions) -> DataFrame:
        """Results of two hit lists over ``scope``.

        Up to AT_ONCE results the hits, over-fetched ten for a result at most, are taken to the driver with their chunks, read by their ids,
        and ranked there (:mod:`at_once`); the result's rows are there when this returns. Larger ones stay distributed and lazy.
        """
        if options.top_k > AT_ONCE:
            return fusion.fuse(lex, den, scope, options).select(*COLUMNS)
        hits = lex.select(F.lit(0).alias("l"), "chunk_idx", "score", "rank").union(den.select(F.lit(1), "chunk_idx", "score", "rank")).collect()
        known = self._rows(scope, sorted({h["chunk_idx"] for h in hits}))
        lists = [[tuple(h)[1:] for h in hits if h["l"] == l] for l in (0, 1)]
        top = at_once.ranking(*lists, {i: (path, first, content) for i, (path, first, _, content) in known.items()}, options, scope)
        known |= self._rows(scope, sorted({i for i, _ in top} - known.keys()))
        found = [(*known[i][:3], score, known[i][3]) for i, score in top]
        return self.spark.createDataFrame(found, RESULT).coalesce(1)

    def _rows(self, scope: DataFrame, ids: list[int]) -> dict[int, tuple]:
        """(file_path, start_line, end_line, content) of chunks by their number."""
        if not ids:
            return {}
        return {r[0]: tuple(r)[1:] for r in scope.where(T.any_of(F.col("chunk_idx"), ids)).select("chunk_idx", "file_path", "start_line", "end_line", "content").collect()}

    def search(self, query: str, top_k: int = 8, filter_paths: list[str] | None = None, alpha: float | None = None, vector: list[float] | None = None, rerank: bool = True) -> DataFrame:
        """Results of a free-text query, best first. An empty list of paths, a blank query or top_k < 1 give none."""
        if top_k < 1 or not query.strip() or filter_paths == []:
            return self.spark.createDataFrame([], RESULT)
        only = self._within(filter_paths)
        lex = self.lexical_hits(query, 5 * top_k, only)
        den = self.dense_hits(vector if vector is not None else self.encode(query), 5 * top_k, only)
        scope = self.chunks if only is None else self.chunks.where(self._at(filter_paths))
        return self._fused(lex, den, scope, fusion.FusionOptions(top_k, query=query, alpha=alpha, rerank=rerank))

    def anchor(self, file: str, line: int):
        """The first chunk of a file that spans a line, with its tokens, or null."""
        at = self.chunks.where((F.col("file_path") == file) & F.lit(line).between(F.col("start_line"), F.col("end_line")))
        return at.orderBy("chunk_idx").limit(1).select("chunk_idx", "content", "file_path", T.tokenize(T.enrich(F.col("content"), F.col("file_path"))).alias("tokens")).first()

    def find_related(self, file: str, line: int, top_k: int = 8) -> DataFrame:
        """C4: chunks like the one at a place: its tokens and its vector as queries, itself left out.

        Of each list 5 top_k + 1 are fetched (K4): the lexical one, from which the anchor then goes if it is there, and the dense one without it.
        """
        got = self.anchor(file, line) if top_k >= 1 else None
        if got is None:
            return self.spark.createDataFrame([], RESULT)
        me = F.col("chunk_idx") != got["chunk_idx"]
        lex = bm25.best(bm25.top(self.lexical, got["tokens"], 5 * top_k + 1).where(me), 5 * top_k + 1)
        v = None if self.vectors is None else self.vectors.where(~me).select("embedding").first()
        den = self.dense_hits(None if v is None else [float(x) for x in v[0]], 5 * top_k + 1, but=got["chunk_idx"])
        return self._fused(lex, den, self.chunks.where(me), fusion.FusionOptions(top_k, query=got["content"]))

    def explain(self, query: str, k: int = 15) -> DataFrame:
        """C10."""
        q = _one(self.spark, query_id=0, query=query)
        return bm25.explain(self.lexical, bm25.query_terms(q), self.chunks, k)


def anchors(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """J5 for many places (place, file_path, line): (place, chunk_idx) of the first chunk that spans each; none for a place without one."""
    at = places.join(chunks, "file_path").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    return at.groupBy("place").agg(F.min("chunk_idx").alias("chunk_idx"))


def percentiles(values: DataFrame, column: str, wanted: dict[str, float]) -> DataFrame:
    """A9 over a column: a row with the nearest-rank percentile of every name in ``wanted``, nulls left out.

    Values are counted first; only (value, count) of each different value goes through the ordered window.
    """
    v = values.where(F.col(column).isNotNull()).select(F.col(column).alias("value"))
    window = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = v.agg(F.count("*").alias("n"))
    cum = v.groupBy("value").count().withColumn("cum", F.sum("count").over(window)).crossJoin(F.broadcast(n))
    return cum.agg(*(F.min(F.when(F.col("cum") > F.floor((F.col("n") - 1) * p + 0.5), F.col("value"))).alias(name) for name, p in wanted.items()))


def formatted(results: DataFrame) -> DataFrame:
    """Results as lines of text."""
    return results.select(F.format_string("%s:%d-%d score=%.4f", "file_path", "start_line", "end_line", "score").alias("line"))


def as_json(results: DataFrame) -> DataFrame:
    """Results as JSON objects."""
    return results.select(F.to_json(F.struct(*COLUMNS)).alias("json"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Shared paths of two results over the longer one's number of paths."""
    x, y = (df.agg(F.collect_set("file_path").alias(n)) for df, n in ((a, "x"), (b, "y")))
    most = F.greatest(F.size("x"), F.size("y"))
    return x.crossJoin(y).select(F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect("x", "y")) / most).alias("overlap"))


def percentile(values: list[float], p: float) -> float:
    """Nearest-rank percentile at index round((n - 1) p), halves up."""
    x = sorted(values)
    return x[int(np.floor((len(x) - 1) * p + 0.5))] if x else 0.0
