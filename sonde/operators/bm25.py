"""BM25 over normalized postings.

Statistics are tables: postings (chunk_idx, term, tf, doc_len), terms (term, df) and corpus (n_docs, avg_len). Scoring joins the
query's few terms to the postings, so only matching postings are read, and ranks by (rounded score, chunk_idx).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T

#: Decimals at which scores are compared: sums may differ beyond with the order of addition.
PLACES = 9
#: Different words whose tokens a task keeps; postings that it hands over at once.
WORDS, POSTINGS = 1 << 16, 1 << 16
#: Terms of one query up to which they are literals in the plan.
LITERALS = 100
#: Of a batch of queries: terms up to which they are sent to the tasks, chunks that a task scores, and products and scores that it holds at once.
BATCHED, CHUNKS, HELD = 1 << 20, 8192, 1 << 21


@dataclass(frozen=True)
class Bm25:
    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    k1: float = 1.5
    b: float = 0.75
    #: (n_docs, n_texts), where ``corpus`` follows from it and the postings (:func:`statistics`).
    counted: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.k1 < 0:
            raise ValueError("k1 must not be negative")
        if not 0 <= self.b <= 1:
            raise ValueError("b must be from 0 to 1")

    @cached_property
    def numbers(self) -> tuple[int, float]:
        """n_docs and avg_len, read once."""
        row = self.corpus.first()
        return row["n_docs"], row["avg_len"]


def token_table(chunks: DataFrame) -> DataFrame:
    """(chunk_idx, tokens) of the enriched text."""
    return chunks.select("chunk_idx", T.tokenize(T.enrich(F.col("content"), F.col("file_path"))).alias("tokens"))


def build(tokens: DataFrame, k1: float = 1.5, b: float = 0.75, keep: bool = False) -> Bm25:
    """Statistics (A1-A3) of (chunk_idx, tokens): one shuffle of partial counts by (chunk, term), one by term.

    With ``keep`` the postings are cached, as term and corpus statistics and every query read them.
    """
    each = tokens.select("chunk_idx", F.size("tokens").cast("long").alias("doc_len"), F.explode("tokens").alias("term"))
    postings = each.groupBy("chunk_idx", "term").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))
    if keep:
        postings = postings.persist()
    terms = frequencies(postings)
    total = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    corpus = tokens.agg(F.count("*").alias("n_docs")).crossJoin(total)
    corpus = corpus.select("n_docs", F.when(F.col("n_docs") > 0, F.col("total") / F.col("n_docs")).otherwise(F.lit(0.0)).alias("avg_len"))
    return Bm25(postings, terms, corpus, k1, b)


def _counts() -> Callable[[bytes], dict[str, int]]:
    """Counts the tokens (T2) of a text in UTF-8. Most words are one token; those of the others are kept, as they come again."""
    word, known = re.compile(T.IDENTIFIER), {}

    def count(text: bytes) -> dict[str, int]:
        out: dict[str, int] = {}
        for w, n in Counter(word.findall(text.decode("latin-1"))).items():  # identifiers are ASCII, so bytes will do
            if w.isalpha() and w[1:].islower():
                w = w.lower()
                out[w] = out.get(w, 0) + n
                continue
            tokens = known.get(w)
            if tokens is None:
                tokens = T.tokens_of(w)
                if len(known) < WORDS:
                    known[w] = tokens
            for t in tokens:
                out[t] = out.get(t, 0) + n
        return out

    return count


def of_chunks(chunks: DataFrame, k1: float = 1.5, b: float = 0.75, keep: bool = False) -> Bm25:
    """:func:`build` of chunks whose ``chunk_idx`` differ: the postings of each are counted where it is read, so only terms are shuffled.

    Chunks without text count as documents, but not for the mean length.
    """
    texts = T.in_batches(chunks.select("chunk_idx", T.enrich(F.col("content"), F.col("file_path")).cast("binary").alias("text")))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counts()
        for batch in batches:
            at, sizes, lens, terms, tfs = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                found = count(text.as_py() or b"")
                at.append(i)
                sizes.append(len(found))
                lens.append(sum(found.values()))
                terms += found
                tfs += found.values()
                if len(terms) >= POSTINGS or i == batch.num_rows - 1:
                    cols = batch.column(0).take(pa.array(np.repeat(at, sizes))), pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(np.repeat(np.array(lens, np.int64), sizes))
                    yield pa.RecordBatch.from_arrays(list(cols), ["chunk_idx", "term", "tf", "doc_len"])
                    at, sizes, lens, terms, tfs = [], [], [], [], []

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counts()
        for batch in batches:
            lens = [sum(count(text.as_py()).values()) if text.is_valid else None for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(lens, pa.int64())], ["doc_len"])

    kind = chunks.schema["chunk_idx"].dataType.simpleString()
    postings = texts.mapInArrow(post, f"chunk_idx {kind}, term string, tf long, doc_len long")
    if keep:
        postings = postings.persist()
    sized = texts.select("text").mapInArrow(measure, "doc_len long")
    corpus = sized.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avg_len"))
    counted = texts.agg(F.count("*").alias("n_docs"), F.count("text").alias("n_texts"))
    return Bm25(postings, frequencies(postings), corpus, k1, b, counted)


def statistics(counted: DataFrame, postings: DataFrame) -> DataFrame:
    """A1: (n_docs, avg_len) from postings that are there, without a pass over the texts' tokens."""
    both = counted.crossJoin(postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total")))
    return both.select("n_docs", F.when(F.col("n_texts") > 0, F.col("total") / F.col("n_texts")).otherwise(F.lit(0.0)).alias("avg_len"))


def frequencies(postings: DataFrame) -> DataFrame:
    """A2: (term, df)."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def weight(index: Bm25, tf: Column, df: Column, doc_len: Column, n: Column, avg: Column) -> Column:
    """A4: one term's part of the score."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    norm = F.when(avg > 0, doc_len / avg).otherwise(F.lit(0.0))
    return idf * (tf * (index.k1 + 1)) / (tf + index.k1 * (1 - index.b + index.b * norm))


def score(index: Bm25, queries: DataFrame, only: DataFrame | None = None, few: bool = False) -> DataFrame:
    """(query_id, chunk_idx, score) of every chunk that has a term of a query (query_id, term).

    ``only`` (chunk_idx) restricts the chunks that are scored (F4); the statistics stay those of the whole corpus. ``few`` says
    that the terms are those of one query and may be broadcast; else Spark chooses by their size.
    """
    hint = F.broadcast if few else lambda df: df
    wanted = queries.distinct()
    df = index.terms.join(hint(wanted.select("term").distinct()), "term", "left_semi")
    known = wanted.join(df, "term")
    postings = index.postings if only is None else index.postings.join(only, "chunk_idx", "left_semi")
    hits = postings.join(hint(known), "term").crossJoin(F.broadcast(index.corpus))
    part = weight(index, F.col("tf"), F.col("df"), F.col("doc_len"), F.col("n_docs"), F.col("avg_len"))
    return hits.groupBy("query_id", "chunk_idx").agg(F.round(F.sum(part), PLACES).alias("score"))


def _among(terms: list[str]) -> Column:
    """:func:`T.any_of` over ``term`` in one expression, as a query may be a whole chunk of terms."""
    return F.expr(" OR ".join("term IN (" + ", ".join(f"'{t}'" for t in terms[i : i + 10]) + ")" for i in range(0, len(terms), 10)))


def top(index: Bm25, terms: list[str], k: int, only: DataFrame | None = None) -> DataFrame:
    """(chunk_idx, score, rank): the best ``k`` chunks for the terms of one query, which the driver knows.

    Terms and their frequencies become literals, so that both statistics tables are read under a pushed filter and nothing is joined.
    """
    wanted = sorted({t for t in terms if re.fullmatch("[a-z0-9_]+", t)})  # no token has other characters
    known = {r["term"]: r["df"] for r in _only(index.terms, [(t,) for t in wanted], "term string").collect()} if wanted else {}
    if not known:
        return index.postings.where(F.lit(False)).select("chunk_idx", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    n, avg = index.numbers
    postings = index.postings if only is None else index.postings.join(only, "chunk_idx", "left_semi")
    postings = _only(postings, sorted(known.items()), "term string, df long")
    df = F.col("df") if len(known) > LITERALS else F.expr("map(" + ", ".join(f"'{t}', {d}L" for t, d in known.items()) + ")[term]")
    part = weight(index, F.col("tf"), df, F.col("doc_len"), F.lit(n), F.lit(avg))
    return best(postings.groupBy("chunk_idx").agg(F.round(F.sum(part), PLACES).alias("score")), k)


def _only(table: DataFrame, terms: list[tuple], kind: str) -> DataFrame:
    """Rows of some terms: up to LITERALS by a pushed filter, more by a broadcast of (term[, df]), so that a row costs one look-up."""
    if len(terms) <= LITERALS:
        return table.where(_among([t[0] for t in terms]))
    rows = F.broadcast(table.sparkSession.createDataFrame(terms, kind))
    return table.join(rows, "term", "inner" if "," in kind else "left_semi")


def best(scores: DataFrame, k: int) -> DataFrame:
    """(chunk_idx, score, rank): the best ``k`` of one query by (score, chunk_idx); only they reach the ranking window."""
    order = [F.desc("score"), F.col("chunk_idx")]
    rows = scores.select("chunk_idx", "score").orderBy(*order).limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def top_many(index: Bm25, queries: DataFrame, k: int) -> DataFrame:
    """:func:`ranked` of :func:`score`: (query_id, chunk_idx, score, rank) of the best ``k`` chunks for each of many queries (query_id, term).

    A frequent term joins every query that has it with nearly every chunk. So the postings of the queries' terms are shuffled once, by chunk, and
    each task multiplies those of its chunks with the queries and hands on ``k`` rows a query. More terms than BATCHED are joined.
    """
    wanted = queries.distinct()
    spark, kind = wanted.sparkSession, wanted.schema["query_id"]
    pairs = wanted.where("query_id is not null and term is not null").limit(BATCHED + 1).collect()
    if len(pairs) > BATCHED or index.postings.schema["chunk_idx"].dataType.simpleString() != "bigint":
        return ranked(score(index, queries), k)
    terms = sorted({p["term"] for p in pairs})
    known = _only(index.terms, [(t,) for t in terms], "term string").collect() if terms else []
    if not known:
        return ranked(score(index, queries.where(F.lit(False))), k)
    ids, number = sorted({p["query_id"] for p in pairs}), {r["term"]: i for i, r in enumerate(known)}
    place = {q: i for i, q in enumerate(ids)}
    of = np.array(sorted((number[p["term"]], place[p["query_id"]]) for p in pairs if p["term"] in number), np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast((np.searchsorted(of[:, 0], np.arange(len(known) + 1)), of[:, 1].astype(np.int32), len(ids)))
    n, avg = index.numbers
    each = F.broadcast(spark.createDataFrame([(r["term"], number[r["term"]], r["df"]) for r in known], "term string, t int, df long"))
    part = weight(index, F.col("tf"), F.col("df"), F.col("doc_len"), F.lit(n), F.lit(avg))
    hits = index.postings.join(each, "term").select("chunk_idx", "t", part.alias("part")).repartition(max(1, -(-n // CHUNKS)), "chunk_idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, query, many = shared.value
        rows = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pylist([], pa.schema([("chunk_idx", pa.int64()), ("t", pa.int32()), ("part", pa.float64())]))])
        chunk, t, part = (rows.column(c).to_numpy() for c in ("chunk_idx", "t", "part"))
        order = np.argsort(chunk, kind="stable")
        chunk, t, part = chunk[order], t[order], part[order]
        border = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(chunk) else np.zeros(0, int)
        border, products = np.r_[border, len(chunk)], np.r_[0, np.cumsum(first[t + 1] - first[t])]
        best = np.zeros(0, [("q", np.int64), ("r", float), ("c", np.int64), ("s", float)])
        least, lo = np.full(many, -1.0), 0
        while lo < len(border) - 1:
            hi = max(lo + 1, min(lo + max(1, HELD // many), int(np.searchsorted(products[border], products[border[lo]] + HELD, "right")) - 1))
            at = slice(border[lo], border[hi])
            size = first[t[at] + 1] - first[t[at]]
            from_ = np.repeat(first[t[at]] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            row = np.repeat(np.searchsorted(border, np.arange(at.start, at.stop), "right") - 1 - lo, size)
            s = np.bincount(row * many + query[from_], np.repeat(part[at], size), (hi - lo) * many).reshape(-1, many)
            r = np.round(s, PLACES)
            i, q = np.nonzero((s > 0) & (r >= least))
            new = np.zeros(len(i), best.dtype)
            new["q"], new["r"], new["c"], new["s"] = q, r[i, q], chunk[border[lo + i]], s[i, q]
            best = np.concatenate([best, new])
            best = best[np.lexsort((best["c"], -best["r"], best["q"]))]
            nth = np.arange(len(best)) - np.searchsorted(best["q"], best["q"])
            best, nth = best[nth < k], nth[nth < k]
            least[best["q"][nth == k - 1]] = best["r"][nth == k - 1]
            lo = hi
        yield pa.RecordBatch.from_arrays([pa.array(best["q"]), pa.array(best["c"]), pa.array(best["s"])], ["q", "chunk_idx", "score"])

    found = hits.mapInArrow(run, "q long, chunk_idx long, score double")
    names = F.broadcast(spark.createDataFrame(list(enumerate(ids)), S.StructType([S.StructField("q", S.LongType()), kind])))
    return ranked(found.join(names, "q").select("query_id", "chunk_idx", F.round("score", PLACES).alias("score")), k)


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "query") -> DataFrame:
    """(query_id, term) of query texts."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(T.tokenize(F.col(text)))).alias("term"))


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_idx, score, rank): the best ``k`` of each query (K1), equal scores by chunk."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_idx")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def explain(index: Bm25, terms: DataFrame, chunks: DataFrame, k: int = 15) -> DataFrame:
    """Why chunks match: (chunk_idx, score, hits 'term x tf', path_hits, doc_len), best first."""
    best = ranked(score(index, terms, few=True), k)
    hits = index.postings.join(F.broadcast(best.select("query_id", "chunk_idx", "score")), "chunk_idx").join(F.broadcast(terms.distinct()), ["query_id", "term"])
    found = hits.groupBy("chunk_idx", "score", "doc_len").agg(F.array_join(F.array_sort(F.collect_list(F.concat("term", F.lit("x"), "tf"))), " ").alias("hits"), F.collect_set("term").alias("terms"))
    path = F.array_distinct(T.tokenize(T.enrich(F.lit(""), F.col("file_path"))))
    rows = found.join(chunks.select("chunk_idx", path.alias("path")), "chunk_idx")
    return rows.select("chunk_idx", "score", "hits", F.size(F.array_intersect("terms", "path")).alias("path_hits"), "doc_len")
