"""Operator 2: character n-gram perplexity under a modified Kneser-Ney model of the corpus, with bands for each language."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut, mix, small_join, table, texts_to_python

ORDER = 5
BITS = 12
_MASK = np.uint64((1 << BITS) - 1)
#: Grams that a task holds before it merges or hands on its partial counts.
HELD = 500_000


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """12-bit symbols of all texts, each after ORDER - 1 zeros, and the number of symbols of each text.

    Letters keep their case, digits are one symbol, white space is one blank however long, and a run of one mark (as $$$) is
    one of it, since what follows the first is no surprise; code points from 4096 on
    share the symbols above 2047 by their lower bits. 0 only stands before a text.
    """
    low = [t or "" for t in texts]
    pad = "\0" * (ORDER - 1)
    cp = np.frombuffer("".join(pad + t for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low)), [len(t) + ORDER - 1 for t in low])
    start = np.zeros(len(cp), bool)
    at = np.cumsum([0] + [len(t) + ORDER - 1 for t in low])[:-1]
    for k in range(ORDER - 1):
        start[at + k] = True
    table_ = _folded()
    s = np.where(cp < 4096, table_[np.minimum(cp, 4095)], 2048 + cp % 2048).astype(np.uint16)
    s[start] = 0
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | ~_MARKS[s[1:]]
    return s[keep], np.bincount(owner[keep], minlength=len(low)) - (ORDER - 1)


def _folded() -> np.ndarray:
    t = np.arange(4096, dtype=np.uint16)
    t[48:58] = 48
    for c in range(4096):
        if chr(c).isspace() or c < 32:
            t[c] = 32
    return t


#: Symbols that are neither letters nor digits, the blank among them; of runs of one, the first counts.
_MARKS = np.array([0 < c < 2048 and not (chr(c).isalnum() or unicodedata.category(chr(c))[0] == "M") for c in range(1 << BITS)])


def grams(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ORDER-gram that ends at each symbol, packed to 60 bits (the oldest symbol highest), text after text."""
    x = s.astype(np.uint64)
    g = x.copy()
    for k in range(1, ORDER):
        g[k:] |= x[:-k] << np.uint64(BITS * k)
    inner = np.ones(len(s), bool)
    at = np.cumsum(np.append(0, n + ORDER - 1))[:-1]
    for k in range(ORDER - 1):
        inner[at + k] = False
    return g[inner]


def _count(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys, c = keys[order], np.concatenate([c for _, c in parts])[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(c, first)


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): counts of all packed 5-grams over all documents, by language; partial counts are made in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size: dict[str, int] = {}

        def out(k: str) -> pa.RecordBatch:
            g, c = _count(held.pop(k))
            size.pop(k)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k, object), pa.string()), pa.array(g.view(np.int64)), pa.array(c)], ["lang", "gram", "n"])

        for b in batches:
            langs, texts = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
            for k in sorted(set(langs.tolist())):
                mine = [texts[i] for i in np.flatnonzero(langs == k)]
                for lo, hi in chunks(mine, 1 << 18):
                    g = grams(*symbols(mine[lo:hi]))
                    if not len(g):
                        continue
                    u, c = np.unique(g, return_counts=True)
                    held.setdefault(k, []).append((u, c))
                    size[k] = size.get(k, 0) + len(u)
                    if size[k] > HELD:
                        held[k] = [_count(held[k])]
                        size[k] = len(held[k][0][0])
                        if size[k] > HELD // 2:
                            yield out(k)
        for k in list(held):
            yield out(k)

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).cast("string").alias("text"))
    return texts_to_python(rows).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def model_table(counts: DataFrame) -> DataFrame:
    """(lang, m, gram, p, bow) of interpolated modified Kneser-Ney: for every m-gram its discounted share and, as a context, its weight.

    5-grams have their counts, shorter grams the number of different symbols before them. ``p`` is max(c - D(c), 0) / total of the
    context, ``bow`` the mass that the context leaves to the next shorter one (null where the gram is no context).
    """
    level, types = None, counts.select("lang", "gram", "n")
    for m in range(ORDER, 0, -1):
        if m < ORDER:
            types = types.select("lang", F.col("gram").bitwiseAND((1 << BITS * m) - 1).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
        types = cut(types)
        nn = types.groupBy("lang").agg(*(F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

        def discount(k: int):
            ratio = F.col(f"n{k + 1}") / F.col(f"n{k}")
            d = F.when((F.col(f"n{k}") > 0) & (F.col("n1") > 0), k - (k + 1) * y * ratio).otherwise(0.5 * k)
            return F.greatest(F.lit(0.05), F.least(d, F.lit(k - 0.05)))

        ds = nn.select("lang", *(discount(k).alias(f"d{k}") for k in (1, 2, 3)))
        x = types.join(F.broadcast(ds), "lang")  # a row for each language
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        x = x.withColumns({"d": d, "context": F.shiftright("gram", BITS)})
        totals = x.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("mass"))
        rows = x.join(totals, ["lang", "context"]).select("lang", F.lit(m).alias("m"), "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("p"))
        weights = totals.select("lang", F.lit(m - 1).alias("m"), F.col("context").alias("gram"), (F.col("mass") / F.col("total")).alias("bow"))
        rows = rows.withColumn("bow", F.lit(None).cast("double")).unionByName(weights.withColumn("p", F.lit(None).cast("double")))
        level = rows if level is None else level.unionByName(rows)
    return level.groupBy("lang", "m", "gram").agg(F.max("p").alias("p"), F.max("bow").alias("bow"))


def _hash(g: np.ndarray, m: int) -> np.ndarray:
    return mix(g + np.uint64((m * 0x9E3779B97F4A7C15) % (1 << 64)))


@dataclass
class Model:
    """For each language: sorted 64-bit hashes of all grams, share (float32, nan: none) and context weight of each."""

    arrays: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]
    symbols: int

    @classmethod
    def of(cls, rows: pa.Table) -> Model:
        coded = rows.column("lang").combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.unify_dictionaries().combine_chunks()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        m = rows.column("m").to_numpy()
        g = rows.column("gram").to_numpy().view(np.uint64)
        p, bow = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.float32) for c in ("p", "bow"))
        out = {}
        for k in sorted(names):
            at = np.flatnonzero(code == names.index(k))
            h = np.zeros(len(at), np.uint64)
            for o in range(ORDER + 1):
                own = m[at] == o
                h[own] = _hash(g[at][own], o)
            order = np.argsort(h)
            at = at[order]
            out[k] = (h[order], np.nan_to_num(p[at]), np.nan_to_num(bow[at], nan=1.0))
        return cls(out, 1 << BITS)

    def find(self, lang: str, g: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        keys, p, bow = self.arrays[lang]
        h = _hash(g, m)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        return np.where(hit, p[at], np.float32(0)), np.where(hit, bow[at], np.float32(1))

    def log_probs(self, lang: str, g: np.ndarray) -> np.ndarray:
        """Natural log probability of the last symbol of each packed 5-gram given the four before it."""
        g, back = np.unique(g, return_inverse=True)
        prob = np.full(len(g), 1.0 / self.symbols)
        for m in range(1, ORDER + 1):
            part = g & np.uint64((1 << BITS * m) - 1)
            share = self.find(lang, part, m)[0]
            context, where = np.unique(part >> np.uint64(BITS), return_inverse=True)
            prob = share + self.find(lang, context, m - 1)[1][where] * prob
        return np.log(prob)[back]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts, smooths and gathers the whole model at once; for a corpus of any size :func:`scored_by_own` takes it in parts."""
    return _gathered(model_table(cut(gram_counts(docs, text, lang))))


def _gathered(rows: DataFrame) -> Model:
    slim = rows.select("lang", F.col("m").cast("byte").alias("m"), "gram", F.col("p").cast("float").alias("p"), F.col("bow").cast("float").alias("bow"))
    return Model.of(slim.toArrow())


#: Symbols three and two before the end of a 5-gram decide its part: all that it is scored by ends in them, or is short.
_PAIR = (1 << 2 * BITS) - 1


def _part(pair: np.ndarray, parts: int) -> np.ndarray:
    return (pair * np.uint64(2654435761) >> np.uint64(16)) % np.uint64(parts)


def _in_part(rows: DataFrame, part: int, parts: int) -> DataFrame:
    """The shares and context weights that score the 5-grams of one of ``parts``; those of the shortest grams are in each."""
    last, before = F.col("gram").bitwiseAND(_PAIR), F.shiftright("gram", BITS).bitwiseAND(_PAIR)
    here = lambda pair: F.expr(f"pmod(shiftright({pair} * 2654435761L, 16), {parts})") == part
    x = rows.withColumns({"l": last, "b": before})
    p, bow = (F.when(short | here(c), F.col(k)) for short, c, k in ((F.col("m") <= 2, "b", "p"), (F.col("m") <= 1, "l", "bow")))
    return x.select("lang", "m", "gram", p.alias("p"), bow.alias("bow")).where("p is not null or bow is not null")


def score_in_parts(docs: DataFrame, rows: DataFrame, parts: int, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """:func:`score` under a model table of any size: one part of it after the other is sent out, each for its own 5-grams.

    Sums are kept by language and MD5 of the text, as equal texts have equal scores.
    """
    name = F.coalesce(F.col(lang).cast("string"), F.lit(""))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), name.alias("lang"), F.col(text).cast("string").alias("text"))
    key = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    sums = None
    for part in range(parts):
        model = _gathered(_in_part(rows, part, parts))
        one = cut(score(keyed.withColumn("doc_id", key), model, part=(part, parts)).distinct().withColumn("part", F.lit(part)))
        sums = one if sums is None else sums.unionByName(one)
    total = sums.groupBy("doc_id", "lang", "part").agg(F.max("n").alias("n"), F.max("log_ppl").alias("log_ppl"))
    total = total.groupBy("doc_id", "lang").agg(F.max("n").alias("n"), F.sum("log_ppl").alias("log_ppl"))
    own = keyed.select("doc_id", "lang", key.alias("key"))
    return own.join(total.withColumnRenamed("doc_id", "key"), ["key", "lang"]).select("doc_id", "lang", "n", "log_ppl")


def scored_by_own(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most_rows: int = 4_000_000) -> DataFrame:
    """Scores of all documents under the whole model of them; above ``most_rows`` the model goes out in parts, and no gram is left out."""
    rows = cut(model_table(cut(gram_counts(docs, text, lang))))
    parts = -(-rows.count() // most_rows)
    if parts > 1:
        return score_in_parts(docs, rows, parts, doc_id, text, lang)
    return score(docs, _gathered(rows), doc_id, text, lang)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", part: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, lang, n, log_ppl): mean negative log probability of a character; null where a text has none.

    With ``part`` = (part, parts) only the 5-grams of that part add to the mean.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = np.array(b.column(1).to_pylist(), object), b.column(2).to_pylist()
            n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for k in sorted(set(langs.tolist())):
                mine = np.flatnonzero(langs == k)
                for lo, hi in chunks([texts[i] for i in mine], 1 << 18):
                    at = mine[lo:hi]
                    s, size = symbols([texts[i] for i in at])
                    n[at] = size
                    g = grams(s, size)
                    if len(g) and k in shared.value.arrays:
                        owner = np.repeat(np.arange(len(at)), size)
                        if part:
                            own = _part((g >> np.uint64(BITS)) & np.uint64(_PAIR), part[1]) == part[0]
                            g, owner = g[own], owner[own]
                        total[at] = np.bincount(owner, -shared.value.log_probs(k, g), len(at))
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), mean], ["doc_id", "lang", "n", "log_ppl"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).cast("string").alias("text"))
    return texts_to_python(rows).mapInArrow(run, f"doc_id {kind}, lang string, n long, log_ppl double")


def _widths(z: DataFrame, labels: DataFrame | None, budget: float, widths: tuple[float, float], least_labels: int) -> DataFrame:
    """(lang, down, up): deviations from the median at which a language's bands end.

    They leave ``budget`` / 2 of the documents labelled clean outside on either side; a language of fewer than ``least_labels`` of them
    takes what all languages have together, and ``widths`` where that is too few.
    """
    langs = z.select("lang").distinct()
    down, up = widths
    if labels is None:
        return langs.select("lang", F.lit(down).alias("down"), F.lit(up).alias("up"))
    clean = cut(z.where("z is not null").join(labels.where(F.col("quality") == 1).select(F.col("doc_id")).distinct(), "doc_id", "left_semi").select("lang", "z"))
    ends = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("labels"), F.percentile_approx("z", [budget / 2, 1 - budget / 2], 100_000).alias("q")).where(F.col("labels") >= least_labels)
    every = ends(clean).first()
    if every is not None:
        down, up = -every["q"][0], every["q"][1]
    own = ends(clean, "lang").select("lang", (-F.col("q")[0]).alias("own_down"), F.col("q")[1].alias("own_up"))
    return small_join(langs, own, ["lang"], "left").select("lang", F.coalesce("own_down", F.lit(down)).alias("down"), F.coalesce("own_up", F.lit(up)).alias("up"))


def perplexity_filter(docs: DataFrame, labels: DataFrame | None = None, budget: float = 0.005, widths: tuple[float, float] = (5.0, 3.0), least_labels: int = 200, short: float = 400.0, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most_rows: int = 4_000_000) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, lower, upper, keep) of every row.

    The model is counted over all documents, for each language apart, and is whole at any size (:func:`scored_by_own`). A deviation is
    the distance of a log perplexity from its language's median in robust deviations (1.4826 times the median absolute one), which
    count as wider by sqrt(1 + ``short`` / n) for a text of n symbols, as short texts scatter more. A language's band ends at two
    deviations of its own (:func:`_widths`), fitted to ``labels`` (doc_id, quality), of which all with quality 1 are
    used, or at ``widths`` below and above without labels. lower and upper are a document's bounds as perplexities, and keep is false outside of
    them. Medians are taken over all documents, to 0.1 % of rank, ends over all labels.

    A null language is the language ''. A null or empty text has no symbol, a null perplexity and keep false; a blank one has one symbol.
    Equal texts get equal scores and repeated rows count as often as they occur; other columns are ignored, as are labels of unknown
    documents. An empty table gives no rows.
    """
    scored = cut(scored_by_own(docs, doc_id, text, lang, most_rows))
    middle = cut(scored.groupBy("lang").agg(F.percentile_approx("log_ppl", 0.5, 1000).alias("mid")))
    spread = small_join(scored, middle, ["lang"], "inner").groupBy("lang").agg(F.first("mid").alias("mid"), F.percentile_approx(F.abs(F.col("log_ppl") - F.col("mid")), 0.5, 1000).alias("mad"))
    unit = 1.4826 * F.greatest(F.col("mad"), F.lit(0.005)) * F.sqrt(1 + short / F.greatest(F.col("n"), F.lit(1)))
    x = small_join(scored, cut(spread), ["lang"], "left").withColumn("unit", unit).withColumn("z", (F.col("log_ppl") - F.col("mid")) / F.col("unit"))
    x = small_join(x, cut(_widths(x, labels, budget, widths, least_labels)), ["lang"], "left")
    low, high = F.col("mid") - F.col("down") * F.col("unit"), F.col("mid") + F.col("up") * F.col("unit")
    inside = F.coalesce(F.col("log_ppl").between(low, high), F.lit(False))
    return x.select("doc_id", "lang", F.col("n").alias("n_symbols"), F.exp("log_ppl").alias("perplexity"), F.exp(low).alias("lower"), F.exp(high).alias("upper"), inside.alias("keep"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity_filter(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
