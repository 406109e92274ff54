import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from sonde.llm import perplexity as P

TEXTS = ["the cat sat on the mat", "The  cat 12 sat\non it", "a mat, the cat; the hat", "", None, "zz"]


def grams_of(text):
    s, n = P.symbols([text])
    return [tuple(int(x) for x in s[i : i + P.ORDER]) for i in range(int(n[0]))]


def brute_model(texts):
    """Interpolated modified Kneser-Ney over plain dictionaries."""
    counts = {P.ORDER: Counter(g for t in texts for g in grams_of(t))}
    for m in range(P.ORDER - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    ds = {}
    for m, c in counts.items():
        n = [0] + [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        ds[m] = {k: min(max((k - (k + 1) * y * n[k + 1] / n[k]) if n[k] and n[1] else 0.5 * k, 0.05), k - 0.05) for k in (1, 2, 3)}
    followers = {m: defaultdict(list) for m in counts}
    for m, c in counts.items():
        for g, v in c.items():
            followers[m][g[:-1]].append(v)

    def prob(g):
        if not g:
            return 1 / (1 << P.BITS)
        m, f = len(g), followers[len(g)].get(g[:-1])
        lower = prob(g[1:])
        if not f:
            return lower
        c = counts[m].get(g, 0)
        d = ds[m][min(c, 3)] if c else 0.0
        return (c - d) / sum(f) + sum(ds[m][min(v, 3)] for v in f) / sum(f) * lower

    return prob


def test_equals_plain_kneser_ney(spark):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    model = P.fit(df)
    prob = brute_model(TEXTS)
    for t in [*TEXTS, "unseen words qx", "the"]:
        g = P.grams(*P.symbols([t]))
        want = [math.log(prob(x)) for x in grams_of(t)]
        assert np.allclose(model.log_probs("en", g), want, atol=1e-5)
    got = {r.doc_id: r for r in P.score(df, model).collect()}
    assert got[3].log_ppl is None and got[4].n == 0
    assert abs(got[0].log_ppl + np.mean([math.log(prob(x)) for x in grams_of(TEXTS[0])])) < 1e-5


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    model = P.fit(df)
    context = int(P.grams(*P.symbols(["the "]))[-1]) & ((1 << 48) - 1)
    g = (np.uint64(context << P.BITS)) + np.arange(1 << P.BITS, dtype=np.uint64)
    assert abs(np.exp(model.log_probs("en", g)).sum() - 1) < 1e-4


def test_a_model_above_the_limit_scores_as_a_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    more = spark.createDataFrame([(10**6, None, None, None, None), (10**6, "", "fr", "s", 0), (None, "zz \u4e2d\u6587", "xx", "s", 1), (10**6 + 1, "zz \u4e2d\u6587", "xx", "s", 1)], docs.schema)
    whole, parts = (sorted((tuple(r) for r in P.perplexity_filter(docs.union(more).union(docs.limit(5)), **how).collect()), key=str) for how in ({}, {"most_rows": 15_000}))
    assert len(whole) == len(parts)
    for a, b in zip(whole, parts, strict=True):
        assert a[:3] == b[:3] and a[6] == b[6]
        assert all(x is y is None or math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a[3:6], b[3:6], strict=True))


def brute_bands(rows, clean, budget, widths, least_labels, short):
    """keep by doc_id of rows (doc_id, lang, n, log perplexity), from sorted lists."""
    quantile = lambda xs, p: sorted(xs)[max(0, math.ceil(p * len(xs)) - 1)]
    z, band = {}, {}
    for k in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == k and r[3] is not None]
        if own:
            mid = quantile([r[3] for r in own], 0.5)
            mad = max(0.005, quantile([abs(r[3] - mid) for r in own], 0.5))
            z |= {r[0]: (r[3] - mid) / (1.4826 * mad * math.sqrt(1 + short / r[2])) for r in own}
    lang = {r[0]: r[1] for r in rows}
    for k in {*lang.values(), None}:
        zs = [z[i] for i in clean if i in z and (k is None or lang[i] == k)]
        band[k] = (quantile(zs, budget / 2), quantile(zs, 1 - budget / 2)) if len(zs) >= least_labels else None
    out = {}
    for i, k in lang.items():
        low, high = band[k] or band[None] or (-widths[0], widths[1])
        out[i] = i in z and low <= z[i] <= high
    return out


def test_bands_equal_sorted_lists(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.withColumn("mid", F.lit("x")).withColumn("z", F.lit(1))
    odd = spark.createDataFrame([(10**6, "xq" * 4000, "en", "s", 1, "", 0), (10**6 + 1, "the " * 50000, "en", "s", 1, "", 0), (10**6 + 2, None, None, None, None, "", 0), (10**6 + 3, "", "fr", "s", 0, "", 0), (10**6 + 4, "a b c", None, "s", 0, "", 0)], docs.schema)
    docs = docs.union(odd)
    scores = [tuple(r) for r in P.scored_by_own(docs).collect()]
    clean = [r.doc_id for r in labels.where("quality = 1").collect()]
    for given, least_labels in ((labels.union(labels), 20), (labels, 10**6), (None, 1)):
        want = brute_bands(scores, clean if given is not None else [], 0.1, (4.0, 2.0), least_labels, 400.0)
        got = {r.doc_id: r.keep for r in P.perplexity_filter(docs, given, 0.1, (4.0, 2.0), least_labels).collect()}
        assert got == want and not got[10**6] and not got[10**6 + 1] and not got[10**6 + 2] and not got[10**6 + 3]


def test_junk_goes_and_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = P.perplexity_filter(docs, labels).join(labels, "doc_id").collect()
    junk, clean = ([r for r in rows if r.quality == q] for q in (0, 1))
    assert sum(not r.keep for r in junk) > 0.6 * len(junk) and sum(not r.keep for r in clean) < 0.02 * len(clean)
    assert sum(r.perplexity > r.upper for r in junk) > 0.2 * len(junk) and sum(r.perplexity < r.lower for r in junk) > 0.2 * len(junk)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "one text here", "en"), (1, "one text here", "en"), (None, " \n ", None)], "doc_id long, text string, lang string")
    got = P.perplexity_filter(docs).collect()
    assert len(got) == 3 and len({(r.doc_id, r.lang, r.n_symbols, r.perplexity, r.keep) for r in got}) == 2
    assert P.perplexity_filter(docs.limit(0)).count() == 0 and P.perplexity_filter(docs.limit(0), docs.selectExpr("doc_id", "1 quality")).count() == 0


def test_symbols():
    s, n = P.symbols(["A  b9!!", None, "$$$aa"])
    assert list(n) == [5, 0, 3] and list(s[4:9]) == [65, 32, 98, 48, 33] and list(s[-3:]) == [36, 97, 97]
