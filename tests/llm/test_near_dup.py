import inspect
import random

import numpy as np
import pytest

from sonde.llm import near_dup as N

WORDS = [a + b + c for a in ("ka", "lo", "mi", "nu", "re") for b in ("sta", "pi", "vor", "en") for c in ("", "da", "lis", "mon", "tek")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def edited(rng, t, k):
    w = t.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def groups(pairs):
    return {r["doc_id"]: r["keep_id"] for r in pairs.collect()}


def brute(rows, most):
    """Components over all pairs of ids."""
    rows = sorted({i: t for i, t in rows if i is not None and t}.items())
    f, has = N.fingerprints([t for _, t in rows])
    ids, root = [i for i, _ in rows], {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if has[i] and has[j] and int(np.bitwise_count(f[i] ^ f[j]).sum()) <= most:
                a, b = find(ids[i]), find(ids[j])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids if find(i) != i}


@pytest.fixture(scope="module")
def corpus():
    rng, rows = random.Random(3), []
    for g in range(12):
        t = text(rng, 150)
        rows += [(len(rows) + k, t if k % 3 == 0 else edited(rng, t, 5)) for k in range(1 + g)]
    rows += [(len(rows) + k, text(rng, rng.randrange(5, 200))) for k in range(80)]
    return rows


def test_recall_against_all_pairs(spark, corpus):
    got, want = groups(N.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string"))), brute(corpus, 48)
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.95 * len(want)
    assert set(got) <= set(want)


def test_oversized_buckets_are_split_and_still_found(spark, corpus):
    want = brute(corpus, 48)
    got = groups(N.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string"), cap=4, bits=4))
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.9 * len(want)


def test_what_stays_oversized_is_compared_in_blocks(spark, corpus):
    """No further bits at all: then blocks alone must find what the buckets hold."""
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    whole, blocks = (groups(N.near_duplicates(df, bits=4, **how)) for how in ({}, {"cap": 4, "levels": 0}))
    assert whole == blocks and whole


def test_string_ids(spark, corpus):
    df = spark.createDataFrame([(f"k{i:04}", t) for i, t in corpus], "doc_id string, text string")
    want = groups(N.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string")))
    assert groups(N.near_duplicates(df)) == {f"k{i:04}": f"k{j:04}" for i, j in want.items()}
    assert N.drop_near_duplicates(df).count() == len(corpus) - len(want)


def test_pairs_meet_at_each_distance_though_all_buckets_are_split(spark):
    """Pairs at 36 and 48 bits, every bucket taken for one of 8 and of 256 times the cap."""
    rng, how = np.random.default_rng(5), {k: p.default for k, p in inspect.signature(N.near_duplicates).parameters.items()}
    pairs = 500
    for distance, least in ((36, 0.97), (48, 0.86)):
        flip = np.zeros((pairs, N.BITS), np.uint8)
        for row in flip:
            row[rng.choice(N.BITS, distance, replace=False)] = 1
        one = rng.integers(0, 2, (pairs, N.BITS), np.uint8)
        f = np.packbits(np.stack([one, one ^ flip], 1).reshape(-1, N.BITS), axis=1, bitorder="little").view(np.int64)
        reps = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(f)], "doc_id long, f0 long, f1 long, f2 long, f3 long")
        keyed = N.buckets(reps, how["tables"], how["bits"])
        for times in (4, 128):
            big = keyed.selectExpr("*", f"{how['cap'] * times} n")
            parts = N.split(big, how["tables"], how["bits"], how["cap"], how["rate"] or how["most"] / (N.BITS - how["bits"]))
            met = parts.selectExpr("key", "doc_id", "doc_id div 2 pair").groupBy("key", "pair").agg({"doc_id": "count"}).where("`count(doc_id)` > 1").select("pair").distinct().count()
            assert met >= least * pairs, (distance, times, met)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (4, 5), (5, 7), (6, 7), (8, 10)], "a long, b long")
    assert {r.doc_id: r.root for r in N.components(edges).collect()} == {2: 1, 3: 1, 9: 1, 5: 4, 6: 4, 7: 4, 10: 8}


def test_long_path_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.root for r in N.components(edges).collect()} == {0}


def test_simhash_ignores_case_punctuation_and_order():
    f, has = N.fingerprints(["One two, three.", "ONE two three", "three two one!", "", None, "..."])
    assert (f[0] == f[1]).all() and (f[0] == f[2]).all() and list(has) == [True, True, True, False, False, False]


def test_a_long_text_is_taken_whole():
    rng = random.Random(1)
    long = text(rng, 60000)
    changed = " ".join(long.split()[:30000]) + " " + " ".join(f"q{w}" for w in text(rng, 30000).split())
    f, _ = N.fingerprints([long, changed])
    assert 0 < int(np.bitwise_count(f[0] ^ f[1]).sum())


def test_edges(spark):
    t = text(random.Random(5), 80)
    rows = [(1, t, "a"), (2, t, None), (2, t, "b"), (None, t, "c"), (3, None, "d"), (4, "", "e"), (5, "", "e"), (6, "!!", None), (7, t.upper(), "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone_id string")
    assert groups(N.near_duplicates(df)) == {2: 1, 7: 1}
    left = N.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 1, 3, 4, 5, 6]
    twice = spark.createDataFrame([(1, "x y z"), (1, "x y z"), (2, "p q r s")], "doc_id long, text string")
    assert sorted(r.doc_id for r in N.drop_near_duplicates(twice).collect()) == [1, 2]
    assert N.near_duplicates(df.limit(0)).count() == 0 and N.drop_near_duplicates(df.limit(0)).count() == 0
