import random

import numpy as np

from sonde.llm import packing as P

SMALL = 32


def naive(lengths, size):
    """Best fit decreasing by a scan over all bins."""
    free, bins = [], []
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        fits = [b for b in range(len(free)) if free[b] >= lengths[i]]
        if fits:
            b = min(fits, key=lambda b: free[b])
        else:
            b = len(free)
            free.append(size)
            bins.append([])
        free[b] -= lengths[i]
        bins[b].append(i)
    return bins


def test_best_fit_equals_a_scan():
    rng = random.Random(0)
    for _ in range(200):
        size = rng.randrange(1, 70)
        lengths = [rng.randrange(1, size + 1) for _ in range(rng.randrange(0, 80))]
        got, want = P.best_fit(lengths, size), naive(lengths, size)
        fill = lambda bins: sorted(sum(lengths[i] for i in b) for b in bins)
        assert fill(got) == fill(want) and sorted(i for b in got for i in b) == list(range(len(lengths)))


ROWS = [(1, "Hello world, this is a text.", "a"), (2, None, "b"), (3, "", "c"), (None, "no id", "d"), (4, "word " * 3000, "e"), (1, "Hello world, this is a text.", "a"), (5, "ñandú 日本語 \U0001f600", None)] + [(10 + i, f"text number {i} " * (i % 9), "z") for i in range(60)]


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, ids string").repartition(3)
    packed = P.pack(df, size=SMALL, group_tokens=500)
    enc = P.encoding(P.TOKENIZER)
    parts = {}
    for r in P.unpack(packed).collect():
        parts.setdefault(r.doc_id, []).append((r.offset, r.tokens))
    want = {}
    for i, t, _ in ROWS:
        if t:
            want.setdefault(i, []).extend((o, enc.encode_ordinary(t)[o : o + SMALL]) for o in range(0, len(enc.encode_ordinary(t)), SMALL))
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}
    for r in packed.collect():
        pos, ids = np.frombuffer(r.positions, "<u2"), np.frombuffer(r.ids, "<u2")
        assert len(ids) == len(pos) == SMALL and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] <= SMALL
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert list(pos[a:b]) == list(range(b - a))
        assert (ids[r.cu_seqlens[-1] :] == 50256).all()


def test_long_text_is_whole(spark):
    df = spark.createDataFrame([(1, "abc déf " * 40000)], "doc_id long, text string")
    got = sorted((r.offset, r.tokens) for r in P.unpack(P.pack(df, size=2048)).collect())
    assert P.encoding(P.TOKENIZER).decode([t for _, ts in got for t in ts]) == "abc déf " * 40000


def test_string_ids(spark):
    df = spark.createDataFrame([("a", "one two"), (None, "three"), ("b", None)], "doc_id string, text string")
    assert sorted((r.doc_id or "", len(r.tokens) > 0) for r in P.unpack(P.pack(df)).collect()) == [("", True), ("a", True)]


def test_empty_and_sink(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    assert P.pack(df.limit(0)).count() == 0
    P.write_matrix(P.pack(df, size=SMALL), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == P.pack(df, size=SMALL).count()
