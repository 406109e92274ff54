import numpy as np
import pytest

from sonde.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, found_lang string, keep int"


def samples():
    rng = np.random.default_rng(0)
    words = {"aa": ["the", "and", "thing", "over"], "bb": ["ñandú", "señor", "los", "ción"]}
    return [(" ".join(rng.choice(w, 30)), k) for k, w in words.items() for _ in range(40)]


@pytest.fixture(scope="module")
def net():
    return L.train(samples(), hidden=4, steps=60, batch=32, span=32)


def brute(net, text):
    """Position probabilities by a plain loop over bytes, window by window."""
    x, total = np.frombuffer(text.encode(), np.uint8), np.zeros(len(net.langs))
    for i in range(0, len(x), L.WINDOW):
        w = x[i : i + L.WINDOW]
        logits = np.zeros((len(w), len(net.langs))) + net.c[:, 0]
        for d, steps in ((0, range(len(w))), (1, range(len(w) - 1, -1, -1))):
            h = np.zeros((net.u[d].shape[1], 1), np.float32)
            for t in steps:
                h = L._cell(net.w[d][:, [w[t]]], net.u[d], h)[0]
                logits[t] += (net.v[d] @ h)[:, 0]
        e = np.exp(logits - logits.max(1, keepdims=True))
        total += (e / e.sum(1, keepdims=True)).sum(0)
    return total / max(1, len(x))


def test_batches_equal_a_plain_loop(net):
    texts = ["", "a", None, "señor " * 100, "the thing " * 13, "x" * 127, "y" * 128, "z" * 129]
    got = net.documents(texts, block=3)
    for t, p in zip(texts, got, strict=True):
        assert np.allclose(p, brute(net, t or ""), atol=1e-5)


def test_gradient_descent_learns(net):
    got = net.documents([t for t, _ in samples()]).argmax(1)
    assert np.mean([net.langs[k] == lang for k, (_, lang) in zip(got, samples(), strict=True)]) > 0.95


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    train, test = [r for r in rows if r.doc_id % 2], [r for r in rows if r.doc_id % 2 == 0]
    net = L.train([(r.text[:2000], r.lang) for r in train], steps=150)
    p = net.documents([r.text for r in test])
    assert np.mean([net.langs[k] == r.lang for k, r in zip(p.argmax(1), test, strict=True)]) > 0.95
    assert (p.max(1) >= 0.4).mean() > 0.97


def test_edges(spark, net):
    rows = [(1, None, "aa", "s", 0, "x", 1), (2, "", "aa", "s", 0, "x", 1), (3, "the thing " * 50000, None, None, None, None, None), (None, "señor los", "bb", "s", 1, "x", 1), (3, "the and", "aa", "s", 1, "x", 1), (3, "the and", "aa", "s", 1, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in L.identify(df, net, least=0.4).collect()]
    assert len(got) == 6
    assert [g for g in got if g[0] in (1, 2)] == [(1, None, 0.0, False), (2, None, 0.0, False)]
    assert sum(g[0] == 3 and g[1] == "aa" and g[3] for g in got) == 3
    kept = L.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} <= {3, None}
    empty = df.limit(0)
    assert L.identify(empty).count() == 0 and L.keep_identified(empty).columns == df.columns


def test_samples_come_from_all_of_a_text(spark):
    text = "".join(f"{i:06}" for i in range(20_000))
    df = spark.createDataFrame([(i, text, "aa") for i in range(40)] + [(99, "short", "bb"), (100, None, "bb")], "doc_id long, text string, lang string")
    got = L.labelled_sample(df, 40, "doc_id", "text", "lang", 100)
    places = [text.index(t) for t, k in got if k == "aa"]
    assert len(places) == 40 and all(len(t) == 100 for t, k in got if k == "aa") and max(places) > 90_000 and min(places) < 30_000
    assert ("short", "bb") in got


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in L.identify(df).collect()] == [(1, None, 0.0, False)]
