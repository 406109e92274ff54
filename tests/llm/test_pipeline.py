import numpy as np

import corpus_pipeline
from sonde.llm import language_id as L
from sonde.llm import near_dup as N
from sonde.llm.decontaminate import Matcher, remove
from tests.llm.test_mixing import brute as mix_brute
from tests.llm.test_near_dup import brute as dup_brute


def test_run_equals_brute_force(spark, sf_dir):
    """All stages once more over plain lists. The network is the one that the stage fits; everything after it is independent."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = L.fit(docs)
    rows = [tuple(r) for r in docs.collect()]
    p = net.documents([r[1] for r in rows])
    rows = [(i, t, net.langs[k], s, n) for (i, t, _, s, n), k, q in zip(rows, p.argmax(1), p.max(1), strict=True) if q >= 0.4]

    gone = dup_brute([(r[0], r[1]) for r in rows], 48)
    assert len({r.doc_id for r in N.near_duplicates(spark.createDataFrame(rows, docs.schema)).collect()} ^ set(gone)) <= 0.1 * len(gone)
    rows = [r for r in rows if r[0] not in gone]

    m = Matcher([r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    hits = {d: [(x, y, w1 - w0, total) for w0, w1, x, y in spans] for d, spans, total in m.find([r[1] for r in rows])}
    kept = []
    for d, (i, t, lang, s, n) in enumerate(rows):
        if d in hits:
            if sum(h[2] for h in hits[d]) > 0.8 * hits[d][0][3]:
                continue
            t = remove(t, [h[:2] for h in hits[d]])
            n = len(t)
        kept.append((i, t, lang, s, n))
    assert hits

    chosen = {(i, s) for i, s, _, _ in mix_brute([(r[0], r[1], r[3]) for r in kept], None, 1024, 4, 17)}
    want = {r[0]: r for r in kept if (r[0], r[3]) in chosen}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert tuple(r)[:5] == want[i] and r.shard_id == 0 and r.n_bytes == len(want[i][1].encode())


def test_stages_keep_the_columns_and_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.shards(spark, docs, sf_dir).count() == docs.count()


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = docs.where("n_chars > 300")
    assert corpus_pipeline.language(spark, docs, sf_dir).where("n_chars > 300").count() >= 0.99 * clean.count()
    assert np.isfinite(docs.count())


ODD = "doc_id long, text string, lang string, source string, n_chars long, shard_id string, gone_id int, mix_source string, found_lang string, item_spans int"


def test_stages_take_odd_rows(spark, sf_dir):
    """Nulls in any column, empty and very long texts, repeated rows and ids, and columns named as the stages' own."""
    more = ("x", 1, "y", "z", 2)
    known = [(*map(r.__getitem__, ("doc_id", "text", "lang", "source", "n_chars")), *more) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    odd = [(None, None, None, None, None, None, None, None, None, None), (10**6, "", "en", "s", 0, *more), (None, "the words of a text without an id", "en", None, 1, *more), (10**6 + 1, "the and of " * 200_000, "en", "s", 9, *more), known[3], known[3], (known[4][0], "another text of the same id", "en", "t", 5, *more)]
    rows = known + odd
    docs = spark.createDataFrame(rows, ODD)
    out = {name: stage(spark, docs, sf_dir) for name, stage in corpus_pipeline.STAGES}
    assert all(df.columns == docs.columns for df in list(out.values())[:-1])
    ids = {name: [r.doc_id for r in df.collect()] for name, df in out.items()}
    assert 10**6 not in ids["language ID"] and 10**6 + 1 in ids["language ID"] and ids["language ID"].count(known[3][0]) == 3
    assert ids["SimHash near-dedup"].count(None) == 2 and 10**6 in ids["SimHash near-dedup"] and ids["SimHash near-dedup"].count(known[4][0]) <= 1
    assert ids["benchmark decontamination"].count(None) == 2 and len(ids["benchmark decontamination"]) > 0.95 * len(rows)
    assert len(ids["mixing sources"]) > 0.5 * len(rows)
    sharded = out["sharding"].collect()
    assert len(sharded) == len(rows) and all(r.shard_id == 0 for r in sharded) and sum(r.n_bytes for r in sharded) == sum(len((r[1] or "").encode()) for r in rows)


def test_several_shards(spark, sf_dir):
    from sonde.llm.sharding import shard

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = shard(corpus_pipeline.near_copies(spark, docs, sf_dir), 32 << 10).collect()
    assert len({r.shard_id for r in got}) > 4 and max(r.shard_depth for r in got) > 2
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard_id, []).append(r.n_bytes)
    assert all(sum(x) <= 32 << 10 or len(x) == 1 for x in sizes.values())
