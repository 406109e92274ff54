import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonde.functions import text as T
from sonde.functions import vectors as V
from sonde.operators import at_once, bm25, fusion
from sonde.plans import index as plans
from sonde.plans.index import CodeIndex, as_json, formatted, percentile

CORPUS = [(0, ["parse", "config"]), (1, ["parse", "json", "config"]), (2, ["render", "html"]), (3, ["config", "parser"])]


def index_of(spark, **how):
    return bm25.build(spark.createDataFrame(CORPUS, "chunk_idx long, tokens array<string>"), **how)


def terms(spark, *ts):
    return spark.createDataFrame([(0, t) for t in ts], "query_id int, term string")


def test_bm25_golden(spark):
    got = {r.chunk_idx: r.score for r in bm25.score(index_of(spark), terms(spark, "parse", "config", "parse")).collect()}
    want = {0: 1.105075921, 1: 0.912888804, 3: 0.375447309}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 2e-9 for k, v in want.items())


def test_bm25_statistics_and_parameters(spark):
    i = index_of(spark)
    assert i.corpus.first().asDict() == {"n_docs": 4, "avg_len": 2.25}
    assert {r.term: r.df for r in i.terms.collect()}["config"] == 3
    flat = {r.chunk_idx: r.score for r in bm25.score(index_of(spark, k1=0.0), terms(spark, "config")).collect()}
    assert len(set(flat.values())) == 1 and set(flat) == {0, 1, 3}
    for how in ({"k1": -1.0}, {"b": -0.1}, {"b": 1.1}):
        with pytest.raises(ValueError):
            index_of(spark, **how)
    only = spark.createDataFrame([(1,), (3,)], "chunk_idx long")
    part = {r.chunk_idx: r.score for r in bm25.score(i, terms(spark, "config", "parse"), only).collect()}
    assert set(part) == {1, 3} and abs(part[1] - 0.912888804) < 2e-9
    empty = bm25.build(spark.createDataFrame([], "chunk_idx long, tokens array<string>"))
    assert empty.corpus.first().avg_len == 0 and bm25.score(empty, terms(spark, "x")).count() == 0


def some_chunks(spark, n, seed=3):
    """Chunks of odd words, some without text."""
    rng = random.Random(seed)
    pieces = ["parseConfig", "XMLParser", "my_func", "__x", "a1b2", "HTTP2Server", "the", "é", "日本x", "\u2028", "1abc", "_", "ABCd", "\n", "doc_7", "\x00y"]
    texts = [None if i % 13 == 5 else "".join(rng.choice(pieces) + rng.choice(["", " ", "."]) for _ in range(rng.randrange(40))) for i in range(n)]
    return spark.createDataFrame([(i, f"src/a{i % 3}/fileName_{i}.py", i, i + 1, t) for i, t in enumerate(texts)], "chunk_idx long, file_path string, start_line int, end_line int, content string")


def test_postings_are_counted_where_chunks_are_read(spark):
    chunks = some_chunks(spark, 60).repartition(3)
    a, b = bm25.of_chunks(chunks), bm25.build(bm25.token_table(chunks))
    for x, y in ((a.postings, b.postings), (a.terms, b.terms)):
        assert sorted(map(tuple, x.select(*y.columns).collect())) == sorted(map(tuple, y.collect()))
    total = sum(r.tf for r in a.postings.collect())
    assert a.corpus.first().asDict() == {"n_docs": 60, "avg_len": total / chunks.where("content is not null").count()}
    plan = bm25.of_chunks(some_chunks(spark, 5)).postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert bm25.of_chunks(chunks.limit(0)).corpus.first().asDict() == {"n_docs": 0, "avg_len": 0.0}


def test_saving_makes_postings_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    chunks = some_chunks(spark, 40)
    index = bm25.of_chunks(chunks)
    postings = index.postings.mapInArrow(seen, index.postings.schema)
    CodeIndex(spark, chunks, bm25.Bm25(postings, bm25.frequencies(postings), index.corpus)).save(str(tmp_path / "i"))
    got = CodeIndex.load(spark, str(tmp_path / "i")).lexical
    assert made.value == got.postings.count() == index.postings.count()
    assert sorted(got.terms.collect()) == sorted(index.terms.collect()) and got.corpus.first() == index.corpus.first()


@pytest.mark.parametrize(("held", "batched", "literals"), [(1 << 21, 1 << 20, 100), (7, 1 << 20, 2), (1 << 21, 3, 100)])
def test_batch_of_queries(spark, monkeypatch, held, batched, literals):
    index = bm25.of_chunks(some_chunks(spark, 200))
    queries = spark.createDataFrame([(f"q{i % 7}", t) for i, t in enumerate(["parse", "config", "the", "my_func", "x", "doc_7", "7", "none", "py", "src", None, "py", "the", "http"] * 3)] + [("r", "nowhere")], "query_id string, term string")
    want = sorted(map(tuple, bm25.ranked(bm25.score(index, queries), 5).select("query_id", "chunk_idx", "score", "rank").collect()))
    for name, value in (("HELD", held), ("BATCHED", batched), ("LITERALS", literals), ("CHUNKS", 30)):
        monkeypatch.setattr(bm25, name, value)
    got = sorted(map(tuple, bm25.top_many(index, queries, 5).select("query_id", "chunk_idx", "score", "rank").collect()))
    assert got == want and len(got) == 35
    assert bm25.top_many(index, queries.where("term = 'nowhere'"), 5).count() == 0
    alike = [(r.chunk_idx, r.score, r["rank"]) for r in bm25.top(index, ["parse", "config", "the", "py"], 9).collect()]
    monkeypatch.setattr(bm25, "LITERALS", 100 if literals == 2 else 2)
    assert alike == [(r.chunk_idx, r.score, r["rank"]) for r in bm25.top(index, ["parse", "config", "the", "py"], 9).collect()]


def test_a_whole_chunk_as_query_is_looked_up(spark):
    words = [f"w{i}" for i in range(300)]
    index = bm25.build(spark.createDataFrame([(i, words[i : i + 30]) for i in range(290)], "chunk_idx long, tokens array<string>"))
    found = bm25.top(index, words, 7)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "w150" not in plan and "Join Inner" in plan
    want = bm25.ranked(bm25.score(index, spark.createDataFrame([(0, w) for w in words], "query_id int, term string")), 7)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select("chunk_idx", "score", "rank").collect()))


def chunk_table(spark, rows):
    return spark.createDataFrame([(i, f, line, line + 5, c) for i, (f, line, c) in enumerate(rows)], "chunk_idx long, file_path string, start_line int, end_line int, content string")


def hits(spark, *ids):
    return spark.createDataFrame([(i, 1.0, r + 1) for r, i in enumerate(ids)], "chunk_idx long, score double, rank int")


def fused(spark, rows, lex, den, **how):
    out = fusion.fuse(hits(spark, *lex), hits(spark, *den), chunk_table(spark, rows), fusion.FusionOptions(**how)).collect()
    return [(r.file_path, round(r.score, 9)) for r in out]


def test_rrf_and_coherence_golden(spark):
    got = fused(spark, [("a.py", 1, "x"), ("b.py", 1, "x"), ("c.py", 1, "x")], [0, 2], [1, 2])
    assert got[0] == ("c.py", 0.019354839) and dict(got[1:]) == {"a.py": 0.009836066, "b.py": 0.009836066}


def test_symbol_golden(spark):
    got = fused(spark, [("a.py", 1, "def parseConfig(x): pass"), ("b.py", 1, "parseConfig()")], [0], [1], query="parseConfig")
    assert got == [("a.py", 0.055081967), ("b.py", 0.005901639)]


def test_path_stem_golden(spark):
    got = fused(spark, [("src/parse_config.py", 1, "x"), ("src/render.py", 1, "y")], [0], [1], query="parse config")
    assert got == [("src/parse_config.py", 0.019672131), ("src/render.py", 0.009836066)]


def test_saturation_golden(spark):
    got = fused(spark, [("x.py", 1, "a"), ("x.py", 10, "a"), ("x.py", 20, "a"), ("y.py", 1, "a")], [0, 1, 2, 3], [])
    assert [s for _, s in got] == [0.009836066, 0.00834178, 0.004032258, 0.001984127] and got[1][0] == "y.py"


def test_penalty_golden(spark):
    assert fused(spark, [("foo.py", 1, "a"), ("foo_test.py", 1, "a")], [0], [1]) == [("foo.py", 0.009836066), ("foo_test.py", 0.00295082)]
    assert dict(fused(spark, [("foo.py", 1, "a"), ("foo_test.py", 1, "a")], [0], [1], alpha=1.0))["foo_test.py"] > 0.009


def test_promotion_enters_only_matching_files(spark):
    rows = [("src/user.py", 1, "user code"), ("lib/users.py", 5, "class User:"), ("lib/users.py", 5, "class User(dup):"), ("lib/other.py", 7, "class User:")]
    got = fused(spark, rows, [0], [], query="User")
    assert [f for f, _ in got][:1] == ["lib/users.py"] and "lib/other.py" not in dict(got) and len(got) == 2


def test_shared_key_adds_up(spark):
    got = fused(spark, [("a.py", 1, "x"), ("a.py", 1, "y"), ("b.py", 1, "z")], [0, 1, 2], [], rerank=False)
    assert got[0] == ("a.py", round(0.5 * (1 / 61 + 1 / 62), 9)) and len(got) == 2


def test_alpha_is_checked():
    with pytest.raises(ValueError):
        fusion.FusionOptions(alpha=1.5)


def greedy(rows, k):
    """The reference behaviour: pick by penalized score, halved for each earlier pick of the file, with an early stop."""
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    chosen, taken = [], {}
    for i, f, s in order:
        if len(chosen) >= k and s <= min(c[0] for c in chosen):
            break
        n = taken.get(f, 0)
        taken[f] = n + 1
        chosen.append((s * 0.5**n, -len(chosen), i))
    chosen.sort(reverse=True)
    return [(i, round(s, 9)) for s, _, i in chosen[:k]]


def test_saturation_equals_the_greedy_walk(spark):
    rng = random.Random(7)
    for _ in range(3):
        rows = [(i, f"f{rng.randrange(4)}.xyz", round(rng.choice([0.5, 0.25, rng.random()]), 3)) for i in range(25)]
        df = spark.createDataFrame([(f, i, i, s, 1, 1, 0) for i, f, s in rows], "file_path string, start_line int, chunk_idx long, s double, den_rank int, lex_rank int, promoted int")
        got = fusion.saturate(df, True).orderBy(F.desc("score"), F.desc("pen"), "start_line").limit(8).collect()
        assert [(r.chunk_idx, r.score) for r in got] == greedy(rows, 8)


MODEL = np.array([[3, 4], [0, 0], [1, 0], [0, 2]], np.float32)
ENCODE = [([0], [0.6, 0.8]), ([2, 3], [0.4472135955, 0.894427191]), ([99, 0], [0.6, 0.8]), ([], [0, 0]), ([-1, 99, 1000], [0, 0]), ([0, 0], [0.6, 0.8]), ([1], [0, 0])]


def test_encode(spark):
    bags = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(ENCODE)], "key int, ids array<int>")
    model = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(MODEL)], "token_id int, embedding array<float>")
    for got in (V.encode(bags, model, 2), V.encode_arrow(bags, MODEL)):
        for r in got.collect():
            assert np.allclose(r.vector, ENCODE[r.key][1], atol=1e-9)
    mapped = V.encode_arrow(bags, MODEL, np.array([2, 2, 3, 3]), np.array([1.0, 1, 0.5, 2])).collect()
    assert np.allclose({r.key: r.vector for r in mapped}[0], [1, 0])
    assert np.allclose(V.rows(spark.createDataFrame([(7,)], "id int"), model, 2).first().embedding, [0, 0])


def test_dot(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(V.dot(F.col("a"), F.col("b"))).collect()] == [25.0, 0.0, -1.0]


def code_index(spark, vectors=None):
    rows = [("auth.py", 1, "def authenticate(token): return refresh token"), ("auth.py", 4, "def login(user): authenticate(user)"), ("users.py", 1, "class UserService: pass"), ("utils.py", 1, "def format_date(d): pass"), ("copy.py", 1, "class UserService: pass")]
    return CodeIndex.from_chunks(spark, chunk_table(spark, rows), vectors=vectors)


def test_search(spark):
    i = code_index(spark)
    assert i.search("refresh token").first().file_path == "auth.py"
    assert i.search("UserService").columns == ["file_path", "start_line", "end_line", "score", "content"]
    assert {r.file_path for r in i.search("UserService").collect()} >= {"users.py", "copy.py"}
    assert {r.file_path for r in i.search("authenticate", filter_paths=["auth.py"]).collect()} == {"auth.py"}
    for none in (i.search("  "), i.search("zzzunknown"), i.search("token", 0), i.search("token", filter_paths=[]), i.find_related("auth.py", 999), i.find_related("none.py", 1)):
        assert none.count() == 0
    related = [r.file_path for r in i.find_related("users.py", 2).collect()]
    assert "copy.py" in related and "users.py" not in related
    assert i.explain("refresh token").first().hits == "refreshx1 tokenx2"
    assert formatted(i.search("refresh token")).first().line.startswith("auth.py:1-6 score=0.0")
    assert as_json(i.search("refresh token")).first().json.startswith('{"file_path":"auth.py","start_line":1,')


def test_partitions_make_no_difference(spark):
    vectors = spark.createDataFrame([(k, [float(k % 3), 1.0]) for k in range(5)], "chunk_idx long, embedding array<double>")
    i = code_index(spark, vectors)
    a = i.search("authenticate user", vector=[0.3, 0.7]).collect()
    b = CodeIndex.from_chunks(spark, i.chunks.repartition(8), vectors=vectors.repartition(3)).search("authenticate user", vector=[0.3, 0.7]).collect()
    assert a == b and a


def test_save_and_load(spark, tmp_path):
    i = code_index(spark)
    i.save(str(tmp_path))
    assert CodeIndex.load(spark, str(tmp_path)).search("refresh token").collect() == i.search("refresh token").collect()
    with pytest.raises(ValueError):
        CodeIndex.from_chunks(spark, i.chunks, model=object())


def test_percentile():
    assert percentile(list(range(30)), 0.5) == 15 and percentile([3.0], 0.95) == 3.0 and percentile([], 0.5) == 0.0


def test_tokens_of_a_query_on_the_driver(spark):
    texts = ["getHTTPResponse_v2 foo123bar __a__ XMLParser", "Foo::bar \u00fcber caf\u00e9 x\u0130y", "", "_", "a_B 9z __init__ HTTP2Request", "doc_7 parser core"]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").orderBy("i").select(T.tokenize(F.col("x")).alias("t")).collect()]
    assert got == [T.tokens_of(t) for t in texts]


def test_plans_over_a_stored_index(spark, tmp_path, capsys, monkeypatch):
    rows = [(i, f"src/f{i}.py", 1, 6, f"def parse_{i}(config): return token{i % 7}") for i in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_idx long, file_path string, start_line int, end_line int, content string")
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(300)], "chunk_idx long, embedding array<double>")
    CodeIndex.from_chunks(spark, chunks, vectors=vectors).save(str(tmp_path / "i"))
    i = CodeIndex.load(spark, str(tmp_path / "i"), vectors=True)
    i.lexical_hits("parse token3", 5).explain("formatted")
    plan = capsys.readouterr().out
    assert "In(term, [3,parse,token,token3])" in plan and "Join" not in plan and plan.count("Scan parquet") <= 2
    i.chunks.where(T.any_of(F.col("chunk_idx"), list(range(25)))).explain("formatted")
    assert "In(chunk_idx, [0,1,2" in capsys.readouterr().out
    got = [r.file_path for r in i.search("parse token3", 5, vector=[1.0, 0.0]).collect()]
    at_once = plans.AT_ONCE
    monkeypatch.setattr(plans, "AT_ONCE", 0)
    assert len(got) == 5 and got == [r.file_path for r in i.search("parse token3", 5, vector=[1.0, 0.0]).collect()]  # by way of the driver, and distributed
    monkeypatch.setattr(plans, "AT_ONCE", at_once)
    assert i.find_related("src/f3.py", 2, 4).count() == 4 and "src/f3.py" not in {r.file_path for r in i.find_related("src/f3.py", 2, 400).collect()}


def test_fusion_on_the_driver_equals_the_distributed_one(spark):
    rng = random.Random(8)
    paths = ["src/parse_config.py", "tests/test_parse.py", "src/compat/old.py", "a\\\\b\\\\parsers.d.ts", "lib/__init__.py", "docs_src/config.md", "fooBar.js", "x"]
    bodies = ["class parseConfig:\n  pass", "def run():", "x\u00a0=\u00a0function parseConfig(", "type\tFooBar {", "create table parseconfig (", "see parseConfig", "fn fooBar<T>", "func a.b::parseConfig\u0085"]
    rows = [(i, rng.choice(paths), rng.randrange(4), rng.choice(bodies)) for i in range(60)]
    chunks = chunk_table(spark, [r[1:] for r in rows]).cache()
    known = {i: (f, line, c) for i, f, line, c in rows}
    for query in ("parseConfig", "a::parseConfig", "where is parseConfig or fooBar in the config parser", "the", "", None):
        for rerank in (True, False):
            lists = [[(i, round(rng.uniform(0, 3), 1), n + 1) for n, i in enumerate(rng.sample(range(40), k))] for k in (9, 12)]
            options = fusion.FusionOptions(14, query=query, rerank=rerank, alpha=rng.choice((None, 0.0, 1.0)))
            want = fusion.ranking(*(spark.createDataFrame(x, "chunk_idx long, score double, rank int") for x in lists), chunks, options).orderBy("rank").collect()
            got = at_once.ranking(*lists, known, options, chunks)
            assert got == [(r.chunk_idx, r.score) for r in want], (query, rerank)
    assert at_once.ranking([], [], known, fusion.FusionOptions(5, query="parseConfig"), chunks) == []
    chunks.unpersist()


def test_text_functions_on_the_driver(spark):
    paths = ["a/b/c_test.go", "src/test_x.py", "x/testing/y.java", "legacy/z.rb", "examples/e.ts", "a.d.ts", "package-info.java", "__init__.py", ".hidden", "a.b.c", "", "dir/", "a\\\\B2C\\\\HTTPServer_v2.kt", "spec/a.rb", "docs_src/x.py"]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").orderBy("i").select(T.path_stem(F.col("p")).alias("stem"), T.parent_name(F.col("p")).alias("parent"), T.path_parts(F.col("p")).alias("parts"), T.path_penalty(F.col("p")).alias("penalty")).collect()
    assert [(r.stem, r.parent, set(r.parts), round(r.penalty, 9)) for r in got] == [(at_once.path_stem(p), at_once.parent_name(p), at_once.path_parts(p), round(at_once.path_penalty(p), 9)) for p in paths]
