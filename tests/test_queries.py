import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if not k.startswith(("op", "pipeline"))))
def test_query(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    if name in entry.oracle_sql():
        cur = duck.sql(entry.oracle_sql()[name])
        at = [cur.columns.index(c) for c in sorted(cur.columns)]
        assert sorted(cur.columns) == cols
        assert got == sorted(repr([norm(r[i]) for i in at]) for r in cur.fetchall())
    else:
        assert got


def test_byte_slice_of_odd_texts(spark, tmp_path):
    texts = ["", "\n", "\n\n", "a", "a\n", "é", "a\né", "é\né\n", "日本\n\n本", "x\r\n😀", "😀", "e\u0301\ne\u0301", "a\0\n\0é", "\ufeffa\u2028\n\u0085", " \n ", None]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/*.parquet'")
    got = entry.queries()["p7_byte_slice"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(entry.oracle_sql()["p7_byte_slice"]).fetchall())


def against_sql(spark, folder, name, **tables):
    """Rows of a query over small tables and those of its SQL."""
    con = duckdb.connect()
    for table, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(folder))
    cur = con.sql(entry.oracle_sql()[name])
    at = [cur.columns.index(c) for c in df.columns]
    return sorted(repr([norm(x) for x in r]) for r in df.collect()), sorted(repr([norm(r[i]) for i in at]) for r in cur.fetchall())


def test_pages_of_one_url(spark, tmp_path):
    pages = [(i, f"http://a.example/{i % 3}" if i % 17 else None, "x" * (i % 4) if i % 19 else None) for i in range(60)]
    got, want = against_sql(spark, tmp_path, "j11_cache_hit_miss", pages=(pages, "page_id long, url string, html string"))
    assert got == want and sum("True" in r for r in got) > 20


def test_keywords_given_twice(spark, tmp_path):
    items = [(0, "par thing of core"), (1, "the and"), (2, None), (3, ""), (4, "compat THING theThing of_ of par par"), (5, "th Of e")]
    pages = [(i, f"http://a.example/{i}" if i % 11 else None, "") for i in range(48)]
    got, want = against_sql(spark, tmp_path, "t18_keyword_overlap", benchmark=(items, "item_id long, text string"), pages=(pages, "page_id long, url string, html string"))
    assert got == want and len(got) == 48


@pytest.mark.parametrize("name", ["a1_corpus_stats", "a2_term_df", "a3_term_tf", "a4_bm25_params", "u5_path_overlap", "k1_bm25_batch", "j7_rrf_fuse"])
def test_texts_that_are_missing(spark, tmp_path, name):
    texts = ["the erth of doc_7 tion", None, "", "tion Doc7Parser théParser the", "the the", "\n", None, "erthOf x_y 3d"] * 3
    rows = [(i, t, "en", f"s{i % 2}", 1) for i, t in enumerate(texts)]
    vectors = [(i, [float((i * j) % 5 - 2) for j in range(64)], 0) for i in range(120)]
    items = [(0, "the tion"), (1, None), (2, "doc parser"), (3, "zzz")]
    got, want = against_sql(spark, tmp_path, name, documents=(rows, "doc_id long, text string, lang string, source string, n_chars long"), embeddings=(vectors, "vec_id long, embedding array<float>, label int"), benchmark=(items, "item_id long, text string"))
    assert got == want and got


def test_entry(spark):
    assert entry.entry(spark).count() == 8


def test_entry_without_the_optional_part():
    code = "import sys; sys.modules['sonde.llm'] = None; sys.path.insert(0, '.')\nimport __spark_entry__ as e\nassert len(e.queries()) > 40 and not any(k.startswith('op') for k in e.queries()) and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])
