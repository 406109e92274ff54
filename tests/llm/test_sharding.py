import duckdb
import numpy as np
import pandas as pd
import pytest

from sonde.llm import sharding as S


def rows():
    return [(i, "é" * (i * 7 % 90)) for i in range(600)] + [(7, "x" * 500)] * 4 + [(None, "no id"), (None, "no id"), (None, None), (1000, None), (1001, ""), (2000, "y" * 100000)]


@pytest.mark.parametrize("limit", [1, 300, 2500, 20000, 10**9])
def test_equals_sql_and_fits(spark, limit):
    documents = pd.DataFrame(rows(), columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    assert len(documents)
    want = duckdb.sql(S.op6_sql(limit)).fetchall()
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    got = [tuple(r) for r in S.shard(df, limit).select("doc_id", "shard_id", "shard_depth", "n_bytes").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    sizes = {}
    for i, s, d, n in got:
        x = sizes.setdefault(s, [0, set(), d])
        x[0] += n
        x[1].add(i)
    assert all(b <= limit or len(ids) == 1 or d == 32 for b, ids, d in sizes.values())


def test_only_oversized_buckets_split():
    hashes = {5 << 16: (10, 2), 6 << 16: (10, 1), 9 << 24: (100, 3)}

    def sizes(level, under):
        out = {}
        for h, (b, n) in hashes.items():
            if under is None or h >> (32 - S.LEVELS[level - 1]) in under:
                p = h >> (32 - S.LEVELS[level])
                x = out.get(p, (0, 0))
                out[p] = (x[0] + b, x[1] + n)
        return tuple(np.array(x, np.int64) for x in ([*sorted(out)], [out[p][0] for p in sorted(out)], [out[p][1] for p in sorted(out)]))

    leaves = [(int(d), int(p)) for d, p in zip(*S.directory(sizes, 25), strict=True)]
    assert leaves == sorted(leaves, key=lambda x: x[1] << (32 - x[0]))
    assert sum(2.0**-d for d, _ in leaves) == 1.0
    held = {x: [h for h in hashes if h >> (32 - x[0]) == x[1]] for x in leaves}
    assert (32, 9 << 24) in leaves  # three rows of the same bits can't be split
    assert [5 << 16, 6 << 16] in held.values() and sum(map(len, held.values())) == 3


def test_edges(spark):
    df = spark.createDataFrame([(1, "a", 5, "x", 9), (None, None, None, None, None)], "doc_id long, text string, shard_id int, hash_bits string, prefix int")
    out = S.shard(df)
    assert out.columns == ["doc_id", "text", "hash_bits", "prefix", "shard_id", "shard_depth", "n_bytes"]
    assert sorted((r.n_bytes, r.shard_id, r.hash_bits or "") for r in out.collect()) == [(0, 0, ""), (1, 0, "x")]
    assert S.shard(df.limit(0)).count() == 0
