import heapq
import math
import random

import duckdb
import pandas as pd

from sonde.llm import mixing as M


def brute(rows, weights, block, shards, seed, share=0.9):
    """A plain implementation: seats one at a time from the highest quotient."""
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    docs = {}
    for i, t, s in rows:
        docs.setdefault(s or "", []).append((md5(f"{seed}:{'' if i is None else i}"), i, len((t or "").split())))
    total = {s: sum(n for _, _, n in d) for s, d in docs.items()}
    w = {s: (total[s] ** 0.5 * total[s] ** 0.25 if weights is None else weights.get(s, 0.0)) for s in total}
    w = {s: x for s, x in w.items() if x > 0 and total[s] > 0}
    blocks = {s: -(-total[s] // block) for s in w}
    seats, left = dict.fromkeys(w, 0), set(w)
    for _ in range(max(1, math.floor(share * sum(blocks.values()) / shards))):
        left -= {s for s in left if seats[s] * shards >= blocks[s]}
        if not left:
            break
        seats[min(left, key=lambda s: (-w[s] / (2 * seats[s] + 1), s))] += 1
    out = []
    for s, q in seats.items():
        order = sorted(range(blocks[s]), key=lambda b: (md5(f"{seed}:{s}:{b}"), b))[: q * shards]
        at = {b: k % shards for k, b in enumerate(order)}
        run = 0
        for key in sorted({k for k, _, _ in docs[s]}):
            same = [d for d in docs[s] if d[0] == key]
            run += sum(n for _, _, n in same)
            b = max(0, (run - 1) // block)
            out += [(i, s, b, at[b]) for _, i, _ in same if b in at]
    return sorted(out, key=str)


def rows():
    out = [(i, "w " * (i % 13), f"s{i * i % 5}") for i in range(400)]
    return out + [(5, "extra words here", "s0"), (5, "extra words here", "s0"), (None, "no id", "s1"), (900, None, "s2"), (901, "", "s2"), (902, "lonely", None), (903, "", "only_empty"), (904, "long " * 3000, "s3")]


def test_equals_brute_force(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    for weights, block, shards in ((None, 16, 2), (None, 5, 3), ({"s0": 1, "s1": 2.5, "s4": 0.25}, 8, 2), ({}, 8, 2), ({"s0": 0.0}, 8, 2)):
        for share in (0.9, 0.3):
            got = sorted((tuple(r) for r in M.mix_sources(df, weights, block, shards, seed=3, share=share).collect()), key=str)
            assert got == brute(rows(), weights, block, shards, 3, share)


def test_quota_shares_follow_the_weights(spark):
    totals = spark.createDataFrame([("a", 10**6), ("b", 10**6), ("c", 10**6)], "source string, total long")
    q = {r.source: r.quota for r in M.quotas(totals, {"a": 5, "b": 3, "c": 1}, 1000, 1, 0.6).collect()}
    assert q["a"] == 1000 and abs(q["b"] - 600) <= 1 and abs(q["c"] - 200) <= 1


def test_a_small_source_of_high_weight_leaves_the_others_to_go_on(spark):
    totals = spark.createDataFrame([("big", 40_000), ("mid", 8_000), ("tiny", 1_500)], "source string, total long")
    q = {r.source: (r.blocks, r.quota) for r in M.quotas(totals, {"big": 1, "mid": 1, "tiny": 5}, 1000, 4, 0.9).collect()}
    assert q == {"big": (40, 8), "mid": (8, 2), "tiny": (2, 1)}  # 11 seats a shard; tiny and mid have given all
    skewed = spark.createDataFrame([("big", 40_000_000), ("a", 2_000_000), ("b", 2_000_000), ("tiny", 3_000)], "source string, total long")
    q = {r.source: r.quota * 4 / r.blocks for r in M.quotas(skewed, None, 1024, 4).collect()}
    assert q["big"] > 0.85 and min(q["a"], q["b"], q["tiny"]) >= 1


def test_quotas_equal_seats_one_at_a_time(spark):
    rng = random.Random(1)
    for k in range(6):
        n = rng.choice((1, 3, 40))
        totals = {f"s{i}": int(10 ** rng.uniform(0, 7)) for i in range(n)}
        weights = None if k % 2 else {s: rng.choice((1, 1, 2, 0.5, 1e-9)) for s in totals}
        w = {s: math.sqrt(t) * math.sqrt(math.sqrt(t)) if weights is None else weights[s] for s, t in totals.items()}
        blocks, seats, left = {s: -(-t // 100) for s, t in totals.items()}, dict.fromkeys(w, 0), [(-w[s], s) for s in w]
        heapq.heapify(left)
        for _ in range(max(1, math.floor(0.8 * sum(blocks.values()) / 3))):
            if not left:
                break
            s = heapq.heappop(left)[1]
            seats[s] += 1
            if seats[s] * 3 < blocks[s]:
                heapq.heappush(left, (-w[s] / (2 * seats[s] + 1), s))
        got = {r.source: r.quota for r in M.quotas(spark.createDataFrame([*totals.items()], "source string, total long"), weights, 100, 3, 0.8).collect()}
        assert got == seats


def test_partitions_make_no_difference(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    a, b = (sorted((tuple(r) for r in M.mix_sources(df.repartition(n), block_tokens=16, shards=2).collect()), key=str) for n in (1, 7))
    assert a == b


def test_edges_and_stage(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows()], "doc_id long, text string, source string, mix_id int, own_source string")
    kept = M.keep_mixed(df, block_tokens=8, shards=2)
    assert kept.columns == df.columns and 0 < kept.count() <= df.count()
    ids = sorted((tuple(r) for r in M.mix_sources(df, block_tokens=8, shards=2).select("doc_id", "source").collect()), key=str)
    assert sorted(((r.doc_id, r.source or "") for r in kept.collect()), key=str) == ids
    assert M.mix_sources(df.limit(0)).count() == 0 and M.keep_mixed(df.limit(0)).count() == 0


def test_sql(spark):
    documents = pd.DataFrame(rows(), columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    documents["text"] = [t and t * 40 for t in documents["text"]]
    want = duckdb.sql(M.OP7_SQL).fetchall()
    df = spark.createDataFrame([(i, t and t * 40, s) for i, t, s in rows()], "doc_id long, text string, source string")
    got = [tuple(r) for r in M.mix_sources(df).collect()]
    assert want and sorted(got, key=str) == sorted(want, key=str)
