"""Operator 4: near duplicates by SimHash and random bit sampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut, free, mix, small_join, texts_to_python, words

BITS = 256
LANES = BITS // 64
FP = [f"f{i}" for i in range(LANES)]


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) uint64 SimHash of each text's distinct words, and which texts have any word."""
    out, has = np.zeros((len(texts), LANES), np.uint64), np.zeros(len(texts), bool)
    for lo, hi in chunks(texts):
        code, _, _, bounds, _ = words(texts[lo:hi])
        if not len(code):
            continue
        doc = np.repeat(np.arange(hi - lo), np.diff(bounds)).astype(np.uint64)
        key = code ^ mix(doc + np.uint64(1))  # a word counts once in a text
        first = np.unique(key, return_index=True)[1]
        first.sort()
        feature, owner = code[first], doc[first].astype(np.int64)
        seen, at = np.unique(owner, return_index=True)
        votes = np.zeros((len(seen), BITS), np.int32)
        size = np.diff(np.append(at, len(owner)))
        step = 1 << 14
        for i in range(0, len(feature), step):  # bounded memory however long a text is
            f, o = feature[i : i + step], owner[i : i + step]
            lanes = np.stack([mix(f + np.uint64((0xD1B54A32D192ED03 * (j + 1)) % (1 << 64))) for j in range(LANES)], 1)
            bits = np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little")
            who, begin = np.unique(o, return_index=True)
            for w, b, e in zip(np.searchsorted(seen, who), begin, np.append(begin[1:], len(o)), strict=True):
                for s in range(b, e, 255):
                    votes[w] += np.add.reduce(bits[s : min(e, s + 255)], axis=0, dtype=np.uint8)
        sign = (2 * votes > size[:, None]) | ((2 * votes == size[:, None]) & (np.arange(BITS) % 2 == 0))
        out[lo + seen] = np.packbits(sign, axis=1, bitorder="little").view(np.uint64)
        has[lo + seen] = True
    return out, has


def fingerprint_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, f0..f3): one row for each id, of the texts that have a word. Map-only up to the final reduction by id."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, has = fingerprints(b.column(1).to_pylist())
            f = f.view(np.int64)
            ids = b.column(0).filter(pa.array(has))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(f[has, j]) for j in range(LANES))], ["doc_id", *FP])

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    fps = texts_to_python(rows).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in FP))
    return fps.groupBy("doc_id").agg(F.min(F.struct(*FP)).alias("f")).select("doc_id", *(F.col(f"f.{c}").alias(c) for c in FP))


#: Chance that a pair at the limit shares one of the ways in which an oversized bucket is split.
MEET = 0.9


def _sample(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).permutation(BITS)[:n]


def _further(path: int, tables: int, bits: int, extra: int) -> np.ndarray:
    """``extra`` coordinates for one way of splitting the buckets under ``path``; none is among those of the path's table."""
    free_ = np.setdiff1d(np.arange(BITS), _sample(path % tables, bits))
    return np.random.default_rng([path, 1]).permutation(free_)[:extra]


def ways(extra: int, rate: float) -> int:
    """Independent samples of ``extra`` bits of which a pair at ``rate`` differing bits shares one with a chance of MEET."""
    together = (1 - rate) ** extra
    return math.ceil(math.log(1 - MEET) / math.log1p(-together)) if together < MEET else 1


def _project(f: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bits of ``f`` (n, 4) at the coordinates ``at``, folded to a uint64."""
    key = np.zeros(len(f), np.uint64)
    for i, p in enumerate(at):
        key |= ((f[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1)) << np.uint64(i)
    return key


def _lanes(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in FP], 1).astype(np.int64).view(np.uint64) if b.num_rows else np.zeros((0, LANES), np.uint64)


#: path is the table plus ``tables`` times a number for the ways that led to the bucket.
_KEYED = "key long, doc_id long, " + ", ".join(f"{c} long" for c in FP) + ", path long"


def _keyed(key: np.ndarray, ids: np.ndarray, f: np.ndarray, path: int) -> pa.RecordBatch:
    f = f.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids), *(pa.array(np.ascontiguousarray(f[:, j])) for j in range(LANES)), pa.array(np.full(len(key), path, np.int64))], ["key", "doc_id", *FP, "path"])


def buckets(reps: DataFrame, tables: int, bits: int) -> DataFrame:
    """Every fingerprint once for each table, under the hash of the coordinates that the table samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, ids = _lanes(b), b.column("doc_id").to_numpy(zero_copy_only=False)
            for t in range(tables):
                yield _keyed(mix(_project(f, _sample(t, bits)) ^ mix(np.full(len(f), t + 1, np.uint64))), ids, f, t)

    return reps.mapInArrow(run, _KEYED)


def split(big: DataFrame, tables: int, bits: int, cap: int, rate: float) -> DataFrame:
    """Members of oversized buckets under further sampled bits.

    A bucket of n gets 1 + log2(n / cap) bits; as each bit costs recall, it is split in as many ways as :func:`ways` says.
    Every way of every table samples on its own, so that a pair that one of them separates can meet in another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, ids = _lanes(b), b.column("doc_id").to_numpy(zero_copy_only=False)
            key, n, path = b.column("key").to_numpy(zero_copy_only=False).view(np.uint64), b.column("n").to_numpy(zero_copy_only=False), b.column("path").to_numpy(zero_copy_only=False)
            extra = np.ceil(np.log2(n / cap)).astype(int) + 1
            for p, e in np.unique(np.stack([path, extra], 1), axis=0).tolist():
                at = np.flatnonzero((path == p) & (extra == e))
                for w in range(ways(e, rate)):
                    own = p % tables + tables * (1009 * (p // tables) + w + 1)
                    more = _project(f[at], _further(own, tables, bits, e))
                    yield _keyed(mix(mix(key[at] + np.uint64(w + 1)) ^ more), ids[at], f[at], own)

    return big.mapInArrow(run, _KEYED)


def _links(ids: np.ndarray, f: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of one bucket's single-linkage components, all pairs considered; ids ascend."""
    left, out = np.arange(len(ids)), []
    while len(left):
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            near = np.bitwise_count(f[left] ^ f[front.pop()]).sum(1) <= most
            hit, left = left[near], left[~near]
            out.append((np.full(len(hit), ids[root]), ids[hit]))
            front.extend(hit)
    return out


def links(keyed: DataFrame, most: int) -> DataFrame:
    """(a, b): pairs that share a bucket and differ in at most ``most`` bits, or spanning links of large buckets."""

    def complete(key: np.ndarray, ids: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        pairs = []
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
        size = np.diff(np.append(begin, len(key)))
        for s, n in zip(begin[size > 16], size[size > 16], strict=True):
            pairs += _links(ids[s : s + n], f[s : s + n], most)
        small = np.repeat(size <= 16, size)
        for lag in range(1, int(size[size <= 16].max(initial=1))):
            i = np.flatnonzero((key[lag:] == key[:-lag]) & small[lag:])
            near = np.bitwise_count(f[i] ^ f[i + lag]).sum(1) <= most
            pairs.append((ids[i[near]], ids[i[near] + lag]))
        a, b = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in pairs)]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            if not b.num_rows:
                continue
            key, ids, f = b.column("key").to_numpy(zero_copy_only=False), b.column("doc_id").to_numpy(zero_copy_only=False), _lanes(b)
            last = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
            if last:
                held.append((key[:last], ids[:last], f[:last]))
            elif held and held[-1][0][-1] != key[0]:
                yield complete(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            if last:
                yield complete(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            held.append((key[last:], ids[last:], f[last:]))
        if held:
            yield complete(*(np.concatenate(x) for x in zip(*held, strict=True)))

    parts = keyed.select("key", "doc_id", *FP).repartition("key").sortWithinPartitions("key", "doc_id")
    return parts.mapInArrow(run, "a long, b long").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, root) with the least id of each connected component, for every id of ``edges`` (a, b) but the roots.

    Alternates large and small stars until nothing changes; each round's edges are checkpointed.
    """
    edges, before = cut(edges), None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        m = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v"), "m").where("v <> m").distinct()
        w = large.toDF("u", "v")
        m = w.groupBy("u").agg(F.min("v").alias("m"))
        small = w.join(m, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("b"), F.col("m").alias("a")).select("a", "b").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("doc_id"), F.col("a").alias("root"))
        before = now


def in_blocks(big: DataFrame, cap: int) -> DataFrame:
    """Members of oversized buckets in blocks of about ``cap``, each block once with every other: all pairs still share a key, none of more than twice ``cap``."""
    k = F.ceil(F.col("n") / cap)
    own = F.pmod(F.xxhash64("doc_id", "key"), k)
    x = big.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), k - 1)))
    return x.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "doc_id", *FP, "path")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 48, tables: int = 50, bits: int = 14, cap: int = 1024, rate: float | None = None, levels: int = 3) -> DataFrame:
    """(doc_id, keep_id) for every document that is a near copy of one that stays; keep_id is the least id of the group.

    Two texts are near when their 256-bit SimHashes (distinct lower-cased words) differ in at most ``most`` bits;
    groups are the connected components. Texts of one fingerprint are first taken together. The others are put
    in ``tables`` tables by ``bits`` sampled coordinates; buckets of more than ``cap`` fingerprints get additional
    bits, ``levels`` times at most, and what is oversized even then, as thousands of near copies are, is compared in full, block
    by block (:func:`in_blocks`). No pair of a bucket is left out, and no task holds a whole bucket.
    With the defaults a pair at ``most`` bits is met with a chance of 0.92, one at 36 bits with 0.99; where all its
    buckets are split once, with 0.9 and 0.99. Splits are made for pairs at ``rate`` differing bits, ``most`` unless given.

    Ids may be of any type that has an order. Rows of a null id, and texts that are null, empty or without a word, are in no group. Rows
    that share an id are one document (the least fingerprint counts). Case, punctuation and repeated words make no difference. Other columns are
    ignored. An empty table gives no rows.
    """
    fp = cut(fingerprint_table(docs, doc_id, text))
    # the number of a fingerprint is settled by the checkpoint
    reps = cut(fp.groupBy(*FP).agg(F.min("doc_id").alias("least")).withColumn("doc_id", F.monotonically_increasing_id()))
    now, done = buckets(reps.select("doc_id", *FP), tables, bits), None
    rate = most / (BITS - bits) if rate is None else rate
    for level in range(levels + 1):
        big = cut(now.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cap))
        if big.isEmpty():
            break
        fits = small_join(now, big.select("key"), ["key"], "left_anti").select(*now.columns)
        done = fits if done is None else done.union(fits)
        rest = small_join(now, big, ["key"], "inner").select(*now.columns, "n")
        now = split(rest, tables, bits, cap, rate) if level < levels else in_blocks(rest, cap)
    roots = components(links(now if done is None else done.union(now), most))
    grouped = cut(small_join(reps, roots, ["doc_id"], "left").withColumn("root", F.coalesce("root", "doc_id")))
    others = grouped.where("root <> doc_id").select("root").distinct()
    keep = cut(grouped.join(others, "root", "left_semi").groupBy("root").agg(F.min("least").alias("keep_id")))
    found = fp.join(small_join(grouped, keep, ["root"], "left").select(*FP, F.coalesce("keep_id", "least").alias("keep_id")), FP)
    return found.select("doc_id", "keep_id").where("doc_id <> keep_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each group of near duplicates; the columns stay.

    Rows that share a non-null id are one document: one of them stays, the least by text. Rows of a null id stay.
    """
    key, name, n = F.col(doc_id), free(docs, "gone_id"), free(docs, "nth")
    gone = cut(near_duplicates(docs, doc_id, text, **how).select(F.col("doc_id").alias(name)))
    kept = small_join(docs.withColumn(name, key), gone, [name], "left_anti")
    again = cut(docs.groupBy(key.alias(name)).agg(F.count("*").alias(n)).where(F.col(n) > 1).where(F.col(name).isNotNull()).select(name))
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = small_join(kept, again, [name], "left_semi").withColumn(n, F.row_number().over(Window.partitionBy(name).orderBy(text)))
    return small_join(kept, again, [name], "left_anti").select(*docs.columns).union(once.where(F.col(n) == 1).select(*docs.columns))


def op4(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
