"""Operator 9: token ids packed into fixed-length rows by best-fit decreasing, as binary matrices."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts_to_python

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict = {}

SCHEMA = "part int, pack long, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<{kind}>, doc_offsets array<int>"


def encoding(path: str):
    """The byte-pair encoding whose ranks are in ``path``, loaded once in each process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


class Capacities:
    """Which free capacities 0..size any bin has, in a segment tree that finds the least one at or above a length."""

    def __init__(self, size: int) -> None:
        self.leaf = 1
        while self.leaf <= size:
            self.leaf *= 2
        self.count = [0] * (2 * self.leaf)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, b: int) -> None:
        self.bins[capacity].append(b)
        i = self.leaf + capacity
        while i:
            self.count[i] += 1
            i //= 2

    def take(self, length: int) -> tuple[int, int] | None:
        """Removes and gives (capacity, bin) with the least capacity that is at least ``length``."""
        i = self.leaf + length
        if not self.count[i]:
            while i > 1 and (i % 2 or not self.count[i + 1]):  # up, until there is something to the right
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaf:
                i *= 2
                if not self.count[i]:
                    i += 1
        capacity = i - self.leaf
        b = self.bins[capacity].pop()
        while i:
            self.count[i] -= 1
            i //= 2
        return capacity, b


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers: the longest item first, each into the fullest bin that has room."""
    free, bins = Capacities(size), []
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        got = free.take(lengths[i])
        if got is None:
            bins.append([])
            got = size, len(bins) - 1
        capacity, b = got
        bins[b].append(i)
        if capacity > lengths[i]:
            free.add(capacity - lengths[i], b)
    return bins


def pack(docs: DataFrame, size: int = 2048, group_tokens: int = 4_000_000, tokenizer: str = TOKENIZER, pad: int = 50256, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``size`` token ids: (part, pack, ids, positions, cu_seqlens, doc_ids, doc_offsets).

    ids is a row of the id matrix and positions the position of each token in its segment, which begin anew at 0 with every
    segment; both are little-endian uint16 (uint32 for a larger ``pad`` or ``size``), filled up with ``pad`` and 0.
    cu_seqlens has the cumulative lengths of the segments from 0; segment j is the tokens of doc_ids[j] from
    doc_offsets[j] on. Documents longer than ``size`` are cut into full segments and a rest, so nothing is lost.

    Each task packs its own input in groups of about ``group_tokens`` tokens, best fit decreasing, without a shuffle;
    ``part`` is the task's number, ``pack`` counts its rows. Which documents share a row depends on how the input is split;
    the tokens don't. Null and empty texts have no tokens and no segment. Repeated rows and null ids are packed like others; ids may be
    of any type; ``tokenizer`` is a file that driver and executors find under the same path. Other columns are ignored. An empty table gives no rows.
    """
    kind = "<u2" if max(pad, size) < 1 << 16 else "<u4"

    def rows(items: list[tuple], part: int, first: int, id_type: pa.DataType) -> pa.RecordBatch:
        bins = best_fit([len(t) for _, _, t in items], size)
        ids = np.full((len(bins), size), pad, kind)
        pos = np.zeros((len(bins), size), kind)
        step = np.arange(size, dtype=kind)
        cu, who, offsets = [], [], []
        for r, b in enumerate(bins):
            at = [0]
            for i in b:
                t, end = items[i][2], at[-1] + len(items[i][2])
                ids[r, at[-1] : end] = t
                pos[r, at[-1] : end] = step[: len(t)]
                at.append(end)
            cu.append(at)
            who.append([items[i][0] for i in b])
            offsets.append([items[i][1] for i in b])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(bins), part, np.int32)), pa.array(np.arange(first, first + len(bins))), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.tobytes() for x in pos], pa.binary()), pa.array(cu, pa.list_(pa.int32())), pa.array(who, pa.list_(id_type)), pa.array(offsets, pa.list_(pa.int32()))],
            ["part", "pack", "ids", "positions", "cu_seqlens", "doc_ids", "doc_offsets"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        enc, items, held, first = encoding(tokenizer), [], 0, 0
        id_type = pa.int64()
        for b in batches:
            id_type = b.schema.field(0).type
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                tokens = np.array(enc.encode_ordinary(t), kind)
                items += [(d, o, tokens[o : o + size]) for o in range(0, len(tokens), size)]
                held += len(tokens)
                if held >= group_tokens:
                    out = rows(items, part, first, id_type)
                    first, items, held = first + out.num_rows, [], 0
                    yield from _slices(out)
        if items:
            yield from _slices(rows(items, part, first, id_type))

    return texts_to_python(docs).select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(run, SCHEMA.format(kind=docs.schema[doc_id].dataType.simpleString()))


def _slices(b: pa.RecordBatch, n: int = 1000) -> Iterator[pa.RecordBatch]:
    for i in range(0, b.num_rows, n):
        yield b.slice(i, n)


def write_matrix(packed: DataFrame, path: str) -> None:
    """Writes packed rows as Parquet with binary columns; every file holds the matrices of its tasks."""
    packed.write.mode("overwrite").option("compression", "zstd").parquet(path)


def unpack(packed: DataFrame, dtype: str = "<u2") -> DataFrame:
    """(doc_id, offset, tokens) of every segment: what :func:`pack` was given, for checks of the round trip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, off, tok = [], [], []
            for ids, cu, ds, os in zip(*(b.column(c).to_pylist() for c in ("ids", "cu_seqlens", "doc_ids", "doc_offsets")), strict=True):
                row = np.frombuffer(ids, dtype)
                for j, (d, o) in enumerate(zip(ds, os, strict=True)):
                    who.append(d)
                    off.append(o)
                    tok.append(row[cu[j] : cu[j + 1]].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(who, b.schema.field("doc_ids").type.value_type), pa.array(off, pa.int32()), pa.array(tok, pa.list_(pa.int32()))], ["doc_id", "offset", "tokens"])

    return packed.mapInArrow(run, f"doc_id {packed.schema['doc_ids'].dataType.elementType.simpleString()}, offset int, tokens array<int>")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
