"""Operator 10: benchmark decontamination with a generalised suffix automaton over test items."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut, free, lowered, texts_to_python, words


class Automaton:
    """Generalised suffix automaton of token sequences.

    ``link`` is the suffix link and ``size`` the longest string of a state; ``need[s]`` is the least match length that counts
    when the match ends in state s, by the shortest item that holds the state's strings. Most states go on with one token
    only: ``token`` and ``after`` have it and the next state, ``many`` the steps of the others; so a state takes some 40 bytes.
    """

    def __init__(self, items: list[list[int]], least: int, coverage: float, floor: int) -> None:
        self.step, self.link, self.size = [{}], [-1], [0]
        for item in items:
            last = 0
            for t in item:
                last = self._extend(last, t)
        shortest = [1 << 30] * len(self.step)
        for item in items:
            s = 0
            for t in item:
                s = self.step[s][t]
                p = s
                while p > 0 and shortest[p] > len(item):
                    shortest[p] = len(item)
                    p = self.link[p]
        need = [min(least, max(floor, math.ceil(coverage * n))) if n < 1 << 30 else least for n in shortest]
        one = [next(iter(x.items())) if len(x) == 1 else (-1, 0) for x in self.step]
        self.token, self.after = array("q", [t for t, _ in one]), array("q", [s for _, s in one])
        self.many = {s: x for s, x in enumerate(self.step) if len(x) > 1}
        self.link, self.size, self.need = array("q", self.link), array("q", self.size), array("q", need)
        del self.step

    def _new(self, step: dict, link: int, size: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        return len(self.step) - 1

    def _extend(self, last: int, t: int) -> int:
        if t in self.step[last]:
            q = self.step[last][t]
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, t, q)
        cur = self._new({}, 0, self.size[last] + 1)
        p = last
        while p != -1 and t not in self.step[p]:
            self.step[p][t] = cur
            p = self.link[p]
        if p != -1:
            q = self.step[p][t]
            self.link[cur] = q if self.size[q] == self.size[p] + 1 else self._clone(p, t, q)
        return cur

    def _clone(self, p: int, t: int, q: int) -> int:
        c = self._new(dict(self.step[q]), self.link[q], self.size[p] + 1)
        self.link[q] = c
        while p != -1 and self.step[p].get(t) == q:
            self.step[p][t] = c
            p = self.link[p]
        return c

    def spans(self, tokens: list[int]) -> list[tuple[int, int]]:
        """Merged [begin, end) token spans of all matches that are long enough where they end."""
        token, after, many, link, size, need = self.token, self.after, self.many, self.link, self.size, self.need
        s = n = 0
        out: list[tuple[int, int]] = []
        for i, t in enumerate(tokens):
            while True:
                nxt = after[s] if token[s] == t else many[s].get(t) if s in many else None
                if nxt is not None or not s:
                    break
                s = link[s]
                n = size[s]
            if nxt is None:
                n = 0
                continue
            s, n = nxt, n + 1
            # a suffix of the match may belong to a shorter item with a lower limit
            if n >= need[s] or (n > 1 and self._suffix(s, n)):
                b = i + 1 - n if n >= need[s] else i + 1 - self._suffix(s, n)
                while out and out[-1][0] >= b:
                    out.pop()
                if out and out[-1][1] >= b:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((b, i + 1))
        return out

    def _suffix(self, s: int, n: int) -> int:
        s = self.link[s]
        while s > 0:
            if self.size[s] >= self.need[s]:
                return self.size[s]
            s = self.link[s]
        return 0


class Matcher:
    """Automata over disjoint groups of items, each of at most ``group`` tokens, with their vocabulary, and the items below ``floor`` words."""

    def __init__(self, items: list[str | None], least: int = 10, coverage: float = 0.6, floor: int = 6, group: int = 2_000_000) -> None:
        code, _, _, bounds, _ = words(items) if items else (np.zeros(0, np.uint64), None, None, np.zeros(1, np.int64), None)
        self.vocabulary, ids = np.unique(code, return_inverse=True)
        every = sorted({tuple(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a})
        seqs = [s for s in every if len(s) >= floor]
        self.short, self.floor = {s for s in every if len(s) < floor}, floor
        self.least = min([least, *(max(floor, math.ceil(coverage * len(s))) for s in seqs)])
        self.automata, part, size = [], [], 0
        for s in seqs:
            part.append(list(s))
            size += len(s)
            if size >= group:
                self.automata.append(Automaton(part, least, coverage, floor))
                part, size = [], 0
        if part:
            self.automata.append(Automaton(part, least, coverage, floor))

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int, int, int]], int]]:
        """(text, spans as (begin word, end word, begin byte, end byte) in order, words of the text) of every text that has one."""
        for lo, hi in chunks(texts):
            code, start, end, bounds, base = words(texts[lo:hi])
            if not len(code) or not len(self.vocabulary):
                continue
            at = np.minimum(np.searchsorted(self.vocabulary, code), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == code
            found: dict[int, list[tuple[int, int]]] = {}
            if self.automata:
                # a match lies within a run of words that occur in items; shorter runs than the least match can't hold one
                inner = np.zeros(len(code), bool)
                inner[bounds[:-1][bounds[:-1] < len(code)]] = True
                new = np.append(True, (known[1:] != known[:-1]) | inner[1:])
                begin = np.flatnonzero(new)
                stop = np.append(begin[1:], len(code))
                take = known[begin] & (stop - begin >= self.least)
                doc = np.searchsorted(bounds, begin[take], side="right") - 1
                for d, b, e in zip(doc.tolist(), begin[take].tolist(), stop[take].tolist(), strict=True):
                    run = at[b:e].tolist()
                    if hits := [(b + x, b + y) for a in self.automata for x, y in a.spans(run)]:
                        found.setdefault(d, []).extend(hits)
            if self.short:
                for d, b, e in self._short_lines(texts[lo:hi], at, known, start - base[np.searchsorted(bounds, np.arange(len(code)), side="right") - 1], bounds):
                    found.setdefault(d, []).append((b, e))
            for d in sorted(found):
                spans = [(x - bounds[d], y - bounds[d], start[x] - base[d], end[y - 1] - base[d]) for x, y in found[d]]
                yield lo + d, merged([tuple(map(int, s)) for s in spans]), int(bounds[d + 1] - bounds[d])

    def _short_lines(self, texts: list[str | None], at: np.ndarray, known: np.ndarray, offset: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, begin word, end word) of the lines that have exactly the words of an item below ``floor`` words."""
        for d, t in enumerate(texts):
            b, e = int(bounds[d]), int(bounds[d + 1])
            if b == e:
                continue
            ends = np.flatnonzero(np.frombuffer(lowered(t), np.uint8) == 10)
            line = np.searchsorted(ends, offset[b:e])
            first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
            size = np.diff(np.append(first, e - b))
            for x, n in zip(first[size < self.floor].tolist(), size[size < self.floor].tolist(), strict=True):
                if known[b + x : b + x + n].all() and tuple(at[b + x : b + x + n].tolist()) in self.short:
                    yield d, b + x, b + x + n


def merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans (begin word, end word, begin byte, end byte) in order, those that meet or overlap as one."""
    out: list[tuple[int, int, int, int]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            b = out[-1]
            out[-1] = (b[0], max(b[1], s[1]), b[2], max(b[3], s[3]))
        else:
            out.append(s)
    return out


_SPANS = "struct<total:long,at:array<struct<w0:long,w1:long,b0:long,b1:long>>>"


def _finder(docs: DataFrame, benchmark: DataFrame, text: str, item: str, part_mb: float, limits: dict) -> tuple[DataFrame, object]:
    """``docs`` and a function from their batches to what :meth:`Matcher.find` gives for ``text``, over all test items.

    Items of up to ``part_mb`` MB make one matcher, which goes out to all tasks. More are dealt by their hash to parts of about that
    size; each part's matcher passes over the different texts, spans are gathered by the MD5 of the text, and ``docs`` gets
    them in its last column.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("item")).where("item is not null")
    size = items.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    parts = max(1, math.ceil(size / (part_mb * (1 << 20))))
    sent = lambda rows: spark.sparkContext.broadcast(Matcher([r[0] for r in rows.distinct().collect()], **limits))
    if parts == 1:
        m, at = sent(items), docs.columns.index(text)
        return docs, lambda b: m.value.find(b.column(at).to_pylist())
    key, spans = free(docs, "text_md5"), free(docs, "item_spans")
    docs = docs.withColumn(key, F.md5(F.col(text).cast("string").cast("binary")))
    each = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).dropDuplicates(["key"])
    all_ = None
    for k in range(parts):
        m = sent(items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k))

        def run(batches: Iterator[pa.RecordBatch], m=m) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(d, n, s) for d, found, n in m.value.find(b.column(1).to_pylist()) for s in found]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([r[1] for r in rows], pa.int64()), *(pa.array([r[2][i] for r in rows], pa.int64()) for i in range(4))], ["key", "total", "w0", "w1", "b0", "b1"])

        one = cut(texts_to_python(each).mapInArrow(run, "key string, total long, w0 long, w1 long, b0 long, b1 long"))
        all_ = one if all_ is None else all_.union(one)
    found = cut(all_.groupBy("key").agg(F.struct(F.first("total").alias("total"), F.collect_set(F.struct("w0", "w1", "b0", "b1")).alias("at")).alias(spans)))
    docs = docs.join(found.withColumnRenamed("key", key), key, "left").drop(key)
    last = len(docs.columns) - 1

    def known(b: pa.RecordBatch) -> Iterator[tuple[int, list, int]]:
        for d, x in enumerate(b.column(last).to_pylist()):
            if x is not None:
                yield d, merged([(s["w0"], s["w1"], s["b0"], s["b1"]) for s in x["at"]]), x["total"]

    return docs, known


#: MB of test items in one matcher: about a million words, of which the automaton takes some 100 MB in each Python worker.
PART_MB = 6


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "text", part_mb: float = PART_MB, **limits) -> DataFrame:
    """(doc_id, n_spans, longest, removed_words, coverage, spans) of every document that holds a passage of a test item.

    A span is a run of words (lower-cased, without punctuation) that occurs in an item and is at least ``least``
    words long, or at least ``coverage`` of an item that holds it, but never fewer than ``floor`` words. Items of fewer words than
    ``floor`` are too common within sentences: they are spans where they are all the words of a line.
    longest counts the words of the longest (merged) span; coverage is the removed share of the document's words;
    spans lists UTF-8 byte ranges. Null, empty and clean texts give no row, repeated rows give one each, and other
    columns are ignored. Items that are null or have no word are passed over; no items: no rows. Items of more than ``part_mb`` MB
    go in parts, with the same result.
    """
    rows, find = _finder(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), benchmark, "text", item, part_mb, limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(find(b))
            sizes = [[w1 - w0 for w0, w1, _, _ in spans] for _, spans, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array([d for d, _, _ in found], pa.int64())),
                    pa.array([len(n) for n in sizes], pa.int32()),
                    pa.array([max(n) for n in sizes], pa.int32()),
                    pa.array([sum(n) for n in sizes], pa.int32()),
                    pa.array([sum(n) / total for n, (_, _, total) in zip(sizes, found, strict=True)], pa.float64()),
                    pa.array([[{"begin": x, "end": y} for _, _, x, y in spans] for _, spans, _ in found], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
                ],
                ["doc_id", "n_spans", "longest", "removed_words", "coverage", "spans"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return texts_to_python(rows).mapInArrow(run, f"doc_id {kind}, n_spans int, longest int, removed_words int, coverage double, spans array<struct<begin:int,end:int>>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", chars: str | None = None, drop_above: float = 0.8, item: str = "text", part_mb: float = PART_MB, **limits) -> DataFrame:
    """``docs`` without the benchmark passages in ``text``; the columns stay, in one pass without a shuffle while the items fit one part.

    Spans are those of :func:`contamination`; each is cut out with the white space after it. Documents of which more
    than ``drop_above`` of the words are benchmark go altogether. A column ``chars`` gets the new length. Null and
    empty texts, and rows without a passage, stay as they are.
    """
    at = docs.columns.index(text)
    size = docs.columns.index(chars) if chars else None
    names, schema = docs.columns, docs.schema
    rows, find = _finder(docs, benchmark, text, item, part_mb, limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(find(b))
            b = pa.RecordBatch.from_arrays(b.columns[: len(names)], schema=pa.schema([b.schema.field(i) for i in range(len(names))]))
            if not found:
                yield b
                continue
            texts, keep = b.column(at).to_pylist(), np.ones(b.num_rows, bool)
            for d, spans, total in found:
                keep[d] = sum(w1 - w0 for w0, w1, _, _ in spans) <= drop_above * total
                texts[d] = remove(texts[d], [(x, y) for _, _, x, y in spans])
            cols = list(b.columns)
            cols[at] = pa.array(texts, b.schema.field(at).type)
            if size is not None:
                n = cols[size].to_pylist()
                for d, _, _ in found:
                    n[d] = len(texts[d])
                cols[size] = pa.array(n, b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema).filter(pa.array(keep))

    return texts_to_python(rows).mapInArrow(run, schema)


def remove(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the byte ranges ``spans`` (ascending, apart) and the white space that follows each."""
    raw, out, last = text.encode(), [], 0
    for x, y in spans:
        out.append(raw[last:x])
        last = y
        while last < len(raw) and raw[last : last + 1] in b" \t\r\n" and raw[last : last + 1]:
            last += 1
    return b"".join([*out, raw[last:]]).decode()


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
