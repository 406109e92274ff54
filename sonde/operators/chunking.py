"""Packing of syntax nodes into chunks of about 750 bytes.

The packing is sequential within a file, so it runs in ``mapInArrow`` over whole files; :func:`merge_adjacent` is also given as a
fold over an array column. Offsets are bytes throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import in_batches
from ..sources.syntax import Node, Provider, provider_for

DESIRED, SMALLEST, DEEPEST, CAP, LOOKBACK = 750, 50, 500, 2000, 300
VERSION = 2
#: Bytes of chunks that a task hands over at once.
AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str

    @property
    def size(self) -> int:
        return self.end - self.start


def pack(node: Node, desired: int = DESIRED, depth: int = 0) -> list[Span]:
    """Siblings are grouped while their sizes add up to ``desired`` at most; a larger node is packed by its own children."""
    kids = [c for c in node.children if c.end > c.start]
    if not kids or depth > DEEPEST or node.end - node.start < SMALLEST:
        return [Span(node.start, node.end, node.kind)]
    out: list[Span] = []
    group: list[Node] = []
    held = 0

    def close() -> None:
        nonlocal held
        if group:
            out.append(Span(group[0].start, group[-1].end, "+".join(n.kind for n in group)))
            group.clear()
        held = 0

    for kid in kids:
        size = kid.end - kid.start
        if group and held + size > desired:
            close()
        if not group and size > desired:
            out += pack(kid, desired, depth + 1)
            continue
        group.append(kid)
        held += size
    close()
    return out


def merge(spans: list[Span], desired: int = DESIRED) -> list[Span]:
    """A left fold that joins neighbours while their sizes add up to ``desired`` at most."""
    out: list[Span] = []
    held = 0
    for s in spans:
        if out and held + s.size <= desired:
            a = out[-1]
            out[-1] = Span(a.start, s.end, a.kind if a.kind == s.kind else f"{a.kind}+{s.kind}")
            held += s.size
        else:
            out.append(s)
            held = s.size
    return out


def cap(span: Span, source: bytes) -> list[Span]:
    """Pieces of at most CAP bytes, cut after the last line feed of the final LOOKBACK bytes where there is one.

    Without a line feed the cut moves back to a character border, so that no code point is split.
    """
    out, at = [], span.start
    while span.end - at > CAP:
        target = at + CAP
        nl = source.rfind(b"\n", target - LOOKBACK, target)
        cut = nl + 1 if nl >= 0 else target
        while nl < 0 and cut > at + 1 and source[cut] & 0xC0 == 0x80:
            cut -= 1
        out.append(Span(at, cut, span.kind))
        at = cut
    return [*out, Span(at, span.end, span.kind)]


def chunk_source(source: str, root: Node, desired: int = DESIRED) -> list[tuple[int, int, int, int, str, str, bool]]:
    """(start_line, end_line, start_byte, end_byte, content, node_type, is_definition) of a parsed file; none for a blank one."""
    if not source.strip():
        return []
    raw = source.encode()
    out, line, seen = [], 1, 0
    for s in (piece for span in merge(pack(root, desired), desired) for piece in cap(span, raw)):
        line += raw.count(b"\n", seen, s.start) if s.start >= seen else -raw.count(b"\n", s.start, seen)
        seen = s.start
        last = line + raw.count(b"\n", s.start, max(s.start, s.end - 1))
        kind = s.kind
        definition = any(w in kind for w in ("class", "constructor", "declaration", "definition", "function", "method"))
        out.append((line, last, s.start, s.end, raw[s.start : s.end].decode(), kind, definition))
    return out


FIELDS = "file_path string, language string, start_line int, end_line int, start_byte int, end_byte int, content string, node_type string, is_definition boolean"


def chunk_batches(batches: Iterator[pa.RecordBatch], provider: Provider | None = None, desired: int = DESIRED) -> Iterator[pa.RecordBatch]:
    """Chunks (FIELDS) of batches of (file_path, language, source), one file after the other, handed over by the megabyte."""
    kinds = (pa.string(), pa.string(), *[pa.int32()] * 4, pa.string(), pa.string(), pa.bool_())
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for b in batches:
        rows, held = [], 0
        for file in zip(*(b.column(c) for c in ("file_path", "language", "source")), strict=True):
            path, lang, source = (x.as_py() for x in file)
            if source is None:
                continue
            for c in chunk_source(source, (provider or provider_for(lang)).parse(source), desired):
                rows.append((path, lang, *c))
                held += c[3] - c[2]
                if held >= AT_ONCE:
                    yield table(rows)
                    rows, held = [], 0
        if rows:
            yield table(rows)


def chunk_files(files: DataFrame, provider: Provider | None = None, desired: int = DESIRED) -> DataFrame:
    """Chunks of (file_path, language, source[, ...]); one file at a time, map-only. Null sources give none.

    Sources come in small batches too, so a task holds little more than its largest file.
    """
    return in_batches(files.select("file_path", "language", "source")).mapInArrow(lambda batches: chunk_batches(batches, provider, desired), FIELDS)


def merge_adjacent(spans: Column, desired: int = DESIRED) -> Column:
    """P4 as an expression over array<struct<start_byte:int,end_byte:int,node_type:string>>."""
    kind = "struct<done:array<struct<start_byte:int,end_byte:int,node_type:string>>,held:int>"
    start = F.from_json(F.lit('{"done":[],"held":0}'), kind)

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc["done"], -1)
        size = s["end_byte"] - s["start_byte"]
        joined = F.struct(last["start_byte"].alias("start_byte"), s["end_byte"].alias("end_byte"), F.when(last["node_type"] == s["node_type"], last["node_type"]).otherwise(F.concat_ws("+", last["node_type"], s["node_type"])).alias("node_type"))
        fits = (F.size(acc["done"]) > 0) & (acc["held"] + size <= desired)
        grown = F.concat(F.slice(acc["done"], F.lit(1), F.greatest(F.size(acc["done"]) - 1, F.lit(0))), F.array(joined))
        return F.struct(F.when(fits, grown).otherwise(F.concat(acc["done"], F.array(s))).alias("done"), F.when(fits, acc["held"] + size).otherwise(size).alias("held"))

    return F.aggregate(spans, start.cast(kind), lambda a, s: step(a, s).cast(kind), lambda a: a["done"])


def merged(files: DataFrame, key: str, spans: str, desired: int = DESIRED) -> DataFrame:
    """P4 over many files: (key, start_byte, end_byte, node_type) of the merged spans of each row, in one pass over its array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [merge([Span(s["start_byte"], s["end_byte"], s["node_type"]) for s in row or ()], desired) for row in b.column(1).to_pylist()]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            cols = [[x.start for f in found for x in f], [x.end for f in found for x in f], [x.kind for f in found for x in f]]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *(pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.string()), strict=True))], [key, "start_byte", "end_byte", "node_type"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, spans).mapInArrow(run, f"{key} {kind}, start_byte int, end_byte int, node_type string")


def lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, start_byte, end_byte, content) of every line of a text, without its line feed; offsets are running sums over the lines."""
    each = files.select(F.col(key).alias(key), F.posexplode(F.split(text, "\n", -1)).alias("n", "content"))
    before = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("content") + 1).over(before), F.lit(0)).cast("int")
    return each.withColumn("start_byte", start).select(key, (F.col("n") + 1).alias("line"), "start_byte", (F.col("start_byte") + F.octet_length("content")).alias("end_byte"), "content")
