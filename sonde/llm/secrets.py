"""Operator 3: secrets by the Shannon entropy of sliding windows."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts_to_python

WINDOW = 20
#: Class of a candidate: what it must match as a whole, and the window entropy (bits a character) from which it is a secret.
CLASSES = (("hex", r"(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+", 2.9), ("base64", r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/=_-]+", 3.9))
#: Class of values of upper-case letters and digits, which have fewer symbols to draw from than the mixed ones.
UPPER = ("upper", r"(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+", 3.2)
#: What may stand before the random part of a key, as in sk_live_.
PREFIX = re.compile(r"(?:[A-Za-z]{2,8}[_-]){1,3}")
#: Candidates that hold one of these are examples, counters or hashes that are public by their form.
ALLOWED = (r"(?i)example", r"(?i)dummy", r"(?i)placeholder", r"(?i)x{6}", r"0123456789", r"(?i)abcdefghij", r"^sha(?:1|256|384|512)-")


def window_entropy(s: str, size: int = WINDOW) -> float:
    """Highest entropy, in bits, of any ``size`` consecutive characters; of the whole where it is shorter.

    The sum of n log n over character counts is carried along: a step of the window changes two counts.
    """
    n = min(size, len(s))
    if not n:
        return 0.0
    xlog = [0.0] + [k * math.log2(k) for k in range(1, n + 2)]
    count: dict[str, int] = {}
    total = 0.0
    for ch in s[:n]:
        k = count.get(ch, 0)
        total += xlog[k + 1] - xlog[k]
        count[ch] = k + 1
    least = total
    for old, new in zip(s, s[n:], strict=False):
        if old != new:
            k = count[old]
            total += xlog[k - 1] - xlog[k]
            count[old] = k - 1
            k = count.get(new, 0)
            total += xlog[k + 1] - xlog[k]
            count[new] = k + 1
            least = min(least, total)
    return max(0.0, math.log2(n) - least / n)


class Scanner:
    def __init__(self, window: int = WINDOW, classes=CLASSES, allowed=ALLOWED, allow_list=()) -> None:
        self.window, self.allow_list = window, frozenset(allow_list)
        self.candidate = re.compile(rf"[A-Za-z0-9+/=_-]{{{window},}}")
        self.classes = [(name, re.compile(p), limit) for name, p, limit in classes]
        self.value_classes = [*self.classes[:1], (UPPER[0], re.compile(UPPER[1]), UPPER[2]), *self.classes[1:]]
        self.allowed = re.compile("|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in allowed)) if allowed else None

    def _judge(self, s: str, classes) -> tuple[str, float] | None:
        """Class and entropy of ``s`` if it is a secret."""
        kind = next(((name, limit) for name, p, limit in classes if p.fullmatch(s)), None)
        if kind is None or s in self.allow_list or (self.allowed and self.allowed.search(s)):
            return None
        h = window_entropy(s, self.window)
        return (kind[0], h) if h >= kind[1] else None

    def _values(self, s: str) -> Iterator[tuple[int, str]]:
        """(offset, value) of what stands between the = of a candidate, and of the value without its prefix."""
        for v in re.finditer("[^=]+", s):
            if self.allowed and self.allowed.search(v[0]):
                continue
            prefix = PREFIX.match(v[0])
            for at in (0, prefix.end()) if prefix else (0,):
                if len(v[0]) - at >= self.window:
                    yield v.start() + at, v[0][at:]

    def scan(self, text: str | None) -> Iterator[tuple[int, int, str, float, str]]:
        for m in self.candidate.finditer(text or ""):
            s = m[0]
            if found := self._judge(s, self.classes):
                yield m.start(), m.end(), *found, s
            elif s not in self.allow_list:
                end = 0
                for at, v in self._values(s):
                    if at >= end and (found := self._judge(v, self.value_classes)):
                        end = at + len(v)
                        yield m.start() + at, m.start() + end, *found, v


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, begin, end, kind, entropy, masked) of every secret, in one pass without a shuffle.

    A candidate is a maximal run of at least ``window`` letters, digits and + / = _ -. Its class is the first of ``classes``
    that it matches; it is a secret when some window of it reaches the class's entropy. Candidates on ``allow_list``, or
    that match a pattern of ``allowed``, are passed over. Where a whole candidate is no secret, the values between its = are
    judged in the same way, and without a prefix such as sk_, upper-case ones by a class of their own. begin and end count characters; masked is the first four
    and the length. Null and empty texts and those without a secret give no row; a secret gives a row for each place, and
    repeated rows theirs. Other columns are ignored.
    """
    scanner = Scanner(**how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for begin, end, kind, h, s in scanner.scan(t):
                    at.append(i)
                    rows.append((begin, end, kind, round(h, 6), f"{s[:4]}*{len(s)}"))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "begin", "end", "kind", "entropy", "masked"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return texts_to_python(docs).select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(run, f"doc_id {kind}, begin int, end int, kind string, entropy double, masked string")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def _sql_kind(s: str, upper: bool = False) -> str:
    """Class of ``s`` in SQL; with ``upper`` that of a value."""
    capitals = f"WHEN regexp_full_match({s}, '[A-Z0-9]+') AND regexp_matches({s}, '[0-9]') AND regexp_matches({s}, '[A-Z]') THEN 'upper' " if upper else ""
    return f"CASE WHEN regexp_full_match({s}, '[0-9a-fA-F]+') AND regexp_matches({s}, '[0-9]') AND regexp_matches({s}, '[a-fA-F]') THEN 'hex' {capitals}WHEN regexp_matches({s}, '[0-9]') AND regexp_matches({s}, '[A-Za-z]') THEN 'base64' END"


def _sql_allowed(s: str) -> str:
    return f"regexp_matches({s}, '(?i:example|dummy|placeholder|x{{6}}|abcdefghij)|0123456789|^sha(?:1|256|384|512)-')"


_SQL_ENTROPY = "list_max(list_transform(range(1, length(s) - 18), lambda j: list_entropy(string_split(substr(s, j, 20), ''))))"
_SQL_SECRET = "coalesce(h >= CASE kind WHEN 'hex' THEN 2.9 WHEN 'upper' THEN 3.2 ELSE 3.9 END, false)"
OP3_SQL = f"""
WITH pieces AS (
  SELECT row_number() OVER () AS r, doc_id, string_split_regex(text, '[^A-Za-z0-9+/=_-]') AS p FROM documents),
placed AS (
  SELECT r, doc_id, unnest(p) AS s, unnest(range(1, len(p) + 1)) AS i FROM pieces),
spans AS (
  SELECT r, doc_id, i, s, coalesce(sum(length(s) + 1) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM placed),
runs AS (
  SELECT r, doc_id, i, s, begin, CASE WHEN NOT {_sql_allowed("s")} THEN {_sql_kind("s")} END AS kind FROM spans WHERE length(s) >= 20),
scored AS (SELECT *, CASE WHEN kind IS NOT NULL THEN {_SQL_ENTROPY} END AS h FROM runs),
parts AS (
  SELECT r, i, doc_id, begin, unnest(string_split(s, '=')) AS v, generate_subscripts(string_split(s, '='), 1) AS n FROM scored WHERE NOT {_SQL_SECRET}),
offsets AS (
  SELECT *, begin + coalesce(sum(length(v) + 1) OVER (PARTITION BY r, i ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM parts),
named AS (SELECT *, regexp_extract(v, '^(?:[A-Za-z]{{2,8}}[_-]){{1,3}}') AS name FROM offsets WHERE v <> '' AND NOT {_sql_allowed("v")}),
vals AS (
  SELECT r, i, n, doc_id, 0 AS o, place, v AS s FROM named UNION ALL
  SELECT r, i, n, doc_id, 1 AS o, place + length(name), substr(v, length(name) + 1) FROM named WHERE name <> ''),
kinds AS (SELECT *, {_sql_kind("s", True)} AS kind FROM vals WHERE length(s) >= 20 AND NOT {_sql_allowed("s")}),
judged AS (SELECT *, CASE WHEN kind IS NOT NULL THEN {_SQL_ENTROPY} END AS h FROM kinds),
first AS (SELECT *, row_number() OVER (PARTITION BY r, i, n ORDER BY o) AS nth FROM judged WHERE {_SQL_SECRET}),
found AS (
  SELECT doc_id, begin, s, kind, h FROM scored WHERE {_SQL_SECRET} UNION ALL
  SELECT doc_id, place, s, kind, h FROM first WHERE nth = 1)
SELECT doc_id, CAST(begin AS INTEGER) AS begin, CAST(begin + length(s) AS INTEGER) AS "end", kind, round(h, 6) AS entropy,
       substr(s, 1, 4) || '*' || length(s) AS masked
FROM found
"""
