"""Helpers shared by the training-data operators: lineage cuts and whole-batch word hashing."""

from __future__ import annotations

import tempfile
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_P = 0x9E3779B97F4A7C15
_PI = pow(_P, -1, 1 << 64)
_POW = {"n": 0}
#: Bytes of lower-cased text in ASCII and Latin-1 that belong to words: letters and digits; of the latter's marks see :func:`_words`.
WORD = np.array([(48 <= b <= 57) or (97 <= b <= 122) or b >= 128 for b in range(256)])
#: Blocks of scripts that are written without blanks between words.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def cut(df: DataFrame) -> DataFrame:
    """``df`` behind a reliable checkpoint, in the folder that ``spark.checkpoint.dir`` names.

    Only a local session without that setting gets a folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="sonde-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch for operators that hand whole texts to Python: some 5 MB of documents, with copies in the JVM and the worker.
BATCH = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def texts_to_python(df: DataFrame) -> DataFrame:
    """``df``, whose session makes Arrow batches of BATCH rows at most from now on; a lower setting stays."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ROWS)) <= BATCH:
        conf.set(_ROWS, BATCH)
    return df


def free(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW["n"] < n:
        size = max(n, 1 << 20)
        both = []
        for base in (_P, _PI):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _POW.update(n=size, p=both[0], q=both[1])
    return _POW["p"][:n], _POW["q"]


def lowered(text: str) -> bytes:
    """Lower-cased UTF-8 of the same byte length as the text's own, so that offsets hold in both."""
    low, size = text.lower().encode(), len(text.encode())
    if len(low) != size:
        low = "".join(c.lower() if len(c.lower().encode()) == len(c.encode()) else c for c in text).encode()
    return low


def chunks(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` characters together; a longer text makes a range of its own."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if size and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Of each code point: 0 for what is no word, 1 for letters, digits and marks, 2 for characters that are words of their own."""
    out = np.array([unicodedata.category(chr(c))[0] in "LNM" for c in range(0x110000)], np.uint8)
    for a, b in UNSPACED:
        out[a : b + 1] *= 2
    return out


def _words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word in UTF-8 bytes. Only text beyond Latin-1's letters needs its code points."""
    if not ((buf == 0xC2) | (buf >= 0xC4)).any():
        is_word = WORD[buf]
        if (buf >= 128).any():
            sign = np.flatnonzero((buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7)))  # times and divided by
            is_word[sign] = is_word[sign + 1] = False
        edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
        if is_word[0]:
            edge = np.concatenate([[0], edge])
        return edge[0::2], edge[1::2]
    cp = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind = _classes()[cp]
    at = np.append(0, np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)))
    before, after = np.append(0, kind[:-1]), np.append(kind[1:], 0)
    begin = (kind > 0) & ((kind == 2) | (before != 1))
    end = (kind > 0) & ((kind == 2) | (after != 1))
    return at[:-1][begin], at[1:][end]


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word of each text, vectorised over all of them.

    Gives (hash uint64, start byte, end byte, bounds, base): the words of text i are bounds[i]:bounds[i+1], its
    bytes begin at base[i] of the joined buffer. A word is a maximal run of letters, digits and combining marks of any
    script, lower-cased; in scripts without blanks between words every character is one. A null counts as an empty text.
    """
    parts = [lowered(t) if t else b"" for t in texts]
    base = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=base[1:])
    buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    start, end = _words(buf)
    p, q = _powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p, out=total[1:])
    code = mix((total[end] - total[start]) * q[start])
    return code, start, end, np.searchsorted(start, base), base


#: Bytes, as :func:`is_small` reckons them, up to which a side of a join is broadcast.
BROADCAST = 32 << 20


def is_small(df: DataFrame, limit: int = BROADCAST) -> bool:
    """Whether all rows of ``df``, counted with the bytes of their columns and 32 more each, come to ``limit`` at most."""
    width = F.lit(32)
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            width = width + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            width = width + 16 * F.greatest(F.size(f.name), F.lit(0))
        else:
            width = width + 8
    return (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= limit


def small_join(left: DataFrame, right: DataFrame, on: list[str], how: str, limit: int = BROADCAST) -> DataFrame:
    """Join that broadcasts ``right`` only after a check of its bytes: above ``limit`` it is a shuffled join."""
    return left.join(F.broadcast(right) if is_small(right, limit) else right, on, how)
