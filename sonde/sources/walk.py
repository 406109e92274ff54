"""Source trees: walk, ignore rules and reading.

Spark's file sources drop names that begin with '_' or '.', so the driver lists the files and executors open them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.text import EXTENSIONS, IGNORED_FOLDERS, ignore_regex

IGNORE_FILES = (".gitignore", ".sondeignore")


def read_rules(root: str) -> list[str]:
    """S3: rules of the root's ignore files, without blank lines, comments and negations."""
    out = []
    for name in IGNORE_FILES:
        path = os.path.join(root, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                out += [x for x in (line.strip() for line in f) if x and x[0] not in "#!"]
    return out


def grammar(path: str) -> str | None:
    """By the last extension in any case; null without a dot."""
    _, dot, ext = path.rpartition(".")
    return EXTENSIONS.get(ext.lower()) if dot else None


def list_files(root: str) -> list[tuple[str, str, str, int, int]]:
    """(absolute path, relative path, grammar, mtime in ms, size) of supported files, sorted; ignored folders aren't entered."""
    if not os.path.isdir(root):
        raise ValueError(f"{root} is not a folder")
    pattern = ignore_regex(read_rules(root))
    rule = re.compile(pattern.replace("\\z", "\\Z")) if pattern else None
    base, out = os.path.abspath(root), []

    def skip(rel: str) -> bool:
        return bool(rule and rule.search(rel))

    for folder, dirs, files in os.walk(base):
        rel = os.path.relpath(folder, base).replace(os.sep, "/")
        at = "" if rel == "." else rel + "/"
        dirs[:] = [d for d in dirs if d not in IGNORED_FOLDERS and not os.path.islink(os.path.join(folder, d)) and not skip(at + d)]
        for name in files:
            path = os.path.join(folder, name)
            lang = grammar(name)
            if lang and name not in IGNORED_FOLDERS and not os.path.islink(path) and not skip(at + name):
                st = os.stat(path)
                out.append((path, at + name, lang, int(st.st_mtime * 1000), st.st_size))
    return sorted(out)


def listing(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """(path, file_path, language, mtime_ms, size) of a tree."""
    df = spark.createDataFrame(list_files(root), "path string, file_path string, language string, mtime_ms long, size long")
    return df.repartition(partitions or spark.sparkContext.defaultParallelism)


def read_sources(files: DataFrame) -> DataFrame:
    """The listing with ``source``; null where a file can't be read or isn't UTF-8 (``error`` says why)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, why = [], []
            for path in b.column("path").to_pylist():
                try:
                    with open(path, "rb") as f:
                        text.append(f.read().decode("utf-8"))
                    why.append(None)
                except (OSError, UnicodeDecodeError) as e:
                    text.append(None)
                    why.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string()), pa.array(why, pa.string())], [*b.schema.names, "source", "error"])

    return files.select("path", "file_path", "language", "mtime_ms", "size").mapInArrow(run, "path string, file_path string, language string, mtime_ms long, size long, source string, error string")
