"""Search sessions: one index for each source tree, built when it is first asked for."""

from __future__ import annotations

import os
import threading
import uuid

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from ..functions.wordpiece import WordPiece
from ..sources.model_files import StaticModel
from ..sources.store import ChunkStore
from .index import CodeIndex


class SearchError(Exception):
    """A request that failed; ``__cause__`` has the reason."""


class SearchSession:
    """C11-C15. Model and tokenizer files come as a pair or not at all."""

    def __init__(self, spark: SparkSession, model_path: str | None = None, tokenizer_path: str | None = None, store_folder: str | None = None) -> None:
        if (model_path is None) != (tokenizer_path is None):
            raise ValueError("give both a model and its tokenizer, or neither")
        self.spark, self.store_folder = spark, store_folder
        self.model = StaticModel.load(model_path) if model_path else None
        self.tokenizer = WordPiece.load(tokenizer_path) if tokenizer_path else None
        self._indexes: dict[str, CodeIndex] = {}
        self._lock, self._locks = threading.Lock(), {}

    def index(self, path: str, timeout: float | None = None) -> CodeIndex:
        """The index of a tree. After ``timeout`` seconds the jobs that build it are cancelled and the request fails (C11)."""
        root = os.path.abspath(path)
        with self._lock:
            lock = self._locks.setdefault(root, threading.Lock())
        with lock:  # a request waits for a build that is under way
            if root not in self._indexes:
                self._indexes[root] = self._within(timeout, lambda: self._build(root), f"can't index {root}")
            return self._indexes[root]

    def _build(self, root: str) -> CodeIndex:
        store = ChunkStore(self.spark, os.path.join(self.store_folder, os.path.basename(root))) if self.store_folder else None
        return CodeIndex.from_path(self.spark, root, store=store, model=self.model, tokenizer=self.tokenizer).cache()

    def _within(self, timeout: float | None, work, what: str):
        """What ``work`` gives; any failure of it, and running out of time, is a SearchError."""
        sc, tag = self.spark.sparkContext, f"sonde-{uuid.uuid4().hex}"
        late = threading.Event()

        def cancel() -> None:
            late.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(timeout, cancel) if timeout is not None else None
        sc.addJobTag(tag)
        try:
            if timer:
                timer.daemon = True
                timer.start()
            got = work()
            if late.is_set():
                raise TimeoutError(f"it took more than {timeout} s")
            return got
        except Exception as e:
            raise SearchError(f"{what}: it took more than {timeout} s" if late.is_set() else f"{what}: {e}") from e
        finally:
            if timer:
                timer.cancel()
            sc.removeJobTag(tag)

    def prewarm(self, path: str, quiet: bool = False, wait: bool = True) -> bool:
        """Builds a tree's index; without ``wait`` in the background, where a failure is left for the first request to meet."""
        if not wait:
            InheritableThread(target=lambda: self.prewarm(path, quiet=True), daemon=True).start()
            return True
        try:
            self.index(path)
        except SearchError:
            if not quiet:
                raise
            return False
        return True

    def search(self, query: str, path: str, top_k: int = 8, timeout: float | None = None, **how) -> DataFrame:
        return self._asked(lambda i: i.search(query, top_k, **how), path, timeout)

    def find_related(self, file: str, line: int, path: str, top_k: int = 8, timeout: float | None = None) -> DataFrame:
        """``file`` may be absolute or relative to the tree."""
        root = os.path.abspath(path)
        rel = os.path.relpath(file, root) if os.path.isabs(file) else file
        return self._asked(lambda i: i.find_related(os.path.normpath(rel).replace(os.sep, "/"), line, top_k), path, timeout)

    def _asked(self, ask, path: str, timeout: float | None) -> DataFrame:
        """Up to AT_ONCE results an index has run the request when it returns, so that failures of its jobs are met here too."""
        index = self.index(path, timeout)
        return self._within(timeout, lambda: ask(index), "the request failed")

    def refresh(self, path: str) -> None:
        """Drops and rebuilds a tree's index; unchanged files come from the chunk store."""
        old = self._indexes.pop(os.path.abspath(path), None)
        if old:
            old.unpersist()
        self.prewarm(path, quiet=True)

    def shutdown(self) -> None:
        for i in self._indexes.values():
            i.unpersist()
        self._indexes.clear()
