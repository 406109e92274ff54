"""Model files: safetensors with a static embedding matrix."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class StaticModel:
    """F32 matrix [vocab, dim], with an optional row for each id and an optional weight for each id."""

    embeddings: np.ndarray
    mapping: np.ndarray | None = None
    sif: np.ndarray | None = None

    @classmethod
    def load(cls, path: str) -> StaticModel:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, raw: bytes) -> StaticModel:
        if len(raw) < 8:
            raise ValueError("too short for a safetensors file")
        (n,) = struct.unpack_from("<Q", raw)
        if n > len(raw) - 8:
            raise ValueError("the header is longer than the file")
        try:
            header = json.loads(raw[8 : 8 + n])
        except ValueError as e:
            raise ValueError("the header isn't JSON") from e
        body = raw[8 + n :]

        def tensor(name: str, kind: str, ndim: int):
            t = header.get(name)
            if not isinstance(t, dict) or t.get("dtype") != kind or len(t.get("shape", ())) != ndim:
                return None
            a, b = t["data_offsets"]
            dtype = {"F32": "<f4", "I64": "<i8", "F64": "<f8"}[kind]
            if not 0 <= a <= b <= len(body) or b - a != int(np.prod(t["shape"])) * np.dtype(dtype).itemsize:
                raise ValueError(f"tensor {name} lies outside of the file or doesn't have its shape's size")
            return np.frombuffer(body[a:b], dtype).reshape(t["shape"])

        matrix = tensor("embeddings", "F32", 2)
        for name in header:
            if matrix is None and name != "__metadata__":
                matrix = tensor(name, "F32", 2)
        if matrix is None:
            raise ValueError("no two-dimensional F32 tensor")
        mapping, sif = tensor("mapping", "I64", 1), tensor("weights", "F64", 1)
        rows = len(matrix)
        return cls(matrix, mapping if mapping is not None and len(mapping) == rows else None, sif if sif is not None and len(sif) == rows else None)

    def row(self, i: int) -> np.ndarray:
        return self.embeddings[i] if 0 <= i < len(self.embeddings) else np.zeros(self.embeddings.shape[1], np.float32)

    def encode(self, ids: list[int]) -> np.ndarray:
        keep = np.array([i for i in ids if 0 <= i < len(self.embeddings)], int)
        at = keep if self.mapping is None else self.mapping[keep]
        ok = (at >= 0) & (at < len(self.embeddings))
        keep, at = keep[ok], at[ok]
        if not len(keep):
            return np.zeros(self.embeddings.shape[1])
        w = 1.0 if self.sif is None else self.sif[keep][:, None]
        v = (self.embeddings[at].astype(float) * w).mean(0)
        n = np.linalg.norm(v)
        return v / n if n > 0 else np.zeros_like(v)

    def table(self, spark: SparkSession) -> DataFrame:
        """model (token_id, embedding, mapping, sif) for joins."""
        rows = [(i, [float(x) for x in v], int(self.mapping[i]) if self.mapping is not None else i, float(self.sif[i]) if self.sif is not None else 1.0) for i, v in enumerate(self.embeddings)]
        return spark.createDataFrame(rows, "token_id int, embedding array<float>, mapping int, sif double")
