"""Pluggable text embedders."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Words whose vectors a worker remembers: about 110 MB of 64 dimensions.
REMEMBERED = 1 << 17


@lru_cache(maxsize=REMEMBERED)
def _token_vector(word: str, dim: int) -> np.ndarray:
    seed = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big")
    return np.random.default_rng(seed).standard_normal(dim)


def first_pooled(matrix: np.ndarray) -> np.ndarray:
    return matrix[0]


def average_pooled(matrix: np.ndarray) -> np.ndarray:
    return matrix.mean(axis=0)


@dataclass(frozen=True)
class Embedder:
    """Turns texts to unit vectors. The built-in one averages a pseudo-random vector per word, so equal words give
    equal directions; a model is plugged in as ``encode``: texts to a matrix."""

    dim: int = 64
    prefix: str = ""
    pool: Callable[[np.ndarray], np.ndarray] = average_pooled
    encode: Callable[[list[str]], np.ndarray] | None = None

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        texts = [self.prefix + (t or "") for t in texts]
        if self.encode is not None:
            rows = list(self.encode(texts))
        else:
            rows = []
            for t in texts:
                words = t.lower().split()
                rows.append(self.pool(np.array([_token_vector(w, self.dim) for w in words])) if words else np.zeros(self.dim))
        out = []
        for r in rows:
            n = float(np.sqrt(r @ r))
            if not np.isfinite(n):
                raise ValueError("vector has no finite norm")
            out.append((r / n if n > 0 else r).astype(np.float32))
        return out


#: Embedders by name, as tenants choose them.
REGISTRY: dict[str, Embedder] = {"hashing-64": Embedder(), "hashing-128": Embedder(dim=128)}


def embedded(text: Column, embedder: Embedder) -> Column:
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(embedder(texts.tolist()))

    return run(text)
