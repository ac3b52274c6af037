"""Embedding texts with a pluggable provider; the default hashes words, needs no model, and is deterministic."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A provider turns a list of texts into a matrix, one row each.
Provider = Callable[[list[str]], np.ndarray]


def hashing_provider(dim: int = 384) -> Provider:
    """Counts of words and pairs of words by signed hash, scaled to length one."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            words = re.findall(r"[a-z]+|\d+", re.sub(r"([a-z])([A-Z])", r"\1 \2", text).lower())
            for w in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)

    return embed


def embed_column(df: DataFrame, text: str, out: str = "embedding", provider: Provider | None = None, most_chars: int = 8192) -> DataFrame:
    """Adds the vectors of a text column; blank and null texts have none. Long texts are cut, as a model's window would."""
    provider = provider or hashing_provider()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            ok = s.map(lambda x: bool(x and x.strip()))
            vectors = iter(provider([x[:most_chars] for x in s[ok]])) if ok.any() else iter(())
            yield pd.Series([next(vectors).tolist() if o else None for o in ok])

    return df.withColumn(out, run(text))
