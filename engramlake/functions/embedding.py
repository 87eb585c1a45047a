"""Text embeddings behind one seam: any encoder of texts, or a hashing vectoriser that needs no model."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramlake.functions.text import python_tokens

#: Numbers of a vector, and tokens of a text that an encoder sees (fixed values).
DIM, MAX_TOKENS = 384, 512

#: A batch of texts to one vector each; None where there is none.
Encoder = Callable[[Sequence[str]], Sequence[np.ndarray | None]]


def hashing(texts: Sequence[str], dim: int = DIM) -> list[np.ndarray | None]:
    """Unit vectors of signed token counts; a text without tokens has none."""
    out: list[np.ndarray | None] = []
    for t in texts:
        v = np.zeros(dim, np.float32)
        for token in python_tokens(t)[:MAX_TOKENS]:
            h = zlib.crc32(token.encode())
            v[h % dim] += 1 if h & 0x80000000 else -1
        length = float(np.sqrt((v * v).sum()))
        out.append(v / length if length else None)
    return out


def embed(text: Column, encoder: Encoder = hashing) -> Column:
    """array<float> of a text column by an encoder, a batch at a time; null for null."""

    def run(batch: pd.Series) -> pd.Series:
        known = batch.notna().to_numpy()
        out: list[list[float] | None] = [None] * len(batch)
        vectors = encoder(batch[known].tolist())
        for k, v in zip(np.flatnonzero(known), vectors, strict=True):
            out[k] = None if v is None else [float(x) for x in v]
        return pd.Series(out)

    return F.pandas_udf(run, T.ArrayType(T.FloatType()))(text)
