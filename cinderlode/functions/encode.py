"""Tokens and vectors of texts (N13-N14): word pieces over a vocabulary file, mean pooling, unit length; encoders are pluggable."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

UNKNOWN, FIRST, LAST, LENGTH = 100, 101, 102, 512


@functools.cache
def vocabulary(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {line.rstrip("\n"): i for i, line in enumerate(f)}


def pieces(word: str, known: dict[str, int]) -> list[int]:
    """The longest known pieces from the left; one unknown piece if any stretch has none."""
    out, at = [], 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in known), None)
        if end is None:
            return [UNKNOWN]
        out.append(known[("##" if at else "") + word[at:end]])
        at = end
    return out


def basic_words(text: str) -> list[str]:
    """Lower-cased words, every ASCII mark a word of its own."""
    spaced = "".join(f" {c} " if c.isascii() and unicodedata.category(c)[0] in "PS" else c for c in text.lower())
    return spaced.split()


def word_pieces(text: Column, path: str, length: int = LENGTH, instruction: str = "", pad: bool = False) -> Column:
    """Piece ids between the first and last mark, cut to length; a text that is cut loses its last mark.

    instruction: what a query, but no passage, is preceded by. pad: ids are filled with zeros to length; see mask_of.
    """

    @F.pandas_udf(Ty.ArrayType(Ty.IntegerType()))
    def run(s: pd.Series) -> pd.Series:
        known = vocabulary(path)
        lead = [i for w in basic_words(instruction) for i in pieces(w, known)]

        def ids(t):
            told = [FIRST, *lead, *(i for w in basic_words(t or "") for i in pieces(w, known)), LAST][:length]
            return told + [0] * (length - len(told)) if pad else told

        return s.map(ids)

    return run(text)


def mask_of(ids: Column) -> Column:
    """1 where there is a piece, 0 where ids were filled up."""
    return F.transform(ids, lambda i: F.when(i != 0, 1).otherwise(0))


def unit(column: Column) -> Column:
    """A vector at length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(column, lambda x: F.when(norm > 0, x / norm).otherwise(x).cast("float"))


def pooled(token_vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the tokens that the mask keeps, at length one; two-dimensional input is taken as pooled already."""
    mean = token_vectors if token_vectors.ndim == 2 else (token_vectors * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


def embedded(df: DataFrame, key: str, text: str, encoder, dims: int = 384) -> DataFrame:
    """key, embedding by an encoder, a function from a list of texts to an array (texts, dims) that can be sent to the executors."""

    def run(batches):
        for batch in batches:
            x = np.asarray(encoder([t or "" for t in batch.column(1).to_pylist()]), np.float32).reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float32()))], names=["key", "embedding"])

    return df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key string, embedding array<float>")


def hashing_encoder(dims: int = 384):
    """A deterministic encoder without a model: signed hashed words, at length one. For tests and for pipelines without a model."""

    def encode(texts):
        import zlib

        out = np.zeros((len(texts), dims), np.float32)
        for i, t in enumerate(texts):
            for w in basic_words(t):
                h = zlib.crc32(w.encode())
                out[i, h % dims] += 1.0 if h & 0x10000 else -1.0
        return pooled(out, None)

    return encode
