"""Injected models: embedding, scoring of pairs, translation; and offline stand-ins that need none."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed_embedding(texts: list[str], size: int = 256) -> np.ndarray:
    """Signed hashing of words and word pairs, with unit length; a text without words is 0."""
    out = np.zeros((len(texts), size))
    for row, text in zip(out, texts, strict=True):
        w = text.lower().split()
        for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]:
            h = zlib.crc32(x.encode("utf-8", "replace"))
            row[h % size] += 1 if h >> 31 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embedded(text: Column, load: Callable[[], Callable[[list[str]], np.ndarray]] = lambda: hashed_embedding) -> Column:
    """A vector for each text; `load` runs once a worker and returns the model."""

    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            yield pd.Series([x.astype(np.float32).tolist() for x in model(part.fillna("").tolist())])

    return F.pandas_udf(vectors, "array<float>")(text)


def overlap_score(queries: list[str], texts: list[str]) -> list[float]:
    """The share of the query's words that the text has."""
    out = []
    for q, t in zip(queries, texts, strict=True):
        a, b = set(q.lower().split()), set(t.lower().split())
        out.append(len(a & b) / len(a) if a else 0.0)
    return out


def reranked(hits: DataFrame, k: int, load: Callable[[], Callable[[list[str], list[str]], list[float]]] = lambda: overlap_score) -> DataFrame:
    """hits (query_id, query, id, text) with ce_score and ce_rank, the k best of each query."""

    def scores(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in parts:
            yield pd.Series(model(q.fillna("").tolist(), t.fillna("").tolist()), dtype=float)

    scored = hits.withColumn("ce_score", F.pandas_udf(scores, "double")("query", "text"))
    w = Window.partitionBy("query_id").orderBy(F.desc("ce_score"), "id")
    return scored.withColumn("ce_rank", F.row_number().over(w)).filter(F.col("ce_rank") <= k)


def translated(text: Column, model: Callable[[str], str] | None = None) -> Column:
    """Each text by the model; without one, null, so the layer adds nothing."""
    if model is None:
        return F.lit(None).cast("string")

    def each(part: pd.Series) -> pd.Series:
        return part.map(lambda x: None if x is None else model(x))

    return F.pandas_udf(each, "string")(text)
