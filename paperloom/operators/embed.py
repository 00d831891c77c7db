"""Embedding: distinct texts go once through a model behind a protocol, and join back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..schemas import Settings


class Embedder(Protocol):
    """A model that a Python worker builds once and calls with batches of texts."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


@lru_cache(maxsize=100_000)
def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


class HashingEmbedder:
    """The offline default: signed hashed words, scaled to length 1. It claims no quality, only determinism."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for word in re.findall(r"\w+", text.lower()):
                h = word_hash(word)
                row[h % self.dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


EMBEDDERS: dict[str, type] = {"hashing": HashingEmbedder}


def get_embedder(provider: str, **options) -> Embedder:
    if provider not in EMBEDDERS:
        raise ValueError(f"unknown embedding provider {provider!r}; known: {sorted(EMBEDDERS)}")
    return EMBEDDERS[provider](**options)


def embed_texts(df: DataFrame, embedder: Embedder, text_col: str = "text", into: str = "embedding") -> DataFrame:
    """df with the embedding of text_col. Each distinct text is embedded once; null text has no embedding."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_text": batch["_text"], into: list(embedder.embed(batch["_text"].tolist()))})

    texts = df.select(F.col(text_col).alias("_text")).where("_text is not null").distinct()
    vectors = texts.mapInPandas(run, f"_text string, {into} array<double>")
    return df.join(vectors, df[text_col] == vectors["_text"], "left").drop("_text")


def token_estimate(texts: Column, settings: Settings = Settings()) -> Column:
    """Aggregate: words times tokens per word, cut to an integer."""
    return (F.sum(word_count(texts)) * F.lit(settings.tokens_per_word)).cast("long")


def embedding_cost(tokens: Column, local: bool = True, settings: Settings = Settings()) -> Column:
    return F.lit(0.0) if local else tokens / F.lit(1e6) * F.lit(settings.embedding_price)


def embedding_metrics(df: DataFrame, text_col: str = "text", batch_size: int = 32) -> DataFrame:
    """One row: texts, distinct texts, batches and estimated tokens."""
    return df.agg(F.count(text_col).alias("texts"), F.countDistinct(text_col).alias("distinct_texts"), token_estimate(F.col(text_col)).alias("tokens")).withColumn(
        "batches", F.ceil(F.col("distinct_texts") / batch_size)
    )
