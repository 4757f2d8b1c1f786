"""Seams for models: embedding, extraction and answering.

A seam is a small object that is sent to the executors; rows go through it in
Arrow batches. The stand-ins are deterministic and need no model and no network.
"""

from __future__ import annotations

import zlib
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LlmClient(Protocol):
    def complete(self, prompt: str) -> str: ...


class Embedder(Protocol):
    def embed(self, text: str) -> list[float]: ...


class ExtractiveStub:
    """Answers with the first sentence of the evidence."""

    def complete(self, prompt: str) -> str:
        evidence = prompt.partition("\nEVIDENCE:\n")[2]
        return evidence.split(". ")[0].strip()


class HashingEmbedder:
    """Unit vectors of hashed words."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, text: str) -> list[float]:
        v = np.zeros(self.dim)
        for w in text.lower().split():
            h = zlib.crc32(w.encode())
            v[h % self.dim] += 1 if h >> 31 else -1
        size = np.linalg.norm(v)
        return (v / size if size else v).tolist()


def embed(chunks: DataFrame, embedder: Embedder, text: str = "chunk", out: str = "embedding") -> DataFrame:
    """Adds a vector column."""

    @F.pandas_udf("array<double>")
    def run(texts):
        return texts.fillna("").map(embedder.embed)

    return chunks.withColumn(out, run(F.col(text)))


def complete(prompts: DataFrame, client: LlmClient, prompt: str = "prompt", out: str = "answer") -> DataFrame:
    """Adds a column of completions."""

    @F.pandas_udf("string")
    def run(texts):
        return texts.fillna("").map(client.complete)

    return prompts.withColumn(out, run(F.col(prompt)))
