"""Embedding models as plug-ins that run in Arrow batches on the executors."""

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class EmbeddingModel(Protocol):
    name: str
    dimension: int
    max_tokens: int

    def embed_batch(self, texts: list[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray: ...


class HashingModel:
    """Normalised counts of hashed words. A deterministic stand-in for tests; it knows nothing of meaning."""

    name, max_tokens = "hashing", 2048

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts):
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
                row[h % self.dimension] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_batch([text])[0]


class SentenceModel:
    """A sentence-transformers model; documents and queries may have prefixes of their own."""

    def __init__(self, name: str, dimension: int, max_tokens: int, document: str = "", query: str = ""):
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise RuntimeError(f"{name} needs the sentence-transformers package and its weights") from e
        self.name, self.dimension, self.max_tokens, self.prefixes = name, dimension, max_tokens, (document, query)
        self.model = SentenceTransformer(name, trust_remote_code=True)
        self.model.max_seq_length = max_tokens

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        return self.model.encode([self.prefixes[0] + t for t in texts], batch_size=4, normalize_embeddings=True)

    def embed_query(self, text: str) -> np.ndarray:
        return self.model.encode([self.prefixes[1] + text], normalize_embeddings=True)[0]


#: Model names, widths, windows and prefixes.
JINA, NOMIC = "jinaai/jina-embeddings-v2-base-code", "nomic-ai/nomic-embed-text-v1.5"
MODELS = {
    "jina": lambda: SentenceModel(JINA, 768, 2048),
    "nomic": lambda: SentenceModel(NOMIC, 768, 2048, "search_document: ", "search_query: "),
    "hashing": HashingModel,
}
MODELS |= {JINA: MODELS["jina"], NOMIC: MODELS["nomic"]}


def create_model(key: str) -> EmbeddingModel:
    """ValueError for a key that isn't registered; add your own to MODELS."""
    if key not in MODELS:
        raise ValueError(f"unknown embedding model: {key}")
    return MODELS[key]()


def embedded(text: Column, key: str) -> Column:
    """Embeddings of a text column; the model is loaded once for each Python worker's run over a partition."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = create_model(key)
        for texts in batches:
            yield pd.Series(list(model.embed_batch([t or "" for t in texts])))

    return embed(text)
