"""Embeddings through an injected provider, in batches; a batch that fails is tried one by one."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.index import missing_embeddings

#: a provider turns texts into vectors of one length
Provider = Callable[[list[str]], list[list[float]]]
BATCH = 10


def hash_provider(size: int = 64) -> Provider:
    """Deterministic unit vectors from hashed character trigrams; for tests and offline use."""

    def one(text: str) -> list[float]:
        v = [0.0] * size
        for i in range(max(len(text) - 2, 1)):
            h = int.from_bytes(hashlib.blake2b(text[i : i + 3].encode(), digest_size=8).digest(), "big")
            v[h % size] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / n for x in v]

    return lambda texts: [one(t) for t in texts]


def checked(vectors: list[list[float]], texts: int) -> list[list[float]]:
    """A reply is one finite, equally long, non-empty vector for each text."""
    if len(vectors) != texts or len({len(v) for v in vectors}) > 1 or any(not v or not all(map(math.isfinite, v)) for v in vectors):
        raise ValueError("the provider's vectors don't fit the texts")
    return vectors


def embed(docs: DataFrame, provider: Provider, name: str, model: str, batch: int = BATCH) -> DataFrame:
    """(doc_id, provider, model, dimensions, embedding, error): a row for each document; failures carry the reason."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            vecs: list = []
            errs: list = []
            for at in range(0, len(texts), batch):
                some = texts[at : at + batch]
                try:
                    vecs += checked(provider(some), len(some))
                    errs += [None] * len(some)
                except Exception:  # noqa: BLE001  then each by itself
                    for t in some:
                        try:
                            vecs += checked(provider([t]), 1)
                            errs.append(None)
                        except Exception as e:  # noqa: BLE001
                            vecs.append(None)
                            errs.append(f"{type(e).__name__}: {e}")
            n = len(ids)
            cols = [pa.array(ids, pa.string()), pa.array([name] * n), pa.array([model] * n), pa.array([len(v) if v else None for v in vecs], pa.int32()), pa.array(vecs, pa.list_(pa.float32())), pa.array(errs, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "provider", "model", "dimensions", "embedding", "error"])

    return docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "doc_id string, provider string, model string, dimensions int, embedding array<float>, error string")


def backfill(docs: DataFrame, embeddings: DataFrame, provider: Provider, name: str, model: str, batch: int = BATCH) -> DataFrame:
    """Embeddings of documents that have none of this provider and model; each candidate is tried once in a run."""
    return embed(missing_embeddings(docs, embeddings, name, model), provider, name, model, batch)
