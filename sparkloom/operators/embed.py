"""Embeddings of nodes: who makes them, where they are kept, and what is still to be made.

An embedder is any object with ``dim``, ``model_id`` and ``embed(texts)``; it is pickled to the executors and called with Arrow batches there.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import VECTOR_COLUMNS
from ..errors import ConfigurationError
from ..functions import codecs
from ..session import map_arrow

BATCH = 128
REMOTE_TIMEOUT_S = 60


class Embedder(Protocol):
    dim: int
    model_id: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Every word moves three components up or down, chosen by its SHA-256: texts that share words are near, without a model."""

    dim: int = 64

    @property
    def model_id(self) -> str:
        return f"hash-{self.dim}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            digests = np.array([list(hashlib.sha256(word.encode()).digest()) for word in text.lower().split()], np.int64).reshape(-1, 32)
            np.add.at(row, digests[:, :3].ravel() % self.dim, (1 - 2 * (digests[:, 16:19] % 2)).ravel())
        return out.tolist()


@dataclass(frozen=True)
class RemoteEmbedder:
    """A service that takes ``{"model", "input"}`` at ``<base_url>/embeddings`` and gives ``{"data": [{"index", "embedding"}]}``."""

    base_url: str
    model_id: str
    dim: int
    key_variable: str | None = None

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        headers = {"Content-Type": "application/json"}
        if self.key_variable and (key := os.environ.get(self.key_variable)):
            headers["Authorization"] = f"Bearer {key}"
        body = json.dumps({"model": self.model_id, "input": texts}).encode()
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/embeddings", body, headers)
        with urllib.request.urlopen(request, timeout=REMOTE_TIMEOUT_S) as answer:
            data = json.load(answer)["data"]
        ordered = {item.get("index", k): item["embedding"] for k, item in enumerate(data)}
        return [ordered[k] for k in sorted(ordered)]


@functools.lru_cache(maxsize=4)
def _local_model(name: str):
    """One model for each worker process, on one thread, as tasks share the machine."""
    try:
        from fastembed import TextEmbedding
    except ImportError as why:
        raise ConfigurationError("The local embedder needs the package fastembed", "Install it on driver and executors, or use provider 'remote' or 'hash'.") from why
    return TextEmbedding(model_name=name, threads=1)


@dataclass(frozen=True)
class LocalEmbedder:
    """A model of the package fastembed, loaded once a worker."""

    model_id: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(x) for x in v] for v in _local_model(self.model_id).embed(texts)] if texts else []


@functools.lru_cache(maxsize=64)
def make_embedder(provider: str | None, model: str = "", dim: int = 64, base_url: str | None = None, key_variable: str | None = None) -> Embedder | None:
    """The embedder of a configuration, the same object for the same one; None without a provider."""
    if provider is None:
        return None
    if provider == "hash":
        return HashEmbedder(dim)
    if provider == "local":
        return LocalEmbedder(model, dim)
    if provider == "remote":
        if not base_url:
            raise ConfigurationError("The remote embedder needs base_url", "Give the root below which /embeddings lies.")
        return RemoteEmbedder(base_url, model, dim, key_variable)
    raise ConfigurationError(f"Unknown embedder {provider}", "Known: hash, local, remote.")


#: Spark's types of the vector columns.
VECTOR_TYPES = {"embedding": "array<float>", "_emb_r": "double", "_emb_code": "binary", "_emb_model": "string"}


def provision(df: DataFrame, dim: int) -> DataFrame:
    """``df`` with the vector columns, null where they are new. Vectors of another size are an error."""
    if "embedding" in df.columns:
        row = df.where(F.col("embedding").isNotNull()).select(F.size("embedding").alias("n")).where(F.col("n") != dim).limit(1).collect()
        if row:
            raise ConfigurationError(f"Vectors of {row[0]['n']} components are stored, the embedder makes {dim}", "Reindex, or use the embedder they were made with.")
    return df.withColumns({c: F.lit(None).cast(VECTOR_TYPES[c]) for c in VECTOR_COLUMNS if c not in df.columns})


def embedded_text(df: DataFrame, key: str) -> Column:
    """The texts of a row, one a line, in the order of its columns; the key's text if it has none."""
    texts = [F.col(f"`{c}`") for c, t in df.dtypes if t == "string" and not c.startswith("_")]
    own = F.col(f"`{key}`").cast("string")
    return F.when(F.coalesce(*texts).isNull(), own).otherwise(F.concat_ws("\n", *texts)) if texts else own


def embed_column(df: DataFrame, text: str, embedder: Embedder, codec: str) -> DataFrame:
    """``df`` with vector columns made from ``text``, which goes."""
    codecs.check_codec(codec)
    names = [c for c in df.columns if c not in (text, *VECTOR_COLUMNS)]
    dim, model = embedder.dim, embedder.model_id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                texts = part.column(text).to_pylist()
                vectors = embedder.embed(texts)
                if len(vectors) != len(texts) or any(len(v) != dim for v in vectors):
                    raise ConfigurationError(f"The embedder gave {len(vectors)} vectors for {len(texts)} texts, or not of {dim} components")
                lengths, units = codecs.split_magnitude(np.asarray(vectors, np.float64).reshape(-1, dim))
                made = [pa.array([[np.float32(x) for x in v] for v in vectors], pa.list_(pa.float32())), pa.array(lengths), pa.array(codecs.encode(units, codec), pa.binary()), pa.array([model] * len(texts))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *made], [*names, *VECTOR_COLUMNS])

    from pyspark.sql import types as T

    kinds = (T.ArrayType(T.FloatType()), T.DoubleType(), T.BinaryType(), T.StringType())
    schema = T.StructType([*(df.schema[c] for c in names), *(T.StructField(c, t) for c, t in zip(VECTOR_COLUMNS, kinds, strict=True))])
    return map_arrow(df.select(*[F.col(f"`{c}`") for c in names], text), run, schema)


def pending_count(df: DataFrame) -> int:
    """Rows without a vector; 0 where the table has no vectors at all."""
    return df.where(F.col("embedding").isNull()).count() if "embedding" in df.columns else 0


def made_pending(df: DataFrame, key: str, embedder: Embedder, codec: str = "fp32", most: int | None = None) -> DataFrame:
    """The rows that have no vector, the first ``most`` by key if given, with one."""
    df = provision(df, embedder.dim)
    pending = df.where(F.col("embedding").isNull())
    if most is not None:
        pending = pending.orderBy(key).limit(most)
    made = embed_column(pending.withColumn("__text", embedded_text(pending, key)), "__text", embedder, codec)
    return made.select(*[F.col(f"`{c}`") for c in df.columns])


def embed_pending(df: DataFrame, key: str, embedder: Embedder, codec: str = "fp32", most: int | None = None) -> DataFrame:
    """``df`` with vectors for rows that have none, the first ``most`` by key if given. Rows that have one are left as they are."""
    made = made_pending(df, key, embedder, codec, most)
    df = provision(df, embedder.dim)
    done = df.where(F.col("embedding").isNotNull())
    if most is not None:
        chosen = df.where(F.col("embedding").isNull()).select(F.col(key).alias("__key")).orderBy("__key").limit(most)
        later = df.where(F.col("embedding").isNull())
        done = done.unionByName(later.join(chosen, later[key] == chosen["__key"], "left_anti"))
    return done.unionByName(made)


def reindex(df: DataFrame, key: str, embedder: Embedder, codec: str = "fp32") -> DataFrame:
    """``df`` with all vectors made anew, whatever it held."""
    return embed_pending(df.drop(*VECTOR_COLUMNS), key, embedder, codec)
