"""Embedding as a plug-in: batches of texts to vectors inside Arrow tasks, with retries."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.runtime import ship, small_batches
from lakequill.schema import EMBED_BATCH

RETRIES, FIRST_WAIT, MOST_WAIT = 5, 0.5, 30.0


class EmbeddingError(RuntimeError):
    """status: of the service's answer; 401 and 403 aren't tried again, 429 and 5xx are."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


class Embedded(NamedTuple):
    """What an embedder may return instead of vectors alone: also the tokens that its service counted."""

    vectors: list[list[float]]
    tokens: int = 0


def vectors_of(got) -> list[list[float]]:
    return got.vectors if isinstance(got, Embedded) else got


def hash_embedder(width: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in: a unit vector that depends on the text alone."""
    def embed(texts):
        out = []
        for t in texts:
            v = np.full(width, 0.1, np.float32)
            v[len(t.encode()) % width] += 1.0
            for b in hashlib.sha256(t.encode()).digest()[:8]:
                v[b % width] += 0.5
            out.append((v / np.linalg.norm(v)).tolist())
        return out

    return embed


def with_retry(embed, texts, wait=time.sleep):
    """embed(texts), again after 429 and server errors: waits double from half a second to 30, with jitter, five tries in all."""
    for attempt in range(1, RETRIES + 1):
        try:
            return embed(texts)
        except EmbeddingError as e:
            if not (e.status == 429 or (e.status or 0) >= 500) or attempt == RETRIES:
                raise
            pause = min(FIRST_WAIT * 2 ** (attempt - 1), MOST_WAIT)
            wait(min(pause + random.random() * pause / 2, MOST_WAIT))


def embed_chunks(chunks: DataFrame, embed, model: str, width: int, batch: int = EMBED_BATCH) -> DataFrame:
    """chunks with embedding_model, vector, request_tokens and request_seconds; texts go to embed in requests of `batch` at most, in order. A request's tokens and seconds stand with its first row, so that sums count each request once, however often tasks are tried."""
    ship(chunks.sparkSession)
    small_batches(chunks.sparkSession)

    @F.arrow_udf("vector array<float>, tokens long, seconds double")
    def vectors(body):
        import pyarrow as pa

        out, used, took = [np.zeros((0, width), np.float32)], [], []
        for i in range(0, len(body), batch):
            texts, began = body.slice(i, batch).to_pylist(), time.monotonic()
            answer = with_retry(embed, texts)
            took += [time.monotonic() - began] + [None] * (len(texts) - 1)
            got = vectors_of(answer)
            if len(got) != len(texts) or any(len(v) != width for v in got):
                raise EmbeddingError(f"not {len(texts)} vectors of {width} components")
            out.append(np.array(got, np.float32).reshape(len(texts), width))
            used += [getattr(answer, "tokens", 0)] + [0] * (len(texts) - 1)
        flat = pa.array(np.concatenate(out).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(body) + 1, dtype=np.int32) * width), flat)
        return pa.StructArray.from_arrays([lists, pa.array(used, pa.int64()), pa.array(took, pa.float64())], ["vector", "tokens", "seconds"])

    own = chunks.withColumn("embedding_model", F.lit(model)).withColumn("_e", vectors("body"))
    return own.withColumn("vector", F.col("_e.vector")).withColumn("request_tokens", F.col("_e.tokens")).withColumn("request_seconds", F.col("_e.seconds")).drop("_e")


def token_usage(embedded: DataFrame) -> DataFrame:
    """One row: the tokens of all requests."""
    return embedded.agg(F.coalesce(F.sum("request_tokens"), F.lit(0)).alias("total_tokens"))
