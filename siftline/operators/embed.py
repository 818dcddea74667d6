"""Vectors for texts.  Both embedders add an array<float> column."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from http.client import HTTPException
from itertools import chain
from typing import Protocol
from urllib.error import HTTPError

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions import text as X


class Embedder(Protocol):
    """add gives every row a vector or, in the column error, the reason why it has none."""

    dimensions: int

    def add(self, df: DataFrame, text: str, out: str) -> DataFrame: ...

    def one(self, text: str) -> list[float]: ...


#: Of each text its vector, or None and the reason.
Vectors = Callable[[list[str | None]], tuple[list[Sequence[float] | None], list[str | None]]]


def md5_bucket(word: Column, dimensions: int) -> Column:
    return (F.conv(F.left(F.md5(word.cast("binary")), F.lit(8)), 16, 10).cast("bigint") % dimensions).cast("int")


def hashed_counts(text: Column, dimensions: int) -> Column:
    """How many words of a text fall into each of the buckets, as an array."""

    def of(buckets: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.size(F.filter(buckets, lambda b: b == d)))
        return runs

    return X.let(F.transform(X.words(text), lambda w: md5_bucket(w, dimensions)), of)


class _Buckets(dict):
    """Bucket of each word, kept for words that come again."""

    def __init__(self, dimensions: int) -> None:
        self.dimensions = dimensions

    def __missing__(self, word: str) -> int:
        self[word] = k = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dimensions
        return k


@dataclass
class HashEmbedder:
    """Feature hashing, of length 1.  A stand-in where no model can be reached: the
    same text always has the same vector."""

    dimensions: int = 64

    def _vectors(self, texts: list[str | None]) -> np.ndarray:
        words = [(t or "").split() for t in texts]
        bucket = _Buckets(self.dimensions)
        flat = np.fromiter(map(bucket.__getitem__, chain.from_iterable(words)), dtype=np.int64)
        row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        out = np.bincount(row * self.dimensions + flat, minlength=len(texts) * self.dimensions).reshape(len(texts), self.dimensions).astype(float)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=np.zeros_like(out), where=length > 0).astype(np.float32)

    def one(self, text: str) -> list[float]:
        return self._vectors([text])[0].tolist()

    def add(self, df: DataFrame, text: str = "content", out: str = "embedding") -> DataFrame:
        return add_vectors(df, text, out, lambda texts: (self._vectors(texts), [None] * len(texts)))


@dataclass
class HttpEmbedder:
    """A service with the widespread ``POST /v1/embeddings`` interface.  Each request
    holds a batch of texts.  A single text is tried again with doubling pauses; for rows,
    a request that fails gives its rows the reason, and trying again is left to who wrote
    them.  Where the service refuses a request for what is in it (it answers, but not
    well), the batch is halved until the texts stand alone that it refuses."""

    base_url: str
    model: str
    api_key: str = ""
    dimensions: int = 768
    timeout_seconds: float = 60.0
    max_retries: int = 3
    batch: int = 32
    pause: float = 1.0  # times the usual pauses

    def _ask(self, texts: list[str]) -> list[list[float]]:
        """One request.  An answer that is cut short, malformed or of the wrong number or
        size is a ValueError."""
        body = json.dumps({"model": self.model, "input": texts}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/v1/embeddings", body, headers)
        with urllib.request.urlopen(request, timeout=self.timeout_seconds) as answer:
            try:
                found = sorted(json.load(answer)["data"], key=lambda d: d.get("index", 0))
                vectors = [d["embedding"] for d in found]
                good = len(vectors) == len(texts) and all(len(v) == self.dimensions for v in vectors)
            except (HTTPException, ValueError, KeyError, TypeError, AttributeError) as e:
                raise ValueError(f"malformed answer: {e}") from e
        if not good:
            raise ValueError("wrong number or size of vectors")
        return vectors

    def one(self, text: str) -> list[float]:
        for attempt in range(1, self.max_retries + 1):
            try:
                return self._ask([text])[0]
            except (OSError, HTTPException, ValueError) as e:
                if attempt == self.max_retries:
                    raise OSError(f"embedding failed {attempt} times: {e}") from e
                time.sleep(self.pause * X.backoff_seconds(attempt))
        raise AssertionError

    def _each(self, texts: list[str]) -> tuple[list[list[float] | None], list[str | None]]:
        try:
            return self._ask(texts), [None] * len(texts)
        except (OSError, HTTPException, ValueError) as e:
            refused = isinstance(e, ValueError) or (isinstance(e, HTTPError) and 400 <= e.code < 500 and e.code not in (401, 403, 404, 408, 429))
            if not refused or len(texts) == 1:
                return [None] * len(texts), [str(e)] * len(texts)
        half = len(texts) // 2
        a, b = self._each(texts[:half]), self._each(texts[half:])
        return a[0] + b[0], a[1] + b[1]

    def add(self, df: DataFrame, text: str = "content", out: str = "embedding") -> DataFrame:
        def vectors(texts: list[str | None]) -> tuple[list[list[float] | None], list[str | None]]:
            parts = [self._each([t or "" for t in texts[i : i + self.batch]]) for i in range(0, len(texts), self.batch)]
            return [v for p in parts for v in p[0]], [e for p in parts for e in p[1]]

        return add_vectors(df, text, out, vectors)


def add_vectors(df: DataFrame, text: str, out: str, vectors: Vectors) -> DataFrame:
    """df with the columns out (array<float>) and error, in Arrow batches."""
    df = df.drop(out, "error")
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, len(whole), 512):
                batch = whole.slice(begin, 512)
                found, errors = vectors(batch.column(at).to_pylist())
                if isinstance(found, np.ndarray):
                    offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
                    lists = pa.ListArray.from_arrays(offsets, pa.array(found.reshape(-1), pa.float32()))
                else:
                    lists = pa.array(found, pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(errors, pa.string())], names=[*batch.schema.names, out, "error"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())]))
