"""Vectors as arrays: products, norms and cosine similarity.

``cosine`` is a Column expression.  ``cosine_udf`` does the same on whole Arrow
batches with one matrix product, for wide vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector]).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """From -1 to 1; null if either has no length or they differ in size."""
    value = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(F.size(a) == F.size(b), _clamped(value))


def _clamped(value: Column) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of two matrices, summed from the first component to the last as
    ``dot`` does, so that equal rows have equal products wherever they lie."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def cosines(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """``cosine`` of all vectors of one list with all of another, NaN where it is null.  Sums go
    from the first component to the last."""
    out = np.full((len(a), len(b)), np.nan)
    sizes, others = (np.array([-1 if n is None else n for n in x.value_lengths().to_pylist()]) for x in (a, b))
    for size in set(sizes[sizes > 0].tolist()) & set(others.tolist()):
        i, j = np.flatnonzero(sizes == size), np.flatnonzero(others == size)
        x, y = (np.asarray(v.take(pa.array(at)).flatten(), dtype=np.float64).reshape(-1, size) for v, at in ((a, i), (b, j)))
        dots, part = np.zeros((len(i), len(j))), np.empty((len(i), len(j)))
        for d in range(size):
            dots += np.multiply.outer(x[:, d], y[:, d], out=part)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[np.ix_(i, j)] = np.clip(dots / np.sqrt(np.multiply.outer(folded(x, x), folded(y, y))), -1, 1)
    return out


def cosine_to(a: Column, query: list[float]) -> Column:
    """Cosine similarity to a fixed vector whose norm is known beforehand."""
    q = np.asarray(query, dtype=np.float64)
    length = float(np.linalg.norm(q))
    if not length:
        return F.lit(None).cast("double")
    value = F.try_divide(dot(a, literal((q / length).tolist())), norm(a))
    return F.when(F.size(a) == len(q), _clamped(value))


def cosine_udf(query: list[float]):
    """A function of one array column, batch by batch."""
    q = np.asarray(query, dtype=np.float64)
    q = q / (np.linalg.norm(q) or np.nan)

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        ok = vectors.map(lambda v: v is not None and len(v) == len(q))
        out = pd.Series(np.nan, index=vectors.index)
        if ok.any():
            m = np.stack(vectors[ok].to_numpy()).astype(np.float64)
            length = np.linalg.norm(m, axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[ok] = np.clip(m @ q / length, -1, 1)
        return out.where(out.notna(), None)

    return score
