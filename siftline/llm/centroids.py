"""k-means over integer vectors with partial-distance search.

A component x becomes floor(scale * x), so all sums and distances are exact whatever the
order of rows.  In each round a task holds its vectors against the centroids in order of
their numbers: the squared differences of the dimensions of most variance come first, and
a vector leaves a centroid as soon as its partial sum is strictly above its best distance;
what is left finishes all dimensions.  Tasks send one row of sums for each cluster; the
driver holds the k centroids alone, so a lost executor costs one task of one round.

Kept are vectors of the right size without null, NaN or infinite components; null vectors
go.  Vectors whose squared distances might not fit in a long (a component of BOUND or more
after scaling) end the run with an error that says so, as no right number can be returned.
Equal distances go to the smaller number; of vectors alike in hash the least in its
components comes first.  Null ids count as the empty string in the hash.  Repeated rows
count each time.  With fewer kept vectors than centroids there are fewer centroids; an
empty table gives an empty one.  Only the id and the vector are read, so no other name
can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import cut

DIMENSIONS = 64
CENTROIDS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
#: Dimensions that are added before vectors are given up again.
STEP = 8
#: 64 * (2 * BOUND) ** 2 is below 2 ** 63.
BOUND = 2**27


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as longs."""
    error = F.raise_error(F.lit(f"a component is too large: squared distances of {BOUND}/{scale} and more don't fit in a long"))

    def of(x: Column) -> Column:
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double")) * scale >= BOUND, error.cast("bigint")).otherwise(y.cast("bigint"))

    return F.transform(vector, of)


def kept_vectors(rows: DataFrame, key: str, vector: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """key and v, the integers of the vectors that are kept."""
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))

    given = rows.select(F.col(key).alias("key"), F.col(vector).alias("x"))
    good = given.filter((F.size("x") == dimensions) & ~F.exists("x", bad))
    return good.select("key", integers(F.col("x")).alias("v"))


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """A batch of lists of one length, none of them null, as rows."""
    return np.asarray(column.flatten()).reshape(len(column), dimensions).astype(np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, and the squared distance.

    order has the dimensions, those of most variance first."""
    sorted_rows, sorted_centroids = vectors[:, order], centroids[:, order]
    best = np.full(len(vectors), np.iinfo(np.int64).max)
    label = np.zeros(len(vectors), dtype=np.int32)
    for number, c in enumerate(sorted_centroids):
        alive = np.arange(len(vectors))
        partial = np.zeros(len(vectors), dtype=np.int64)
        for a in range(0, len(order), step):
            off = sorted_rows[alive, a : a + step] - c[a : a + step]
            partial += np.einsum("ij,ij->i", off, off)
            stay = partial <= best[alive]  # strictly above the best: given up
            alive, partial = alive[stay], partial[stay]
        closer = partial < best[alive]  # equal: the smaller number keeps it
        best[alive[closer]] = partial[closer]
        label[alive[closer]] = number
    return label, best


def _sums(vectors: DataFrame, label, dimensions: int) -> DataFrame:
    """cluster, n and exact sums of components, a row for each cluster and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: np.ndarray | None = None
        for batch in batches:
            rows = matrix(batch.column(0), dimensions)
            numbers, k = label(rows)
            if n is None:
                n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dimensions), dtype=np.int64)
            n += np.bincount(numbers, minlength=k)
            for c in np.unique(numbers):
                sums[c] += rows[numbers == c].sum(axis=0)
        if n is not None:
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * dimensions), pa.array(sums.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), flat], names=["cluster", "n", "sums"])

    parts = vectors.select("v").mapInArrow(run, "cluster int, n long, sums array<long>")
    # decimals, as sums of all tasks may be beyond a long
    total = [F.sum(F.col("sums")[d].cast("decimal(28,0)")).alias(f"s{d}") for d in range(dimensions)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *total)


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors of the k smallest hashes, in their order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in vectors.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()], dtype=np.int64)


def variance_order(vectors: DataFrame, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Dimensions, that of most variance first; one row of moments leaves the cluster."""
    found = vectors.agg(*[F.var_pop(F.col("v")[d]).alias(f"v{d}") for d in range(dimensions)]).first()
    return np.argsort([-(found[d] or 0.0) for d in range(dimensions)], kind="stable")


def train(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids after all rounds, and the order of dimensions."""
    centroids = first_centroids(vectors, k, seed)
    order = variance_order(vectors, dimensions)
    for _ in range(rounds if len(centroids) else 0):
        now = centroids
        sums = _sums(vectors, lambda rows, now=now: (nearest(rows, now, order)[0], len(now)), dimensions)
        centroids = now.copy()
        for r in sums.filter("n > 0").collect():
            centroids[r.cluster] = [int(r[f"s{d}"]) // r.n for d in range(dimensions)]
    return centroids, order


def assign(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray, dimensions: int = DIMENSIONS) -> DataFrame:
    """key, cluster and distance (squared) of every kept vector."""
    from pyspark.sql import types as T

    schema = T.StructType([vectors.schema["key"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, best = nearest(matrix(batch.column(1), dimensions), centroids, order)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label), pa.array(best)], names=schema.names)

    return vectors.select("key", "v").mapInArrow(run, schema)


def cluster_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> DataFrame:
    """key, cluster, distance, the inertia of the cluster and of all, and the digest of
    the cluster's final centroid, for every kept vector."""
    vectors = cut(kept_vectors(rows, key, vector, dimensions), "vectors")
    centroids, order = train(vectors, k, rounds, seed, dimensions)
    found = cut(assign(vectors, centroids, order, dimensions), "assigned")
    inertia = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    # k rows, so they travel as literals
    def of(values: list, kind: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster") + 1)

    by_cluster, shas = of([inertia.get(c, 0) for c in range(len(digests))], "bigint"), of(digests, "string")
    total = F.lit(sum(inertia.values())).cast("long")
    return found.select(F.col("key").alias(key), "cluster", "distance", by_cluster.alias("cluster_inertia"), total.alias("inertia"), shas.alias("centroid_sha256"))
