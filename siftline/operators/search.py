"""Top-k search by cosine similarity, exact and by cells."""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.vector import cosine_to, cosine_udf, cosines

if TYPE_CHECKING:
    from siftline.operators.store import Store

DEFAULT_LIMIT = 5
#: Up to this many best chunks are looked up in the documents at a time.
LOOK_UP = 10_000
#: Chunks of a document in one block of cosine_pairs, about, and rows that are multiplied at a time.
PAIRED, TILE = 1_024, 256
#: Pairs that a task makes, about: its rows are few bytes and don't tell how long it takes.
PAIRS_OF_TASK = 4_000_000


def check_dimensions(chunks: DataFrame, dimensions: int) -> None:
    """Raise if a stored vector has another size."""
    r = chunks.filter(F.col("embedding").isNotNull()).agg(F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")).first()
    if r["a"] is not None and (r["a"], r["b"]) != (dimensions, dimensions):
        raise ValueError(f"stored vectors have {r['a']} to {r['b']} dimensions, not {dimensions}")


def score_chunks(chunks: DataFrame, query: list[float], namespace: str = "", vectorised: bool = False) -> DataFrame:
    """Chunks with vectors, in one namespace or (empty) in all, with their score."""
    rows = chunks.filter(F.col("embedding").isNotNull())
    if namespace:
        rows = rows.filter(F.col("namespace") == namespace)
    score = cosine_udf(query)(F.col("embedding")) if vectorised else cosine_to(F.col("embedding"), query)
    return rows.withColumn("score", score)


def search(chunks: DataFrame, documents: DataFrame, query: list[float], namespace: str = "", limit: int = 0, vectorised: bool = False) -> DataFrame:
    """The best ``limit`` chunks (0 or less: 5) with the file names of their documents.

    The limit comes first, as each task keeps its best rows only; the join then has
    that many rows on one side.  Ties go to the lower chunk id, zero vectors last.
    Every chunk needs its document, which deletion sees to."""
    k = limit if limit > 0 else DEFAULT_LIMIT
    best = score_chunks(chunks, query, namespace, vectorised).orderBy(F.desc_nulls_last("score"), "id").limit(k)
    named = (F.broadcast(best) if k <= LOOK_UP else best).join(documents.select(F.col("id").alias("document_id"), "filename"), "document_id")
    out = named.select(F.col("id").alias("chunk_id"), "document_id", "namespace", "filename", "chunk_index", "content", "score", "metadata")
    return out.orderBy(F.desc_nulls_last("score"), "chunk_id")


def search_store(store: Store, query: list[float], namespace: str = "", limit: int = 0) -> DataFrame:
    """search over a store: one pass over the vectors of the namespace, whose best chunks
    (some more than asked for, as deleted documents and older attempts are still there)
    are then held against the events of their documents alone.  Only if too few of these
    count, the pass is made again for more.  A limit beyond LOOK_UP joins all chunks."""
    store = store.pinned()
    k = limit if limit > 0 else DEFAULT_LIMIT
    of = namespace or None
    kind = "chunk_id string, document_id string, namespace string, filename string, chunk_index int, content string, score double, metadata map<string,string>"
    columns = [F.col("id").alias("chunk_id"), "document_id", "namespace", "filename", "chunk_index", "content", "score", "metadata"]
    order = [F.desc_nulls_last("score"), "chunk_id"]
    scored = score_chunks(store.written_chunks(of), query).drop("embedding", "created_at")
    n = 2 * k
    while n <= LOOK_UP:
        best = scored.orderBy(F.desc_nulls_last("score"), "id").limit(n).collect()
        held = store.spark.createDataFrame(best, scored.schema)
        asked = held.select(F.col("document_id").alias("id")).distinct()
        found = store.counted(held, store.events(of, ids=documents_of(best)).join(F.broadcast(asked), "id", "left_semi")).select(*columns).orderBy(*order).limit(k).collect()
        if len(found) == k or len(best) < n:
            return store.spark.createDataFrame(found, kind).orderBy(*order)
        n *= 4
    return store.counted(scored, store.events(of)).select(*columns).orderBy(*order).limit(k)


def cosine_pairs(chunks: DataFrame, digits: int) -> DataFrame:
    """a, b (a before b) and rounded score of all pairs of chunks of each document; null as
    ``cosine`` is.  The chunks of a document are dealt to blocks, and each two blocks meet in
    a task of their own, so no task holds more than two blocks however long a document is."""
    rows = chunks.filter(F.col("document_id").isNotNull() & F.col("id").isNotNull()).select("document_id", "id", F.col("embedding").cast("array<double>").alias("embedding"))
    blocks = rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / PAIRED).cast("int"))
    pairs = blocks.agg(F.sum(F.col("n").cast("double") * F.col("n") / 2).alias("pairs")).first()["pairs"] or 0
    tasks = max(int(pairs // PAIRS_OF_TASK), chunks.sparkSession.sparkContext.defaultParallelism)
    own, other = F.col("own"), F.col("other")
    dealt = rows.join(blocks.drop("n"), "document_id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("document_id", F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), "own", "id", "embedding")

    def run(group: pa.Table) -> pa.Table:
        names, rank = np.unique(np.array(group["id"].to_pylist(), dtype=str), return_inverse=True)
        names, rank = pa.array(names.tolist(), pa.string()), rank.reshape(-1).astype(np.int32)
        by_id = np.argsort(rank, kind="stable")
        own, first, last = np.asarray(group["own"])[by_id], group["i"][0].as_py(), group["j"][0].as_py()
        vectors = group["embedding"].combine_chunks()
        one, two = by_id[own == first], by_id[own == last]
        out = []
        for k in range(0, len(one), TILE):
            left = one[k : k + TILE]
            for m in range(k if first == last else 0, len(two), TILE):
                right = two[m : m + TILE]
                x, y = np.broadcast_arrays(rank[left][:, None], rank[right])
                pairs = x < y if first == last else np.full(x.shape, True)
                score = cosines(vectors.take(pa.array(left)), vectors.take(pa.array(right)))[pairs]
                score = np.copysign(np.floor(np.abs(score) * 10**digits + 0.5) / 10**digits, score) + 0.0
                a, b = np.minimum(x, y)[pairs], np.maximum(x, y)[pairs]
                out.append(pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(score, from_pandas=True)], names=["a", "b", "score"]))
        kind = pa.schema([("a", pa.string()), ("b", pa.string()), ("score", pa.float64())])
        return pa.Table.from_batches(out, kind)

    return dealt.repartition(tasks, "document_id", "i", "j").groupBy("document_id", "i", "j").applyInArrow(run, "a string, b string, score double")


def documents_of(rows: list) -> list[str] | None:
    """The documents of some chunks, if they are so few that their buckets alone are read."""
    ids = {r["document_id"] for r in rows}
    return sorted(ids) if len(ids) <= 64 else None


def train_cells(chunks: DataFrame, cells: int, seed: int = 1, sample_rows: int = 100_000) -> list[list[float]]:
    """Centres of k-means cells from at most sample_rows vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = chunks.filter(F.col("embedding").isNotNull()).orderBy(F.xxhash64("id")).limit(sample_rows)
    model = KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=10).fit(rows.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
    return [c.tolist() for c in model.clusterCenters()]


def assign_cells(chunks: DataFrame, centres: list[list[float]]) -> DataFrame:
    """Chunks with the number of the nearest cell; write them partitioned by it."""
    scores = F.array(*[F.coalesce(cosine_to(F.col("embedding"), c), F.lit(-2.0)) for c in centres])
    return chunks.withColumn("cell", F.when(F.col("embedding").isNotNull(), F.array_position(scores, F.array_max(scores)).cast("int") - 1))


def search_cells(indexed: DataFrame, documents: DataFrame, query: list[float], centres: list[list[float]], probes: int = 1, namespace: str = "", limit: int = 0) -> DataFrame:
    """Approximate search: only the cells nearest to the query are read."""
    c = np.array(centres)
    near = np.argsort(-(c @ np.array(query)) / np.maximum(np.linalg.norm(c, axis=1), 1e-12), kind="stable")[:probes]
    return search(indexed.filter(F.col("cell").isin([int(x) for x in near])), documents, query, namespace, limit)
