"""Reproducible shuffle into shards by a Feistel permutation.

Rows get global numbers 0..N-1 in the order of (doc_id, checksum, size), a keyed
Feistel network permutes the numbers, cycle walking keeps them below N.  The
permuted number p gives ``shard = p % n_shards`` and ``slot = p // n_shards``, so
shard counts differ by one row at most, slots have no gap, and the place of any row
number can be computed without the data.

Nulls: a null text counts as empty, null ids sort first.  Very long texts count by their
size and checksum alone; rows that repeat each have a place of their own.  Ties: rows that agree in
id, checksum and size are interchangeable; any order among them gives the same
content.  An empty table gives an empty result.  Other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import cut, text_of

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around on purpose."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where a permutation of 0..n-1, chosen by seed, puts each number."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> bits, x & mask
        for key in keys:
            left, right = right, left ^ (_mix(right ^ key) & mask)
        x = (left << bits) | right
        out[walking] = x
        walking = walking[x >= n]  # outside: permute again until it falls inside
    return out.astype(np.int64)


def number_rows(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with a column ``row_number`` from 0 in the given order, and their count.

    One range shuffle; each partition numbers its own rows, and partition offsets
    come from a table with one row per partition.
    """
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    ranged = cut(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the shuffle above: bounded by spark.sql.shuffle.partitions
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n")).first()["n"]
    numbered = ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn("row_number", F.col("_offset") + within).drop("_part", "_offset", "_at"), int(total)


def shard_documents(docs: DataFrame, n_shards: int = 16, seed: int = 20_240_501) -> DataFrame:
    """doc_id, size, text_crc32, row_number, permuted, shard, slot of every row."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    text = text_of()
    base = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, total = number_rows(cut(base, "sizes"), ["doc_id", "text_crc32", "size"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("row_number").to_numpy(zero_copy_only=False)
            p = permute(number, total, seed)
            new = [pa.array(p), pa.array((p % n_shards).astype(np.int32)), pa.array(p // n_shards)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "permuted", "shard", "slot"])

    schema = "doc_id long, size long, text_crc32 long, row_number long, permuted long, shard int, slot long"
    columns = numbered.select(F.col("doc_id").cast("long"), "size", "text_crc32", F.col("row_number").cast("long"))
    return columns.mapInArrow(place, schema)
