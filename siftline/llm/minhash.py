"""Near-duplicate documents: banded MinHash, sequential Bayesian pruning, exact links.

1. One pass over the texts: the distinct shingles of each document as 64-bit hashes,
   a 128-bit digest of that set, and a MinHash signature.
2. Documents with equal sets are one class from here on (a group of copies, however
   large, costs one row).
3. Bands of the class signatures make buckets.  A bucket of up to ``PAIRS_TO`` classes
   gives all its pairs; a larger one gives a star around its least member.
4. Sequential verification: signatures of candidate pairs are compared in batches of
   ``BATCH`` hashes; a pair goes as soon as the posterior chance that its similarity
   reaches the threshold (uniform prior) is below ``MISS``.  Survivors are compared on
   their full sets of shingles.
5. Connected components of the links.
6. What stars can't see: in each large bucket with more than one component, the
   classes outside its most frequent component are a query set; blocks of them meet
   blocks of all its classes, are pruned and verified inside the task, and only links
   leave it, one for each class and component.  A pair is looked at in the first
   bucket that both share.  Components are then completed with these links.

So no pairs of a large group are written out, no group is gathered in one task, and no
link between two texts that share a band is lost.  A pair at the threshold itself
shares none of the bands with probability under 2e-5.

Null and empty texts have no shingles and are linked with nothing.  Very long texts are
worked on whole, each as one row with its set of shingles.  Rows that repeat a doc_id each
give a row; ties go to the smallest doc_id; null ids never lead.  An empty table gives an
empty one.  Only doc_id and text are read, so names of other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import cut, is_small, small, strings
from siftline.llm.shingles import WordHashes, mix, shingles

BANDS, ROWS = 28, 5
HASHES = BANDS * ROWS
BATCH = 20
MISS = 1e-6
PAIRS_TO = 8
#: Shingles of the classes in one block, about: 2 MB of hashes.
BLOCK_SHINGLES = 250_000
_SLICE = 200_000
_PAIRS = 50_000  # compared at a time


def multipliers(n: int = HASHES) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Least value under each hash function of each run that begins at starts."""
    out = np.empty((len(starts), HASHES), dtype=np.uint32)
    for j, a in enumerate(multipliers()):
        out[:, j] = np.minimum.reduceat((hashes * a) >> np.uint64(32), starts)
    return out


@lru_cache(maxsize=8)
def least_matches(percent: int) -> tuple[int, ...]:
    """For n = BATCH, 2 BATCH, ... the fewest matches of n at which the posterior
    chance of a similarity of percent / 100 or more is still MISS or above."""
    grid = np.linspace(0.0005, 0.9995, 1000)
    high = grid >= percent / 100
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        m = np.arange(n + 1)[:, None]
        like = m * np.log(grid) + (n - m) * np.log1p(-grid)
        like = np.exp(like - like.max(axis=1, keepdims=True))
        out.append(int(np.argmax(like[:, high].sum(axis=1) / like.sum(axis=1) >= MISS)))
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Places of the pairs of rows of signatures a and b that no batch rules out."""
    left = np.arange(len(a))
    matches = np.zeros(len(a), dtype=np.int32)
    for k, least in enumerate(least_matches(percent)):
        cols = slice(k * BATCH, (k + 1) * BATCH)
        matches += (a[left, cols] == b[left, cols]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        left, matches = left[keep], matches[keep]
    return left


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], type=pa.binary())


def describe(docs: DataFrame, width: int) -> DataFrame:
    """key, doc_id, node (digest of the set; null if empty), n_shingles, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            rows: list[int] = []
            sets: list[np.ndarray] = []
            size = 0

            def flush() -> pa.RecordBatch:
                n = np.array([len(s) for s in sets], dtype=np.int64)
                flat = np.concatenate(sets) if len(sets) else np.empty(0, dtype=np.uint64)
                full = np.flatnonzero(n)
                starts = (np.cumsum(n) - n)[full]
                node: list[bytes | None] = [None] * len(sets)
                sign: list[bytes | None] = [None] * len(sets)
                if len(full):
                    sums = [np.add.reduceat(mix(flat ^ np.uint64(c)), starts) + n[full].astype(np.uint64) for c in (0x1234567, 0xABCDEF987)]
                    for i, d, s in zip(full.tolist(), np.stack(sums, axis=1), signatures(flat, starts), strict=True):
                        node[i], sign[i] = d.tobytes(), s.tobytes()
                at = pa.array(rows)
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(node, type=pa.binary()), pa.array(n), pa.array(sign, type=pa.binary())],
                    names=["key", "doc_id", "node", "n_shingles", "signature"],
                )

            for i, text in enumerate(strings(batch.column(2))):
                rows.append(i)
                sets.append(np.unique(shingles(cache.of(text), width)))
                size += len(sets[-1])
                if size > _SLICE:
                    yield flush()
                    rows, sets, size = [], [], 0
            if rows:
                yield flush()

    return docs.select("key", "doc_id", "text").mapInArrow(run, "key long, doc_id long, node binary, n_shingles long, signature binary")


def bands(classes: DataFrame) -> DataFrame:
    """bucket, band and node, BANDS rows for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2])
            for r in range(ROWS):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
            nodes = batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), BANDS)))
            band = pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(batch)))
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), band, nodes], names=["bucket", "band", "node"])

    return classes.select("node", "signature").mapInArrow(run, "bucket long, band int, node binary")


def _prune(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint32).reshape(-1, HASHES) for k in (2, 3))
                yield batch.take(pa.array(survivors(a, b, percent))).select([0, 1])

    sig = classes.select("node", "signature")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x, dtype=np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3))
            keep = [i for i in range(len(batch)) if linked(a[i], b[i], percent)]
            yield batch.take(pa.array(keep, type=pa.int64())).select([0, 1])

    both = pairs.join(sets.select("node", "hashes").toDF("a", "set_a"), "a").join(sets.select("node", "hashes").toDF("b", "set_b"), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


def _sets(docs: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """node and sorted hashes of the classes in needed (node, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for i, (node, text) in enumerate(zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True)):
                s = np.unique(shingles(cache.of(text), width))
                d = np.array([np.add.reduce(mix(s ^ np.uint64(c))) + np.uint64(len(s)) for c in (0x1234567, 0xABCDEF987)], dtype=np.uint64)
                if len(s) and d.tobytes() == node:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([s.tobytes()], type=pa.binary())], names=["node", "hashes"])

    found = docs.join(small(needed), "key").select("node", "text").mapInArrow(run, "node binary, hashes binary")
    return cut(found.dropDuplicates(["node"]), "sets")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """node and component (the least node reachable) of all nodes in edges; after a number
    of rounds, the least node found so far.

    Least labels spread along edges, and labels of labels are followed in each round,
    so the rounds grow with the logarithm of the longest path.  All tables stay
    distributed; each round is written out.
    """
    sym = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(b, a)).distinct(), "edges")
    labels = cut(sym.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    hint = F.broadcast if is_small(labels) else lambda df: df  # the tables of all rounds have its size
    for done in count(1):
        spread = sym.join(hint(labels.toDF("y", "l")), "y").groupBy("x").agg(F.min("l").alias("l"))
        near = spread.join(hint(labels.toDF("x", "old")), "x").select(F.col("x").alias("node"), "old", F.least("old", "l").alias("component"))
        up = hint(labels.toDF("component", "above"))
        new = cut(near.join(up, "component").select("node", "old", F.least("component", "above").alias("component")), "labels")
        if done == rounds or new.filter(F.col("old") != F.col("component")).isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def _candidates(buckets: DataFrame) -> DataFrame:
    """Stars of all buckets, and all pairs of those of at most PAIRS_TO classes."""
    stars = buckets.filter(F.col("node") != F.col("leader")).select(F.col("leader").alias("a"), F.col("node").alias("b"))
    few = buckets.filter((F.col("n") > 2) & (F.col("n") <= PAIRS_TO) & (F.col("node") != F.col("leader")))
    lists = few.groupBy("bucket").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    pairs = lists.select(F.posexplode("nodes").alias("i", "a"), "nodes").select("a", F.explode(F.slice("nodes", F.col("i") + 2, PAIRS_TO)).alias("b"))
    return stars.union(pairs).distinct()


def _links_between(asked: list[dict], there: list[dict], band: int, percent: int) -> list[tuple[bytes, bytes]]:
    """Links from the classes asked to those there of other components, one for each
    class and component, among the pairs whose first common band is this one."""
    sig = [np.frombuffer(b"".join(x["signature"] for x in side), dtype=np.uint32).reshape(-1, HASHES) for side in (asked, there)]
    names = {c: k for k, c in enumerate({x["component"] for x in (*asked, *there)})}
    part = [np.array([names[x["component"]] for x in side]) for side in (asked, there)]
    sets = [[np.frombuffer(x["hashes"], dtype=np.uint64) for x in side] for side in (asked, there)]
    least = np.array(least_matches(percent))
    out = []
    step = max(1, _PAIRS // len(there))
    for low in range(0, len(asked), step):
        i, j = np.nonzero(part[0][low : low + step, None] != part[1][None, :])
        i += low
        equal = sig[0][i] == sig[1][j]
        mine = equal.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
        i, j, equal = i[mine], j[mine], equal[mine]
        good = (equal.reshape(-1, len(least), BATCH).sum(axis=2).cumsum(axis=1) >= least).all(axis=1)
        i, j = i[good], j[good]
        for k in np.unique(i).tolist():
            others = j[i == k]
            size = np.array([len(sets[1][o]) for o in others])
            flat = np.concatenate([sets[1][o] for o in others])
            own = sets[0][k]
            found = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            common = np.add.reduceat(found, np.cumsum(size) - size, dtype=np.int64)
            linked_to = others[100 * common >= percent * (len(own) + size - common)]
            _, first = np.unique(part[1][linked_to], return_index=True)
            out += [(asked[k]["node"], there[o]["node"]) for o in linked_to[first].tolist()]
    return out


def _residue(large: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components inside large buckets."""
    member = large.select("bucket", "band", "node").join(small(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))
    member = member.join(small(classes.select("node", "n_shingles")), "node")
    total = F.sum("n_shingles").alias("total")
    by_part = member.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), total)
    top = F.max(F.struct("n", "total", "component"))
    most = by_part.groupBy("bucket").agg(top.alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("total").alias("total")).filter("parts > 1")
    most = cut(most.select("bucket", F.col("top.component").alias("most"), F.ceil(F.col("total") / BLOCK_SHINGLES).alias("blocks"), F.ceil((F.col("total") - F.col("top.total")) / BLOCK_SHINGLES).alias("ask_blocks")), "mixed")
    placed = cut(member.drop("n_shingles").join(small(most), "bucket"), "members")
    hashed = F.xxhash64("node")
    # every block that asks meets every block: each row goes to the meetings of its own block
    last = {c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1) for c in ("blocks", "ask_blocks")}
    there = placed.select("bucket", "band", F.explode(last["ask_blocks"]).alias("x"), F.pmod(hashed, F.col("blocks")).alias("y"), F.lit(False).alias("asks"), "node", "component")
    asks = placed.filter("component <> most").select("bucket", "band", F.pmod(hashed, F.col("ask_blocks")).alias("x"), F.explode(last["blocks"]).alias("y"), F.lit(True).alias("asks"), "node", "component")
    needed = placed.select("node").distinct()
    full = sets.join(needed, "node", "left_semi").join(classes.select("node", "signature"), "node")
    rows = there.union(asks).join(full, "node")
    met = rows.groupBy("bucket", "band", "x", "y").agg(F.collect_list(F.struct("asks", "node", "component", "signature", "hashes")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, band in enumerate(batch.column(0).to_pylist()):
                side = {True: [], False: []}
                for x in batch.column(1)[k].as_py():
                    side[x["asks"]].append(x)
                found = _links_between(side[True], side[False], band, percent) if all(side.values()) else []
                yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], type=pa.binary()) for n in (0, 1)], names=["a", "b"])

    return met.select("band", "rows").mapInArrow(run, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(describe(keyed, width), "described")
    one = Column.__getitem__(F.min(F.struct("key", "signature")), "signature")
    classes = cut(
        rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"), F.max("n_shingles").alias("n_shingles"), one.alias("signature")),
        "classes",
    )
    spread = bands(classes)
    heads = spread.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = cut(spread.join(heads, "bucket"), "buckets")
    left = cut(_prune(_candidates(buckets), classes, percent), "survivors")
    large = buckets.filter(F.col("n") > PAIRS_TO)
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).union(large.select("node")).distinct()
    sets = _sets(keyed.select("key", "text"), cut(nodes.join(classes.select("node", "key"), "node"), "needed"), width)
    links = cut(_verify(left, sets, percent), "links")
    labels = components(links)
    more = cut(_residue(large, labels, classes, sets, percent), "links")
    if not more.isEmpty():
        labels = components(links.union(more))
    grouped = classes.select("node", "rep").join(small(labels), "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    least = cut(grouped.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    named = cut(grouped.join(small(least), "component").select("node", "component_id"), "named")
    out = rows.select("doc_id", "node", "n_shingles").join(small(named), "node", "left")
    final = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", final.alias("component_id"), F.coalesce(F.col("doc_id") == final, F.lit(False)).alias("kept"))
