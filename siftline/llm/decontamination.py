"""Benchmark decontamination by SimHash windows.

An item of the benchmark is the weighted set of its five-word shingles; a shingle
weighs as many characters as its words have.  Each document is looked at through
windows of as many shingles as an item has:

1. windows that hold no shingle of an item of their size have similarity 0 to all of
   them and are passed over (a table of bits, then exact hashes);
2. the others get a SimHash of ``BITS`` bits.  The fingerprints of the items of that
   size are indexed by ``BLOCKS`` blocks of bits: two fingerprints within ``RADIUS``
   agree in some block up to RADIUS // BLOCKS bits, so looking up every block value
   with its neighbours of that distance misses none within the radius;
3. candidates within the radius are verified by their exact weighted Jaccard
   similarity (shingles that recur count as often), which must reach ``SIMILARITY``.

A document with fewer shingles than an item is one window.  Documents stay in their
partition: no shuffle.  Items come to the tasks in blocks of ``ITEMS`` items and
``ITEM_BYTES`` at most, one pass over the texts for each block, whose finds are written
before the next one is read, so what is sent and held is bounded.

Words are lower-cased and free of ASCII punctuation.  Null and empty texts and items
match nothing, an empty table gives an empty one.  Items under five words are one shingle.
Very long texts take time in proportion.  Repeated items and repeated documents each give
rows; of equal windows the first counts.  Columns of any name stay as they are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import append_columns, cut, fresh
from siftline.llm.shingles import WordHashes, mix, shingles

WIDTH = 5
SIMILARITY = 0.8
BITS, RADIUS, BLOCKS = 64, 20, 7
#: Items sent to the tasks at a time.
ITEMS = 20_000
#: Bytes of item texts in such a block, unless one item has more.
ITEM_BYTES = 32_000_000
_FILTER_BITS = 22
_PAIRS = 2_000_000  # candidates looked at together
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_PLAIN).split()


def shingled(cache: WordHashes, text: str | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles in order, and their weights."""
    words = words_of(text)
    hashes = shingles(np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words)), width)
    chars = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))])
    k = min(width, len(words))
    return hashes, (chars[k:] - chars[: len(chars) - k])[: len(hashes)]


def fingerprints(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of size shingles that begin at starts."""
    signs = np.unpackbits(hashes.view(np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.int64) * 2 - 1
    sums = np.zeros((len(hashes) + 1, BITS), dtype=np.int64)
    np.cumsum(signs * weights[:, None], axis=0, out=sums[1:])
    return np.packbits(sums[starts + size] > sums[starts], axis=1).view(np.uint64).reshape(-1)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class HammingIndex:
    """Fingerprints by blocks of bits; finds all within RADIUS of a fingerprint."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        edges = [BITS * k // BLOCKS for k in range(BLOCKS + 1)]
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.near: list[tuple[np.ndarray, np.ndarray]] = []
        for shift, mask in self.blocks:
            values = np.arange(int(mask) + 1, dtype=np.uint64)
            own = (prints >> shift) & mask
            ball = values[_popcount(values) <= RADIUS // BLOCKS]  # differences allowed within a block
            spread = (own[:, None] ^ ball[None, :]).reshape(-1)
            order = np.argsort(spread, kind="stable")
            items = np.repeat(np.arange(len(prints)), len(ball))[order]
            self.near.append((np.searchsorted(spread[order], np.arange(int(mask) + 2, dtype=np.uint64)), items))

    def within(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, item and distance of all pairs within the radius."""
        out = []
        n = len(self.prints)
        step = max(1, _PAIRS // max(1, n))
        for low in range(0, len(queries), step):
            mine = queries[low : low + step]
            parts = []
            for (shift, mask), (begin, items) in zip(self.blocks, self.near, strict=True):
                v = ((mine >> shift) & mask).astype(np.int64)
                count = begin[v + 1] - begin[v]
                ends = np.cumsum(count)
                at = np.repeat(begin[v] - (ends - count), count) + np.arange(int(ends[-1]))
                parts.append(np.repeat(np.arange(len(mine)), count) * n + items[at])
            pairs = np.unique(np.concatenate(parts))
            q, i = pairs // n, pairs % n
            distance = _popcount(self.prints[i] ^ mine[q])
            near = distance <= RADIUS
            out.append((q[near] + low, i[near], distance[near]))
        q, i, d = (np.concatenate([o[k] for o in out]) if out else np.empty(0, dtype=np.int64) for k in range(3))
        return q, i, d


class ItemBlock:
    """What a task needs of some items: per shingle width, then per window size."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        cache = WordHashes()
        self.widths: dict[int, dict] = {}
        for item, text in items:
            n = len(words_of(text))
            if n:
                hashes, weights = shingled(cache, text, WIDTH)
                self.widths.setdefault(min(n, WIDTH), {}).setdefault(len(hashes), []).append((item, hashes, weights))
        self.least = {(width, size): min(int(w.sum()) for _, _, w in group) for width, sizes in self.widths.items() for size, group in sizes.items()}
        self.tables = {}
        for width, sizes in self.widths.items():
            # shingle -> the window sizes of the items that have it
            pairs = np.array(sorted({(int(h), size) for size, group in sizes.items() for _, hs, _ in group for h in hs}), dtype=np.uint64).reshape(-1, 2)
            bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
            bits[(pairs[:, 0] >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            index = {size: HammingIndex(np.array([fingerprints(h, w, np.array([0]), size)[0] for _, h, w in group], dtype=np.uint64)) for size, group in sizes.items()}
            self.tables[width] = (pairs[:, 0].copy(), pairs[:, 1].astype(np.int64), bits, index)

    def hits(self, cache: WordHashes, text: str | None) -> list[tuple[int, int, int, int, float]]:
        """(item, first word, end word, distance, similarity) of the best window of
        each item found in a text."""
        best: dict[int, tuple[float, int, int, int]] = {}
        for width, (keys, sizes_of, bits, index) in self.tables.items():
            hashes, weights = shingled(cache, text, width)
            maybe = np.flatnonzero(bits[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            if not len(maybe):
                continue
            low, high = np.searchsorted(keys, hashes[maybe], "left"), np.searchsorted(keys, hashes[maybe], "right")
            place, size = np.repeat(maybe, high - low), np.concatenate([sizes_of[a:b] for a, b in zip(low, high, strict=True)])
            for whole in np.unique(size).tolist():
                at = place[size == whole]
                # of a text shorter than the item the whole is the window
                s = min(whole, len(hashes))
                if s < whole and weights.sum() < SIMILARITY * self.least[width, whole]:
                    continue
                starts = np.unique(np.maximum(at[:, None] - np.arange(s)[None, :], 0).reshape(-1))
                starts = starts[starts + s <= len(hashes)]
                # only the stretches of the text that these windows cover
                for run in np.split(starts, np.flatnonzero(np.diff(starts) > s) + 1):
                    if len(run):
                        lo, hi = int(run[0]), int(run[-1]) + s
                        prints = fingerprints(hashes[lo:hi], weights[lo:hi], run - lo, s)
                        for q, i, d in zip(*[v.tolist() for v in index[whole].within(prints)], strict=True):
                            item, ih, iw = self.widths[width][whole][i]
                            a = int(run[q])
                            sim = similarity(hashes[a : a + s], weights[a : a + s], ih, iw)
                            if sim >= SIMILARITY and (-sim, d, a) < best.get(item, (0.0, 0, 0, 0))[:3]:
                                best[item] = (-sim, d, a, a + s - 1 + width)
        return [(item, a, b, d, -sim) for item, (sim, d, a, b) in sorted(best.items())]


def similarity(ah: np.ndarray, aw: np.ndarray, bh: np.ndarray, bw: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    a, b = Counter(ah.tolist()), Counter(bh.tolist())
    weight = dict(zip(ah.tolist(), aw.tolist(), strict=True))
    common = sum(n * weight[h] for h, n in (a & b).items())
    return common / (int(aw.sum()) + int(bw.sum()) - common)


HIT = "array<struct<item:bigint,first:int,end:int,distance:int,similarity:double>>"


def item_blocks(benchmark: DataFrame) -> Iterator[ItemBlock]:
    """The items, ITEMS at a time."""
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, math.ceil(size["n"] / ITEMS), math.ceil(size["bytes"] / ITEM_BYTES))
    for k in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        yield ItemBlock([tuple(r) for r in mine.toLocalIterator()])


def with_hits(docs: DataFrame, block: ItemBlock, name: str, text: str = "text") -> DataFrame:
    """docs with a column of hits; rows keep their partition and all columns."""

    def make():
        cache = WordHashes()
        kind = pa.list_(pa.struct([("item", pa.int64()), ("first", pa.int32()), ("end", pa.int32()), ("distance", pa.int32()), ("similarity", pa.float64())]))

        def of(texts: list[str | None]) -> list[pa.Array]:
            return [pa.array([[dict(zip(("item", "first", "end", "distance", "similarity"), h, strict=True)) for h in block.hits(cache, t)] for t in texts], type=kind)]

        return of

    return append_columns(docs, text, make, f"{name} {HIT}")


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item found in it, with the best window (words)."""
    out = None
    for block in item_blocks(benchmark):
        found = with_hits(docs.select("doc_id", "text"), block, "hits").select("doc_id", F.explode("hits").alias("h"))
        rows = found.select("doc_id", F.col("h.item").alias("item_id"), F.col("h.first").alias("first_word"), F.col("h.end").alias("end_word"), "h.distance", F.round("h.similarity", 9).alias("similarity"))
        if out is not None:  # what a block has found is written before the next one is read
            out = cut(out, "hits")
        out = rows if out is None else out.union(rows)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold an item.  For items of several blocks the documents
    are numbered and written once; each block then gives the numbers of rows that go."""
    name, row = fresh(docs, "hits"), fresh(docs, "row")
    blocks = item_blocks(benchmark)
    block, later = next(blocks), next(blocks, None)
    if later is None:
        return with_hits(docs, block, name).filter(F.size(name) == 0).drop(name)
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    texts, gone = numbered.select(row, "text"), None
    for block in chain([block, later], blocks):
        found = cut(with_hits(texts, block, "hits").filter(F.size("hits") > 0).select(row), "gone")
        gone = found if gone is None else gone.union(found)
    return numbered.join(gone, row, "left_anti").select(*docs.columns)
