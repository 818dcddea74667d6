"""Word shingles as 64-bit hashes in numpy, used inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CACHE_WORDS = 150_000
LONG_WORD = 256  # bytes; longer words are hashed one by one
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
_IN_WORD = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around on purpose."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word, kept for words that come again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased."""
        words = (text or "").encode().lower().split()  # bytes: ASCII only, both calls
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, split and lower-cased as by WordHashes, end to end,
    and the number of words of each.  All words are hashed at once, eight bytes at a time, so
    one that comes once costs no more than others; the hashes are not those of WordHashes."""
    column = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    n = int(at[-1] - at[0]) if len(at) else 0
    if not n:
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    padded = np.zeros(n + 8, dtype=np.uint8)
    np.take(_LOWER, data, out=padded[:n])
    inside = _IN_WORD[data]
    edge = np.zeros(n + 1, dtype=bool)  # another text begins
    edge[at] = True
    start = np.flatnonzero(inside & np.concatenate([[True], edge[1:-1] | ~inside[:-1]]))
    end = np.flatnonzero(inside & np.concatenate([edge[1:-1] | ~inside[1:], [True]])) + 1
    size = end - start
    eight = np.ndarray(n + 1, dtype="<u8", buffer=padded, strides=(1,))
    out = mix(size.astype(np.uint64) * _PRIME)
    some = np.flatnonzero(size <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        some = some[size[some] > k]
        if not len(some):
            break
        out[some] = mix(out[some] ^ (eight[start[some] + k] & _FIRST_BYTES[np.minimum(size[some] - k, 8)]))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(padded[start[i] : end[i]].tobytes())
    return out, np.diff(np.searchsorted(start, at))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, in order; of all words if there are fewer."""
    n = len(words)
    if n == 0:
        return words
    size, width = max(n - k + 1, 1), min(n, k)
    h = np.full(size, width, dtype=np.uint64)
    for i in range(width):
        h = h * _PRIME + words[i : i + size]
    return mix(h)
