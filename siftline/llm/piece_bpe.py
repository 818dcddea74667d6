"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut into units before each run of word marks, as no piece has a mark after
another character.  The distinct new units of a batch become one flat numpy array of
symbols.  In each round every unit merges its pairs of least rank from the left on, all
units at once; units without a pair leave the arrays.  Units are cut beforehand where two
characters meet that no piece has side by side, so a very long one takes few rounds.

Null texts count as empty; an empty text has the end id only.  Very long texts are worked
on whole, in a batch of their own.  Repeated rows each have their ids, an empty table gives
an empty one, and only the key and the text are read, so no other name can clash.  The
model file is a parameter that names a file on every worker; it is read once per worker
process.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import text_of

MARK = "▁"
CACHE_UNITS = 200_000
CHUNK_CHARS = 250_000
_UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_SPAN = 0x110000
_NONE = np.iinfo(np.int64).max


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of flat that begin at starts, end to end."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


class PieceModel:
    """Vocabulary, pair ranks and unit cache of one model file."""

    def __init__(self, model_file: str) -> None:
        read = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = n = read.get_piece_size()
        special = [i for i in range(n) if read.is_byte(i) or read.is_control(i) or read.is_unknown(i) or read.is_unused(i)]
        self.end_id = read.eos_id()
        names = [read.id_to_piece(i) for i in range(n)]
        skip = set(special)
        self.ids = {p: i for i, p in enumerate(names) if i not in skip}
        self.byte_ids = np.array([read.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        score = np.array([read.get_score(i) for i in range(n)])
        levels = np.unique(-score)  # equal scores share a rank: then the leftmost pair goes first
        rank = np.searchsorted(levels, -score)
        pairs: dict[int, int] = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self._symbol(piece[:cut]), self._symbol(piece[cut:])
                if left >= 0 and right >= 0:
                    pairs[left * (n + _SPAN) + right] = i
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[int(k)] for k in self.keys], dtype=np.int64)
        self.ranks = rank[self.merged].astype(np.int64)
        self.bigrams = np.array(sorted({ord(a) * _SPAN + ord(b) for p in self.ids for a, b in zip(p, p[1:])}), dtype=np.int64)
        pieces = [b"" if i in skip else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        for b, i in enumerate(self.byte_ids):
            pieces[i] = bytes([b])
        self.piece_bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.piece_len = np.array([len(p) for p in pieces], dtype=np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.char_symbol = np.arange(_SPAN, dtype=np.int64) + n
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_symbol[ord(p)] = i
        self.forget()

    def forget(self) -> None:
        """Units that are known, by number: where their ids are and how many."""
        self.known: dict[str, int] = {}
        self.unit_ids, self.unit_at, self.unit_len = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _symbol(self, s: str) -> int:
        """Pieces have their ids; a character that is none has size + code point."""
        i = self.ids.get(s, -1)
        return i if i >= 0 else self.size + ord(s) if len(s) == 1 else -1

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (_NONE: no merge) and its place in the pair table."""
        key = left * (self.size + _SPAN) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE), at

    def _rounds(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all units, end to end, and how many each has."""
        whole = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        symbols = self.char_symbol[chars]
        # no merge reaches over two characters that no piece has side by side: what lies
        # between such places is merged on its own
        pair = chars[:-1] * _SPAN + chars[1:]
        at = np.minimum(np.searchsorted(self.bigrams, pair), len(self.bigrams) - 1)
        begins = np.ones(len(chars), dtype=bool)
        begins[1:] = self.bigrams[at] != pair
        heads = np.cumsum(whole) - whole
        begins[heads] = True
        lengths = np.diff(np.concatenate([np.flatnonzero(begins), [len(chars)]]))
        unit = np.arange(len(lengths))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # units, lengths, symbols
        while len(unit):
            starts = np.cumsum(lengths) - lengths
            rank = np.full(len(symbols), _NONE)
            rank[:-1], at = self._pair(symbols[:-1], symbols[1:])
            rank[starts + lengths - 1] = _NONE  # the last symbol of a unit has no partner
            least = np.minimum.reduceat(rank, starts)
            owner = np.repeat(np.arange(len(unit)), lengths)
            hits = np.flatnonzero((rank == least[owner]) & (rank != _NONE))
            first = self._together(symbols, rank, at, owner, hits)
            over = least == _NONE
            ended = over[owner]
            done.append((unit[over], lengths[over], symbols[ended]))
            symbols[first] = self.merged[at[first]]
            keep = ~ended
            keep[first + 1] = False
            symbols = symbols[keep]
            lengths = (lengths - np.bincount(owner[first], minlength=len(unit)))[~over]
            unit = unit[~over]
        number, size, flat = (np.concatenate([d[k] for d in done]) for k in range(3))
        order = np.argsort(number)
        parts = np.cumsum(begins)[heads] - 1  # the first part of each unit
        return gather(flat, (np.cumsum(size) - size)[order], size[order]), np.add.reduceat(size[order], parts)

    def _together(self, symbols: np.ndarray, rank: np.ndarray, at: np.ndarray, owner: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Of the pairs of least rank of each unit, the places of those that merge in this
        round: from the left on all that don't overlap.  One after the other would give the
        same, unless a merge makes a pair with a neighbour that goes before the rest; a unit
        where that happens merges its first pair only."""
        if not len(hits):
            return hits
        # in a run of overlapping pairs every other one, from the left
        fresh = np.concatenate([[True], (np.diff(hits) != 1) | (np.diff(owner[hits]) != 0)])
        places = np.arange(len(hits))
        hits = hits[(places - np.maximum.accumulate(np.where(fresh, places, 0))) % 2 == 0]
        head = np.concatenate([[True], np.diff(owner[hits]) != 0])
        several = np.flatnonzero(~head | np.concatenate([~head[1:], [False]]))
        if not len(several):
            return hits
        mine = hits[several]
        new = self.merged[at[mine]]
        # the left neighbour as it is after the merges before it, the right one as it is now
        after = symbols.copy()
        after[mine] = new
        left = mine - 1
        follows = np.concatenate([[False], mine[1:] == mine[:-1] + 2])
        left = np.where(follows, mine - 2, left)
        inside = (left >= 0) & (owner[np.maximum(left, 0)] == owner[mine])
        early = np.where(inside, self._pair(after[np.maximum(left, 0)], new)[0], _NONE) <= rank[mine]
        right = np.minimum(mine + 2, len(symbols) - 1)
        inside = (mine + 2 < len(symbols)) & (owner[right] == owner[mine])
        early |= np.where(inside, self._pair(new, symbols[right])[0], _NONE) <= rank[mine]
        unsafe = np.zeros(int(owner[-1]) + 1, dtype=bool)
        unsafe[owner[mine[early]]] = True
        return hits[head | ~unsafe[owner[hits]]]

    def _to_ids(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for symbols; a character that is no piece gives the ids of its bytes."""
        bare = np.flatnonzero(symbols >= self.size)
        if not len(bare):
            return symbols.astype(np.int32), lengths
        each = [self.byte_ids[list(chr(s - self.size).encode("utf-8", "surrogatepass"))] for s in symbols[bare].tolist()]
        wide = np.ones(len(symbols), dtype=np.int64)
        wide[bare] = [len(e) for e in each]
        out = np.repeat(symbols, wide)
        out[np.repeat(symbols >= self.size, wide)] = np.concatenate(each)
        return out.astype(np.int32), np.add.reduceat(wide, np.cumsum(lengths) - lengths)

    def _learn(self, units: list[str]) -> None:
        """Encode units that are not known."""
        ids, lengths = self._to_ids(*self._rounds(units))
        base = len(self.known)
        self.known.update(zip(units, range(base, base + len(units)), strict=True))
        self.unit_at = np.concatenate([self.unit_at, len(self.unit_ids) + np.cumsum(lengths) - lengths])
        self.unit_len = np.concatenate([self.unit_len, lengths])
        self.unit_ids = np.concatenate([self.unit_ids, ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's ids end."""
        units: list[str] = []
        ends: list[int] = []
        for text in texts:
            if text:
                units += _UNITS.findall(MARK + text.replace(" ", MARK))
            ends.append(len(units))
        new = set(units).difference(self.known)
        if new and len(self.known) + len(new) > CACHE_UNITS:
            self.forget()
            new = set(units)
        if new:
            self._learn(sorted(new))
        use = np.fromiter(map(self.known.__getitem__, units), dtype=np.int64, count=len(units))
        took = self.unit_len[use]
        at = np.concatenate([[0], np.cumsum(took)])[np.array(ends, dtype=np.int64)]
        # the end id after each text
        out = np.full(int(took.sum()) + len(texts), self.end_id, dtype=np.int32)
        stops = at + np.arange(1, len(texts) + 1)
        inside = np.ones(len(out), dtype=bool)
        inside[stops - 1] = False
        out[inside] = gather(self.unit_ids, self.unit_at[use], took)
        return out, stops

    def decode(self, flat: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of lists of ids, laid end to end."""
        took = self.piece_len[flat]
        out = gather(self.piece_bytes, self.piece_at[flat], took).tobytes()
        at = np.concatenate([[0], np.cumsum(took)])[np.concatenate([[0], ends])]
        texts = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if a < b and out[a] == 0x20:
                a += 1  # the mark that encoding puts before a text
            texts.append(out[a:b].decode("utf-8", "replace"))
        return texts


@lru_cache(maxsize=2)
def model_of(model_file: str) -> PieceModel:
    return PieceModel(model_file)


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about CHUNK_CHARS; a longer text makes a run of its own."""
    begin, chars = 0, 0
    for i, t in enumerate(texts):
        if i > begin and chars + len(t) > CHUNK_CHARS:
            yield begin, i
            begin, chars = i, 0
        chars += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def encode_decode(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, token_ids (with the end id) and decoded text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_file)
        for whole in batches:
            for begin in range(0, len(whole), 1024):
                batch = whole.slice(begin, 1024)
                texts = batch.column(1).to_pylist()
                for a, b in chunks(texts):
                    flat, ends = model.encode(texts[a:b])
                    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    ids = pa.ListArray.from_arrays(offsets, pa.array(flat, type=pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids, pa.array(model.decode(flat, ends), type=pa.string())], names=["key", "token_ids", "decoded"])
        model.forget()  # the worker lives on, for other work

    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, token_ids array<int>, decoded string").withColumnRenamed("key", key)
