"""Near-duplicate passages between documents, by compact windows.

The tokens of a text are its five-word shingles.  A passage is a window of ``TOKENS``
tokens (``WORDS`` words); two passages of different texts are linked if the Jaccard
similarity of their tokens is ``SIMILARITY`` or more, read in the same order (tokens are
common if they lie at the same place of both, or next to it).  Where no token recurs
within a passage that is the similarity of the two sets.  A link reaches from the first to
the last common token.  Linked passages of a
text that overlap make one stretch, and stretches are one class if links lead from one to
the other.

Under one hash function a token c is a node of the Cartesian tree of the hash values.  Its
compact window (c, [l, r]) groups all subsequences that contain c and lie in [l, r]: they
share the min-hash of c.  Those of ``TOKENS`` tokens start from lo = max(l, c - TOKENS + 1)
to hi = min(c, r - TOKENS + 1).

1. Equal texts (by a 128-bit digest) are one class; a class of two documents or more is a
   repeat as a whole, besides its passages that other texts have.
2. Each text gives the (function, token) and places of its compact windows under
   ``HASHES`` functions, called tokens below.  Those of two texts or more are kept.
3. A token of up to ``PAIRS_TO`` texts gives all pairs of them, one of more a star around
   its shortest text.  Pairs need ``ENOUGH`` common tokens, of all both texts have.
4. In a task with the two texts of a pair, compact windows of the same token under the
   same function are joined: on a diagonal, their intervals [lo, hi] are laid over each
   other, and where those of ``ENOUGH`` functions meet, the passages that start there are
   candidates.  The similarity of each candidate is counted.
5. Stretches and their classes (connected components of the links).
6. What stars can't see: of each token of more texts whose members are in two classes or
   more, the members outside its most frequent class are a query set.  Blocks of them meet
   blocks of all members, with the tokens around, and every pair of passages around the
   token that can be linked is looked at in the task.  The pairs of texts found, one for each member and
   class, are compared as in 4, and classes are completed.  ``BLOCK_HASHES`` functions
   suffice here, as one common token brings a pair together.

So no link is lost that agrees in ``ENOUGH`` of ``HASHES`` min-hashes (at the threshold
itself 0.973 of all, and 0.992 in step 6; a longer passage has several windows that may
agree, a verbatim one agrees in all), however many texts share a token; no
pairs of a large group are written out and no group is gathered in one task.  Members of a
line shorter than a passage that recurs in very many texts are copied to each of its blocks
in step 6, as nothing links them.

Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased.  Null, empty and short texts have no
passages; an empty table gives an empty result.  Very long texts are one row each, in
memory with their tokens.  Texts are compared as tokens of 32 bits: one pair of passages in
10^7 can count a token too many.  Where a token recurs often in both texts of a
pair (more than ``PLACES`` pairs of places), equal passages of a text are joined once: the first
stands for the others, which then get its link.  All pairs of places of what is left are
joined, by bands of diagonals if they are very many, so memory is bounded and no link
depends on how often a token recurs.  A repeated row
counts as another document.  Null ids are never a partner.  Ties go to the smallest
doc_id.  Only doc_id and text are read, so names of other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import cut, forget, small, text_of
from siftline.llm.minhash import components
from siftline.llm.shingles import mix, shingles, word_hashes

WIDTH = 5
WORDS = 50
TOKENS = WORDS - WIDTH + 1
HASHES = 4
ENOUGH = 2
SIMILARITY = 80  # percent
#: Tokens of more texts give stars and, for what these leave, blocks; no result depends on it.
PAIRS_TO = 2
#: Functions whose tokens are gone through in step 6.
BLOCK_HASHES = 3
#: Beyond so many pairs of places of a token equal passages are joined once, and so many are
#: joined at a time; no result depends on either.
PLACES = 64
JOINED = 2_000_000
PERIOD = 16  # words
#: Members of a token in one block of step 6.
BLOCK = 2_000
_SALTS = [np.uint64(0x5851F42D4C957F2D * (k + 1) % 2**64) for k in range(HASHES)]
_SLICE = 1_000_000  # bytes of texts that are described at a time
_PAIRED = 200_000  # tokens of texts that are compared at a time
_TOGETHER = 4_096  # pairs of members that are looked at at a time, of small groups with those of others
_OWN = 16  # bytes of a label that is a place's own
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def window_runs(values: np.ndarray, width: int = TOKENS, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The compact windows that hold windows of width tokens: c, lo and hi.  whole tells
    of each window of width tokens whether it lies in one text, where values hold several."""
    n = len(values)
    if n < width:
        return (np.empty(0, dtype=np.int64),) * 3
    # values made distinct by their place in the low bits: of equal ones the first is less
    bits = np.uint64(n.bit_length())
    keys = ((values >> bits) << bits) | np.arange(n, dtype=np.uint64)
    # least of each window by blocks of width: running minima from both sides
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    at = np.arange(n - width + 1) if whole is None else np.flatnonzero(whole)
    least = least[at]
    if not len(at):
        return (np.empty(0, dtype=np.int64),) * 3
    edge = np.flatnonzero((least[1:] != least[:-1]) | (np.diff(at) != 1))
    first, last = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(at) - 1]])
    return (least[first] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), at[first], at[last]


def interval(values: np.ndarray, c: int) -> tuple[int, int]:
    """[l, r] of the node c: the widest stretch in which nothing is less (of equal values
    the first is less)."""
    left, right = np.flatnonzero(values[:c] <= values[c]), np.flatnonzero(values[c + 1 :] < values[c])
    return (int(left[-1]) + 1 if len(left) else 0), (c + int(right[0]) if len(right) else len(values) - 1)


class Texts:
    """Tokens of some texts, laid end to end."""

    def __init__(self, tokens: list[np.ndarray]) -> None:
        self.n = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.tokens = np.concatenate(tokens) if tokens else np.empty(0, dtype=np.uint64)
        self.of = np.repeat(np.arange(len(tokens)), self.n)
        n = len(self.tokens)
        self.padded = np.pad(self.tokens, (1, 2))  # once, as verify is called very often
        self.whole = self.of[: max(n - TOKENS + 1, 0)] == self.of[TOKENS - 1 :] if n >= TOKENS else np.empty(0, dtype=bool)

    def windows(self) -> tuple[np.ndarray, ...]:
        """k, c, lo, hi of the compact windows of all texts, places as laid, by text."""
        wide = self.tokens.astype(np.uint64)
        parts = [window_runs(mix(wide ^ s), TOKENS, self.whole) for s in _SALTS]
        k = np.repeat(np.arange(HASHES), [len(p[0]) for p in parts])
        c, lo, hi = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(self.of[c], kind="stable")
        return k[order], c[order], lo[order], hi[order]

    def first_alike(self, which: np.ndarray) -> np.ndarray:
        """Of each place of some texts at which a window of TOKENS tokens starts, the first place
        in the same text whose window has the same tokens, by a 64-bit hash; of others their own."""
        n = len(self.tokens)
        out = np.arange(n)
        if n < TOKENS:
            return out
        power = np.cumprod(np.full(n, _PAIR, dtype=np.uint64))
        inverse = np.cumprod(np.full(n, np.uint64(pow(int(_PAIR), -1, 2**64)), dtype=np.uint64))
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.tokens.astype(np.uint64)) * power)])
        start = np.flatnonzero(self.whole & np.isin(np.arange(len(self.n)), which)[self.of[: n - TOKENS + 1]])
        value = mix((total[start + TOKENS] - total[start]) * inverse[start]) ^ mix(self.of[start].astype(np.uint64) + _PAIR)
        _, first, back = np.unique(value, return_index=True, return_inverse=True)
        out[start] = start[first][back]
        return out

    def run_ends(self, k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Functions and places of compact windows, by place; of a run of one token (a word
        again and again) the first and the last place, as every passage with a part of it
        that is no longer has one of these."""
        if not len(c):
            return k, c
        edge = np.flatnonzero((self.tokens[1:] != self.tokens[:-1]) | (self.of[1:] != self.of[:-1]))
        first, last = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(self.tokens) - 1]])
        run = np.searchsorted(last, c)
        both = np.unique(np.concatenate([first[run], last[run]]) * HASHES + np.concatenate([k, k]))
        both = both[~self._inside_periods()[both // HASHES]]
        return both % HASHES, both // HASHES

    def _inside_periods(self) -> np.ndarray:
        """Of each token, whether it is inside a stretch of some words again and again (up to
        PERIOD), two rounds or more from both ends: what holds it is there at the ends, too."""
        inside = np.zeros(len(self.tokens) + 1, dtype=np.int32)
        for d in range(1, min(PERIOD, len(self.tokens) - 1) + 1):
            again = np.flatnonzero(self.tokens[d:] == self.tokens[:-d])
            again = again[self.of[again] == self.of[again + d]]
            if not len(again):
                continue
            edge = np.flatnonzero(np.diff(again) != 1)
            begin, end = again[np.concatenate([[0], edge + 1])], again[np.concatenate([edge, [-1]])] + 1 + d  # of the whole stretch, end exclusive
            long = end - begin >= TOKENS + 4 * d
            np.add.at(inside, begin[long] + 2 * d, 1)
            np.add.at(inside, end[long] - 2 * d, -1)
        return np.cumsum(inside)[:-1] > 0


def names(k: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """A number for each token under a function, which its last three bits tell."""
    return (mix(tokens.astype(np.uint64) ^ np.array(_SALTS, dtype=np.uint64)[k]) & ~np.uint64(7)) | k.astype(np.uint64)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] places, and so on, end to end."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and its length."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return first, np.diff(np.append(first, len(keys)))


_EMPTY = np.empty(0, dtype=np.int64)
_NONE = (*(_EMPTY,) * 5, np.empty(0), _EMPTY, _EMPTY)


def verify(texts: Texts, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Linked passages among the pairs (x + i, y + i), i < n, of windows: for each run of
    them the number of the row, the first and the last common token on both sides (less
    x, less y), the greatest similarity, and the first and last i."""
    if not len(n):
        return _NONE
    t = texts.padded
    long = n + TOKENS - 1
    px, py = _spread(x, long) + 1, _spread(y, long) + 1
    # tokens of x that y has at the same place, at the next and at the previous one
    own = t[px]
    same, after, before = (own == t[py + shift] for shift in (0, 1, -1))
    begin = np.cumsum(long) - long
    at = _spread(begin, n)
    end = at + TOKENS - 1
    common, shared = None, []
    later, earlier = np.concatenate([[False], after[:-1]]), np.concatenate([before[1:], [False]])
    later[begin] = earlier[begin + long - 1] = False  # rows are apart
    for up, down in ((after, before), (earlier, later)):  # tokens of x with a partner; tokens of y with one
        shared.append(same | up | down)
        total = np.zeros(len(px) + 1, dtype=np.int64)
        np.cumsum(shared[-1], out=total[1:])
        # at both ends of a window, a partner outside doesn't count
        mine = total[end + 1] - total[at] - (~(same | up)[at] & down[at]) - (~(same | down)[end] & up[end])
        common = mine if common is None else np.minimum(common, mine)
    either = 2 * TOKENS - common
    good = np.flatnonzero(100 * common >= SIMILARITY * either)
    if not len(good):
        return _NONE
    row = np.repeat(np.arange(len(n)), n)
    edge = np.flatnonzero((np.diff(good) != 1) | (row[good[1:]] != row[good[:-1]]))
    first, last = good[np.concatenate([[0], edge + 1])], good[np.concatenate([edge, [len(good) - 1]])]
    best = np.maximum.reduceat(common[good] / either[good], np.concatenate([[0], edge + 1]))
    out = []
    for s in shared:
        hits = np.flatnonzero(s)
        out += [hits[np.searchsorted(hits, at[first])], hits[np.searchsorted(hits, end[last], "right") - 1]]
    before = (np.cumsum(n) - n)[row[first]]
    return row[first], *(v - begin[row[first]] for v in out), best, first - before, last - before


def compare(tokens: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Linked passages of pairs (a, b) of texts: number of the pair, first and last token on
    both sides, similarity."""
    texts = Texts(tokens)
    windows = texts.windows()
    sides = Sides(texts, windows, a, b)
    heavy = np.unique(sides.pair[_often(sides)])
    light = np.setdiff1d(np.arange(len(a)), heavy)
    found = [_meet(texts, a, b, windows, sides, light)[:6]]
    if len(heavy):
        found += _compare_repeating(texts, windows, a, b, heavy)
    return _as_one(*(np.concatenate([f[i] for f in found]) for i in range(6)))


class Sides:
    """Compact windows of both texts of each pair, in the order of their keys (token,
    function and pair) and places: numbers of the windows, keys, places in their texts."""

    def __init__(self, texts: Texts, windows: tuple[np.ndarray, ...], a: np.ndarray, b: np.ndarray) -> None:
        k, c = windows[:2]
        of, at, named = texts.of[c], c - texts.start[texts.of[c]], names(k, texts.tokens[c])
        begin, end = (np.searchsorted(of, np.arange(len(texts.n)), where) for where in ("left", "right"))
        for side, which in (("x", a), ("y", b)):
            count = (end - begin)[which]
            w = _spread(begin[which], count)
            pair = np.repeat(np.arange(len(which)), count)
            key = named[w] + pair.astype(np.uint64) * _PAIR
            order = np.argsort(key, kind="stable")  # by place then, as a text's windows of a function are
            setattr(self, side, w[order])
            setattr(self, f"key_{side}", key[order])
            setattr(self, f"at_{side}", at[w][order])
            if side == "x":
                self.pair = pair[order]
        # the stretch of y with the key of each x
        (first_x, self.n_x), (first_y, n_y) = _runs(self.key_x), _runs(self.key_y)
        known, wanted = self.key_y[first_y], self.key_x[first_x]
        i = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
        there = known[i] == wanted if len(known) else np.zeros(len(wanted), dtype=bool)
        low, n = (np.repeat(np.where(there, v[i] if len(v) else 0, 0), self.n_x) for v in (first_y, n_y))
        self.low, self.high = low, low + n

    def joined(self, keep: np.ndarray, band: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of x and y with equal keys and their pair, of the x that are kept; on
        diagonals (place in x less place in y) of a band, both ends in it, where one is given."""
        low, high = self.low[keep], self.high[keep]
        if band is not None:
            rank = np.cumsum(np.concatenate([[0], self.key_y[1:] != self.key_y[:-1]])) if len(self.key_y) else _EMPTY
            wide = int(max(self.at_y.max(initial=0), self.at_x.max(initial=0))) + 1
            line = rank * wide + self.at_y
            mine = np.where(high > low, rank[np.minimum(low, max(len(rank) - 1, 0))] if len(rank) else 0, 0) * wide
            at = self.at_x[keep]
            least, most = np.clip(at - band[1], 0, wide), np.clip(at - band[0], -1, wide - 1)
            low, high = (np.clip(np.searchsorted(line, mine + v, where), low, high) for v, where in ((least, "left"), (most, "right")))
        count = np.maximum(high - low, 0)
        i = np.repeat(keep, count)
        return self.x[i], self.y[_spread(low, count)], self.pair[i]


def _often(sides: Sides) -> np.ndarray:
    """Windows of x whose token has more than PLACES pairs of places in their pair."""
    mine = np.repeat(sides.n_x, sides.n_x)
    return np.flatnonzero(mine * (sides.high - sides.low) > PLACES)


def _compare_repeating(texts: Texts, windows: tuple[np.ndarray, ...], a: np.ndarray, b: np.ndarray, heavy: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Links of the pairs heavy, whose texts repeat themselves: of passages that come first
    in their text, then of those that are like them."""
    alike = texts.first_alike(np.concatenate([a[heavy], b[heavy]]))
    first = alike == np.arange(len(alike))
    # compact windows from their first to their last start that is no repeat
    k, c, lo, hi = windows
    ahead = np.append(np.minimum.accumulate(np.where(first, np.arange(len(first)), len(first))[::-1])[::-1], len(first))
    behind = np.maximum.accumulate(np.where(first, np.arange(len(first)), -1))
    lo, hi = ahead[lo], behind[hi]
    some = lo <= hi
    own = (k[some], c[some], lo[some], hi[some])
    sides = Sides(texts, own, a[heavy], b[heavy])
    pair, x0, x1, y0, y1, best, s0, s1, d = _meet(texts, a[heavy], b[heavy], own, sides, np.arange(len(heavy)))
    found = [(heavy[pair], x0, x1, y0, y1, best)]
    order = np.argsort(pair, kind="stable")
    edge = np.searchsorted(pair[order], np.arange(len(heavy) + 1))
    for side, (mine, other) in enumerate(((a, b), (b, a))):
        runs = []
        for p in np.unique(pair).tolist():
            rows = order[edge[p] : edge[p + 1]]
            less = -d[rows] if side else d[rows]
            begin = s0[rows] - (d[rows] if side else 0)
            runs.append((p, *_repeats(texts, alike, int(mine[heavy[p]]), begin, begin + s1[rows] - s0[rows], less)))
        if not runs:
            continue
        of = np.repeat([r[0] for r in runs], [len(r[1]) for r in runs])
        at, partner, n = (np.concatenate([r[i] for r in runs]) for i in (1, 2, 3))
        row, i0, i1, j0, j1, alike_best = verify(texts, at + texts.start[mine[heavy[of]]], partner + texts.start[other[heavy[of]]], n)[:6]
        here, there = (at[row] + i0, at[row] + i1), (partner[row] + j0, partner[row] + j1)
        found.append((heavy[of[row]], *((*there, *here) if side else (*here, *there)), alike_best))
    return found


def _repeats(texts: Texts, alike: np.ndarray, text: int, begin: np.ndarray, end: np.ndarray, less: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of passages of a text that are repeats of linked ones, which start from begin to
    end with partners at less: place, place of the partner, number."""
    start, n = int(texts.start[text]), int(texts.n[text])
    first = alike[start : start + n] - start
    link = np.full(n, -1)
    count = end - begin + 1
    link[_spread(begin, count)] = np.repeat(np.arange(len(begin)), count)
    again = np.flatnonzero((first != np.arange(n)) & (link[first] >= 0))
    if not len(again):
        return _EMPTY, _EMPTY, _EMPTY
    of = link[first[again]]
    partner = first[again] - less[of]
    edge = np.flatnonzero((np.diff(again) != 1) | (np.diff(partner) != 1))
    head, tail = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(again) - 1]])
    return again[head], partner[head], tail - head + 1


def _as_one(pair: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links of a pair that follow each other and overlap on both sides as one, as they lie in
    the same stretches: texts that repeat themselves link on very many diagonals."""
    for _ in range(2):
        order = np.lexsort((y0, x0, pair))
        pair, x0, x1, y0, y1, best = (v[order] for v in (pair, x0, x1, y0, y1, best))
        if len(pair) < 2:
            break
        apart = (pair[1:] != pair[:-1]) | (x0[1:] > x1[:-1]) | (y0[1:] > y1[:-1]) | (y1[1:] < y0[:-1])
        head = np.concatenate([[0], np.flatnonzero(apart) + 1])
        pair, x0, y0 = pair[head], np.minimum.reduceat(x0, head), np.minimum.reduceat(y0, head)
        x1, y1, best = (np.maximum.reduceat(v, head) for v in (x1, y1, best))
    return pair, x0, x1, y0, y1, best


def _meet(texts: Texts, a: np.ndarray, b: np.ndarray, windows: tuple[np.ndarray, ...], sides: Sides, pairs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links of some pairs, JOINED windows or so at a time: pairs in groups, and a pair of
    very many by bands of diagonals that overlap by what a shift needs.  Also the first and
    last start in x and its diagonal."""
    count = np.bincount(sides.pair, weights=sides.high - sides.low, minlength=len(a)).astype(np.int64)
    wanted = np.zeros(len(a), dtype=bool)
    wanted[pairs] = True
    parts = []
    group = np.cumsum(np.where(wanted & (count <= JOINED), count, 0)) // JOINED
    for g in np.unique(group[wanted & (count <= JOINED)]):
        keep = np.flatnonzero((wanted & (count <= JOINED) & (group == g))[sides.pair])
        parts.append(_meet_joined(texts, a, b, windows, *sides.joined(keep)))
    for p in np.flatnonzero(wanted & (count > JOINED)).tolist():
        keep = np.flatnonzero(sides.pair == p)
        least, most = -int(texts.n[b[p]]), int(texts.n[a[p]])
        step = max(1, int((most - least) * JOINED / count[p]))
        for d in range(least, most + 1, step):
            parts.append(_meet_joined(texts, a, b, windows, *sides.joined(keep, (d - 1, d + step))))
    return tuple(np.concatenate([q[i] for q in parts]) for i in range(9)) if parts else (*_NONE, _EMPTY)


def _meet_joined(texts: Texts, a: np.ndarray, b: np.ndarray, windows: tuple[np.ndarray, ...], wx: np.ndarray, wy: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, ...]:
    """The interval join: where, on a diagonal, ENOUGH intervals of joined windows meet;
    what starts there is verified."""
    _, c, lo, hi = windows
    sx, sy = texts.start[a[pair]], texts.start[b[pair]]
    diagonal = (c[wx] - sx) - (c[wy] - sy)
    steps = []
    for shift in (0, 1, -1):
        d = diagonal + shift
        first = np.maximum(lo[wx] - sx, lo[wy] - sy + d)
        last = np.minimum(hi[wx] - sx, hi[wy] - sy + d)
        on = np.flatnonzero(first <= last)
        own = np.full(len(on), int(shift == 0))
        steps += [(pair[on], d[on], first[on], np.ones(len(on), dtype=np.int64), own), (pair[on], d[on], last[on] + 1, np.full(len(on), -1), -own)]
    p, d, at, cover, own = (np.concatenate([s[i] for s in steps]) for i in range(5))
    if not len(p):
        return (*_NONE, _EMPTY)
    longest = int(texts.n.max()) + 2
    line, of = np.unique(p * (4 * longest) + d + 2 * longest, return_inverse=True)
    order = np.argsort(of * longest + at, kind="stable")
    of, at = of[order], at[order]
    inside = ((np.cumsum(cover[order]) >= ENOUGH) & (np.cumsum(own[order]) >= 1))[:-1] & (of[1:] == of[:-1]) & (at[1:] > at[:-1])
    s = np.flatnonzero(inside)
    if not len(s):
        return (*_NONE, _EMPTY)
    line_of, first, last = of[s], at[s], at[s + 1] - 1
    # adjoining ones as one
    edge = np.flatnonzero((line_of[1:] != line_of[:-1]) | (first[1:] != last[:-1] + 1))
    head, tail = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(s) - 1]])
    line_of, first, last = line_of[head], first[head], last[tail]
    p = line[line_of] // (4 * longest)
    d = line[line_of] % (4 * longest) - 2 * longest
    x, y = texts.start[a[p]] + first, texts.start[b[p]] + first - d
    row, i, j, i2, j2, best, s0, s1 = verify(texts, x, y, last - first + 1)
    return p[row], first[row] + i, first[row] + j, (first - d)[row] + i2, (first - d)[row] + j2, best, first[row] + s0, first[row] + s1, d[row]


# -- tables --------------------------------------------------------------------------


def _describe(docs: DataFrame) -> DataFrame:
    """docs (doc_id, class, h, text) with the number of words, tokens and places of the
    compact windows, and all tokens cut to 32 bits, in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(3)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            begin = 0
            while begin < len(batch):
                # texts of _SLICE bytes, and one more
                part = batch.slice(begin, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + _SLICE)) + 1 - begin)
                words, count = word_hashes(part.column(3))
                tokens, first = shingles(words, WIDTH), np.cumsum(count) - count
                texts = Texts([tokens[i : i + (n - WIDTH + 1 if n >= WORDS else 0)] for i, n in zip(first.tolist(), count.tolist(), strict=True)])
                k, c = texts.run_ends(*texts.windows()[:2])
                ends = np.searchsorted(texts.of[c], np.arange(len(part)), "right").astype(np.int32)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                named, at = pa.array(names(k, texts.tokens[c]).view(np.int64)), pa.array((c - texts.start[texts.of[c]]).astype(np.int32))
                cut_to = (texts.tokens >> np.uint64(32)).astype(np.uint32)
                whole = pa.array([cut_to[i : i + n].tobytes() for i, n in zip(texts.start.tolist(), texts.n.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(j) for j in (0, 1, 2)], pa.array(count.astype(np.int32)), pa.ListArray.from_arrays(offsets, named), pa.ListArray.from_arrays(offsets, at), whole], names=["doc_id", "class", "h", "words", "tokens", "at", "text"])
                begin += len(part)

    return docs.select("doc_id", "class", "h", "text").mapInArrow(run, "doc_id long, class binary, h long, words int, tokens array<long>, at array<int>, text binary")


_FOUND = "class binary, first int, end int, partner binary, partner_first int, partner_end int, similarity double"


def _found(a: list[bytes], b: list[bytes], x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, similarity: np.ndarray) -> pa.RecordBatch:
    """Rows of _FOUND from tokens; in words, ends exclusive."""
    numbers = [pa.array(v.astype(np.int32)) for v in (x0, x1 + WIDTH, y0, y1 + WIDTH)]
    columns = [pa.array(a, pa.binary()), *numbers[:2], pa.array(b, pa.binary()), *numbers[2:], pa.array(similarity)]
    return pa.RecordBatch.from_arrays(columns, names=["class", "first", "end", "partner", "partner_first", "partner_end", "similarity"])


def _compare_pairs(pairs: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Links of pairs (a, b) of texts, which key names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, int] = {}
            tokens: list[np.ndarray] = []
            rows: list[tuple[bytes, bytes]] = []
            size = 0

            def place(key: bytes, k: int, i: int) -> int:
                if key not in known:
                    known[key] = len(tokens)
                    tokens.append(np.frombuffer(batch.column(k)[i].as_buffer(), dtype=np.uint32))
                return len(tokens[known[key]])

            def flush() -> pa.RecordBatch:
                a, b = (np.array([known[r[k]] for r in rows], dtype=np.int64) for k in (0, 1))
                p, *where = compare(tokens, a, b)
                out = _found([rows[i][0] for i in p.tolist()], [rows[i][1] for i in p.tolist()], *where)
                known.clear(), tokens.clear(), rows.clear()
                return out

            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                size += place(a, 2, i) + place(b, 3, i)
                rows.append((a, b))
                if size > _PAIRED:
                    yield flush()
                    size = 0
            if rows:
                yield flush()

    x, y = (texts.select(F.col(key).alias(h), F.col("class").alias(f"class_{h}"), F.col("text").alias(f"text_{h}")) for h in ("a", "b"))
    both = pairs.join(x, "a").join(y, "b")
    return both.select("class_a", "class_b", "text_a", "text_b").mapInArrow(run, _FOUND)


def _pairs(shared: DataFrame) -> DataFrame:
    """Pairs of texts with ENOUGH common tokens, by small groups and by leaders."""
    few = shared.filter(F.col("n") <= PAIRS_TO).groupBy("token").agg(F.array_sort(F.collect_list("h")).alias("all"))
    pairs = few.select(F.posexplode("all").alias("i", "a"), "all").select("a", F.explode(F.slice("all", F.col("i") + 2, PAIRS_TO)).alias("b"))
    stars = shared.filter((F.col("n") > PAIRS_TO) & (F.col("h") != F.col("leader"))).select(F.col("leader").alias("a"), F.col("h").alias("b"))
    counted = cut(pairs.union(stars).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "counted")
    # of a pair that too few tokens gave, all that both texts have count
    lists = cut(shared.groupBy("h").agg(F.collect_list("token").alias("common")), "lists")
    single = counted.filter(F.col("n") < ENOUGH).join(lists.toDF("a", "common_a"), "a").join(lists.toDF("b", "common_b"), "b")
    single = single.filter(F.size(F.array_intersect("common_a", "common_b")) >= ENOUGH)
    return counted.filter(F.col("n") >= ENOUGH).select("a", "b").union(single.select("a", "b"))


def _stretches(found: DataFrame) -> DataFrame:
    """class, first, end, node, best: overlapping linked passages of a text as one, with
    the most similar partner."""
    sides = found.select("class", "first", "end", "similarity", "partner").union(found.select("partner", "partner_first", "partner_end", "similarity", "class"))
    # one row for each place first, so that a text with very many links makes no hot task
    narrow = sides.groupBy("class", "first", "end").agg(F.max(F.struct("similarity", "partner")).alias("best"))
    order = Window.partitionBy("class").orderBy("first", "end")
    fresh = (F.col("first") >= F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int")
    islands = narrow.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy("class", "island").agg(F.min("first").alias("first"), F.max("end").alias("end"), F.max("best").alias("best"))
    node = F.concat("class", F.unhex(F.lpad(F.hex(F.col("first").cast("long")), 16, "0")))
    return cut(out.select("class", "first", "end", node.alias("node"), "best"), "stretches")


def _classes(found: DataFrame, stretches: DataFrame, rounds: int | None = None) -> DataFrame:
    """node and component of all stretches (after some rounds, parts of components)."""
    a = stretches.select("class", F.col("first").alias("s"), F.col("end").alias("e"), F.col("node").alias("a"))
    b = a.toDF("partner", "s2", "e2", "b")
    places = found.select("class", "first", "partner", "partner_first").distinct()
    edges = places.join(a, (places["class"] == a["class"]) & (F.col("first") >= F.col("s")) & (F.col("first") < F.col("e"))).drop(a["class"])
    edges = edges.join(b, (edges["partner"] == b["partner"]) & (F.col("partner_first") >= F.col("s2")) & (F.col("partner_first") < F.col("e2")))
    return components(edges.select("a", "b").distinct(), rounds=rounds)


def _members(shared: DataFrame, stretches: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the tokens that gave stars: token, h, class, at, label (component of the stretch
    there, or a label of the place's own), written out for the tokens of two labels or more."""
    named = stretches.join(labels, "node").join(texts.select("h", "class"), "class").select(F.col("h").alias("of"), "first", "end", "component")
    mine = (F.col("n") > PAIRS_TO) & (F.col("token").bitwiseAND(7) < BLOCK_HASHES)
    large = shared.filter(mine).select("token", "h", F.explode("places").alias("at"))
    there = (F.col("h") == F.col("of")) & (F.col("at") >= F.col("first")) & (F.col("at") + WIDTH <= F.col("end"))
    own = F.concat(F.unhex(F.lpad(F.hex("h"), 16, "0")), F.unhex(F.lpad(F.hex(F.col("at").cast("long")), 16, "0")))
    placed = cut(large.join(named, there, "left").select("token", "h", "at", F.coalesce("component", own).alias("label")), "placed")
    parts = placed.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("token").agg(F.max(F.struct("n", "label"))["label"].alias("most"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("asking")).filter("parts > 1")
    mixed = cut(mixed.select("token", "most", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asking") / BLOCK).cast("int").alias("ask_blocks")), "mixed")
    return placed.join(small(mixed), "token").select("token", "h", "at", "label", (F.col("label") != F.col("most")).alias("asks"), "blocks", "ask_blocks")


def _contexts(members: DataFrame, texts: DataFrame) -> DataFrame:
    """members with their class, the tokens around and the place of the token in these.
    Places of a text with the same tokens around are one row."""
    asked = members.groupBy("h").agg(F.collect_list(F.struct("token", "at", "asks", "blocks", "ask_blocks", "label")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                tokens = np.frombuffer(batch.column(1)[i].as_buffer(), dtype=np.uint32)
                places = batch.column(2).slice(i, 1).flatten()
                at = places.field("at").to_numpy()
                begin, end = np.maximum(at - TOKENS + 1, 0), np.minimum(at + TOKENS, len(tokens))
                around = [tokens[p:q].tobytes() for p, q in zip(begin.tolist(), end.tolist(), strict=True)]
                own = [len(v) <= _OWN for v in places.field("label").to_pylist()]
                label = [None if o else v for o, v in zip(own, places.field("label").to_pylist(), strict=True)]
                rows = {key: j for j, key in reversed(list(enumerate(zip(places.field("token").to_pylist(), label, (at - begin).tolist(), around, strict=True))))}
                first = pa.array(list(rows.values()), pa.int64())
                columns = [*[places.field(n).take(first) for n in ("token", "asks", "blocks", "ask_blocks", "label")], batch.column(0).take(pa.array(np.full(len(rows), i)))]
                columns += [pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "asks", "blocks", "ask_blocks", "label", "class", "centre", "around"])

    wanted = texts.join(asked, "h").select("class", "text", "places")
    return cut(wanted.mapInArrow(run, "token long, asks boolean, blocks int, ask_blocks int, label binary, class binary, centre int, around binary"), "contexts")


def _residue(contexts: DataFrame) -> DataFrame:
    """Pairs (a, b) of an asking member's class and one of another label."""
    hashed = F.xxhash64("class", "around")
    last = {c: F.sequence(F.lit(0), F.col(c) - 1) for c in ("blocks", "ask_blocks")}
    columns = ("asks", "class", "label", "centre", "around")
    there = contexts.withColumn("asks", F.lit(False)).select("token", F.explode(last["ask_blocks"]).alias("x"), F.pmod(hashed, F.col("blocks")).alias("y"), *columns)
    asks = contexts.filter("asks").select("token", F.pmod(hashed, F.col("ask_blocks")).alias("x"), F.explode(last["blocks"]).alias("y"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a meeting follow each other; those of the last one wait for more."""
        rest: pa.Table | None = None

        def found(table: pa.Table) -> pa.RecordBatch:
            pairs = links_in_groups(*[table.column(c).to_pylist() for c in ("meeting", *columns)])
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            meeting = table.column("meeting").to_numpy()
            whole = int(np.argmax(meeting == meeting[-1]))
            rest = table.slice(whole)
            if whole:
                yield found(table.slice(0, whole))
        if rest is not None:
            yield found(rest)

    meeting = F.xxhash64("token", "x", "y").alias("meeting")
    rows = there.union(asks).select(meeting, *columns).repartition("meeting").sortWithinPartitions("meeting")
    return rows.mapInArrow(run, "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links_in_groups(group: list[int], asks: list[bool], cls: list[bytes], label: list[bytes], centre: list[int], around: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Classes of the members that ask with those of their group that do not and have another
    label, if passages around the common token are linked.  The rows of a group follow each
    other.  In a large group what is linked has one label from then on, so each member gives
    one pair with each label."""
    texts = Texts([np.frombuffer(r, dtype=np.uint32) for r in around])
    middle = np.array(centre, dtype=np.int64)
    text, part = (pa.array(v, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64) for v in (cls, label))
    # the tokens around that of the group, side by side
    grid = np.zeros((len(cls), 2 * TOKENS + 1), dtype=np.uint32)
    grid[texts.of, np.arange(len(texts.of)) - np.repeat(texts.start + middle, texts.n) + TOKENS] = texts.tokens
    number = np.array(group)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(number) != 0) + 1, [len(number)]])
    asking = np.array(asks, dtype=bool)
    few: list[tuple[np.ndarray, np.ndarray]] = []
    out: list[tuple[bytes, bytes]] = []
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        xs = np.flatnonzero(asking[low:high]) + low
        ys = np.flatnonzero(~asking[low:high]) + low
        if len(xs) * len(ys) <= _TOGETHER:
            few.append((np.repeat(xs, len(ys)), np.tile(ys, len(xs))))
            continue
        mine = part.copy()
        for x, y in _candidates(texts, grid, middle, xs, ys):
            other = (mine[x] != mine[y]) & (text[x] != text[y])
            x, y = _linked(texts, grid, middle, x[other], y[other])
            for i in np.unique(x).tolist():
                to = y[x == i]
                to = to[mine[to] != mine[i]]
                out += [(cls[i], cls[j]) for j in to[np.unique(mine[to], return_index=True)[1]].tolist()]
                mine[np.isin(mine, mine[to])] = mine[i]
    x, y = (np.concatenate([f[k] for f in few]) if few else np.empty(0, dtype=np.int64) for k in (0, 1))
    other = (part[x] != part[y]) & (text[x] != text[y])
    x, y = x[other], y[other]
    for k in range(0, len(x), 20_000):
        out += [(cls[i], cls[j]) for i, j in zip(*[v.tolist() for v in _linked(texts, grid, middle, x[k : k + 20_000], y[k : k + 20_000])], strict=True)]
    return list(dict.fromkeys(out))


_FEWEST = -(-2 * TOKENS * SIMILARITY // (100 + SIMILARITY))  # common tokens of two passages
_ODD = TOKENS - _FEWEST  # tokens of a passage without a partner, at most
_ASKING = 256  # members whose candidates are looked up at a time


def _linked(texts: Texts, grid: np.ndarray, middle: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of members that are linked around their common token."""
    own = grid[x, 1:-1]
    alike = grid[y, 1:-1] == own
    for k in (1, -1):
        alike |= grid[y, 1 + k : 2 * TOKENS + k] == own
    some = alike.sum(axis=1, dtype=np.int8) >= _FEWEST
    total = np.cumsum(alike[some], axis=1, dtype=np.int8)
    within = total[:, TOKENS - 1 :].copy()
    within[:, 1:] -= total[:, :-TOKENS]
    some[some] = within.max(axis=1, initial=0) >= _FEWEST
    x, y = x[some], y[some]
    # windows that hold the token on both sides, aligned at it
    first = np.maximum(-np.minimum(middle[x], middle[y]), 1 - TOKENS)
    last = np.minimum(np.minimum(texts.n[x] - middle[x], texts.n[y] - middle[y]) - TOKENS, 0)
    x, y, first, last = (v[first <= last] for v in (x, y, first, last))
    row = np.unique(verify(texts, texts.start[x] + middle[x] + first, texts.start[y] + middle[y] + first, last - first + 1)[0])
    return x[row], y[row]


def _candidates(texts: Texts, grid: np.ndarray, middle: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of members of both sides that may be linked, in order, _TOGETHER or so at a
    time.  All but _ODD tokens of a passage of x have a partner at the same place of y or
    next to it.  So one of the _ODD + 1 tokens has that fewest of the other side have there."""
    column = np.arange(grid.shape[1])
    begin, end = TOKENS - middle, TOKENS - middle + texts.n
    row, at = np.nonzero((column >= begin[ys, None]) & (column < end[ys, None]))
    code = (at << 32) | grid[ys[row], at]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    first, count = _runs(code)
    known = code[first]
    for k in range(0, len(xs), _ASKING):
        part = xs[k : k + _ASKING]
        # places of x (by place, so that lookups stay close) and what the other side has there
        own = grid[part, 1:-1].T.astype(np.int64)
        there, n = [], []
        for shift in (0, 1, -1):
            wanted = ((column[1:-1, None] + shift) << 32) | own
            i = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            there.append(i)
            n.append(np.where(known[i] == wanted, count[i], 0))
        # windows from column 1, 2, ... of the grid, which hold the common token
        windows = np.lib.stride_tricks.sliding_window_view(sum(n).T, TOKENS, axis=1)
        fewest = np.argpartition(windows, _ODD, axis=2)[:, :, : _ODD + 1] + np.arange(TOKENS)[:, None]
        of, start = np.nonzero((column[1 : TOKENS + 1] >= begin[part, None]) & (column[1 : TOKENS + 1] + TOKENS <= end[part, None]))
        chosen = np.zeros(own.shape, dtype=bool)
        chosen[fewest[of, start], of[:, None]] = True
        may = np.zeros((len(part), len(ys)), dtype=bool)
        much = (sum(n) * chosen).sum(axis=0) >= len(ys)
        may[much] = True
        chosen &= ~much
        for i, m in zip(there, n, strict=True):
            of = np.nonzero(chosen & (m > 0))
            may[np.repeat(of[1], m[of]), row[_spread(first[i[of]], m[of])]] = True
        ends = np.cumsum(may.sum(axis=1))
        x, y = np.nonzero(may)
        low = 0
        while low < len(x):
            # rows of x whole, one at least
            high = int(ends[max(np.searchsorted(ends, low + _TOGETHER, "right") - 1, np.searchsorted(ends, low, "right"))])
            yield part[x[low:high]], ys[y[low:high]]
            low = high


def short_first(text: Column) -> Column:
    """A number for each text by which shorter ones come first, made of the number of
    binary digits of its length and a hash."""
    size = F.floor(F.log2(F.octet_length(text) + F.lit(1))).cast("long")
    return F.shiftleft(size, 57).bitwiseOR(F.xxhash64(text).bitwiseAND(F.lit((1 << 57) - 1)))


def find_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, first_word, end_word, class_id, partner_id, similarity, n_links: a row for
    each stretch of a document that is near-duplicate in a different text, and one for the
    whole of a document that has exact copies.  class_id is the smallest doc_id of the
    class of stretches, n_links the number of other documents in it, partner_id that of
    the most similar linked text (or another copy)."""
    text = text_of()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("class"), short_first(text).alias("h"), "text")
    described = cut(_describe(keyed).withColumn("row", F.monotonically_increasing_id()), "described")
    long = described.filter(F.col("words") >= WORDS)
    rows = cut(long.select("doc_id", "class", "h", "words", "row"), "rows")
    classes = cut(rows.groupBy("class").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other"), F.count(F.lit(1)).alias("copies"), F.max("words").alias("words"), F.min("h").alias("h"), F.min("row").alias("row")), "classes")
    seen = long.select("h", F.inline(F.arrays_zip("tokens", "at"))).withColumnRenamed("tokens", "token")
    recurs = cut(seen.groupBy("token").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high").select("token"), "recurs")
    seen = cut(seen.join(recurs, "token", "left_semi"), "seen")
    placed = seen.groupBy("token", "h").agg(F.collect_set("at").alias("places"))
    heads = placed.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("leader"))
    shared = cut(placed.join(heads, "token"), "shared")
    needed = cut(shared.select("h").distinct(), "needed")
    wanted = cut(classes.join(needed, "h").select("row"), "wanted")
    texts = cut(long.select("row", "class", "h", "text").join(small(wanted), "row").drop("row"), "texts")
    forget(described, seen, recurs)  # all that was made of them is written

    found = cut(_compare_pairs(cut(_pairs(shared), "pairs"), texts, "h"), "found")
    stretches = _stretches(found)
    # a few rounds join most of what stars link; who asks too much is answered all the same
    labels = _classes(found, stretches, rounds=5)
    contexts = _contexts(_members(shared, stretches, labels, texts), texts)
    more = cut(_residue(contexts), "more")
    forget(contexts)
    if not more.isEmpty():
        found = found.union(cut(_compare_pairs(more, texts, "class"), "found"))
        stretches = _stretches(found)
    labels = _classes(found, stretches)
    forget(shared, texts)

    placed = stretches.join(labels, "node").join(small(classes.drop("h", "row")), "class")
    # copies of a text count once for each stretch; a class with two stretches of a text counts it once
    texts_in = placed.groupBy("component", "class").agg(F.max("copies").alias("copies"), F.min("rep").alias("rep"))
    sizes = cut(texts_in.groupBy("component").agg(F.sum("copies").alias("all"), F.min("rep").alias("class_id")), "sizes")
    partners = classes.select(F.col("class").alias("partner"), F.col("rep").alias("partner_rep"))
    near = placed.join(small(sizes), "component").join(small(partners), F.col("best.partner") == F.col("partner"), "left")
    near = near.select("class", "first", "end", "class_id", "partner_rep", F.lit(False).alias("whole"), F.round("best.similarity", 9).alias("similarity"), (F.col("all") - 1).alias("n_links"))
    copied = classes.filter("copies > 1").select("class", F.lit(0).alias("first"), F.col("words").alias("end"), F.col("rep").alias("class_id"), F.lit(None).cast("long").alias("partner_rep"), F.lit(True).alias("whole"), F.lit(1.0).alias("similarity"), (F.col("copies") - 1).alias("n_links"))
    out = rows.select("doc_id", "class").join(near.union(copied), "class").join(classes.select("class", "rep", "other"), "class")
    own: Column = F.when(F.col("doc_id") == F.col("rep"), F.col("other")).otherwise(F.col("rep"))
    return out.select("doc_id", F.col("first").alias("first_word"), F.col("end").alias("end_word"), "class_id", F.when(F.col("whole"), own).otherwise(F.col("partner_rep")).alias("partner_id"), "similarity", F.col("n_links").cast("long").alias("n_links"))
