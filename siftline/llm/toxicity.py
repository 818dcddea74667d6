"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding: compatibility forms, lower case, look-alike letters and digits that stand for
letters; everything that is no letter becomes one space, so an entry with a leading
space matches at the start of a word only.

The lexicon is learnt from labelled rows: starts of words of ``PREFIXES`` letters. For
each, the documents that have it once, twice or four times are compared between toxic
and other ones by likelihood ratio; it is an entry if the best passes ``MIN_G2``, and
its weight is the log ratio of its rates among words.  Of starts that continue each
other only the strongest is kept.  A phrase of ``EXCEPTIONS`` hides the entries in it.
The weights found in a text are summed and divided by its number of words; a logistic
curve fitted on labelled rows set aside (one in ``CURVE``) makes that a score from 0 to 1.

At most ``TRAIN_ROWS`` labelled rows (those of least hash) train it, which bounds what is
collected and sent to the tasks.  All rows are scored, whole, without a shuffle.

Null and empty texts have score 0.  Very long texts take time in proportion.  Without
labels of both kinds every score is 0; an empty table gives an empty one.  Repeated rows
each have their score.  Labels that repeat a doc_id: the highest counts.  Columns of any
name stay as they are.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import append_columns, cut, fresh, strings

PREFIXES = range(3, 11)
TRAIN_ROWS = 10_000
CURVE = 4  # one in so many training rows fits the curve
LEVELS = (1, 2, 4)
MIN_G2 = 16.0
MIN_WEIGHT = 0.7
SHORT = 8  # words added to the length, so that one word in a very short text is not all
THRESHOLD = 0.3
#: Letters and signs that look like Latin letters.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j",
    "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "α": "a", "ο": "o", "ι": "i", "ν": "v", "ρ": "p",
    "τ": "t", "υ": "u", "κ": "k", "ε": "e", "ı": "i", "ɑ": "a", "ɡ": "g", "@": "a", "$": "s", "€": "e",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "!": "i", "|": "l",
}
#: Harmless phrases with words that insult elsewhere.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "loser bracket", "disgusting smell")
_FOLD = str.maketrans(LOOK_ALIKES)
#: Signs that stand for a letter do so only inside a word: "st!pid", not "stop!".
_SIGNS = re.compile(r"(?<!\w)[@$€!|]+|[@$€!|]+(?!\w)")
_NO_LETTER = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """The letters of a text, words apart by one space, with a space at both ends."""
    t = unicodedata.normalize("NFKC", text or "").lower()
    return f" {_NO_LETTER.sub(' ', _SIGNS.sub(' ', t).translate(_FOLD)).strip()} "


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def starts_of(words: list[str]) -> Counter:
    """How often each start of a word occurs."""
    found: Counter = Counter()
    for w, n in Counter(words).items():
        for k in PREFIXES:
            if len(w) >= k:
                found[w[:k]] += n
    return found


@dataclass
class Lexicon:
    """Entries with weights, and the curve from density to score."""

    weights: dict[str, float]
    slope: float = 0.0
    bias: float = -20.0
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            found.add_word(f" {entry}", (len(entry) + 1, w))
        for phrase in self.exceptions:
            found.add_word(f" {phrase}", (len(phrase) + 1, -1.0))
        found.make_automaton()
        return found

    def density(self, automaton: ahocorasick.Automaton, text: str | None) -> float:
        """Weights of all entries found, per hundred words."""
        if not len(automaton) or not text:
            return 0.0
        folded = fold(text)
        found = [(end - n + 1, end, w) for end, (n, w) in automaton.iter(folded)]
        # exceptions by their starts, each with the farthest end of those up to it
        hidden = sorted((a, b) for a, b, w in found if w < 0)
        begins, reach = [a for a, _ in hidden], list(accumulate((b for _, b in hidden), max))
        total = 0.0
        for a, b, w in found:
            k = bisect_right(begins, a)
            if w >= 0 and not (k and b <= reach[k - 1]):
                total += w
        return 100 * total / (folded.count(" ") + SHORT)

    def score(self, density: float) -> float:
        if not density:
            return 0.0
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.bias + self.slope * math.log1p(density)))))


def choose(rated: list[tuple[str, float]]) -> dict[str, float]:
    """The lexicon from (start, weight), strongest first."""
    kept: dict[str, float] = {}
    beginnings: set[str] = set()  # of all that is kept
    for s, w in rated:
        if s not in beginnings and not any(s[:k] in kept for k in range(1, len(s))):
            kept[s] = w
            beginnings.update(s[:k] for k in range(1, len(s) + 1))
    return kept


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of at most TRAIN_ROWS labelled rows that are not held out."""
    mine = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    mine = mine.groupBy("doc_id").agg(F.max("toxic").alias("_toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    return docs.select("doc_id", "text").join(F.broadcast(mine), "doc_id").select("text", F.col("_toxic").alias("toxic"))


def _for_curve() -> Column:
    """The training rows that fit the curve and choose no entries."""
    return F.pmod(F.xxhash64("text", F.lit(3)), F.lit(CURVE)) == 0


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """A lexicon from the labelled rows of docs."""
    rows = cut(training_rows(docs, labels), "training")
    first = rows.filter(~_for_curve())
    sizes = {r["toxic"]: r["n"] for r in first.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return Lexicon({})

    wide = 2 * (len(LEVELS) + 1)  # documents by level and occurrences, of other and of toxic

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([v[k] for v in found.values()], pa.int64()) for k in range(wide))], names=["start", *(f"c{k}" for k in range(wide))])
            found.clear()
            return out

        for batch in batches:
            for text, label in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = fold(text).split()
                side = (len(LEVELS) + 1) * (label > 0)
                found.setdefault("", [0] * wide)[side + len(LEVELS)] += len(words)
                for start, n in starts_of(words).items():
                    row = found.setdefault(start, [0] * wide)
                    for k, level in enumerate(LEVELS):
                        row[side + k] += n >= level
                    row[side + len(LEVELS)] += n
                if len(found) > 150_000:
                    yield flush()
        yield flush()

    schema = ", ".join(["start string", *(f"c{k} long" for k in range(wide))])
    counts = cut(first.select("text", "toxic").mapInArrow(count, schema).groupBy("start").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(wide)]), "starts")
    words = counts.filter("start = ''").first()
    half, n = len(LEVELS) + 1, float(toxic + other)

    def g2(k: int) -> Column:
        b, a = F.col(f"c{k}").cast("double"), F.col(f"c{half + k}").cast("double")
        c, d = toxic - a, other - b

        def part(x: Column, row: Column, col: float) -> Column:
            return F.when(x > 0, x * F.log(x * n / (row * col))).otherwise(0.0)

        return F.when(a * other > b * toxic, 2 * (part(a, a + b, toxic) + part(b, a + b, other) + part(c, c + d, toxic) + part(d, c + d, other))).otherwise(0.0)

    weight = F.log((F.col(f"c{wide - 1}") + 0.5) / float(words[f"c{wide - 1}"] + 1)) - F.log((F.col(f"c{half - 1}") + 0.5) / float(words[f"c{half - 1}"] + 1))
    rated = counts.filter("start <> ''").select("start", F.greatest(*[g2(k) for k in range(len(LEVELS))]).alias("g2"), weight.alias("weight"))
    strong = rated.filter((F.col("g2") >= MIN_G2) & (F.col("weight") >= MIN_WEIGHT))
    # starts of the words of TRAIN_ROWS rows at most; of equal ones the longest first
    best = strong.orderBy(F.desc(F.round("g2", 6)), F.desc(F.length("start")), "start").collect()
    lexicon = Lexicon(choose([(r["start"], r["weight"]) for r in best]))
    return fit(lexicon, rows.filter(_for_curve()))


def fit(lexicon: Lexicon, rows: DataFrame) -> Lexicon:
    """Fit the curve; what comes back is one row for each density, in steps of 0.02,
    and label."""
    step = F.round(F.log1p("density") / 0.02).cast("int")
    table = densities(rows, lexicon).filter("density > 0").groupBy(step.alias("x"), (F.col("toxic") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not table:
        return lexicon
    x, y, n = (np.array([float(r[k]) for r in table]) for k in ("x", "y", "n"))
    x *= 0.02
    design = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):  # Newton, with a weak prior that keeps separable labels finite
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (n * (y - p)) - 0.05 * w
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        w = w + np.linalg.solve(hessian, gradient)
    lexicon.slope, lexicon.bias = float(max(w[0], 0.0)), float(w[1])
    return lexicon


def densities(docs: DataFrame, lexicon: Lexicon, text: str = "text", names: tuple[str, str] = ("density", "score")) -> DataFrame:
    """docs with the density and the score of each row."""

    def make():
        automaton = lexicon.automaton()

        def of(texts: list[str | None]) -> list[pa.Array]:
            found = [lexicon.density(automaton, t) for t in texts]
            return [pa.array(found), pa.array([lexicon.score(d) for d in found])]

        return of

    return append_columns(docs, text, make, ", ".join(f"{n} double" for n in names))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, density of every row."""
    scored = densities(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "density")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the score calls toxic."""
    density, score = fresh(docs, "density"), fresh(docs, "score")
    return densities(docs, learn(docs, labels), names=(density, score)).filter(F.col(score) < THRESHOLD).drop(density, score)
