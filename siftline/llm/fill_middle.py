"""Fill-in-middle: texts cut in three at unit borders and put in another order.

A unit is a run of white space with the word after it, or white space at the end of the
text.  Where units begin, and whether a text has one of the markers, is what a small
automaton tells.  It runs over all chunks of text at once: each chunk gives, for every
state it may be entered in, the state it ends in and how many units begin.  These functions
are composed, which is associative, so prefixes of a document are composed by doubling and
give the state in which each chunk is really entered.  A cut is then looked for in the one
chunk that holds it.

This happens on two levels.  A batch of texts is cut into lanes of LANE characters, one
row of numpy arrays each.  A giant text of more than CHUNK characters is dealt over the
tasks in chunks of CHUNK characters, whose functions alone are shuffled and composed; the
two chunks with its cuts are then scanned again.  A text of up to CHUNK characters is a
single chunk and needs no shuffle; both ways give the same for every text.

Null texts count as empty: form plain, no units.  Very long texts are worked on whole.
Repeated rows each have their result; a null id counts as the empty string in the hash; an
empty table gives an empty one; only the key and the text are read, so no other name can
clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.common import cut, strings, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100 texts so many are rearranged, and of 100 of these so many have the suffix first.
RATE, SUFFIX_FIRST = 50, 80
CHUNK = 65_536
LANE = 64
#: Characters that are scanned at a time.
BATCH_CHARS = 1_000_000

# Classes of characters: nothing (padding), white space, other, and those of markers.
PAD, SPACE, OTHER, OPEN, LETTER, CLOSE = range(6)
_CLASS = np.full(128, OTHER, dtype=np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
_CLASS[ord("<")], _CLASS[ord(">")] = OPEN, CLOSE
_CLASS[[ord(c) for c in "PSM"]] = LETTER
# States: 4 * (0 nothing read, 1 in white space, 2 in a word) + (0 no marker, 1 after its
# first and 2 after its second character, 3 a marker was found).
STATES = 12


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a unit begins, for each class and state."""
    follows = np.zeros((6, STATES), dtype=np.uint8)
    begins = np.zeros((6, STATES), dtype=np.int64)
    for c in range(6):
        for s in range(STATES):
            unit, marker = divmod(s, 4)
            if c == PAD:
                follows[c, s] = s
                continue
            begins[c, s] = unit == 0 or (c == SPACE and unit == 2)
            step = {(OPEN, 0): 1, (OPEN, 1): 1, (OPEN, 2): 1, (LETTER, 1): 2, (CLOSE, 2): 3}.get((c, marker), 0)
            follows[c, s] = 4 * (1 if c == SPACE else 2) + (3 if marker == 3 else step)
    return follows, begins


FOLLOWS, BEGINS = _automaton()


def classes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(codes < 128, _CLASS[np.minimum(codes, 127)], np.uint8(OTHER))


class Scan:
    """The automaton over several texts, all lanes at once."""

    def __init__(self, texts: list[str]) -> None:
        self.chars = np.array([len(t) for t in texts], dtype=np.int64)
        each = np.maximum(1, -(-self.chars // LANE))  # an empty text has a lane of padding
        self.first = np.concatenate([[0], np.cumsum(each)])  # lane of each text, and the end
        self.text = np.repeat(np.arange(len(texts)), each)
        self.lanes = np.full((self.first[-1], LANE), PAD, dtype=np.uint8)
        flat = self.lanes.reshape(-1)
        whole = classes_of("".join(texts))
        to = np.repeat(self.first[:-1] * LANE - (np.cumsum(self.chars) - self.chars), self.chars) + np.arange(len(whole))
        flat[to] = whole
        self.ends, self.counts = self._functions()

    def _functions(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each lane and state of entry: state at the end, units that begin."""
        n = len(self.lanes)
        state = np.tile(np.arange(STATES, dtype=np.uint8), (n, 1))
        count = np.zeros((n, STATES), dtype=np.int64)
        for k in range(LANE):
            at = self.lanes[:, k : k + 1].astype(np.int64) * STATES + state
            count += BEGINS.reshape(-1)[at]
            state = FOLLOWS.reshape(-1)[at]
        return state, count

    def compose(self) -> tuple[np.ndarray, np.ndarray]:
        """The same for all lanes of a text up to each one, by doubling."""
        ends, counts = self.ends.copy(), self.counts.copy()
        d = 1
        while d < len(ends):
            later = np.flatnonzero(self.text[d:] == self.text[:-d]) + d
            if not len(later):
                break
            before = ends[later - d].astype(np.int64)
            more = np.take_along_axis(counts[later], before, axis=1)
            moved = np.take_along_axis(ends[later], before, axis=1)
            counts[later] = counts[later - d] + more
            ends[later] = moved
            d *= 2
        return ends, counts

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """The function of each whole text."""
        ends, counts = self.compose()
        last = self.first[1:] - 1
        return ends[last], counts[last]

    def select(self, entry: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Place of the begin number ``wanted`` (from 0) of each text that is entered in
        the state ``entry``; its length where there are not so many."""
        ends, counts = self.compose()
        counted = counts[np.arange(len(counts)), entry[self.text]]  # begins up to the end of each lane
        # lanes of a text that end before the begin that is wanted
        behind = np.add.reduceat((counted <= wanted[self.text]).astype(np.int64), self.first[:-1])
        lane = self.first[:-1] + behind
        inside = lane < self.first[1:]
        lane = np.minimum(lane, self.first[1:] - 1)
        head = lane == self.first[:-1]
        before = np.maximum(lane - 1, 0)
        state = np.where(head, entry, ends[before, entry]).astype(np.int64)
        left = wanted - np.where(head, 0, counts[before, entry])
        place = self.chars.copy()
        for k in range(LANE):
            at = self.lanes[lane, k].astype(np.int64) * STATES + state
            begins = BEGINS.reshape(-1)[at]
            place = np.where(inside & (begins == 1) & (left == 0), (lane - self.first[:-1]) * LANE + k, place)
            left = left - begins
            state = FOLLOWS.reshape(-1)[at].astype(np.int64)
        return place


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin, chars = 0, 0
    for i, t in enumerate(texts):
        if i > begin and chars + len(t) > BATCH_CHARS:
            yield begin, i
            begin, chars = i, 0
        chars += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def hashes(key: str, seed: int) -> list[Column]:
    """h1 to h4 of an id."""
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(sha, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _cut_small(rows: DataFrame) -> DataFrame:
    """rows (key, text, h1 to h4) with n, marked and the places of both cuts."""
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("n long, marked boolean, a long, b long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                texts = batch.column(1).to_pylist()
                h1, h2 = (np.asarray(batch.column(c)) for c in (2, 3))
                for i, j in _runs(texts):
                    scan = Scan(texts[i:j])
                    ends, counts = scan.totals()
                    n, start = counts[:, 0], np.zeros(j - i, dtype=np.int64)
                    one, two = h1[i:j] % (n + 1), h2[i:j] % (n + 1)
                    new = [n, ends[:, 0] % 4 == 3, scan.select(start, np.minimum(one, two)), scan.select(start, np.maximum(one, two))]
                    yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *map(pa.array, new)], names=schema.names)

    return rows.mapInArrow(run, schema)


def chunk_functions(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """row, chunk, ends and counts of the chunks of giant texts (row, text), dealt over
    the tasks chunk by chunk."""
    step = max(1, BATCH_CHARS // size)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), strings(batch.column(1), 1), strict=True):
                for k in range(0, len(text), size):
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([k // size], pa.int64()), pa.array([text[k : k + size]])], names=["row", "chunk", "text"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                ends, counts = Scan(part.column(2).to_pylist()).totals()
                offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * STATES)
                flat = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64).reshape(-1))) for x in (ends, counts)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *flat], names=["row", "chunk", "ends", "counts"])

    pieces = rows.select("row", "text").mapInArrow(split, "row long, chunk long, text string")
    return pieces.repartition("row", "chunk").mapInArrow(scan, "row long, chunk long, ends array<long>, counts array<long>")


def _composed(functions: DataFrame) -> DataFrame:
    """row and steps: for each chunk of a text in order the state in which it is entered
    and how many units begin before it, and a last one for the end of the text.

    A text has few chunks: what one row can hold bounds them."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "ends", "counts")))
    start = F.array(F.struct(F.lit(0).cast("long").alias("state"), F.lit(0).cast("long").alias("begun")))

    def step(done: Column, f: Column) -> Column:
        last = F.element_at(done, -1)
        at = last["state"].cast("int") + 1
        new = F.struct(F.element_at(f["ends"], at).alias("state"), (last["begun"] + F.element_at(f["counts"], at)).alias("begun"))
        return F.concat(done, F.array(new))

    return functions.groupBy("row").agg(ordered.alias("f")).select("row", F.aggregate("f", start, step).alias("steps"))


def _cut_giants(rows: DataFrame, size: int) -> DataFrame:
    """The same as _cut_small for giant texts: functions of chunks are composed, then the
    chunks with cuts are looked at."""
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "giants")
    steps = _composed(chunk_functions(rows, size))
    known = rows.select("row", "h1", "h2").join(steps, "row")
    n = F.element_at("steps", -1)["begun"]
    known = known.withColumn("n", n).withColumn("marked", F.element_at("steps", -1)["state"] % 4 == 3)
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    for name, wanted in (("a", F.least(one, two)), ("b", F.greatest(one, two))):
        # the chunk that holds the cut is the last one with no more begins before it
        chunk = F.greatest(F.size(F.filter("steps", lambda s: s["begun"] <= F.col("wanted"))) - 1, F.lit(0))
        known = known.withColumn("wanted", wanted).withColumn("chunk", F.least(chunk, F.size("steps") - 2).cast("long"))
        before = F.element_at("steps", F.col("chunk").cast("int") + 1)
        known = known.withColumn(name, F.struct("chunk", before["state"].alias("state"), (F.col("wanted") - before["begun"]).alias("wanted")))
    held = rows.join(known.select("row", "n", "marked", "a", "b"), "row")
    for name in ("a", "b"):
        held = held.withColumn(f"{name}_text", F.substring("text", (F.col(f"{name}.chunk") * size + 1).cast("int"), F.lit(size)))

    @F.pandas_udf("long")
    def place(text, state, wanted):
        import pandas as pd

        found = [Scan([t]).select(np.array([s]), np.array([w]))[0] for t, s, w in zip(text, state, wanted, strict=True)]
        return pd.Series(found, dtype="int64")

    places = [(F.col(f"{c}.chunk") * size + place(f"{c}_text", f"{c}.state", f"{c}.wanted")).alias(c) for c in ("a", "b")]
    return held.select("key", "text", "h1", "h2", "h3", "h4", "n", "marked", *places)


def assemble(text: Column, form: Column, a: Column, b: Column) -> Column:
    """The output: parts of the text in the order of the form."""
    a, b = a.cast("int"), b.cast("int")
    prefix, middle = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a)
    suffix = F.substring(text, b + 1, F.lit(2**31 - 1))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "plain", text).when(form == "psm", psm).otherwise(spm)


def restore(output: Column, form: Column) -> Column:
    """The text, from the output and its form alone: rearranged texts have no other marker."""
    parts = F.split(output, "<[PSM]>", -1)  # empty, then the parts in their order
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """key, n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if
    plain) and output of every row."""
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    rows = rows.select("key", "text", *hashes("key", seed))
    giant = F.length("text") > chunk
    found = _cut_small(rows.filter(~giant)).unionByName(_cut_giants(rows.filter(giant), chunk))
    plain = (F.col("text") == "") | F.col("marked") | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    found = found.withColumn("form", form)
    moved = F.col("form") != "plain"
    return found.select(
        F.col("key").alias(key),
        "n",
        "form",
        F.when(moved, F.col("a")).alias("prefix_chars"),
        F.when(moved, F.col("b") - F.col("a")).alias("middle_chars"),
        assemble(F.col("text"), F.col("form"), F.col("a"), F.col("b")).alias("output"),
    )
