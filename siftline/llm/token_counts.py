"""Token counts of a byte-level BPE without token ids.

Pre-tokens are counted for the whole corpus, each task sending its partial counts; the
pieces of each distinct one are counted once.  Then each document's pre-token frequencies
meet these counts: pre-tokens that make up more than one in HOT of all, of which there are
less than HOT, by a broadcast table, all others by a join on the pre-token.  So no task of
the join gets a hot key.  Per document only sums remain; ids are never made.

Special strings in a text count one each and cut it, as the library takes them.  Null texts
count as empty and have no token.  Very long texts are read as a stream of pre-tokens,
repeated rows each have their counts, an empty table gives an empty one, and only the key
and the text are read, so no other name can clash.  Only tokenizer files with the
byte-level pre-tokenizer, its pattern and no normalizer are taken; others are refused.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.common import cut, strings, text_of

#: Pre-tokens of more than one in HOT of all are broadcast: so many at most, each by KEY
#: characters at most.
HOT = 500_000
KEY = 64
#: A task sends its counts on whenever it has so many distinct pre-tokens.
DISTINCT = 200_000
#: Texts beyond so many characters are matched as a stream.
LONG = 1_000_000
LIMIT = 512

# The pattern of the byte-level pre-tokenizer.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
LETTER, NUMBER, OTHER = r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]"


def pattern_of(letter: str = LETTER, number: str = NUMBER, other: str = OTHER) -> str:
    return rf"(?V1){CONTRACTIONS}| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+"


def _ranges(chars: tuple[str, ...]) -> str:
    """chars, in ascending order, as ranges of a character class."""
    runs: list[list[int]] = []
    for c in map(ord, chars):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


@lru_cache(maxsize=1)
def unknown_letters() -> tuple[str, ...]:
    """Letters and numbers of this regex module's Unicode tables that the tokenizer's
    older tables don't know; they are neither there."""
    from tokenizers.pre_tokenizers import ByteLevel

    library = ByteLevel(add_prefix_space=False, use_regex=True)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out: list[str] = []
    for kind, beside in ((LETTER, "a"), (NUMBER, "1")):
        mine = regex.findall(kind, every)
        for i in range(0, len(mine), 10_000):
            part = mine[i : i + 10_000]
            begins = {a for _, (a, _) in library.pre_tokenize_str(beside + beside.join(part))}
            out += [c for k, c in enumerate(part) if 2 * k + 1 in begins]
    return tuple(sorted(out))


class PreTokens:
    """Cuts texts as the tokenizer file says."""

    def __init__(self, specials: tuple[str, ...], unknown: tuple[str, ...]) -> None:
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.unknown = frozenset(unknown)
        new = _ranges(unknown)
        self.plain = regex.compile(pattern_of())
        self.exact = regex.compile(pattern_of(f"[{LETTER}--[{new}]]", f"[{NUMBER}--[{new}]]", f"[{OTHER}||[{new}]]")) if new else self.plain

    def of(self, text: str) -> tuple[Iterator[str], int]:
        """The pre-tokens of a text and the number of special strings in it."""
        parts = self.special.split(text) if self.special else [text]
        return (t for part in parts for t in self._match(part)), len(parts) - 1

    def _match(self, part: str) -> Iterator[str] | list[str]:
        pattern = self.plain if self.unknown.isdisjoint(part) else self.exact
        return pattern.findall(part) if len(part) < LONG else map(itemgetter(0), pattern.finditer(part))


@lru_cache(maxsize=2)
def _pre_tokens(specials: tuple[str, ...], unknown: tuple[str, ...]) -> PreTokens:
    return PreTokens(specials, unknown)


def read_rules(tokenizer_file: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Special strings of a tokenizer file, and letters that it does not know."""
    with open(tokenizer_file, encoding="utf-8") as f:
        rules = json.load(f)
    pre = rules.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or rules.get("normalizer"):
        raise ValueError(f"{tokenizer_file}: only plain byte-level pre-tokenizers are supported")
    added = rules.get("added_tokens") or []
    if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added):
        raise ValueError(f"{tokenizer_file}: added tokens with options are not supported")
    return tuple(a["content"] for a in added), unknown_letters()


@lru_cache(maxsize=2)
def _tokenizer(tokenizer_file: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    from tokenizers import Tokenizer

    read = Tokenizer.from_file(tokenizer_file)
    read.no_truncation()
    read.no_padding()
    return read


def key_of(token: str) -> str:
    """The pre-token, or a digest where it is long: what is broadcast stays bounded."""
    return token if len(token) <= KEY else "\x00" + hashlib.sha256(token.encode()).hexdigest()


def distinct_pre_tokens(docs: DataFrame, rules, text: str = "text") -> DataFrame:
    """token, n: each distinct pre-token of all texts and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _pre_tokens(*rules)
        seen: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])
            seen.clear()
            return out

        for batch in batches:
            for t in strings(batch.column(0)):
                seen.update(cutter.of(t)[0])
                if len(seen) >= DISTINCT:
                    yield sent()
        yield sent()

    found = docs.select(text_of(text).alias("text")).mapInArrow(run, "token string, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def count_pieces(tokens: DataFrame, tokenizer_file: str) -> DataFrame:
    """token, n and pieces, by one call of the library for each distinct token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(tokenizer_file).encode_batch_fast
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                pieces = [len(e) for e in encode(batch.column(0).to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64())], names=["token", "n", "pieces"])

    return tokens.select("token", "n").mapInArrow(run, "token string, n long, pieces long")


def frequencies(rows: DataFrame, rules, hot: dict[str, int]) -> DataFrame:
    """row, key and n_bytes of each document with ``counted``, the pieces of what hot knows,
    and ``rare``, the frequencies of its other pre-tokens."""
    sent = rows.sparkSession.sparkContext.broadcast(hot)
    kind = rows.schema["key"].dataType
    rare = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("n", T.LongType())]))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("key", kind), T.StructField("n_bytes", T.LongType()), T.StructField("counted", T.LongType()), T.StructField("rare", rare)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, known = _pre_tokens(*rules), sent.value
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                sizes, counted, tokens, times, ends = [], [], [], [], [0]
                for t in strings(batch.column(2)):
                    found, total = cutter.of(t)
                    for token, n in Counter(found).items():
                        pieces = known.get(key_of(token))
                        if pieces is None:
                            tokens.append(token)
                            times.append(n)
                        else:
                            total += n * pieces
                    sizes.append(len(t.encode()))
                    counted.append(total)
                    ends.append(len(tokens))
                flat = pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(times, pa.int64())], names=["token", "n"])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(counted, pa.int64()), lists], names=schema.names)

    return rows.select("row", "key", "text").mapInArrow(run, schema)


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text", most: int = HOT) -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row.

    tokenizer_file names a file on every worker."""
    rules = read_rules(tokenizer_file)
    pieces = cut(count_pieces(distinct_pre_tokens(docs, rules, text), tokenizer_file), "pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    # less than ``most`` short strings, long ones as digests: all have more than total / most
    short = F.when(F.length("token") <= KEY, F.col("token")).otherwise(F.concat(F.lit("\x00"), F.sha2("token", 256)))
    hot = {r.key: r.pieces for r in pieces.filter(F.col("n") * most > total).select(short.alias("key"), "pieces").collect()}
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), text_of(text).alias("text"))
    each = cut(frequencies(rows, rules, hot), "frequencies")
    rest = each.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.n")
    sums = rest.join(pieces.select("token", "pieces"), "token").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    n_tokens = (F.col("counted") + F.coalesce("more", F.lit(0))).alias("n_tokens")
    out = each.select("row", "key", "n_bytes", "counted").join(sums, "row", "left").select(F.col("key").alias(key), "n_bytes", n_tokens)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
