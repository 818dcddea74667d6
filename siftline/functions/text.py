"""Text as Column expressions: clean up, words, overlapping windows, paths, formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space, as the inside of a character class.
SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same without control characters.
_SOFT_SPACE = r" \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Control characters but the line feed.
_CONTROL = r"\x{0}-\x{9}\x{B}-\x{1F}\x{7F}-\x{9F}"
CHUNK = "array<struct<chunk_index:int,content:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: The characters of SPACE.
_SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def normalise(text: Column) -> Column:
    """Without control characters but line feeds (tabs and carriage returns go, too),
    runs of spaces as one, no white space at either end.  Computed once, however often the
    result is named; a single plain space is not touched."""
    bare = F.regexp_replace(text, f"[{_CONTROL}]+", "")
    return let(bare, lambda t: trim(F.regexp_replace(t, f"[{_SOFT_SPACE}]{{2,}}|[{_SOFT_SPACE[1:]}]", " ")))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE}]++"))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+", -1), "")


def check_window(size: int, overlap: int) -> int:
    """The step between windows."""
    if size < 1 or overlap < 0 or overlap >= size:
        raise ValueError(f"overlap must be from 0 to below size, not {overlap} of {size}")
    return size - overlap


def chunks(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Windows of size words, each begins size - overlap words after the one before;
    the last is the first that reaches the end.  No words: no windows."""
    step = check_window(size, overlap)

    def of(w: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(w) - size) / F.lit(step)).cast("int"))
        made = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("chunk_index"), F.array_join(F.slice(w, i * step + 1, size), " ").alias("content")))
        return F.when(F.size(w) > 0, made).otherwise(F.array().cast(CHUNK))

    return let(words(F.coalesce(text, F.lit(""))), of)


def chunk_count(text: Column, size: int = 512, overlap: int = 64) -> Column:
    step = check_window(size, overlap)
    return let(word_count(F.coalesce(text, F.lit(""))), lambda n: F.when(n == 0, 0).otherwise(F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int")) + 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(filename: Column) -> Column:
    """Lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(filename, r"(\.[^./\\]*)$", 1))


def format_of(filename: Column) -> Column:
    return F.regexp_replace(extension(filename), r"^\.", "")


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def lenient_int(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID), F.lit(False))


def score_bucket(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "mid").otherwise("low")


def percent(score: Column) -> Column:
    return F.format_string("%.1f%%", score * 100)


def redact_header(value: Column) -> Column:
    return F.when(F.length(value) >= 10, F.concat(F.left(value, F.lit(10)), F.lit("***"))).otherwise("***")


def tool_prefix(name: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(trim(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(plain == "", "").otherwise(F.concat(plain, F.lit("_")))


def base64url(text: Column) -> Column:
    """Bytes of base64 text in the letters of URLs, without padding.  Line breaks, which
    Spark's base64 puts after 76 letters, are no part of it."""
    bare = F.translate(text, "-_\r\n", "+/")
    return let(bare, lambda t: F.unbase64(F.rpad(t, (F.ceil(F.length(t) / 4) * 4).cast("int"), "=")))


def total_pages(total: Column, page_size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / page_size)).cast("long")


def backoff_seconds(attempt: int, base: float = 2.0) -> float:
    return base * 2 ** (attempt - 1)
