"""Spans of regular expressions as Column expressions (no Python on the rows).

Positions are code points, end exclusive.  The patterns handed to this module use
possessive repetition and anchors at the start of a run, so that matching takes time
in proportion to the text and no stack, however long a run is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.llm.common import let

SPAN = "array<struct<start:int,end:int,value:string>>"
_BLOCK = 64
_PIECE = 4096


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def located(text: Column, pattern: str, found: Column) -> Column:
    """start, end and value of each of the matches ``found`` of the pattern, in order.

    What lies between matches comes from splitting at the same pattern, so a start is
    the summed length of all that precedes.
    """

    def over(gaps: Column) -> Column:
        steps = F.transform(found, lambda v, i: F.length(F.get(gaps, i)) + F.length(v))

        def placed(ends: Column) -> Column:
            def span(value: Column, i: Column) -> Column:
                end = F.get(ends, i)
                return F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"))

            return F.transform(found, span)

        return let(running(steps, F.lit(0), lambda a, b: a + b), placed)

    return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), over)).otherwise(F.array().cast(SPAN))


def running(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Sums (by add) of all values up to each place of an int array.  Blocks keep the work
    near to the array's length; a fold that builds an array copies it at each step."""

    def of(v: Column) -> Column:
        def heads(sums: Column) -> Column:
            before = F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda b: F.aggregate(F.slice(sums, 1, b), zero, add))

            def each(head: Column) -> Column:
                def at(x: Column, i: Column) -> Column:
                    block = F.floor(i / _BLOCK).cast("int")
                    return F.aggregate(F.slice(v, block * _BLOCK + 1, i - block * _BLOCK + 1), F.get(head, block), add)

                return F.transform(v, at)

            return let(before, each)

        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int"))
        return let(F.transform(blocks, lambda b: F.aggregate(F.slice(v, b * _BLOCK + 1, _BLOCK), zero, add)), heads)

    return F.when(F.size(values) > 0, let(values, of)).otherwise(F.array().cast("array<int>"))


def pieces(text: Column) -> Column:
    """A text as pieces of _PIECE code points, for cut_out."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))


def cut_out(parts: Column, start: Column, end: Column) -> Column:
    """What lies from start to end; finding a place in a long text takes time in
    proportion to what precedes it, in pieces it does not."""
    first, last = F.floor(start / _PIECE).cast("int"), F.floor((F.greatest(end, start + 1) - 1) / _PIECE).cast("int")
    whole = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
    return F.substring(whole, start - first * _PIECE + 1, F.greatest(end - start, F.lit(0)))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _digit_sum(digits: Column) -> Column:
    return F.aggregate(F.split(digits, "(?!^)"), F.lit(0), lambda a, d: a + F.coalesce(d.try_cast("int"), F.lit(0)))


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid Luhn check digit."""
    back = F.reverse(digits)
    plain = F.regexp_replace(back, "(.).?", "$1")
    doubled = F.translate(F.regexp_replace(back, ".(.?)", "$1"), "0123456789", "0246813579")
    return (_digit_sum(plain) + _digit_sum(doubled)) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether letters and digits, first four moved to the end, leave 1 modulo 97."""
    moved = F.concat(F.substring(value, 5, 64), F.substring(value, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.array_remove(F.split(moved, "(?!^)"), ""), F.lit(0), step) == 1


def listing(spans: Column) -> Column:
    """kind:start:end of spans (sorted), comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
