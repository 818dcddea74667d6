"""Personal data: patterns propose, checksums confirm, context words adjust.

Base kinds are email, ip, card and phone; a base span that passes its check is always
kept.  The kinds iban (length of its country, mod-97) and ssn are added where their score,
from the check and from words nearby, reaches ``ADDED_AT``.  Each span has its score.
Matching, checks, scores and redaction are Column expressions in one pass without a
shuffle, whose time grows with the text and the number of spans, not with their product.

Null or empty texts have no spans, and stay as they are.  Overlapping spans of different
kinds all count; redaction merges them.  Very long texts are worked on whole.  Repeated
rows each have their spans, an empty table gives an empty one.  All columns stay; one
with the name of the column that is added is replaced, no other name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import let, text_of
from siftline.llm.spans import cut_out, digits_of, located, luhn, matches, mod97, pieces, running

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
#: Countries by the length of their account numbers (ISO 13616).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
    25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA",
    30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # fewer than 12 digits can't pass, and a later start in the same run has fewer still
    "card": r"[0-9](?:[\x20-]?[0-9]){11}(?:[\x20-]?+[0-9])*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{c})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this can have no match (saves the pattern's pass).
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "host|server|address|\\bip\\b",
    "card": "card|visa|master|amex|credit|pay",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security",
}
#: Score of a span that matched and passed its check, and what a context word adds.
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT_ADDS = 0.3
CONTEXT_CHARS = 40
ADDED_AT = 0.7
SPANS = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"


def _part_ok(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)


def _passes(kind: str, value: Column) -> Column:
    digits = digits_of(value)
    if kind == "ip":
        return F.forall(F.split(value, "\\."), _part_ok)
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(value, "\x20", ""))
    if kind == "ssn":
        return ~value.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with a column of spans, sorted by start and then by kind as in KINDS."""
    body = text_of(text)

    def scored(rank: int, kind: str, parts: Column) -> Column:
        found = matches(body, PATTERNS[kind])
        if kind in NEEDS:
            found = F.when(F.contains(body, F.lit(NEEDS[kind])), found).otherwise(F.array().cast("array<string>"))

        def span(s: Column) -> Column:
            before = cut_out(parts, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)), s["start"])
            after = cut_out(parts, s["end"], s["end"] + CONTEXT_CHARS // 2)
            near = F.lower(before).rlike(CONTEXT[kind]) | F.lower(after).rlike(CONTEXT[kind])
            score = F.least(F.lit(1.0), F.lit(SCORE[kind]) + F.when(near, CONTEXT_ADDS).otherwise(0.0))
            return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), score.alias("score"))

        def spans(f: Column) -> Column:
            made = F.transform(F.filter(located(body, PATTERNS[kind], f), lambda s: _passes(kind, s["value"])), span)
            made = made if kind in BASE else F.filter(made, lambda s: s["score"] >= ADDED_AT)
            return F.when(F.size(f) > 0, made).otherwise(F.array().cast(SPANS))

        return let(found, spans)

    return docs.withColumn(out, let(pieces(body), lambda parts: F.array_sort(F.concat(*[scored(i, k, parts) for i, k in enumerate(KINDS)]))))


def redact(text: Column, spans: Column) -> Column:
    """text with each run of overlapping spans replaced by ``<KIND>`` of its first."""

    def over(ends: Column) -> Column:
        """ends: the farthest end of all spans up to each."""

        def before(i: Column) -> Column:
            return F.when(i > 0, F.get(ends, i - 1)).otherwise(0)

        def joined(parts: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                kept = F.concat(cut_out(parts, before(i), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
                return F.when(s["start"] >= before(i), kept).otherwise("")

            last = F.element_at(ends, -1)
            return F.concat(F.array_join(F.transform(spans, piece), ""), cut_out(parts, last, F.length(text)))

        return let(pieces(text), joined)

    return F.when(F.size(spans) > 0, let(running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b)), over)).otherwise(text)
