import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from siftline.llm import token_counts as C

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def cases():
    rng = random.Random(12)
    alphabet = list("aeint  \n\t'.,0129éßж日😀 　\x00") + ["'s", "'ll", "'RE", "the", " of", "<|endoftext|>", "<|endoftext", "\U000323b0", "͸"]
    texts = [None, "", " ", "a", "  x", "x  ", "x  <|endoftext|>  y", "<|endoftext|>" * 3, "''s 's'll", "a" * 500, " " * 400, "日本語" * 90, "don't've 12²"]
    return texts + ["".join(rng.choices(alphabet, k=rng.choice([1, 4, 20, 200]))) for _ in range(600)]


def counted(library, t):
    return len(library.encode(t or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("most", [C.HOT, 100, 1])
def test_counts_are_the_library_s(spark, library, most):
    """With most, few and no pre-tokens broadcast; long ones are broadcast as digests."""
    rows = [(i, t, 3) for i, t in enumerate(cases())] + [(None, "no id", 1), (5, "twice", 1), (5, "twice", 1), (9, "z" * 100 + " and", 0)] + [(100_000 + i, "q" * 90, 0) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = sorted(((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in C.count_tokens(df, FILE, limit=20, most=most).collect()))
    want = sorted((i or -1, len((t or "").encode()), counted(library, t), counted(library, t) > 20) for i, t, _ in rows)
    assert [(a if a >= 0 else -1, *r) for a, *r in got] == [(a if a >= 0 else -1, *r) for a, *r in want]
    assert C.count_tokens(df.limit(0), FILE).count() == 0


def test_every_character_is_classed_as_the_library_does():
    """Beside a letter, a digit and a sign, for all code points."""
    library = ByteLevel(add_prefix_space=False, use_regex=True)
    cutter = C.PreTokens((), C.unknown_letters())
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for beside in "a1!":
        for i in range(0, len(chars), 50_000):
            text = beside + beside.join(chars[i : i + 50_000]) + beside
            got, at = [], 0
            for t in cutter.of(text)[0]:
                got.append((at, at + len(t)))
                at += len(t)
            assert got == [span for _, span in library.pre_tokenize_str(text)]


def test_a_text_as_a_stream_gives_the_same(monkeypatch, library):
    text = "".join(t or "" for t in cases())
    cutter = C.PreTokens(("<|endoftext|>",), C.unknown_letters())
    whole = list(cutter.of(text)[0])
    monkeypatch.setattr(C, "LONG", 10)
    assert list(cutter.of(text)[0]) == whole


def test_a_very_long_text(spark, library):
    text = "some words, 12 of them'll " * 100_000 + "x" * 20_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert C.count_tokens(df, FILE, most=3).first().n_tokens == counted(library, text)


def test_each_distinct_pre_token_once(spark):
    df = spark.createDataFrame([(i, "the cat and the dog") for i in range(100)], "doc_id long, text string").repartition(4)
    got = {r.token: r.n for r in C.distinct_pre_tokens(df, C.read_rules(FILE)).collect()}
    assert got == {"the": 100, " cat": 100, " and": 100, " the": 100, " dog": 100}


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        C.read_rules(public_tokenizers.path("word_bpe_49k.json"))
