import random

import numpy as np
import pytest
import sentencepiece

from siftline.llm import piece_bpe
from siftline.llm.queries import piece_model_file


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model_file())


def cases():
    rng = random.Random(5)
    alphabet = list("aaabcdeeeiinnorstt  \n\t▁ßéü日本😀ﬁ２0123.,-_<>/\x00") + ["the", "ing", "  ", "́"]
    out = ["", " ", "   ", "a", " a b", "a\nb", "▁x", "<s></s><0x41>", "ﬁ ２", "\x00", "a" * 700, " " * 300, "ab" * 400, "日本語" * 90, "xyz0189" * 100]
    return out + ["".join(rng.choices(alphabet, k=rng.choice([1, 3, 10, 60, 400]))) for _ in range(1500)]


def test_ids_and_texts_are_the_library_s(library):
    model = piece_bpe.PieceModel(piece_model_file())
    texts = cases()
    flat, ends = model.encode(texts)
    begins = np.concatenate([[0], ends[:-1]])
    decoded = model.decode(flat, ends)
    for text, a, b, back in zip(texts, begins, ends, decoded, strict=True):
        ids = library.encode(text, add_eos=True)
        assert flat[a:b].tolist() == ids, repr(text)
        assert back == library.decode(ids), repr(text)


def test_long_units_as_the_library_does():
    """Random letters, few letters (many equal pairs side by side) and one very long unit."""
    model = piece_bpe.PieceModel(piece_model_file())
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model_file())
    rng = random.Random(1)
    units = ["".join(rng.choices("abeinrst"[:k], k=n)) for k in (1, 2, 3, 8) for n in (2, 9, 100, 900) for _ in range(6)]
    units += ["ing" * 700, "日本語" * 300, "".join(rng.choices("etaoinshrdlu", k=60_000))]
    flat, ends = model.encode(units)
    for unit, a, b in zip(units, [0, *ends[:-1]], ends, strict=True):
        assert flat[a:b].tolist() == library.encode(unit, add_eos=True)

def test_forgetting_changes_nothing(monkeypatch):
    texts = cases()[:300]
    want = piece_bpe.PieceModel(piece_model_file()).encode(texts)
    monkeypatch.setattr(piece_bpe, "CACHE_UNITS", 50)
    model = piece_bpe.PieceModel(piece_model_file())
    got = [model.encode([t])[0].tolist() for t in texts]
    assert [i for g in got for i in g] == want[0].tolist()


def test_rows(spark, library):
    rows = [(1, "a b", "x"), (2, None, "y"), (3, "", "z"), (3, "a b", None), (None, "q", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    got = piece_bpe.encode_decode(df, piece_model_file()).collect()
    assert sorted((r.doc_id or 0, r.token_ids, r.decoded) for r in got) == sorted((i or 0, library.encode(t or "", add_eos=True), t or "") for i, t, _ in rows)
    assert piece_bpe.encode_decode(df.limit(0), piece_model_file()).count() == 0
