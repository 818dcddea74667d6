import random
import zlib

from siftline.llm import toxicity as T


def table(n=600, seed=4):
    rng = random.Random(seed)
    clean = ["word", "the", "river", "stone", "lamp", "idea", "idling", "märz", "cloud", "grass"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(clean) + rng.choice(["", "s", "ly", "en"]) for _ in range(rng.choice([10, 60, 300]))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(max(1, len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "1d10t", "ѕcum", "moron!", "vekuda", "vekulo", "Vekuni"])
        docs.append((i, " ".join(w), "x"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_fold():
    assert T.fold("1D10T, ѕсum! ｆｏｏ  st!pid? 99") == " idiot scum foo stipid "
    assert T.fold(None) == T.fold("") == "  "


def test_exception_phrases():
    lexicon = T.Lexicon({"trash": 3.0}, 1.0, 0.0)
    found = lexicon.automaton()
    assert lexicon.density(found, "a trash can") == 0 and lexicon.density(found, "such trash") > 0
    assert lexicon.density(found, "untrashed") == 0


def test_held_out_rows(spark):
    docs, labels = table()
    d = spark.createDataFrame([*docs, (9000, None, None), (9001, "", ""), (None, "idiot idiot idiot", "q"), (3, docs[3][1], "again")], "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (labels[5][0], 1, 0), (None, 0, 1), (7777, None, None)], "doc_id long, quality int, toxic int")
    rows = T.score_documents(d, lab).collect()
    assert len(rows) == len(docs) + 4
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in docs)
    assert by[9000].score == by[9001].score == 0
    tested = [(by[i].predicted, t) for i, _, t in labels if by[i].held_out]
    assert len(tested) > 100
    assert sum(p == t for p, t in tested) / len(tested) > 0.97
    assert by[None].predicted == 1  # obfuscated or not: the same entry
    kept = T.reject_toxic(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(r.predicted == 0 for r in rows)


def test_no_labels(spark):
    d = spark.createDataFrame([(1, "idiot")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in T.score_documents(d, lab).collect()] == [0.0]
    assert T.score_documents(d.limit(0), lab).count() == 0


def plain_density(text, weights, exceptions):
    """By substring search at starts of words, one entry after the other."""
    folded = T.fold(text)
    spans = lambda e: [(k, k + len(e)) for k in range(len(folded)) if folded.startswith(f" {e}", k - 1) and k]
    hidden = [s for e in exceptions for s in spans(e)]
    total = sum(w for e, w in weights.items() for a, b in spans(e) if not any(x <= a and b <= y for x, y in hidden))
    return 100 * total / (folded.count(" ") + T.SHORT)


def test_density_against_substring_search():
    rng = random.Random(8)
    weights = {"tra": 1.0, "trash": 2.5, "clown": 3.0, "fish": 0.5, "los": 1.5}
    lexicon = T.Lexicon(weights)
    found = lexicon.automaton()
    parts = ["trash", "trash can", "can", "clown fish", "fish", "Cl0wn", "l0ser bracket", "loser", "trash bin", "|", "a"]
    for n in (0, 1, 5, 40, 300):
        for _ in range(20):
            text = rng.choice([" ", "  ", ", "]).join(rng.choices(parts, k=n))
            assert abs(lexicon.density(found, text) - plain_density(text, weights, T.EXCEPTIONS)) < 1e-9, text


def test_very_long_text_of_exceptions():
    """Time in proportion: entries in 200,000 exception phrases."""
    lexicon = T.Lexicon({"trash": 2.0}, 1.0, 0.0)
    assert lexicon.density(lexicon.automaton(), "trash can " * 200_000) == 0
    assert lexicon.density(lexicon.automaton(), "trash can " * 200_000 + "trash") > 0
