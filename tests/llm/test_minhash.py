import random

import numpy as np

from siftline.llm import minhash
from tests_llm_helpers import brute_components, word_sets


def brute(rows, width=4, percent=80):
    components = brute_components(rows, width, percent)
    sizes = map(len, word_sets(rows, width))
    return sorted((d if d is not None else -1, n, c if c is not None else -1) for (d, _), n, c in zip(rows, sizes, components, strict=True))


def corpus(seed, groups=8, size=14):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "the", "of", "é", "x"]) + str(rng.randrange(300))
    rows, ids = [], iter(rng.sample(range(10_000), 2_000))
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 30, 90]))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = word()
            rows.append((next(ids), " ".join(w) if rng.random() < 0.8 else "\n ".join(w).upper()))
    rows += [(next(ids), " ".join(word() for _ in range(40))) for _ in range(60)]
    return rows + [(next(ids), None), (next(ids), ""), (next(ids), " \t"), (rows[0][0], rows[0][1])]


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS_TO", 3)  # so that stars and blocks are used too
    for seed in (1, 2):
        rows = corpus(seed)
        got = minhash.near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_shingles int")).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = minhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (5, "A b c d"), (None, "q")], schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, False), (0, 5, False), (0, 5, False), (5, 5, True)]


def test_posterior_bounds():
    least = minhash.least_matches(80)
    assert list(least) == sorted(least) and all(0 < m < 0.8 * n for m, n in zip(least, range(20, 141, 20), strict=True))
    rng = np.random.default_rng(0)
    a = rng.integers(0, 9, (50, minhash.HASHES), dtype=np.uint32)
    assert minhash.survivors(a, a.copy(), 80).tolist() == list(range(50))
    assert not len(minhash.survivors(a, a + np.uint32(1), 80))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)]
    got = dict(map(tuple, minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
