import random

import numpy as np
import pytest

from siftline.llm import decontamination as D
from siftline.llm.shingles import WordHashes


def words(rng, n):
    return [rng.choice("abcdefgh") * rng.randrange(1, 4) + str(rng.randrange(400)) for _ in range(n)]


def corpus(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(words(rng, rng.choice([5, 14, 30, 59])))) for i in range(12)] + [(90, "two words"), (91, None), (92, ""), (93, "again " * 30), (94, "two words")]
    docs = []
    for i in range(120):
        w = words(rng, rng.choice([0, 3, 60, 400]))
        if i % 2:
            part = items[rng.randrange(12)][1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 3])):
                part[rng.randrange(len(part))] = "edited"
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        docs.append((i, (" " if i % 3 else ", ").join(w).upper()))
    return items, [*docs, (500, None), (501, ""), (502, "say Two, words!"), (503, items[0][1]), *[(510 + k, " ".join(t.split()[:-k])) for k, (_, t) in enumerate(items[:12]) if k], (530, " ".join(["again"] * 40)), (503, items[0][1])]


def brute(items, docs):
    cache, out = WordHashes(), {}
    for item, t in items:
        n = len(D.words_of(t))
        if not n:
            continue
        ih, iw = D.shingled(cache, t, D.WIDTH)
        for doc, text in docs:
            if n < D.WIDTH:
                dh, dw = D.shingled(cache, text, n)
            else:
                dh, dw = D.shingled(cache, text, D.WIDTH)
            s = min(len(ih), len(dh))
            best = max((D.similarity(dh[a : a + s], dw[a : a + s], ih, iw) for a in range(len(dh) - s + 1)), default=0) if s else 0
            if best >= D.SIMILARITY:
                out[doc, item] = round(best, 9)
    return out


@pytest.mark.parametrize("blocks", [D.ITEMS, 4])
def test_against_all_windows(spark, monkeypatch, blocks):
    monkeypatch.setattr(D, "ITEMS", blocks)
    items, docs = corpus(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, hits int, item_id int")
    want = brute(items, docs)
    assert len(want) > 20
    got = D.find_contamination(d, b).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == want
    assert len(got) == len(want) + sum(d == 503 for d, _ in want)  # that row is there twice
    kept = D.decontaminate(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _ in docs} - {i for i, _ in want})
    assert D.find_contamination(d, b.limit(0)).count() == 0 and D.find_contamination(d.limit(0), b).count() == 0


def test_index_misses_none_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 300, dtype=np.uint64)
    queries = prints[:40].copy()
    for k in range(40):
        for bit in rng.choice(64, size=k % 24, replace=False):
            queries[k] ^= np.uint64(1) << np.uint64(bit)
    q, i, _ = D.HammingIndex(prints).within(queries)
    got = set(zip(q.tolist(), i.tolist(), strict=True))
    want = {(q, i) for q in range(40) for i in range(300) if int(queries[q] ^ prints[i]).bit_count() <= D.RADIUS}
    assert got == want


def test_whole_items_in_longer_text():
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, 25))) for i in range(30)]
    block, cache = D.ItemBlock(items), WordHashes()
    text = " ".join(words(rng, 5_000) + items[7][1].split() + words(rng, 5_000))
    ((item, a, b, distance, sim),) = block.hits(cache, text)
    assert (item, a, b, distance, sim) == (7, 5_000, 5_025, 0, 1.0)


def test_a_very_long_text():
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, 40))) for i in range(50)]
    block, cache = D.ItemBlock(items), WordHashes()
    text = " ".join(words(rng, 150_000) + items[9][1].split()[:-2])
    ((item, begin, end, *_),) = block.hits(cache, text)
    assert item == 9 and begin in (149_998, 149_999, 150_000) and end == begin + 40
