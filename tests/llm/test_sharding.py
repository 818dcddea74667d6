import zlib
from collections import Counter

import numpy as np
import pytest

from siftline.llm.sharding import ROUNDS, permute, shard_documents


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    p = permute(np.arange(n), n, 7)
    assert sorted(p.tolist()) == list(range(n))
    assert permute(np.array([n - 1]), n, 7)[0] == p[-1]
    if n >= 1000:
        assert p.tolist() != permute(np.arange(n), n, 8).tolist()
        assert abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.1


def test_shards(spark):
    rows = [(i % 90, "t" * (i % 7) if i % 5 else None, i) for i in range(203)] + [(None, "ü", 1)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, size int").repartition(7)
    got = shard_documents(df).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted(r.row_number for r in got) == list(range(len(rows)))
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    again = shard_documents(df.repartition(3)).collect()
    key = lambda rs: Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rs)
    assert key(got) == key(again)
    assert shard_documents(df.limit(0)).count() == 0
    assert len(shard_documents(df, n_shards=1).filter("shard = 0").collect()) == len(rows)


def scalar(number, n, seed):
    """One number through the network, in plain integers."""
    wrap = 2**64

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % wrap
        x = (x ^ x >> 27) * 0x94D049BB133111EB % wrap
        return x ^ x >> 31

    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys = [mix((k + seed * 0x9E3779B97F4A7C15) % wrap) for k in range(1, ROUNDS + 1)]
    while True:
        left, right = number >> half, number % 2**half
        for key in keys:
            left, right = right, left ^ mix(right ^ key) % 2**half
        number = (left << half) + right
        if number < n:
            return number


def test_places_are_those_of_a_scalar_network(spark):
    for n in (1, 2, 7, 100, 5000):
        assert permute(np.arange(n), n, 99).tolist() == [scalar(i, n, 99) for i in range(n)]
    df = spark.createDataFrame([(i, "x" * (i % 5)) for i in range(150)] + [(3, "long " * 100_000)], "doc_id long, text string")
    for r in shard_documents(df, n_shards=4, seed=5).collect():
        p = scalar(r.row_number, 151, 5)
        assert (r.permuted, r.shard, r.slot) == (p, p % 4, p // 4)
