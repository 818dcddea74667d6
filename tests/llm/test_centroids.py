import hashlib
import math
import random

import numpy as np
import pytest

from siftline.llm import centroids as K

D = K.DIMENSIONS


def plain_version(rows):
    """Lloyd's rounds in Python integers: (id, cluster, distance, inertia of it, of all, digest)."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == D and all(x is not None and math.isfinite(x) for x in v)]
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:8]]

    def assigned():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), k) for k, c in enumerate(centres)) for _, v in kept]

    for _ in range(10):
        at = assigned()
        for k in range(len(centres)):
            mine = [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == k]
            if mine:
                centres[k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    at = assigned()
    inertia = [sum(d for d, c in at if c == k) for k in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((str(i), c, d, inertia[c], sum(inertia), sha[c]) for (i, _), (d, c) in zip(kept, at, strict=True))


def run(spark, rows, kind="array<float>"):
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], f"vec_id long, embedding {kind}, cluster int").repartition(3)
    return sorted((str(r.vec_id), *r[1:]) for r in K.cluster_vectors(df).collect())


def floats(rng, n, spread=1.0):
    return [float(np.float32(rng.gauss(0, spread))) for _ in range(n)]


def test_as_the_plain_version(spark):
    rng = random.Random(13)
    rows = [(i, floats(rng, D, spread=0.1 + (i % 5))) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]  # rows and ids again, no id
    rows += [(400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 65), (404, [None, *[0.5] * 63]), (405, [math.nan, *[0.5] * 63]), (406, [-math.inf, *[0.5] * 63])]
    assert run(spark, rows) == plain_version(rows)


def test_ties_go_to_the_smaller_number(spark):
    """Few different vectors, so centroids are alike and distances equal."""
    rows = [(i, [float((i % 3) - 1)] * D) for i in range(40)]
    got = run(spark, rows, "array<double>")
    assert got == plain_version(rows)
    assert len({r[1] for r in got}) <= 3


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, n):
    rng = random.Random(n)
    rows = [(i, floats(rng, D)) for i in range(n)]
    assert run(spark, rows) == plain_version(rows)


def test_a_search_given_up_loses_nothing():
    rng = np.random.default_rng(4)
    rows, centres = rng.integers(-3, 4, (2_000, D)), rng.integers(-3, 4, (8, D))
    centres[5] = centres[2]
    label, best = K.nearest(rows, centres, rng.permutation(D))
    every = ((rows[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (label == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()


def test_distances_beyond_a_long_are_an_error(spark):
    rows = [(1, [1e30] * D), (2, [0.0] * D)]
    with pytest.raises(Exception, match="too large"):
        run(spark, rows)
