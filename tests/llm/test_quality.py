import random
import re

import numpy as np

from siftline.llm import quality as Q
from siftline.llm.quality import reject_outliers


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = {t: tri.count(t) for t in set(tri)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    places = {i + k for i, t in enumerate(tri) if count[t] > 1 for k in range(3)}
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(places), n < 50 or 100 * len(places) > 50 * n)


def texts():
    rng = random.Random(2)
    out = [None, "", " \n\n", "a", "a b c", "a b c a b c", "x\n" * 60, "é😀 " * 200, "a b " * 3000, "\x0b|a\r\n|a\r\n"]
    for _ in range(500):
        w = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 9))) for _ in range(rng.randrange(40, 300))]
        out.append("".join(x + rng.choice([" ", " ", " ", "\n", "\t"]) for x in w))
    for k in range(10):
        out.append(" ".join("#|$%" * 9 + str(i) for i in range(100 + k)))
    return out


def test_counts_and_outliers(spark):
    cases = texts()
    df = spark.createDataFrame([(i, t, None if i % 9 == 0 else "en", f"s{i % 2}" if i % 7 else None, 1) for i, t in enumerate(cases)], "doc_id long, text string, lang string, source string, kept int")
    got = {r.doc_id: r for r in reject_outliers(df).collect()}
    assert len(got) == len(cases)
    for i, t in enumerate(cases):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), repr(t)[:80]
        assert not (r.base_failed and r.kept)
    plain = [got[i] for i in range(10, 510)]
    assert np.mean([r.kept for r in plain if not r.base_failed]) > 0.99
    assert not any(got[i].kept for i in range(510, 520))
    assert reject_outliers(df.limit(0)).count() == 0


def plain_determinant(x, starts=40):
    """Least log determinant of all starts of a plain minimum-covariance-determinant search."""
    rng, n, best = np.random.default_rng(0), len(x), np.inf
    h, floor = int(np.ceil(Q.SUBSET * n)), np.diag(np.square(Q.FLOOR))
    for _ in range(starts):
        near = rng.choice(n, 8, replace=False)
        for _ in range(60):
            mean, cov = x[near].mean(axis=0), np.cov(x[near].T, bias=True) + floor
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            new = np.argsort(d, kind="stable")[:h]
            if set(new) == set(near):
                break
            near = new
        best = min(best, np.linalg.slogdet(cov)[1])
    return best


def test_least_determinant(spark):
    """Two groups with outliers of their own: no start of a plain search does better."""
    rng = np.random.default_rng(4)
    groups = {}
    for name, n in (("a", 300), ("b", 900)):
        x = rng.normal(size=(n, 5)) @ rng.normal(size=(5, 5)) + rng.normal(size=5) * 5
        x[: n // 6] += 30
        groups[name] = x
    rows = [(g, *map(float, r)) for g, x in groups.items() for r in x]
    df = spark.createDataFrame(rows, "group string, " + ", ".join(f"{f} double" for f in Q.FEATURES))
    for r in Q.factored(Q.least_determinant(df)).collect():
        x = groups[r.group]
        assert r.n == len(x) and r.logdet <= plain_determinant(x) + 0.01
        good = x[len(x) // 6 :]
        assert np.allclose([r[f"m_{i}"] for i in range(5)], good.mean(axis=0), atol=0.6)


def test_small_groups_are_drawn_toward_all_rows(spark):
    table = spark.createDataFrame([("", 100, 1.0), ("s", 50, 3.0), ("l", 10**9, 3.0)], "group string, n long, scale double")
    got = {r.group: r.scale for r in Q._drawn(table, ["scale"]).collect()}
    assert got["s"] == 2.0 and abs(got["l"] - 3) < 1e-6 and got[""] == 1.0


def test_steps_end_with_each_group_though_limits_are_rough(spark, monkeypatch):
    """Limits of large groups are off by some rows, another way in each step: determinants go
    up and down for ever, and a group's steps end when its own falls no more."""
    rng = np.random.default_rng(5)
    rows = [(g, *map(float, r)) for g in "ab" for r in rng.normal(size=(400, 5))]
    df = spark.createDataFrame(rows, "group string, " + ", ".join(f"{f} double" for f in Q.FEATURES))
    nearest, shares = Q._nearest, []

    def rough(rows, share):
        shares.append(share)
        return nearest(rows, share + (0.01 if len(shares) % 2 else -0.01))

    monkeypatch.setattr(Q, "_nearest", rough)
    assert {r.group for r in Q.least_determinant(df).collect()} == {"a", "b"}
    assert len(shares) < 2 + Q.TRIALS + 10
