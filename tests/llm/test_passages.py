import random
from collections import Counter

import numpy as np
import pyarrow as pa

from siftline.llm import passages as P
from siftline.llm.shingles import WordHashes, shingles, word_hashes

SCHEMA = "doc_id long, text string"


def prose(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randrange(900)) for _ in range(n)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"new{rng.randrange(10**6)}"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, f"more{rng.randrange(10**6)}")
    return words


def passages(words):
    """All passages of a text as bags of shingles, by plain slices."""
    tokens = [tuple(words[i : i + P.WIDTH]) for i in range(len(words) - P.WIDTH + 1)]
    return [Counter(tokens[i : i + P.TOKENS]) for i in range(len(tokens) - P.TOKENS + 1)]


def brute(texts):
    """Words of each text in linked passages, and the class of each stretch (text, first
    word, end word) as the least text in it, by comparing all passages of all texts."""
    bags = [passages(t) for t in texts]
    where = {}  # shingle -> passages with it
    for t, bs in enumerate(bags):
        for i, bag in enumerate(bs):
            for s in bag:
                where.setdefault(s, set()).add((t, i))
    links = []
    for t, bs in enumerate(bags):
        for i, bag in enumerate(bs):
            for u, j in set().union(*[where[s] for s in bag]) if bag else ():
                if u > t:
                    common = (bag & bags[u][j]).total()
                    if 100 * common >= P.SIMILARITY * (2 * P.TOKENS - common):
                        links.append((t, i, u, j))
    covered = [set() for _ in texts]
    starts = {}
    for t, i, u, j in links:
        common = bags[t][i] & bags[u][j]
        for a, k in ((t, i), (u, j)):
            hits = [w for w in range(k, k + P.TOKENS) if tuple(texts[a][w : w + P.WIDTH]) in common]
            covered[a].update(range(hits[0], hits[-1] + P.WIDTH))
            starts[t, i, u, j, a] = hits[0]
    stretches = {}
    for t, words in enumerate(covered):
        for w in sorted(words):
            if w - 1 in words:
                stretches[t, w] = stretches[t, w - 1]
            else:
                stretches[t, w] = (t, w)
    parent = {s: s for s in stretches.values()}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for t, i, u, j in links:
        parent[root(stretches[t, starts[t, i, u, j, t]])] = root(stretches[u, starts[t, i, u, j, u]])
    least = {}
    for s in parent:
        least[root(s)] = min(least.get(root(s), s[0]), s[0])
    return covered, {s: least[root(s)] for s in parent}


def test_compact_windows_are_the_wide_nodes():
    rng = np.random.default_rng(3)
    for n, top in ((5, 9), (46, 1000), (300, 50), (700, 10**6)):
        v = rng.integers(0, top, n, dtype=np.uint64) << np.uint64(40)
        want = {}
        for i in range(n - P.TOKENS + 1):
            want.setdefault(i + int(np.argmin(v[i : i + P.TOKENS])), []).append(i)
        c, lo, hi = P.window_runs(v)
        assert {k: [a, b] for k, a, b in zip(c.tolist(), lo.tolist(), hi.tolist(), strict=True)} == {k: [s[0], s[-1]] for k, s in want.items()}
        for k, a, b in zip(c.tolist(), lo.tolist(), hi.tolist(), strict=True):
            left, right = P.interval(v, k)
            assert (a, b) == (max(left, k - P.TOKENS + 1), min(k, right - P.TOKENS + 1)) and v[left : right + 1].min() == v[k]


def test_texts_laid_end_to_end_keep_their_own_windows():
    rng, cache = random.Random(2), WordHashes()
    texts = [cache.of(" ".join(prose(rng, n))) for n in (0, 3, 49, 50, 51, 300, 20, 700)] + [cache.of("a b " * 90)]
    tokens = [shingles(w, P.WIDTH) if len(w) >= P.WORDS else w[:0] for w in texts]
    laid = P.Texts(tokens)
    k, c, lo, hi = laid.windows()
    for i, own in enumerate(tokens):
        alone = P.Texts([own]).windows()
        mine = laid.of[c] == i
        start = laid.start[i]
        assert [k[mine].tolist(), *[(v[mine] - start).tolist() for v in (c, lo, hi)]] == [v.tolist() for v in alone]


def test_compare_against_all_passages():
    """No text too many; at least 99 of 100 words in linked passages are found."""
    rng, cache = random.Random(1), WordHashes()
    pairs, tokens = [], []
    for t in range(60):
        p = prose(rng, rng.randrange(50, 110))
        if t % 10 == 0:
            p = p[:20] * 4
        if t % 15 == 0:
            p[10:10] = ["so"] * 30
        pairs.append((prose(rng, rng.randrange(50)) + p, prose(rng, rng.randrange(50)) + edited(rng, p, rng.randrange(4))))
        tokens += [shingles(cache.of(" ".join(w)), P.WIDTH) for w in pairs[-1]]
    found = P.compare(tokens, np.arange(0, 120, 2), np.arange(1, 120, 2))
    want, got = set(), set()
    for t, (x, y) in enumerate(pairs):
        covered, _ = brute([x, y])
        want |= {(t, k, w) for k in (0, 1) for w in covered[k]}
    for t, a, b, a2, b2, similarity in zip(*found, strict=True):
        assert 0.8 <= similarity <= 1
        got |= {(t, 0, w) for w in range(a, b + P.WIDTH)} | {(t, 1, w) for w in range(a2, b2 + P.WIDTH)}
    assert {(t, k) for t, k, _ in want} == {(t, k) for t, k, _ in got}
    # an end of a link may have its partner next to the passage: at most WIDTH words more
    near = {(t, k, w + d) for t, k, w in want for d in range(-P.WIDTH, P.WIDTH + 1)}
    assert got <= near and len(got - want) < 0.005 * len(want) and len(got & want) > 0.99 * len(want)


def corpus(seed):
    """Texts with passages that two, several and most of them share, some edited; lines
    shorter than a passage; texts of one word; variants that link only to each other."""
    rng = random.Random(seed)
    hot, line, small = prose(rng, 65), prose(rng, 20), [prose(rng, 55) for _ in range(4)]
    variants = [hot[:28] + prose(rng, 30), hot[:28] + prose(rng, 30)]  # share a line with hot only
    texts = []
    for i in range(70):
        w = prose(rng, rng.randrange(20, 90))
        at = rng.randrange(len(w))
        if i % 3 == 0:
            w[at:at] = edited(rng, hot, rng.choice([0, 0, 1, 1, 2]))
        elif i % 7 == 1:
            w[at:at] = variants[i % 2]
        elif i % 5 == 1:
            w[at:at] = edited(rng, small[i % 4], rng.choice([0, 1]))
        else:
            w[at:at] = line
        texts.append(w)
    texts += [["so"] * n for n in (60, 75)] + [prose(rng, 10) + ["so"] * 55, [*small[0], *line, *small[1], *line, *line]]
    return texts


def test_all_links_of_a_corpus(spark, monkeypatch):
    """Against all pairs of passages: every text and class is found, with stars and blocks too."""
    for seed, few, block in ((1, 4, 2000), (2, 2, 7)):
        monkeypatch.setattr(P, "PAIRS_TO", few)
        monkeypatch.setattr(P, "BLOCK", block)
        texts = corpus(seed)
        covered, classes = brute(texts)
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], SCHEMA)
        got = P.find_repeats(df).collect()
        mine = [set() for _ in texts]
        for r in got:
            mine[r.doc_id].update(range(r.first_word, r.end_word))
            assert r.partner_id != r.doc_id and 0.8 <= r.similarity <= 1
        assert sum(len(m - c) for m, c in zip(mine, covered, strict=True)) < 0.005 * sum(map(len, covered))
        assert [bool(m) for m in mine] == [bool(c) for c in covered]
        assert sum(map(len, mine)) > 0.98 * sum(map(len, covered))
        by_class = lambda rows: sorted({(t, c) for t, c in rows})
        assert by_class((r.doc_id, r.class_id) for r in got) == by_class((t, c) for (t, _), c in classes.items())


def test_links_in_groups(monkeypatch):
    """Of members with half of a passage and members with an edit of all of it: only the
    latter are linked, alone or in a batch of groups, each label once in a large one."""
    rng, cache = random.Random(5), WordHashes()
    hot = prose(rng, 70)
    rows = []
    for i in range(30):
        w = prose(rng, 50) + (edited(rng, hot[:34], 1) + hot[34:] if i % 2 else hot[:39] + prose(rng, 40)) + prose(rng, 50)
        t = shingles(cache.of(" ".join(w)), P.WIDTH)
        c = next((k for k in range(len(t)) if w[k : k + P.WIDTH] == hot[34:39]), None)
        if c is not None:
            around = (t[max(0, c - P.TOKENS + 1) : c + P.TOKENS] >> np.uint64(32)).astype(np.uint32).tobytes()
            rows += [(g, asks, bytes([i]) * 16, i.to_bytes(16), min(c, P.TOKENS - 1), around) for g in (1, 2) for asks in (True, False)]
    rows.sort()
    edits = {r[2] for r in rows if r[2][0] % 2}
    columns = [list(v) for v in zip(*rows, strict=True)]
    found = P.links_in_groups(*columns)
    near = {frozenset(p) for p in found}
    assert near <= {frozenset((a, b)) for a in edits for b in edits if a != b} and {k for p in near for k in p} == edits
    monkeypatch.setattr(P, "_TOGETHER", 10)
    found = P.links_in_groups(*columns)
    assert {frozenset(p) for p in found} <= near and {k for p in found for k in p} == edits and len(found) < len(near)


def test_rows_of_all_kinds(spark):
    rng = random.Random(14)
    passage = prose(rng, 60)
    a, b = prose(rng, 30) + passage + prose(rng, 20), prose(rng, 50) + passage + prose(rng, 40)
    texts = [*(" ".join(w) for w in (a, a, a, b, b)), None, "", "x", " ".join(prose(rng, 49))]
    rows = [(i, t, 0, "x") for i, t in enumerate(texts)] + [(None, " ".join(prose(rng, 90)), 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_links int, class string")
    got = sorted((r.doc_id, r.first_word, r.end_word, r.class_id, r.partner_id, r.n_links) for r in P.find_repeats(df).collect())
    first = [r for d, other in ((0, 2), (1, 0), (2, 0)) for r in ((d, 0, 110, 0, other, 2), (d, 30, 90, 0, 3, 4))]
    assert got == first + [r for d, other in ((3, 4), (4, 3)) for r in ((d, 0, 150, 3, other, 1), (d, 50, 110, 0, 0, 4))]
    assert P.find_repeats(df.limit(0)).count() == 0
    # a row twice is two documents of one text; a null id is never a partner
    twice = spark.createDataFrame([(7, texts[0]), (7, texts[0]), (None, texts[3])], SCHEMA)
    got = sorted((r.doc_id or 0, r.first_word, r.partner_id) for r in P.find_repeats(twice).collect())
    assert got == [(0, 50, 7), (7, 0, 7), (7, 0, 7), (7, 30, None), (7, 30, None)]


def test_a_very_long_text(spark):
    rng = random.Random(4)
    passage = prose(rng, 80)
    long = prose(rng, 60_000) + passage + ["again"] * 30_000 + ["to", "and", "fro"] * 9_000
    df = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(prose(rng, 30) + passage))], SCHEMA)
    assert sorted((r.doc_id, r.first_word, r.end_word) for r in P.find_repeats(df).collect()) == [(1, 60_000, 60_080), (2, 30, 110)]


def repeating(rng):
    """Two texts that share a passage of 70 words verbatim and repeat fragments of it, more
    often before it in one and after it in the other; and where the passage begins."""
    passage = prose(rng, 70)
    cut_out = [passage[i : i + 30] for i in (0, 20, 40)]
    some = lambda n: [w for _ in range(n) for w in [*rng.choice(cut_out), *prose(rng, rng.randrange(3))]]
    before, after = some(12), [*prose(rng, 5), *some(3)]
    return [*before, *passage, *some(3)], [*after, *passage, *some(12)], len(before), len(after)


def words_in(found):
    """Words of both texts of a pair that its links cover."""
    out = [set(), set()]
    for i, j, k, m in zip(*(v.tolist() for v in found[1:5]), strict=True):
        out[0].update(range(i, j + P.WIDTH))
        out[1].update(range(k, m + P.WIDTH))
    return out


def test_a_passage_among_its_own_fragments(spark, monkeypatch):
    """Tokens recur at different ranks on both sides of what the texts share.  Links are
    those of a join of all pairs of places, none of them false, and the passage is one."""
    cache = WordHashes()
    for seed in range(6):
        a, b, at, at_b = repeating(random.Random(seed))
        tokens = [shingles(cache.of(" ".join(t)), P.WIDTH) for t in (a, b)]
        found = P.compare(tokens, np.array([0]), np.array([1]))
        got, (covered, _) = words_in(found), brute([a, b])
        assert got[0] >= set(range(at, at + 70)) and got[1] >= set(range(at_b, at_b + 70)) and found[5].max() == 1.0
        assert all(mine <= {w + d for w in want for d in range(-P.WIDTH, P.WIDTH + 1)} for mine, want in zip(got, covered, strict=True))
        with monkeypatch.context() as m:
            m.setattr(P, "PLACES", 10**9)
            assert words_in(P.compare(tokens, np.array([0]), np.array([1]))) == got
        if seed < 2:
            df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], SCHEMA)
            rows = P.find_repeats(df).collect()
            assert {r.doc_id for r in rows} == {1, 2} and len({r.class_id for r in rows}) == 1


def test_lines_again_and_again_link_wherever_they_are(monkeypatch):
    """Repeats of linked passages are covered, on both sides, and bands of diagonals give
    what one join gives."""
    rng, cache = random.Random(4), WordHashes()
    line, tail = prose(rng, 35), prose(rng, 60)
    a = [*(w for k in range(25) for w in [*line, f"a{k}"]), *tail, *line * 20]
    b = [*prose(rng, 30), *line * 12, *prose(rng, 9), *(w for k in range(25) for w in [*line, f"b{k}"]), *tail]
    tokens = [shingles(cache.of(" ".join(t)), P.WIDTH) for t in (a, b)]
    covered, _ = brute([a, b])
    got = words_in(P.compare(tokens, np.array([0]), np.array([1])))
    for mine, want in zip(got, covered, strict=True):  # an end may have its partner next to the passage
        assert mine <= {w + d for w in want for d in range(-P.WIDTH, P.WIDTH + 1)} and len(want - mine) <= 0.02 * len(want)
    monkeypatch.setattr(P, "JOINED", 500)
    assert words_in(P.compare(tokens, np.array([0]), np.array([1]))) == got
    monkeypatch.setattr(P, "PLACES", 10**9)
    for mine, whole in zip(got, words_in(P.compare(tokens, np.array([0]), np.array([1]))), strict=True):
        assert len(mine ^ whole) <= P.WIDTH


def test_members_of_a_large_group_are_looked_at_together(monkeypatch):
    """One call for thousands of pairs, not one for each member; the links are those of all
    pairs, one for each member and label that is not linked yet."""
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 2**32, 2 * P.TOKENS - 1, dtype=np.uint32) for _ in range(6)]
    around = [b.copy() for b in (base[int(k)] for k in rng.integers(0, 6, 330))]
    for a in around:
        a[rng.integers(0, len(a), 4)] = rng.integers(0, 2**32, 4, dtype=np.uint32)
        a[P.TOKENS - 1] = 7
    names = [b"%016d" % i for i in range(330)]
    asks = [i < 300 for i in range(330)]
    linked, calls = P._linked, []
    monkeypatch.setattr(P, "_linked", lambda *a: calls.append(1) or linked(*a))
    got = P.links_in_groups([1] * 330, asks, names, names, [P.TOKENS - 1] * 330, [a.tobytes() for a in around])
    assert len(calls) <= 2 + -(-300 * 30 // P._TOGETHER) + 1
    monkeypatch.undo()
    monkeypatch.setattr(P, "_TOGETHER", 10**9)  # all pairs as one
    whole = P.links_in_groups([1] * 330, asks, names, names, [P.TOKENS - 1] * 330, [a.tobytes() for a in around])
    assert set(got) <= set(whole) and got

    def parts(pairs):
        of = {n: n for n in names}

        def root(n):
            while of[n] != n:
                n = of[n]
            return n

        for a, b in pairs:
            of[root(a)] = root(b)
        groups = {}
        for n in names:
            groups.setdefault(root(n), set()).add(n)
        return sorted(map(sorted, groups.values()))

    assert parts(got) == parts(whole)


def test_a_short_line_of_many_texts_asks_few_pairs(monkeypatch):
    """Of members that share a line shorter than a passage, and tokens elsewhere with others,
    few pairs are looked at; the links are those of all pairs."""
    rng = np.random.default_rng(8)
    size, centre = 2 * P.TOKENS - 1, P.TOKENS - 1
    pool, line = rng.integers(1, 2**32, 3_000, dtype=np.uint32), rng.integers(1, 2**32, 30, dtype=np.uint32)
    around = [rng.choice(pool, size) for _ in range(400)]
    for i in range(0, 40, 2):  # near copies, some of them a place further on
        around[i + 1] = around[i].copy()
        around[i + 1][rng.integers(0, size, 3)] = 5
        if i % 4:
            around[i + 1][centre + 8 :] = np.concatenate([[6], around[i + 1][centre + 8 : -1]])
    for a in around:
        a[centre - 15 : centre + 15] = line
    names = [b"%016d" % i for i in range(800)]
    rows = ([1] * 800, [i < 400 for i in range(800)], names[:400] * 2, names[:400] * 2, [centre] * 800, [a.tobytes() for a in around] * 2)
    linked, pairs = P._linked, []
    monkeypatch.setattr(P, "_linked", lambda *a: pairs.append(len(a[3])) or linked(*a))
    got = P.links_in_groups(*rows)
    assert sum(pairs) < 400 * 400 / 20
    pairs.clear()
    monkeypatch.setattr(P, "_TOGETHER", 10**9)  # all pairs as one
    whole = P.links_in_groups(*rows)
    assert sum(pairs) > 400 * 390 and {frozenset(p) for p in got} == {frozenset(p) for p in whole} and len({frozenset(p) for p in whole}) >= 15


def test_links_do_not_depend_on_the_row_before():
    """The first token of a row isn't common because the last one of the row before has its
    partner at the next place."""
    rng = np.random.default_rng(2)
    a = rng.integers(1, 2**32, P.TOKENS, dtype=np.uint32)
    b = a.copy()
    b[0] = 1
    texts = P.Texts([a, b, np.concatenate([[2], a]).astype(np.uint32)])
    x, y, n = np.array([0, 0]), np.array([texts.start[2], texts.start[1]]), np.array([1, 1])
    both = P.verify(texts, x, y, n)
    alone = P.verify(texts, x[1:], y[1:], n[1:])
    assert [v[both[0] == 1].tolist() for v in both[1:]] == [v.tolist() for v in alone[1:]] and alone[3].tolist() == [1]


def test_hashes_of_all_words_at_once():
    """Words are split and lower-cased as by WordHashes, and equal ones alone have one hash."""
    rng = random.Random(6)
    texts = [None, "", "x", " \t", f"{'A' * 300} {'a' * 300} {'a' * 299}b", "É é ß\x00 \x00\x0b\x1c a\x85b  c", "12345678 123456789 1234567 12345678"]
    texts += ["".join(rng.choice("aAbBZz09é日\U0001f600 \t\n\x0b\x0c\r\x1c\x00") * rng.choice([1, 1, 1, 9]) for _ in range(rng.randrange(60))) for _ in range(300)]
    for column in (pa.array(texts), pa.array(texts).slice(3, 200), pa.array(texts, pa.large_string()), pa.array([], pa.string()), pa.array([None, None], pa.string())):
        got, count = word_hashes(column)
        words = [(t or "").encode().lower().split() for t in column.to_pylist()]
        flat = [w for ws in words for w in ws]
        assert count.tolist() == [len(w) for w in words] and len(flat) == len(got)
        assert len(set(zip(flat, got.tolist(), strict=True))) == len(set(flat)) == len(set(got.tolist()))
