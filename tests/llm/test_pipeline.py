"""The five stages against a plain version of each."""

import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import decontamination as D
from siftline.llm import pii
from siftline.llm.queries import piece_model_file
from siftline.llm.shingles import WordHashes
from tests_llm_helpers import brute_components


def corpus(seed=11):
    rng = random.Random(seed)
    word = lambda: rng.choice(["la", "mo", "ti", "ré"]) + rng.choice(["na", "ku", "so"]) + str(rng.randrange(500))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(5)]
    docs, labels = [], []
    for i in range(240):
        w = [word() for _ in range(rng.randrange(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["blarghest", "zonkers", "blarghino"])
        if i % 17 == 3:
            w[5:5] = items[i % 5][1].split()
        if i % 9 == 4:
            w.insert(3, f"me{i}@mail.example.org 10.1.2.{i % 250}")
        docs.append((i + 1000, " ".join(w)))
        labels.append((i + 1000, 1, int(toxic)))
    for k in range(30):  # copies, with an edit or none
        d, t = docs[k * 5 + 1]
        w = t.split()
        if k % 3 and len(w) > 90:
            w[40] = "edited"
        docs.append((k + 10, " ".join(w)))
    docs += [(1, None), (2, ""), (3, " \n"), (1001, docs[1][1]), (1, None)]
    return [(d, t, "en", "s", len(t or "")) for d, t in docs], items, labels


def kept_rows(rows, component):
    """One row of each group, by the smallest id and the least hash; component is by number."""
    groups = {}
    for (d, t), c in zip(rows, component, strict=True):
        key = c if (t or "").split() else ("empty", d, t or "")
        groups.setdefault(key, set()).add((d, hashlib.md5((t or "").encode()).hexdigest(), t or ""))
    return [(d, t) for d, _, t in map(min, groups.values())]


@pytest.fixture
def sf_dir(tmp_path):
    docs, items, labels = corpus()
    for name, rows, columns in (("documents", docs, ["doc_id", "text", "lang", "source", "n_chars"]), ("benchmark", items, ["item_id", "text"]), ("labels", labels, ["doc_id", "quality", "toxic"])):
        pq.write_table(pa.table({c: [r[k] for r in rows] for k, c in enumerate(columns)}), tmp_path / f"{name}.parquet")
    return tmp_path


def test_stages(spark, sf_dir):
    docs, items, _ = corpus()
    rows = [(d, t) for d, t, *_ in docs if not any(x in (t or "") for x in ("blargh", "zonkers"))]
    component = brute_components([(i, t) for i, (_, t) in enumerate(rows)], width=5, percent=80)
    rows = kept_rows(rows, component)
    cache = WordHashes()

    def leaks(text):
        h, w = D.shingled(cache, text, D.WIDTH)
        for _, t in items:
            ih, iw = D.shingled(cache, t, D.WIDTH)
            if any(D.similarity(h[a : a + len(ih)], w[a : a + len(ih)], ih, iw) >= D.SIMILARITY for a in range(len(h) - len(ih) + 1)):
                return True
        return False

    rows = [(d, t) for d, t in rows if not leaks(t)]
    assert 100 < len(rows) < 200
    plain = {}
    for d, t in rows:
        if "@" in (t or ""):
            head, rest = t.split(" me", 1)
            _, _, tail = rest.split(" ", 2)
            t = f"{head} <EMAIL> <IP> {tail}"
        plain.setdefault(d, []).append(t)
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model_file())
    want = sorted((d, library.encode(t or "", add_eos=True)) for d, ts in plain.items() for t in ts)
    got = corpus_pipeline.run(spark, str(sf_dir)).collect()
    assert sorted((r.doc_id, r.token_ids) for r in got) == want
    assert all(r.decoded_ok and r.n_tokens == len(r.token_ids) for r in got)


def test_stages_keep_the_columns_and_stand_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wide = docs.withColumns({"score": F.lit(1), "node": F.lit("x"), "key": F.lit(2), "_extra": F.lit(0), "kept": F.lit("k"), "_email": F.lit(1), "_pii": F.lit(2), "pii": F.lit(5), "hits": F.lit(3), "_hits": F.lit(6), "density": F.lit(4), "_score": F.lit(7), "row": F.lit(8), "any": F.lit(9)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(sf_dir)).columns == docs.columns
        out = stage(spark, wide, str(sf_dir))
        assert out.columns == wide.columns and out.filter("_pii <> 2 or pii <> 5 or hits <> 3 or density <> 4 or row <> 8").isEmpty() and not out.isEmpty()
        assert stage(spark, docs.limit(0), str(sf_dir)).count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and pii.KINDS[:4] == pii.BASE


def test_each_row_is_judged_by_its_own_text(spark):
    """Ids that several rows bear, one of them a near copy of another id."""
    rng = random.Random(3)
    text = lambda: [f"w{rng.randrange(10_000)}" for _ in range(120)]
    a, b, c, long = text(), text(), text(), [w for _ in range(400) for w in text()]
    near = lambda words: [*words[:60], "other", *words[61:]]
    rows = [(3, a), (5, near(a)), (5, b), (2, c), (2, near(c)), (None, a), (None, near(b)), (7, long), (8, near(long)), (9, None), (9, None), (9, []), (10, None)]
    rows = [(d, None if w is None else " ".join(w)) for d, w in rows]
    df = spark.createDataFrame([(d, t, "en", 1) for d, t in rows], "doc_id long, text string, lang string, row int")
    got = [(r.doc_id, r.text or "") for r in corpus_pipeline.near_duplicate_groups(spark, df, "").collect()]
    named = [(d, t) for d, t in rows if d is not None]
    want = kept_rows(named, brute_components([(i, t) for i, (_, t) in enumerate(named)], width=5, percent=80))
    assert sorted(map(str, got)) == sorted(map(str, [*want, *[(None, t) for d, t in rows if d is None]]))
    assert {d for d, _ in want} == {2, 3, 5, 7, 9, 10} and len(want) == 6
