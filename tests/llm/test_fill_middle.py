import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import fill_middle as M

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output)"""
    text = text or ""
    units = UNITS.findall(text)
    sha = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(sha[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:p]), "".join(units[p:q]), "".join(units[q:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def cases():
    rng = random.Random(11)
    alphabet = list("ab \n\t\x0b\x85 <>PSM日😀é") + ["word", "  ", "<P", "<<S", "S>", "\x00"]
    texts = [None, "", " ", "   \n", "a", " a", "a ", "x" * 300, " " * 300, "a b " * 200, "<P>", "x <M> y", "a<" + "S>b", "<<S>", "a<P", "é " * 150 + "\n"]
    texts += ["".join(rng.choices(alphabet, k=rng.choice([1, 5, 63, 64, 65, 128, 200, 700]))) for _ in range(400)]
    texts += ["".join(rng.choices(["one", "two ", " ", "\n", "three"], k=300)) for _ in range(100)]
    return list(enumerate(texts)) + [(None, "a b c d"), (7, "again"), (7, "again"), (7, None)]


@pytest.mark.parametrize("chunk", [M.CHUNK, 100, 7])
def test_rows_as_the_plain_version(spark, chunk):
    """Also where every text of some words is a giant one, whose cuts and markers lie
    anywhere in its chunks."""
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in cases()], "doc_id long, text string, n string, output int").repartition(3)
    out = M.fill_middle(df, chunk=chunk).withColumn("back", M.restore(F.col("output"), F.col("form")))
    key = lambda r: str(r)
    got = sorted(((r.doc_id, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.back) for r in out.collect()), key=key)
    want = sorted(((d, plain_version(d, t), t or "") for d, t in cases()), key=key)
    assert got == want
    assert {r[1][1] for r in got} == {"plain", "psm", "spm"}
    assert M.fill_middle(df.limit(0), chunk=chunk).count() == 0


def test_functions_compose():
    """Lanes of a text, composed from any state, end and count as a walk over it does."""
    rng = random.Random(3)
    texts = ["".join(rng.choices(list("a <P>\n"), k=k)) for k in (0, 1, 63, 64, 65, 500, 1000)]
    ends, counts = M.Scan(texts).totals()
    for i, t in enumerate(texts):
        for s in range(M.STATES):
            state, n = s, 0
            for c in M.classes_of(t):
                n += int(M.BEGINS[c, state])
                state = int(M.FOLLOWS[c, state])
            assert (ends[i, s], counts[i, s]) == (state, n)


def test_selection_finds_each_begin():
    text = "one  two\nthree" * 40 + "  "
    begins = [m.start() for m in UNITS.finditer(text)] + [len(text)]
    k = len(begins)
    found = M.Scan([text] * k).select(np.zeros(k, dtype=np.int64), np.arange(k))
    assert found.tolist() == begins


def test_a_giant_document(spark):
    rng = random.Random(8)
    text = " ".join(rng.choices(["alpha", "beta", "日本", "\n"], k=300_000))
    df = spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string")
    out = M.fill_middle(df).withColumn("back", M.restore(F.col("output"), F.col("form")) == F.lit(text))
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.filter("back").collect()}
    assert got == {i: plain_version(i, text) for i in range(4)}
