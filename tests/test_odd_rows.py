"""Queries on rows that the small tables lack, against their SQL."""

import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry


@pytest.fixture
def agrees(spark, tmp_path):
    """Whether a query gives what its SQL gives, over one table of these rows."""

    def check(name, table, kind, rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        want = con.execute(entry.oracle_sql()[name])
        columns = [d[0] for d in want.description]
        there = sorted(map(str, want.fetchall()))
        return sorted(str(tuple(r)) for r in entry.queries()[name](spark, str(tmp_path)).select(*columns).collect()) == there and there

    return check


def test_long_urls(agrees):
    urls = [f"https://a.example.net/{'y' * k}" for k in range(0, 120, 7)]
    assert agrees("small_functions", "pages", "page_id long, url string", list(enumerate(urls)))


#: Documents some of which have no words, or no letters.
BLANK = [(n, t, "en", "web", len(t)) for n, t in enumerate(["one two", "", " \n ", "three four " * 300, "É.", "five", "", "six."])]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["ingest_stream", "ingest_with_failures", "lifecycle_counts"])
def test_blank_documents(agrees, name):
    assert agrees(name, "documents", DOCUMENTS, BLANK)


def test_documents_without_letters(agrees):
    texts = ["É."] * 13 + [""] * 13 + ["1 2", "a É"] * 13
    assert agrees("parse_documents", "documents", DOCUMENTS, [(n, t, "fr", "web", len(t)) for n, t in enumerate(texts)])


def brute(rows, asked, k):
    """The k best of each query by products of sequential sums; ties by id."""
    out = []
    for q, v in asked:
        length = math.sqrt(sum(x * x for x in v))
        scores = [(-sum(x * y for x, y in zip(v, r, strict=True)) / length / math.sqrt(sum(x * x for x in r)), i) for i, r in rows if r and len(r) == len(v) and any(r)] if length else []
        out += [(q, i, n + 1) for n, (_, i) in enumerate(sorted((round(s, 9), i) for s, i in scores)[:k])]
    return sorted(out)


def test_many_queries_at_once(spark, tmp_path, monkeypatch):
    """Exactly the best: among many near copies, copies, and vectors that are no such."""
    from siftline.operators import vector_index

    for name, n in (("ASKED", 7), ("ROWS", 32), ("BLOCKS", 2)):
        monkeypatch.setattr(vector_index, name, n, raising=False)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=16)
    near = [middle + 0.05 * rng.normal(size=16) for _ in range(250)]
    rows = [(f"v{i}", np.float32(v).astype(float).tolist()) for i, v in enumerate([*near, *rng.normal(size=(150, 16))])]
    rows += [(f"c{i}", rows[5][1]) for i in range(40)] + [("null", None), ("short", [1.0] * 8), ("zero", [0.0] * 16)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(3)
    index = vector_index.VectorIndex(spark, f"{tmp_path}/i").fit(df, cells=4, parts=4, slots=2).add(df)
    asked = [r for r in rows if r[1] and len(r[1]) == 16][::9] + [("z", [0.0] * 16)]
    got = index.search_rows(spark.createDataFrame(asked, "query_id string, vector array<float>"), k=10).collect()
    assert sorted((r.query_id, r.id, r.place) for r in got) == brute(rows, asked, 10)


def test_pairs_of_long_documents(spark, tmp_path, monkeypatch):
    """All pairs, of which each task makes those of two blocks."""
    from siftline.operators import search
    from siftline.plans import queries

    monkeypatch.setattr(search, "PAIRED", 8, raising=False)
    monkeypatch.setattr(search, "TILE", 3, raising=False)
    rng = np.random.default_rng(4)
    rows = {n: np.float32(rng.normal(size=12)).astype(float).tolist() for n in [*range(7, 9_000, 200), *range(8, 1_000, 200)]}
    rows |= {9_007: None, 9_207: [0.0] * 12, 9_407: [1.0] * 5, 9_607: [1.0, 2.0, 3.0, 4.0, 6.0], 9_807: rows[7]}
    spark.createDataFrame([(n, v, 1) for n, v in rows.items()], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.cosine_within_document(spark, str(tmp_path))
    want = {}
    for n, v in rows.items():
        for m, w in rows.items():
            if n % 200 == m % 200 and str(n) < str(m):
                usable = v and w and len(v) == len(w) and any(v) and any(w)
                want[str(n), str(m)] = float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)) if usable else None
    got = {(r.a, r.b): r.score for r in found.collect()}
    assert got.keys() == want.keys() and all((s is None) == (want[p] is None) and (s is None or abs(s - want[p]) < 1e-6) for p, s in got.items())
    assert found.count() == len(want) and "Join" not in str(found._jdf.queryExecution().optimizedPlan()).partition("FlatMapGroupsInArrow")[0]


def test_queries_stay_off_the_driver(spark, tmp_path, monkeypatch):
    """A table of queries is searched without a query or a candidate on the driver."""
    from siftline.operators.vector_index import VectorIndex

    rows = [(str(i), np.random.default_rng(i).normal(size=8).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    index = VectorIndex(spark, f"{tmp_path}/i").fit(df, cells=2, parts=2, slots=2).add(df)

    def refuse(*_, **__):
        raise AssertionError("rows on the driver")

    with monkeypatch.context() as m:
        for name in ("collect", "toLocalIterator", "toPandas", "toArrow"):
            m.setattr(type(df), name, refuse)
        found = index.search_rows(df.selectExpr("id query_id", "embedding vector"), k=3)
    assert found.count() == 120
