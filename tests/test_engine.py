"""Files in, chunks out: batch, stream, recovery, deletion, search."""

import hashlib
import http.server
import json
import math
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline import config as C
from siftline.functions import text as X
from siftline.functions import vector as V
from siftline.operators import access, catalog, search
from siftline.operators.embed import HashEmbedder, HttpEmbedder, hashed_counts
from siftline.plans.engine import Engine, page_count
from siftline.sources.files import read_files


def small_config(**more):
    c = C.Config(**more)
    c.chunker = C.Chunker(size=20, overlap=5)
    c.embedder.dimensions = 32
    c.instance_id = "here"
    return c


@pytest.fixture
def files(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.txt").write_text(" ".join(f"alpha{i}" for i in range(60)))
    (d / "b.json").write_text('{"k": "beta gamma"}')
    (d / "c.exe").write_text("x")
    (d / "d.txt").write_text((d / "a.txt").read_text())
    (d / "e.csv").write_text("a,b\n1\n")
    (d / "f.txt").write_text(" \t\n")
    (d / "g.html").write_text("<p>delta <b>epsilon</b>")
    return d


def engine(spark, tmp_path, **more):
    return Engine(spark, f"{tmp_path}/store", small_config(**more), HashEmbedder(32))


def test_batch(spark, tmp_path, files):
    e = engine(spark, tmp_path)
    aside = {r.filename: r.reason for r in e.ingest(str(files), "ns").collect()}
    assert set(aside) == {"c.exe", "d.txt"} and "unsupported" in aside["c.exe"] and "exists" in aside["d.txt"]
    page, total = e.list_documents("ns", limit=50)
    state = {r.filename: (r.status, r.chunk_count, r.error) for r in page.collect()}
    assert total == 5 and state["a.txt"] == ("completed", 4, None) and state["g.html"][0] == "completed"
    assert state["e.csv"][0] == "failed" and "wrong number of fields" in state["e.csv"][2]
    assert state["f.txt"][2] == 'parser returned empty text for "f.txt"'
    best = e.search("delta epsilon", "ns", 1).collect()
    assert [(r.filename, r.chunk_index, round(r.score, 4)) for r in best] == [("g.html", 0, 1.0)]
    assert e.search("alpha1 alpha2").count() == 5 and e.search("alpha1", "other").count() == 0
    with pytest.raises(ValueError):
        e.search("  ")
    assert {r.reason for r in e.ingest(str(files), "ns").collect()} >= {"document already exists"}
    assert e.list_documents("ns")[1] == 5
    doc = page.filter("filename = 'a.txt'").first()["id"]
    e.delete_document(doc, "ns")
    assert e.store.chunks().filter(F.col("document_id") == doc).count() == 0 and e.list_documents("ns")[1] == 4
    with pytest.raises(LookupError):
        e.delete_document(doc, "ns")
    with pytest.raises(LookupError):
        e.get_document(doc, "ns")
    for call in (e.get_document, e.delete_document):
        with pytest.raises(ValueError, match="not a document id"):
            call("17'", "ns")
    assert e.list_documents("ns", limit=3, offset=90)[0].count() == 1  # the last page
    assert e.health() == {"status": "ok", "code": 200, "services": {"database": "ok", "embedder": "ok"}}
    again = e.store.compact(f"{tmp_path}/compacted")
    assert again.documents().count() == 4 and again.chunks().count() == e.store.chunks().count()
    with pytest.raises(ValueError, match="dimensions"):
        Engine(spark, f"{tmp_path}/store", small_config(), HashEmbedder(16))


def test_stream_takes_each_file_once(spark, tmp_path, files):
    e = engine(spark, tmp_path)
    run = lambda: e.watch(str(files), "s", f"{tmp_path}/cp", available_now=True).awaitTermination(120)
    assert run()
    assert e.list_documents("s")[1] == 5
    chunks = e.store.chunks().count()
    (files / "h.md").write_text("zeta eta theta")
    assert run()
    assert e.list_documents("s")[1] == 6 and e.store.chunks().count() == chunks + 1
    # a replay of the first batch changes nothing
    from siftline.streaming import ingest

    first = read_files(spark, [str(p) for p in sorted(files.iterdir()) if p.name != "h.md"])
    name = "s" + hashlib.sha256(f"{tmp_path}/cp".encode()).hexdigest()[:16] + "-0"
    ingest.ingest_files(first, e.store, e.config, e.embedder, "s", name, e.store.seq_of(name))
    assert e.list_documents("s")[1] == 6 and e.store.chunks().count() == chunks + 1


def test_two_streams_into_one_namespace(spark, tmp_path):
    e = engine(spark, tmp_path)
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.txt").write_text(f"text of {name}")
        assert e.watch(f"{tmp_path}/{name}", "n", f"{tmp_path}/cp-{name}", available_now=True).awaitTermination(120)
    names = lambda: sorted(r.filename for r in e.list_documents("n", limit=9)[0].collect())
    assert names() == ["one.txt", "two.txt"] and e.search("two", "n", 1).first()["filename"] == "two.txt"
    # deleted, and there again with the same bytes under another name
    doc = e.list_documents("n", limit=9)[0].filter("filename = 'one.txt'").first()["id"]
    e.delete_document(doc, "n")
    assert names() == ["two.txt"] and e.search("one", "n").count() == 1
    (tmp_path / "one" / "again.txt").write_text("text of one")
    assert e.watch(f"{tmp_path}/one", "n", f"{tmp_path}/cp-one", available_now=True).awaitTermination(120)
    assert names() == ["again.txt", "two.txt"] and e.search("one", "n", 1).first()["filename"] == "again.txt"


def test_files_that_are_taken_in_can_go(spark, tmp_path):
    e = engine(spark, tmp_path)
    (tmp_path / "in").mkdir()
    query = e.watch(f"{tmp_path}/in", "n", f"{tmp_path}/cp", done="delete")
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text(f"number {k}")
        query.processAllAvailable()
    assert len(list((tmp_path / "in").iterdir())) < 3 and e.list_documents("n")[1] == 3
    e.close()
    assert not query.isActive and e.streams == []


def test_chunks_without_their_event_do_not_count(spark, tmp_path, files):
    """A crash between the chunks and the event of a later attempt."""
    from siftline.sources.files import identify
    from siftline.streaming import ingest

    e = engine(spark, tmp_path)
    e.ingest(str(files / "a.txt"), "n")
    before = sorted((r.id, r.attempt) for r in e.store.chunks().collect())
    again = identify(read_files(spark, str(files / "a.txt")), "n").withColumn("created_at", F.current_timestamp())
    later = e.store.now()
    e.store.append_chunks(ingest.chunk_rows(ingest.windows(ingest.prepare(again, e.config)), e.embedder, later), f"b{later}")
    assert sorted((r.id, r.attempt) for r in e.store.chunks("n").collect()) == before and len(before) == 4
    assert e.search("alpha1", "n", 9).count() == 4
    e.store.set_status(e.list_documents("n")[0].first()["id"], "processing")
    assert e.store.chunks().count() == 4  # a later state keeps the attempt


def test_search_reads_one_namespace_once(spark, tmp_path, files):
    e = engine(spark, tmp_path)
    e.ingest(str(files), "n")
    e.ingest(str(files), "m")
    plan = e.store.written_chunks("n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "(part#" in plan.split("PartitionFilters")[1].split("]")[0]
    want = [(r.document_id, r.chunk_index) for r in search.search(e.store.chunks("n"), e.store.documents("n"), e.embedder.one("alpha3 beta"), "n", 6).collect()]
    assert [(r.document_id, r.chunk_index) for r in e.search("alpha3 beta", "n", 6).collect()] == want
    assert e.search("alpha3", "n", search.LOOK_UP).count() == e.store.chunks("n").count()  # by the join


def test_http_embedder(spark):
    """A service that fails, cuts short and answers wrongly before it answers well."""
    answers, asked = [], []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, self.headers.get("Authorization"), body["model"], len(body["input"])))
            vectors = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]
            kind = answers.pop(0) if answers else "good"
            data = {"good": json.dumps({"data": vectors[::-1]}), "cut": '{"data": [', "few": json.dumps({"data": vectors[1:]}), "wide": json.dumps({"data": [v | {"embedding": [1.0] * 3} for v in vectors]}), "other": '{"error": 1}', "down": ""}[kind].encode()
            self.send_response(503 if kind == "down" else 200)
            self.send_header("Content-Length", str(len(data) + 5 * (kind == "cut")))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    embedder = HttpEmbedder(f"http://127.0.0.1:{server.server_port}/", "m", "k", 2, 2.0, max_retries=3, batch=2, pause=0.0)
    for bad in ("cut", "few", "wide", "other", "down"):
        answers[:] = [bad, bad]
        assert embedder.one("abc") == [3.0, 1.0] and not answers
    answers[:] = ["down"] * 3
    with pytest.raises(OSError, match="3 times"):
        embedder.one("abc")
    assert asked[0] == ("/v1/embeddings", "Bearer k", "m", 1)
    asked.clear()
    rows = spark.createDataFrame([("a",), ("bb",), (None,), ("cccc",), ("",)], "content string").coalesce(1)
    assert sorted(r.embedding for r in embedder.add(rows).collect()) == [[0.0, 1.0], [0.0, 1.0], [1.0, 1.0], [2.0, 1.0], [4.0, 1.0]]
    assert sorted(a[3] for a in asked) == [1, 2, 2]
    server.shutdown()


def test_hashed_words_by_column_and_by_numpy(spark):
    rows = spark.createDataFrame([("one two two",), ("",), (None,), ("é é é",)], "content string")
    for r in HashEmbedder(8).add(rows).withColumn("n", hashed_counts(F.coalesce("content", F.lit("")), 8)).collect():
        length = math.sqrt(sum(x * x for x in r.n)) or 1.0
        assert np.allclose(r.embedding, [x / length for x in r.n])


def test_recovery(spark, tmp_path, files):
    e = engine(spark, tmp_path)
    make = lambda i, path: e.store.create_document(i, "r", path.rsplit("/", 1)[1], "txt", None, path, "here")
    make("one", str(files / "a.txt"))
    make("two", str(files / "gone.txt"))
    e.store.set_status("one", "processing")
    e.store.create_document("three", "r", "x.txt", "txt", None, "/x", "elsewhere")
    got = dict(map(tuple, e.recover().collect()))
    assert got == {"one": "completed", "two": "failed"}
    rows = {r.id: r for r in e.store.documents().collect()}
    assert rows["three"].status == "pending" and rows["two"].error == "file not found on disk after restart"
    assert e.store.chunks().filter("document_id = 'one'").count() == 4
    assert e.store.clear_file_path("three") == 1 and e.store.set_status("nobody", "failed") == 0
    assert {r.id for r in catalog.unfinished(e.store.documents(), "elsewhere").collect()} == set()


def test_normalise_and_windows(spark):
    cases = {"a\tb": "ab", "a\r\nb": "a\nb", "a  b": "a b", "a 　 b": "a b", "a\u0085b": "ab", "\n\n a \n b \n": "a \n b", "\u0000": ""}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "x string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", X.normalise(F.col("x"))).collect())

    def loop(words, size, step):
        out, i = [], 0
        while words:
            out.append((len(out), " ".join(words[i : i + size])))
            if i + size >= len(words):
                break
            i += step
        return out

    rng = random.Random(1)
    texts = [" ".join(f"w{k}" for k in range(n)) for n in (0, 1, 511, 512, 513, 959, 960, 961, 1408, 1409)] + [" ".join("x" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 90))) for _ in range(40)]
    for size, overlap in ((512, 64), (7, 0), (10, 9), (1, 0)):
        for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.chunks(F.col("t"), size, overlap).alias("c"), X.chunk_count(F.col("t"), size, overlap).alias("n")).collect():
            want = loop(r.t.split(), size, size - overlap)
            assert [tuple(c) for c in r.c] == want and r.n == len(want)
    for bad in ((5, 5), (5, 6), (5, -1), (0, 0)):
        with pytest.raises(ValueError):
            X.chunks(F.col("t"), *bad)


def test_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(str(i), "d", "n", i, "c", rng.normal(size=8).tolist()) for i in range(30)] + [("z", "d", "n", 0, "c", [0.0] * 8), ("n", "d", "n", 0, "c", None), ("t", "d", "m", 0, "c", [1.0] * 8), ("u", "d", "m", 0, "c", [1.0] * 8)]
    chunks = spark.createDataFrame(rows, "id string, document_id string, namespace string, chunk_index int, content string, embedding array<float>").withColumn("metadata", F.create_map(F.lit("a"), F.lit("b")))
    docs = spark.createDataFrame([("d", "f.txt")], "id string, filename string")
    for vectorised in (False, True):
        got = search.search(chunks, docs, [1.0] * 8, limit=100, vectorised=vectorised).collect()
        assert [r.chunk_id for r in got[:2]] == ["t", "u"] and got[-1].chunk_id == "z" and len(got) == 33
        for r in got[:-1]:
            v = next(x[5] for x in rows if x[0] == r.chunk_id)
            assert math.isclose(r.score, sum(v) / math.sqrt(8) / np.linalg.norm(v), abs_tol=1e-6)
    assert search.search(chunks, docs, [1.0] * 8, "m", -1).count() == 2 and search.search(chunks, docs, [1.0] * 8).count() == 5
    assert V.cosine_to(F.col("embedding"), [0.0] * 8) is not None
    with pytest.raises(ValueError):
        search.check_dimensions(chunks, 9)


def test_lists(spark):
    docs = spark.createDataFrame([(str(i), "n" if i % 2 else "", f"f{9 - i}", "failed" if i % 3 else "pending", i) for i in range(9)], "id string, namespace string, filename string, status string, created_at int")
    ids = lambda **k: [r.id for r in catalog.list_documents(docs, k.pop("ns", ""), **k).collect()]
    assert ids() == ["8", "6", "4", "2", "0"] and ids(sort_order="asc", limit=2) == ["0", "2"]
    assert ids(sort_by="filename", sort_order="ASC") == ["8", "6", "4", "2", "0"] and ids(offset=99) == [] and ids(ns="n", status="pending") == ["3"]
    assert catalog.count_documents(docs, "n").first()["total"] == 4
    with pytest.raises(ValueError):
        ids(offset=-1)
    assert [page_count(n, 10) for n in (0, 1, 10, 11)] == [1, 1, 1, 2]


def test_access(spark):
    acl = spark.createDataFrame([("a", ["x"]), ("b", ["*"]), ("c", [])], "api_key string, namespaces array<string>")
    asks = [("a", "x", 200), ("a", "y", 403), ("b", "y", 200), (None, "x", 401), ("q", "x", 401), ("a", "", 400), ("a", "zzz", 400), ("c", "x", 403)]
    df = spark.createDataFrame(asks, "api_key string, namespace string, want int")
    assert all(r.code == r.want for r in access.check_requests(df, acl, ["x", "y"]).collect())
    assert access.check_requests(df, acl.limit(0), ["x"]).filter("code <> 200").count() == 0
    assert access.namespace_allowed(df, acl).count() == 2
    assert access.visible_namespaces("a", [("a", ["x"]), ("a", ["y"])], ["x", "y"]) == ["x"]
    assert access.visible_namespaces("b", [("b", ["*"])], ["x", "y"]) == ["x", "y"] and access.visible_namespaces("q", [("b", ["*"])], ["x"]) == []
    req = spark.createDataFrame([(1, "search_x", "n"), (2, "delete", "n"), (3, "search_x", "m"), (4, "delete", "")], "request_id int, tool string, namespace string")
    # a rule that can't be evaluated for a request is passed over
    rules = [("cast(tool as int) > 0", [], []), ("1 / (request_id - 2) > 0 and element_at(array(1), 5) = 1", [], []), ("tool is null", ["*"], []), ("no_such_claim = 1", ["*"], []), ("true", ["search_*"], ["n"])]
    assert [r.allowed for r in access.tool_policy(req, rules).orderBy("request_id").collect()] == [True, False, False, False]
    assert access.tool_policy(req, []).filter("allowed").count() == 4 and access.tool_policy(req, [("false", [], [])]).filter("allowed").count() == 0


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("KEY", "s3")
    p = tmp_path / "c.yaml"
    p.write_text("embedder: {api_key: '${KEY}', dimensions: 0}\nchunker: {size: 100}\nauth: {api_keys: [{key: k, namespaces: ['*']}]}\nnamespaces: [{name: n}]\n")
    c = C.load(str(p))
    assert (c.embedder.api_key, c.embedder.dimensions, c.chunker.size, c.chunker.overlap, c.auth.api_keys[0].namespaces, c.namespaces[0].name, c.worker.queue()) == ("s3", 768, 100, 64, ["*"], "n", 30)
    p.write_text("chunker: {size: 10, overlap: 10}")
    with pytest.raises(ValueError):
        C.load(str(p))


def test_health_has_a_deadline(spark, tmp_path, files, monkeypatch):
    e = engine(spark, tmp_path)
    slow = spark.range(1).select(F.col("id").cast("string").alias("id"), F.lit("").alias("namespace"), F.expr("reflect('java.lang.Thread', 'sleep', 60000L)").alias("created_at"))
    monkeypatch.setattr(e.store, "documents", lambda: slow)
    began = time.monotonic()
    got = e.health(seconds=2.0)
    assert time.monotonic() - began < 20 and (got["status"], got["code"]) == ("degraded", 503)
    assert got["services"] == {"database": "error: no answer within 2 s", "embedder": "ok"}
    end = time.monotonic() + 30
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.monotonic() < end:
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()  # cancelled


def test_uploads_are_swept(spark, tmp_path, files):
    e = engine(spark, tmp_path)
    e.ingest(str(files), "n")
    (files / "late.txt").write_text("not yet taken in")
    left = lambda: sorted(p.name for p in files.iterdir())
    assert e.sweep(str(files)) == 0  # within the grace time
    e.sweep(str(files), grace_seconds=0.0)
    assert left() == ["e.csv", "f.txt"]  # failed documents keep theirs
    e.delete_document(e.list_documents("n", status="failed", limit=9)[0].filter("filename = 'e.csv'").first()["id"], "n")
    assert e.sweep(str(files), grace_seconds=0.0) == 1 and left() == ["f.txt"]


def test_keys_alone(spark):
    acl = spark.createDataFrame([("a", ["x"]), ("a", ["y"])], "api_key string, namespaces array<string>")
    df = spark.createDataFrame([("a", 200), ("q", 401), (None, 401)], "api_key string, want int")
    assert all(r.code == r.want for r in access.check_key(df, acl).collect()) and access.check_key(df, acl).count() == 3
    assert access.check_key(df, acl.limit(0)).filter("code <> 200").count() == 0


def test_tools_by_name_and_policy(spark, tmp_path, files):
    e = engine(spark, tmp_path)
    rules = [('payload.role == "admin"', [], []), ('payload.role == "reader"', ["list_*", "search"], ["n"])]
    admin, reader = '{"role": "admin"}', '{"role": "reader"}'
    e.call("my_upload_document", {"path": str(files / "g.html"), "namespace": "n"}, rules, admin, prefix="my_")
    assert e.call("list_documents", {"namespace": "n"}, rules, reader)[1] == 1
    assert e.call("search", {"query": "delta", "namespace": "n", "limit": 1}, rules, reader).count() == 1
    for tool, arguments, payload in (("delete_document", {"id": "x", "namespace": "n"}, reader), ("search", {"query": "q", "namespace": "m"}, reader), ("search", {"query": "q"}, None)):
        with pytest.raises(PermissionError):
            e.call(tool, arguments, rules, payload)
    with pytest.raises(LookupError, match="no such tool"):
        e.call("close", {}, rules, admin)
    assert e.call("health", {})["status"] == "ok"  # without rules all is allowed
