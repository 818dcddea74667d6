"""Versions of a store, its life cycle, its index and what fails alone."""

import http.server
import json
import sys
import threading
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from siftline import config as C
from siftline import schema as S
from siftline.operators.embed import HashEmbedder, HttpEmbedder, add_vectors
from siftline.operators.manifest import Conflict, Folder
from siftline.operators.store import Store, bucket, transitions
from siftline.plans.engine import Engine
from siftline.streaming import ingest

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


def settings(dimensions=8, **worker):
    c = C.Config(worker=C.Worker(**worker))
    c.chunker = C.Chunker(size=20, overlap=5)
    c.embedder.dimensions = dimensions
    c.instance_id = "here"
    return c


class Refusing(HashEmbedder):
    """Refuses texts with a certain word, so often (-1: always)."""

    def __init__(self, dimensions, word, times=-1):
        super().__init__(dimensions)
        self.word, self.times = word, times

    def add(self, df, text="content", out="embedding"):
        again = self.times != 0
        self.times -= 1

        def vectors(texts):
            bad = [again and self.word in (t or "").split() for t in texts]
            return [None if b else v for b, v in zip(bad, self._vectors(texts).tolist(), strict=True)], ["refused" if b else None for b in bad]

        return add_vectors(df, text, out, vectors)


def texts(spark, rows):
    """(name, text) as files."""
    df = spark.createDataFrame([(f"/in/{n}.txt", t) for n, t in rows], "path string, t string")
    return df.select("path", F.timestamp_seconds(F.lit(1)).alias("modificationTime"), F.length("t").cast("long").alias("length"), F.col("t").cast("binary").alias("content"))


def states(store):
    return {r.filename: (r.status, r.chunk_count, r.error) for r in store.documents().collect()}


# --- documents that fail alone ------------------------------------------------------
def test_one_document_of_many_fails_alone(spark, tmp_path):
    c, store = settings(max_retries=3), Store(spark, f"{tmp_path}/s", 8)
    rows = [(f"d{i}", f"text number {i}") for i in range(200)] + [("bad", " ".join(["fine"] * 30) + " poison")]
    ingest.ingest_files(texts(spark, rows), store, c, Refusing(8, "poison"), "n", "b1", store.now(), retry_seconds=0.0)
    got = states(store)
    assert got.pop("bad.txt") == ("processing", 0, "generating embeddings: refused")
    assert set(got.values()) == {("completed", 1, None)} and len(got) == 200
    ingest.retry_all(store, c, Refusing(8, "poison"), retry_seconds=0.0)
    assert states(store)["bad.txt"] == ("failed", 0, "generating embeddings: refused")
    last = store.events().filter("filename = 'bad.txt'").orderBy(F.desc("seq")).first()
    assert last.tries == 3 and last.next_try is None and last.file_path == "/in/bad.txt"
    assert store.chunks().count() == 200  # also its windows that have a vector don't count


def test_a_later_try_completes_from_the_windows_kept(spark, tmp_path):
    """The file is not read again, and compaction in between keeps its windows."""
    c, store = settings(max_retries=3), Store(spark, f"{tmp_path}/s", 8)
    e = Refusing(8, "slow", times=1)
    ingest.ingest_files(texts(spark, [("a", " ".join(f"w{i}" for i in range(50)) + " slow"), ("b", "quick")]), store, c, e, "n", "b1", store.now(), retry_seconds=3600.0)
    assert ingest.retry(store, c, e) == 0  # not due yet
    store.compact(whole=True, grace_seconds=0.0)
    assert states(store)["a.txt"][0] == "processing" and store.chunks().count() == 1
    assert ingest.retry(store, c, e, at=F.current_timestamp() + F.expr("interval 2 hours")) == 1
    assert states(store) == {"a.txt": ("completed", 4, None), "b.txt": ("completed", 1, None)}
    assert sorted(r.chunk_index for r in store.chunks().filter("embedding is not null").collect()) == [0, 0, 1, 2, 3]
    assert ingest.waiting(store).count() == 0


class Service(http.server.BaseHTTPRequestHandler):
    """Refuses the text "no", and counts requests in flight."""

    flying = most = 0
    lock = threading.Lock()
    down = False

    def do_POST(self):
        cls = type(self)
        with cls.lock:
            cls.flying += 1
            cls.most = max(cls.most, cls.flying)
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
        time.sleep(0.02)
        code = 503 if cls.down else 422 if any("no" in t.split() for t in asked) else 200
        body = json.dumps({"data": [{"index": i, "embedding": [1.0, float(len(t))]} for i, t in enumerate(asked)]}).encode()
        with cls.lock:
            cls.flying -= 1
        self.send_response(code)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    kind = type("Own", (Service,), {"lock": threading.Lock()})
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), kind)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    kind.url = f"http://127.0.0.1:{server.server_port}"
    yield kind
    server.shutdown()


def test_a_refused_text_is_found_by_halving(spark, service):
    rows = spark.createDataFrame([(f"t{i}" if i != 11 else "oh no",) for i in range(40)], "content string").coalesce(1)
    found = HttpEmbedder(service.url, "m", dimensions=2, batch=16).add(rows).collect()
    assert [r.content for r in found if r.embedding is None] == ["oh no"] and "422" in next(r.error for r in found if r.error)
    service.down = True
    found = HttpEmbedder(service.url, "m", dimensions=2, batch=16).add(rows).collect()
    assert all(r.embedding is None and "503" in r.error for r in found)


def test_requests_in_flight_are_bounded(spark, tmp_path, service):
    c = settings(2, pool_size=2)
    store = Store(spark, f"{tmp_path}/s", 2)
    rows = texts(spark, [(f"d{i}", f"number {i}") for i in range(60)]).repartition(12)
    ingest.ingest_files(rows, store, c, HttpEmbedder(service.url, "m", dimensions=2, batch=4), "n", "b1", store.now())
    assert service.most == 2 and {s[0] for s in states(store).values()} == {"completed"}


# --- life cycle ---------------------------------------------------------------------
class Killed(Exception):
    pass


def test_a_batch_that_dies_is_finished_from_the_log(spark, tmp_path, monkeypatch):
    d = tmp_path / "in"
    d.mkdir()
    for name in ("a", "b", "gone"):
        (d / f"{name}.txt").write_text(f"text of {name}")
    c = settings(lease_seconds=30.0)
    e = Engine(spark, f"{tmp_path}/store", c, HashEmbedder(8))

    def die(*_, **__):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(ingest, "finish", die)
        with pytest.raises(Killed):
            e.ingest(str(d), "n")
    assert {s[0] for s in states(e.store).values()} == {"processing"} and e.store.chunks().count() == 0
    (d / "gone.txt").unlink()
    # while the lease of the batch holds, recovery leaves its documents alone
    batch = e.store.events().select("batch_id").filter("batch_id like '%.p'").first()[0].removesuffix(".p")
    with e.store.lease(batch, 30.0):
        assert e.store.running() == [batch] and e.recover().count() == 0
    got = {r.id: r.status for r in e.recover().collect()}
    assert sorted(got.values()) == ["completed", "completed", "failed"]
    assert states(e.store)["gone.txt"] == ("failed", 0, "file not found on disk after restart")
    assert states(e.store)["a.txt"] == ("completed", 1, None) and e.store.chunks().count() == 2
    counts = {(r.from_status, r.to_status): r.n for r in transitions(e.store.events()).collect()}
    assert counts == {(None, "pending"): 3, ("pending", "processing"): 3, ("processing", "failed"): 1, ("processing", "processing"): 2, ("processing", "completed"): 2}
    assert e.recover().count() == 0


def test_a_lease_runs_out_with_its_driver(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", 8)
    store.log.files.write("leases/dead", json.dumps({"until": store.now() - 1}))
    store.log.files.write("leases/half", '{"un')
    with store.lease("alive", 5.0):
        assert store.running() == ["alive"]
    assert store.running() == []


# --- versions -----------------------------------------------------------------------
def add(store, i, spark):
    rows = texts(spark, [(f"d{i}", f"text number {i}")])
    ingest.ingest_files(rows, store, settings(), HashEmbedder(8), "n", f"b{i}", store.now())


def test_of_two_writers_both_commit(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", 8)
    errors = []

    def write(k):
        try:
            for j in range(15):
                store.log.commit([Folder("chunks", f"w{k}-{j}", f"w{k}", 1)])
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    now = store.snapshot()
    assert not errors and len(now.folders) == 60 and now.version == 61 and len(store.log.versions()) == 61
    with pytest.raises(Conflict):
        store.log.commit(remove=["w0-0", "never there"])
    assert "w0-0" in store.snapshot().folders


def test_small_batches_merge_next_to_a_reader_and_a_writer(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", 8)
    at, sizes = None, []
    for i in range(12):
        add(store, i, spark)
        if i == 5:
            at = store.pinned()
            before = at.chunks()
        store.upkeep()
        sizes.append(max(len(store.snapshot().of(t)) for t in ("events", "chunks", "hashes")))
    assert max(sizes) < 24 and len(states(store)) == 12 and store.chunks().count() == 12
    # a reader keeps what it opened
    assert before.count() == 6 and at.documents().count() == 6
    with pytest.raises(ValueError, match="read only"):
        at.change(F.lit(True), deleted=F.lit(True))
    # a merge that another writer overtook is left for the next time
    stale = store.pinned()
    store.compact(whole=True)
    with pytest.raises(Conflict):
        store.log.commit(remove=list(stale.snapshot().folders))
    assert all(len(store.snapshot().of(t)) == 1 for t in ("events", "chunks", "hashes"))
    # within the grace time nothing goes that a reader may hold
    assert store.vacuum(grace_seconds=3600.0) == 0 and before.count() == 6
    assert store.vacuum(grace_seconds=0.0) > 20
    assert store.documents().count() == 12 and store.chunks().count() == 12 and len(store.log.versions()) <= 11


def test_what_no_longer_counts_goes_with_a_whole_merge(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", 8)
    for i in range(3):
        add(store, i, spark)
    store.change(F.col("filename") == "d1.txt", deleted=F.lit(True))
    store.compact(whole=True)
    assert store.written_chunks().count() == 2 and store.documents().count() == 2
    assert store.events().filter("deleted").count() == 1  # a batch that still runs may meet it
    store.compact(whole=True, grace_seconds=0.0)
    add(store, 9, spark)
    store.compact(whole=True, grace_seconds=0.0)
    assert store.events().filter("deleted").count() == 0 and store.documents().count() == 3
    add(store, 1, spark)  # the same bytes come again
    assert sorted(states(store)) == ["d0.txt", "d1.txt", "d2.txt", "d9.txt"]


def test_a_stream_s_batch_counts_once(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", 8)
    rows = texts(spark, [("a", "one text")])
    for _ in range(2):  # a replay that began before the end was seen
        ingest.ingest_files(rows, store, settings(), HashEmbedder(8), "n", "sx-0", store.seq_of("sx-0"), ("x", 0))
        store.compact(whole=True)
    assert store.chunks().count() == 1 and store.snapshot().meta["streams"] == {"x": 0}
    assert store.seq_of("sx-0") == store.seq_of("sx-0")


def files_read(rows):
    return rows.select(F.input_file_name().alias("f")).distinct().count()


# --- index and metadata -------------------------------------------------------------
def test_the_index_reads_only_buckets_of_the_hashes_that_come(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", 8)
    n = 4_000
    rows = spark.range(n).select(F.lit("n").alias("namespace"), F.sha2(F.col("id").cast("string"), 256).alias("file_hash"), F.col("id").cast("string").alias("id"), F.lit(1).alias("seq"), (F.col("id") % 7 == 0).alias("deleted"))
    store.commit([store.stage(rows, "hashes", "old", depth=6)])
    come = rows.filter("id in ('5', '7', '11')").select("file_hash").unionByName(spark.createDataFrame([("new",)], "file_hash string"))
    found = store.known_hashes("n", come)
    assert {r.file_hash for r in found.collect()} == {r.file_hash for r in rows.filter("id in ('5', '11')").collect()}
    assert store.known_hashes("m", come).count() == 0
    plan = found._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "bucket#" in text.split("PartitionFilters")[1].split("]")[0]
    asked = {r[0] for r in come.select(bucket(F.col("file_hash"), 6)).collect()}
    assert len(asked) <= 4 and files_read(store._read("hashes", buckets={6: sorted(asked)})) <= 4 < files_read(store._read("hashes"))


def test_a_point_change_reads_one_bucket(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", 8)
    row = {"namespace": F.lit("n"), "filename": F.lit("f"), "format": F.lit("txt"), "status": F.lit("completed"), "chunk_count": F.lit(0), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp(), "seq": F.lit(1)}
    docs = spark.range(3_000).select(F.col("id").cast("string").alias("id")).withColumns(row)
    store.commit([store.stage(docs, "events", "old", depth=5)])
    assert files_read(store.events(ids=["17"])) == 1 < files_read(store.events())
    assert store.set_status("17", "failed", "why") == 1 and store.documents(ids=["17"]).first().error == "why"
    assert store.set_status("none", "failed") == 0 and store.documents().count() == 3_000


def test_opening_reads_no_data(spark, tmp_path):
    path = f"{tmp_path}/s"
    store = Store(spark, path, 8)
    add(store, 1, spark)
    # broken data files: nothing of them is read
    for f in (tmp_path / "s" / "chunks").rglob("*.parquet"):
        f.write_bytes(b"broken")
    again = Store(spark, path, 8)
    assert sum(f.rows for f in again.snapshot().of("chunks")) == 1
    with pytest.raises(ValueError, match="have 8 dimensions, not 9"):
        Store(spark, path, 9)


def test_an_older_store_gains_columns(spark, tmp_path):
    path = f"{tmp_path}/s"
    store = Store(spark, path, 8)
    add(store, 1, spark)
    old = store.snapshot()
    store.log.commit(meta={"schema": 1, "columns": {"events": S.DOCUMENTS.names}})
    name = old.of("chunks")[0].name
    rows = store._read("chunks", folders=old.of("chunks")).drop("batch", "error")
    rows.withColumns({"part": F.lit("nn"), "bucket": F.lit(0)}).write.partitionBy("part", "bucket").parquet(f"{path}/chunks/batch={name}-old")
    store.log.commit([Folder("chunks", f"{name}-old", "x", 1)], [name])
    again = Store(spark, path, 8)
    assert again.snapshot().meta["schema"] == 2 and "next_try" in again.snapshot().meta["columns"]["events"]
    assert again.chunks().select("error").first()[0] is None
