"""Mutable documents and chunks on append-only Parquet.

Every change of a document is a row in ``events``; the latest row of an id is its
state, and a deleted one hides the document and its chunks.  Changes of all writers are
ordered by ``seq``, microseconds since 1970.  Chunks carry the number of the attempt that
wrote them; that of the latest event counts.  ``hashes`` says which content came to a
namespace and went.  Columns that an older store lacks are null.

Each write is a new folder ``<table>/batch=<name>``, below which rows lie by namespace and
by a bucket of their key; a version of the manifest makes it visible (see manifest).  Fresh
folders have one bucket, merged ones as many as their rows need, so what looks for a few
keys reads a few buckets of bounded size.  A session on a store reads no data: sizes,
schema and row counts are in the manifest.
"""

from __future__ import annotations

import contextlib
import json
import math
import re
import threading
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline import schema as S
from siftline.operators.manifest import NAMESPACES, Conflict, Folder, Log, Snapshot

TABLES = {"events": S.EVENTS, "chunks": S.CHUNKS, "hashes": S.HASHES}
#: The column whose hash deals a table's rows to buckets, and how many rows a bucket should have.
KEYS = {"events": "id", "chunks": "document_id", "hashes": "file_hash"}
BUCKET_ROWS = {"events": 200_000, "chunks": 500_000, "hashes": 200_000}
MAX_DEPTH = 12
#: Compaction in tiers merges so many folders of about the same size.
FAN = 8
#: Up to so many keys are looked up by their buckets.
FEW_KEYS = 256
SCHEMA_VERSION = 2
LEASE_SECONDS = 60.0


def latest(events: DataFrame) -> DataFrame:
    """One row per id: the event of the highest seq, partial maxima first."""
    columns = [c for c in events.columns if c != "id"]
    best = events.groupBy("id").agg(F.max_by(F.struct(*columns), "seq").alias("e"))
    return best.select("id", *[F.col(f"e.{c}").alias(c) for c in columns])


def live(events: DataFrame) -> DataFrame:
    return latest(events).filter(~F.coalesce("deleted", F.lit(False)))


def cascade(chunks: DataFrame, deleted: DataFrame) -> DataFrame:
    """chunks without those of deleted documents (column id)."""
    return chunks.join(deleted.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def transitions(events: DataFrame) -> DataFrame:
    """How often each status followed another."""
    from pyspark.sql import Window

    before = F.lag("status").over(Window.partitionBy("id").orderBy("seq"))
    return events.withColumn("from_status", before).groupBy("from_status", F.col("status").alias("to_status")).agg(F.count(F.lit(1)).alias("n"))


def bucket(key: Column, depth: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(2**depth)).cast("int")


def depth_for(rows: int, most: int) -> int:
    """Buckets of about ``most`` rows; null keys and hot ones may have more."""
    return min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, rows) / most))))


def shaped(rows: DataFrame, kind: T.StructType) -> DataFrame:
    """The columns of a table, those that rows lacks as null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])


class Store:
    """The tables below a folder."""

    def __init__(self, spark: SparkSession, path: str, dimensions: int) -> None:
        self.spark, self.path, self.dimensions = spark, path.rstrip("/"), dimensions
        self.log = Log(spark, self.path)
        self._pinned: Snapshot | None = None
        self._migrate()

    # --- versions -------------------------------------------------------------------
    def _migrate(self) -> None:
        """Say what is missing in the manifest; refuse a store with vectors of another size."""
        meta = self.snapshot().meta
        while meta.get("schema", 0) < SCHEMA_VERSION or "dimensions" not in meta:
            new = {"schema": SCHEMA_VERSION, "columns": {n: k.names for n, k in TABLES.items()}}
            meta = self.log.commit(meta=new if "dimensions" in meta else new | {"dimensions": self.dimensions}).meta
        if meta["dimensions"] != self.dimensions:
            raise ValueError(f"stored vectors have {meta['dimensions']} dimensions, not {self.dimensions}")

    def snapshot(self) -> Snapshot:
        return self._pinned or self.log.snapshot()

    def pinned(self) -> Store:
        """The store as it is now, whatever is written or merged later."""
        out = object.__new__(Store)
        out.__dict__ |= self.__dict__ | {"_pinned": self.snapshot()}
        return out

    # --- reading --------------------------------------------------------------------
    def _read(self, name: str, namespace: str | None = None, keys: list[str] | None = None, buckets: dict[int, list[int]] | None = None, folders: list[Folder] | None = None) -> DataFrame:
        """A table with the batch that wrote each row.  Of one namespace, only its folders
        are read; of few keys, or of buckets by depth, only these buckets."""
        kind = TABLES[name]
        whole = T.StructType([*kind.fields, T.StructField("part", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.StringType())])
        folders = self.snapshot().of(name, namespace) if folders is None else folders
        out: DataFrame | None = None
        for depth in sorted({f.depth for f in folders}):
            places = [f"{self.path}/{name}/batch={f.name}" for f in folders if f.depth == depth]
            rows = self.spark.read.schema(whole).option("basePath", f"{self.path}/{name}").parquet(*places)
            if namespace is not None:
                rows = rows.filter((F.col("part") == _part(namespace)) & (F.col("namespace") == namespace))
            if keys is not None and len(keys) <= FEW_KEYS:
                rows = rows.filter(F.col("bucket").isin([bucket(F.lit(k), depth) for k in keys]) if depth else F.lit(True))
                rows = rows.filter(F.col(KEYS[name]).isin(keys))
            elif keys is not None:
                rows = rows.filter(F.col(KEYS[name]).isin(keys))
            if buckets is not None and depth:
                rows = rows.filter(F.col("bucket").isin(buckets[depth]))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            out = self.spark.createDataFrame([], whole)
        return out.withColumn("batch", F.regexp_replace("batch", "-[0-9a-f]{8}$", "")).drop("part", "bucket")

    def events(self, namespace: str | None = None, without: str | None = None, ids: list[str] | None = None) -> DataFrame:
        """All events, or those of a namespace or of some ids; without those of one batch."""
        rows = self._read("events", namespace, ids)
        return (rows if without is None else rows.filter(F.col("batch") != without)).drop("batch")

    def documents(self, namespace: str | None = None, ids: list[str] | None = None) -> DataFrame:
        return live(self.events(namespace, ids=ids)).select(*S.DOCUMENTS.names)

    def written_chunks(self, namespace: str | None = None) -> DataFrame:
        """All chunks that were ever written, also those that don't count any more."""
        return self._read("chunks", namespace).drop("batch")

    def counted(self, chunks: DataFrame, events: DataFrame) -> DataFrame:
        """chunks of the attempt that the latest event of a live document names, with its
        filename.  Chunks without an event don't count."""
        now = live(events).select(F.col("id").alias("_id"), F.col("attempt").alias("_attempt"), F.col("filename").alias("filename"))
        mine = (F.col("document_id") == F.col("_id")) & (F.col("_attempt").isNull() | (F.col("attempt") == F.col("_attempt")))
        return chunks.join(now, mine).drop("_id", "_attempt")

    def chunks(self, namespace: str | None = None) -> DataFrame:
        at = self.pinned()
        return at.counted(at.written_chunks(namespace), at.events(namespace)).select(*S.CHUNKS.names)

    def known_hashes(self, namespace: str, come: DataFrame, without: str | None = None) -> DataFrame:
        """namespace and file_hash of live documents among the hashes that come (column
        file_hash): of merged folders only the buckets of these hashes are read."""
        folders = self.snapshot().of("hashes", namespace)
        deepest = max((f.depth for f in folders), default=0)
        buckets = None
        if deepest:
            asked = [r["b"] for r in come.select(bucket(F.col("file_hash"), deepest).alias("b")).distinct().collect()]  # 2 ** MAX_DEPTH at most
            buckets = {d: sorted({b % 2**d for b in asked}) for d in range(1, deepest + 1)}
        rows = self._read("hashes", namespace, buckets=buckets, folders=folders)
        rows = rows if without is None else rows.filter(F.col("batch") != without)
        mine = rows.join(come.select("file_hash").distinct(), "file_hash", "left_semi")
        now = mine.groupBy("namespace", "file_hash", "id").agg(F.max_by("deleted", "seq").alias("deleted"))
        return now.filter(~F.coalesce("deleted", F.lit(False))).select("namespace", "file_hash").distinct()

    # --- writing --------------------------------------------------------------------
    @staticmethod
    def now() -> int:
        return time.time_ns() // 1000

    def stage(self, rows: DataFrame, table: str, batch: str, depth: int = 0) -> Folder:
        """Write rows to a new folder, which no reader sees before it is committed."""
        name = f"{batch}-{uuid.uuid4().hex[:8]}"
        seen = Observation()
        rows = shaped(rows, TABLES[table])
        if depth:
            rows = rows.repartition("namespace", bucket(F.col(KEYS[table]), depth))
        out = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.collect_set("namespace").alias("namespaces"))
        out = out.withColumns({"part": F.concat(F.lit(_part("")), "namespace"), "bucket": bucket(F.col(KEYS[table]), depth) if depth else F.lit(0)})
        out.write.partitionBy("part", "bucket").parquet(f"{self.path}/{table}/batch={name}")
        found = seen.get
        spaces = sorted(found["namespaces"])
        return Folder(table, name, batch, found["rows"], depth, tuple(spaces) if len(spaces) <= NAMESPACES else None)

    def commit(self, folders: list[Folder], replace: str | None = None, stream: tuple[str, int] | None = None) -> None:
        """Make staged folders visible, all at once."""
        if self._pinned:
            raise ValueError("a pinned store is read only")
        self.log.commit([f for f in folders if f.rows], replace=replace, stream=stream)

    def stage_events(self, rows: DataFrame, batch: str, seq: int, hashes: bool = True) -> list[Folder]:
        """rows have the columns of documents; optionally deleted, and the attempt of the
        chunks that count, else seq.  hashes: their content comes or goes."""
        if "deleted" not in rows.columns:
            rows = rows.withColumn("deleted", F.lit(False))
        if "attempt" not in rows.columns:
            rows = rows.withColumn("attempt", F.lit(seq))
        out = rows.withColumns({"seq": F.lit(seq).cast("long"), "batch_id": F.lit(batch)})
        folders = [self.stage(out, "events", batch)]
        if hashes:
            folders.append(self.stage(out.filter(F.col("file_hash").isNotNull()), "hashes", batch))
        return folders

    def append_events(self, rows: DataFrame, batch: str, seq: int, hashes: bool = True) -> None:
        self.commit(self.stage_events(rows, batch, seq, hashes), replace=batch)

    def append_chunks(self, rows: DataFrame, batch: str) -> None:
        self.commit([self.stage(rows, "chunks", batch)], replace=batch)

    def change(self, where: Column, namespace: str | None = None, ids: list[str] | None = None, **values: Column) -> int:
        """Append a new state for the documents that match, of one namespace or some ids
        if they are given; how many there were.  No match is no error."""
        rows = live(self.events(namespace, ids=ids)).drop("seq").filter(where).withColumns({"updated_at": F.current_timestamp(), **values})
        seq = self.now()
        folders = self.stage_events(rows, f"c{seq}", seq, hashes="deleted" in values)
        self.commit(folders)
        return folders[0].rows

    # --- batches --------------------------------------------------------------------
    def settled(self, rows: DataFrame, name: str) -> DataFrame:
        """rows as they are now, written to the store's work folder: later changes of
        the tables they come from don't show in them."""
        path = f"{self.path}/work/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def seq_of(self, batch: str) -> int:
        """The place of a batch in the order of changes: now, and the same if the batch
        is written again."""
        name = f"work/{batch}-seq"
        self.log.files.write_new(name, str(self.now()))
        return int(self.log.files.read(name))

    def forget(self, name: str) -> None:
        """Remove a table of the work folder."""
        self.log.files.remove(f"work/{name}")

    @contextlib.contextmanager
    def lease(self, batch: str, seconds: float = LEASE_SECONDS) -> Iterator[None]:
        """While a batch is worked on, a file says so and is renewed; what recovers
        leaves the documents of such a batch alone.  It ends with the batch, and runs
        out if the driver dies."""
        over = threading.Event()

        def hold() -> None:
            self.log.files.write(f"leases/{batch}", json.dumps({"until": self.now() + int(seconds * 1e6)}))

        def renew() -> None:
            while not over.wait(seconds / 3):
                hold()

        hold()
        keeper = threading.Thread(target=renew, daemon=True)
        keeper.start()
        try:
            yield
        finally:
            over.set()
            keeper.join()
            self.log.files.remove(f"leases/{batch}")

    def running(self) -> list[str]:
        """Batches whose lease has not run out."""
        now = self.now()
        out = []
        for name, _ in self.log.files.names("leases"):
            with contextlib.suppress(Exception):  # it may end meanwhile, or be half written
                if json.loads(self.log.files.read(f"leases/{name}"))["until"] > now:
                    out.append(name)
                    continue
                self.log.files.remove(f"leases/{name}")
        return out

    # --- documents ------------------------------------------------------------------
    def create_document(self, id: str, namespace: str, filename: str, format: str, file_hash: str | None, file_path: str | None, instance_id: str | None) -> None:
        row = self.spark.createDataFrame([(id, namespace, filename, format, S.PENDING, None, 0, file_hash, file_path, instance_id)], "id string, namespace string, filename string, format string, status string, error string, chunk_count int, file_hash string, file_path string, instance_id string")
        seq = self.now()
        self.append_events(row.withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()}), f"c{seq}", seq)

    def set_status(self, id: str, status: str, error: str | None = None) -> int:
        if status not in S.STATUSES:
            raise ValueError(f"unknown status {status}")
        return self.change(F.col("id") == id, ids=[id], status=F.lit(status), error=F.lit(error).cast("string"))

    def clear_file_path(self, id: str) -> int:
        return self.change(F.col("id") == id, ids=[id], file_path=F.lit(None).cast("string"), updated_at=F.col("updated_at"))

    def delete_document(self, namespace: str, id: str) -> None:
        n = self.change((F.col("id") == id) & (F.col("namespace") == namespace), namespace, [id], deleted=F.lit(True))
        if not n:
            raise LookupError(f"document {id} not found")

    # --- upkeep ---------------------------------------------------------------------
    def _merged(self, table: str, folders: list[Folder], all_events: DataFrame | None, keep_deleted_since: int) -> DataFrame:
        """The rows of some folders that matter; of all folders (all_events given) what no
        longer counts goes, too."""
        rows = self._read(table, folders=folders).drop("batch")
        if table == "events":
            rows = latest(rows)
            return rows if all_events is None else rows.filter(~F.coalesce("deleted", F.lit(False)) | (F.col("seq") >= keep_deleted_since))
        if table == "hashes":
            now = rows.groupBy("namespace", "file_hash", "id").agg(F.max_by(F.struct("deleted", "seq"), "seq").alias("e"))
            rows = now.select("namespace", "file_hash", "id", "e.seq", "e.deleted")
            return rows if all_events is None else rows.filter(~F.coalesce("deleted", F.lit(False)) | (F.col("seq") >= keep_deleted_since))
        if all_events is None:
            return rows
        now = live(all_events).select(F.col("id").alias("document_id"), F.col("attempt").alias("_a"), F.col("windows_of").alias("_w"))
        counts = F.col("_a").isNull() | (F.col("attempt") == F.col("_a")) | (F.col("attempt") == F.col("_w"))
        return rows.join(now, "document_id").filter(counts).drop("_a", "_w")

    def compact(self, path: str | None = None, whole: bool = False, grace_seconds: float = 86_400.0) -> Store:
        """Merge folders in place, next to readers and writers: FAN or more of about the
        same number of rows, so each row is written again a logarithmic number of times.
        whole merges everything and drops what no longer counts but deletions of the
        grace time, which a batch that still runs may meet.  A path: the current state
        alone, written to a new store."""
        if path is not None:
            new, seq = Store(self.spark, path, self.dimensions), self.now()
            at = self.pinned()
            new.commit([new.stage(at._merged(t, at.snapshot().of(t), at.events(), seq), t, f"m{seq}", depth_for(sum(f.rows for f in at.snapshot().of(t)), BUCKET_ROWS[t])) for t in TABLES])
            return new
        at = self.pinned()
        since = self.now() - int(grace_seconds * 1e6)
        groups: list[tuple[str, list[Folder]]] = []
        for table in TABLES:
            tiers: dict[int, list[Folder]] = {}
            for f in at.snapshot().of(table):
                tiers.setdefault(0 if whole else int(math.log(f.rows + 1, FAN)), []).append(f)
            groups += [(table, fs) for fs in tiers.values() if len(fs) >= (2 if whole else FAN)]
        add, remove = [], []
        for table, folders in groups:
            depth = depth_for(sum(f.rows for f in folders), BUCKET_ROWS[table])
            rows = at._merged(table, folders, at.events() if whole else None, since)
            if not depth:  # few rows: one file a namespace
                rows = rows.repartition("namespace")
            add.append(self.stage(rows, table, f"m{self.now()}", depth))
            remove += [f.name for f in folders]
        if remove:
            self.log.commit([f for f in add if f.rows], remove)
        return self

    def upkeep(self) -> bool:
        """Compaction in tiers, left for the next time if another writer was at it."""
        try:
            self.compact()
            return True
        except Conflict:
            return False

    def vacuum(self, grace_seconds: float = 86_400.0) -> int:
        """Delete folders of data that no version of the grace time names, and versions
        beyond it; how many folders.  Fresh ones, which a writer may yet commit, stay."""
        since = self.now() - int(grace_seconds * 1e6)
        keep = set(self.snapshot().folders) | self.log.named_since(since)
        gone = 0
        for table in TABLES:
            for name, changed in self.log.files.names(table):
                if re.sub("^batch=", "", name) not in keep and changed < since:
                    self.log.files.remove(f"{table}/{name}")
                    gone += 1
        self.log.trim(since)
        return gone


def _part(namespace: str) -> str:
    """The folder of a namespace: never empty, as an empty name would be read as null."""
    return f"n{namespace}"
