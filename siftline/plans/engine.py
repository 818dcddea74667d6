"""One object with what callers do: take in, list, get, delete, search, health, info."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from siftline.config import Config
from siftline.functions import text as X
from siftline.operators import access, catalog
from siftline.operators.embed import Embedder, HashEmbedder, HttpEmbedder
from siftline.operators.search import search_store
from siftline.operators.store import Store
from siftline.sources.files import read_files
from siftline.streaming import ingest


#: The names of the tools.
TOOLS = ("list_documents", "get_document", "upload_document", "delete_document", "search", "health")


class Engine:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, embedder: Embedder | None = None) -> None:
        self.config = (config or Config()).check()
        e = self.config.embedder
        remote = HttpEmbedder(e.base_url, e.model, e.api_key, e.dimensions, e.timeout_seconds, self.config.worker.max_retries)
        self.embedder = embedder or (remote if e.base_url else HashEmbedder(e.dimensions))
        self.spark, self.store = spark, Store(spark, path, self.embedder.dimensions)
        self.streams: list = []

    def ingest(self, paths: str | list[str], namespace: str = "", wait: bool = True) -> DataFrame:
        """Take in files; returns what was set aside and why.  Documents that could not be
        embedded are tried again until they are or the tries are used up (wait), or
        with a later call of retry."""
        attempt = self.store.now()
        aside = ingest.ingest_files(read_files(self.spark, paths), self.store, self.config, self.embedder, namespace, f"b{attempt}", attempt)
        if wait:
            ingest.retry_all(self.store, self.config, self.embedder, namespace)
        return aside

    def retry(self, namespace: str | None = None) -> int:
        """Try again what is due; how many documents."""
        return ingest.retry(self.store, self.config, self.embedder, namespace)

    def upload_document(self, path: str, namespace: str = "") -> DataFrame:
        return self.ingest(path, namespace)

    def watch(self, path: str, namespace: str, checkpoint: str, available_now: bool = False, done: str = "off", archive: str = ""):
        """A stream of new files; done says what becomes of files taken in (see read_files)."""
        query = ingest.start_stream(self.store, self.config, self.embedder, path, namespace, checkpoint, available_now, done, archive)
        self.streams.append(query)
        return query

    def close(self, timeout_seconds: float = 30.0) -> None:
        """Stop all streams, each after the micro-batch it is at, or when time is up."""
        ingest.drain(self.streams, timeout_seconds)
        self.streams.clear()

    def recover(self) -> DataFrame:
        return ingest.recover(self.store, self.config, self.embedder)

    def list_documents(self, namespace: str = "", **how) -> tuple[DataFrame, int]:
        """A page and the number of all that match; an offset past the end gives the last page."""
        docs = self.store.pinned().documents(namespace)
        total = catalog.count_documents(docs, namespace, how.get("status", "")).first()["total"]
        size = how["limit"] if how.get("limit", 0) > 0 else catalog.PAGE_SIZE
        if total and how.get("offset", 0) >= total:
            how["offset"] = (page_count(total, size) - 1) * size
        return catalog.list_documents(docs, namespace, **how).drop("file_path", "instance_id"), total

    def get_document(self, id: str, namespace: str = "") -> DataFrame:
        found = catalog.get_document(self.store.documents(namespace, [self._checked(id)]), namespace, id)
        if found.isEmpty():
            raise LookupError(f"document {id} not found")
        return found.drop("file_path", "instance_id")

    def delete_document(self, id: str, namespace: str = "") -> None:
        self.store.delete_document(namespace, self._checked(id))

    @staticmethod
    def _checked(id: str) -> str:
        if not re.fullmatch(X.UUID, id or ""):
            raise ValueError(f"not a document id: {id!r}")
        return id

    def search(self, query: str, namespace: str = "", limit: int = 0) -> DataFrame:
        if not query.strip():
            raise ValueError("query must not be empty")
        k = limit if limit > 0 else self.config.search.default_limit
        return search_store(self.store, self.embedder.one(query), namespace, k)

    def info(self, key: str | None = None) -> list[str]:
        acl = [(k.key, k.namespaces) for k in self.config.auth.api_keys]
        return access.visible_namespaces(key, acl, [n.name for n in self.config.namespaces])

    def call(self, tool: str, arguments: dict, rules: list[tuple[str, list[str], list[str]]] = (), payload: str | None = None, prefix: str = "") -> object:
        """What an agent's tool call does: one of TOOLS by its name, after a prefix, if the
        policies allow it for the payload of the caller's token."""
        name = tool.removeprefix(prefix)
        if name not in TOOLS:
            raise LookupError(f"no such tool: {tool}")
        space = arguments.get("namespace")
        asked = self.spark.createDataFrame([(name, space if isinstance(space, str) else "", payload)], "tool string, namespace string, payload string")
        if not access.policy(asked, list(rules)).first()["allowed"]:
            raise PermissionError(f"access denied: no permission to use {name!r}")
        return getattr(self, name)(**arguments)

    def health(self, seconds: float = 5.0) -> dict:
        """ok if within some seconds the tables can be read and the embedder answers, else
        degraded.  Jobs of a probe that is late are cancelled."""
        probes = {"database": lambda: catalog.list_documents(self.store.documents(), "", limit=1).collect(), "embedder": lambda: self.embedder.one("ping")}
        services = within(self.spark, probes, seconds)
        ok = all(v == "ok" for v in services.values())
        return {"status": "ok" if ok else "degraded", "code": 200 if ok else 503, "services": services}

    def sweep(self, path: str, grace_seconds: float = 86_400.0) -> int:
        """Delete files below a folder of uploads that no document needs any more: those of
        completed and deleted documents, and of inserts that failed; how many."""
        return ingest.sweep(self.store, path, grace_seconds)


def within(spark: SparkSession, probes: dict[str, Callable[[], object]], seconds: float) -> dict[str, str]:
    """What becomes of some probes that run side by side, until time is up."""
    out = {name: f"error: no answer within {seconds:g} s" for name in probes}
    tags = {name: f"probe-{uuid.uuid4().hex}" for name in probes}
    context = spark.sparkContext

    def run(name: str) -> None:
        context.addJobTag(tags[name])
        try:
            probes[name]()
            answer = "ok"
        except Exception as e:  # noqa: BLE001  whatever it is, it is not healthy
            answer = f"error: {e}"
        if not over:
            out[name] = answer

    over = False
    threads = {name: InheritableThread(target=run, args=(name,), daemon=True) for name in probes}
    for t in threads.values():
        t.start()
    end = time.monotonic() + seconds
    for name, t in threads.items():
        t.join(max(0.0, end - time.monotonic()))
        if t.is_alive():
            context.cancelJobsWithTag(tags[name])
    over = True
    return out


def page_count(total: int, size: int) -> int:
    return max(1, -(-total // size))


backoff_seconds = X.backoff_seconds
