"""The driver's tables in the shape of the document store."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.operators.embed import HashEmbedder, add_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as the catalog: the language is the namespace, the rest follows from
    the id."""
    n = F.col("doc_id")
    status = F.when(n % 10 == 0, "failed").when(n % 10 == 1, "pending").when(n % 10 == 2, "processing").otherwise("completed")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + n * 60)
    name = F.concat(F.lit("doc_"), F.lpad(n.cast("string"), 6, "0"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(
        n.cast("string").alias("id"),
        F.col("lang").alias("namespace"),
        name.alias("filename"),
        F.lit("txt").alias("format"),
        status.alias("status"),
        F.when(status == "failed", "parsing failed").alias("error"),
        F.when(status == "completed", X.chunk_count(F.col("text"))).otherwise(0).alias("chunk_count"),
        X.file_hash(F.col("text").cast("binary")).alias("file_hash"),
        F.when(status != "completed", F.concat(F.lit("/data/"), name)).alias("file_path"),
        F.concat(F.lit("node-"), (n % 3).cast("string")).alias("instance_id"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as chunks of the first 200 documents."""
    n = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        n.cast("string").alias("id"),
        (n % 200).cast("string").alias("document_id"),
        F.col("label").cast("string").alias("namespace"),
        F.floor(n / 200).cast("int").alias("chunk_index"),
        F.concat(F.lit("vector "), n.cast("string")).alias("content"),
        "embedding",
        F.create_map(F.lit("filename"), F.concat(F.lit("doc_"), F.lpad((n % 200).cast("string"), 6, "0"), F.lit(".txt"))).alias("metadata"),
    )


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()["embedding"])


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as changes of documents: the user is the document."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("status"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"), (F.col("event_type") == "refund").alias("deleted"))


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see, below spark.checkpoint.dir.  A session that
    names none is refused unless it runs on one machine, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="siftline-")
    return f"{shared.rstrip('/')}/siftline-{uuid.uuid4().hex}"


def document_files(rows: DataFrame) -> DataFrame:
    """documents as text files; the later the id, the later the file."""
    content = F.coalesce("text", F.lit("")).cast("binary")
    name = F.concat(F.lit("/docs/doc_"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt"))
    return rows.select(name.alias("path"), F.timestamp_seconds("doc_id").alias("modificationTime"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))


class RefusingEmbedder(HashEmbedder):
    """Refuses texts whose MD5 begins with a digit, as a service refuses what it can't take;
    those of a second digit are refused the first time only."""

    def __init__(self, dimensions: int, always: str, once: str) -> None:
        super().__init__(dimensions)
        self.always, self.once = always, once

    def add(self, df: DataFrame, text: str = "content", out: str = "embedding") -> DataFrame:
        digits, self.once = self.always + self.once, ""

        def vectors(texts: list[str | None]) -> tuple[list, list[str | None]]:
            bad = [hashlib.md5((t or "").encode()).hexdigest()[0] in digits for t in texts]
            found = self._vectors(texts).tolist()
            return [None if b else v for b, v in zip(bad, found, strict=True)], ["refused" if b else None for b in bad]

        return add_vectors(df, text, out, vectors)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as requests with the payload of a token: who asks has a role or none, a
    level that is a number or not, groups, and claims nested in claims, or no payload."""
    n = F.col("doc_id")
    fields = [
        F.when(n % 5 < 4, F.concat(F.lit('"role": "'), F.element_at(F.array(*map(F.lit, ["admin", "reader", "guest", "reader"])), (n % 5 + 1).cast("int")), F.lit('"'))),
        F.when(n % 3 == 0, F.concat(F.lit('"level": '), (n % 10).cast("string"))).when(n % 3 == 1, F.lit('"level": "high"')),
        F.when(n % 4 < 2, F.concat(F.lit('"groups": ["g'), (n % 4).cast("string"), F.lit('", "all"]'))),
        F.when(n % 2 == 0, F.concat(F.lit('"org": {"name": "'), F.col("lang"), F.lit('"}'))),
    ]
    payload = F.when(n % 11 != 0, F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")))
    tool = F.element_at(F.array(*map(F.lit, ["search", "search_all", "delete_document"])), (n % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(n.alias("request_id"), F.when(n % 7 == 0, "").otherwise(F.col("lang")).alias("namespace"), tool.alias("tool"), payload.alias("payload"))
