"""From raw documents to token ids: five stages, each a table for the next.

toxicity drops documents that score as toxic; near_duplicates keeps the row of the
smallest doc_id of each group; decontamination drops documents that hold a benchmark item; pii
replaces personal data by its kind; tokens encodes what is left.

All stages but the last return the columns of documents, whatever they are besides doc_id
and text.  Null and empty texts are clean and stay; so do rows without an id.  Very long
texts are worked on whole; an empty table gives an empty one.  Of rows that repeat an id
and its text one stays; names of columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import cut, fresh, read_table
from siftline.llm.decontamination import decontaminate
from siftline.llm.minhash import near_duplicates
from siftline.llm.pii import find_pii, redact
from siftline.llm.piece_bpe import encode_decode
from siftline.llm.queries import piece_model_file
from siftline.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles here; one document of each group stays: of its rows that with the
    smallest id, of these that with the least hash of the text, of rows alike any one.  Each
    row is judged by its own text, whatever other rows bear its id.  Rows without words are
    in no group, but of those with the same id and text one stays.  Rows without an id
    stay, and leave no other row out."""
    row = fresh(docs, "row")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), width=5, percent=80)
    rows = numbered.select(F.col(row).alias("_row"), F.col("doc_id").alias("_id"), F.md5(F.coalesce("text", F.lit(""))).alias("_hash")).filter(F.col("_id").isNotNull())
    joined = rows.join(groups.select(F.col("doc_id").alias("_row"), "n_shingles", "component_id"), "_row")
    group = F.when(F.col("n_shingles") > 0, F.col("component_id").cast("string")).otherwise(F.concat_ws(":", F.lit("e"), F.col("_id").cast("string"), F.col("_hash")))
    judged = cut(joined.select("_row", "_id", "_hash", group.alias("_group")), "judged")
    stays = judged.groupBy("_group").agg(F.min(F.struct("_id", "_hash", "_row")).alias("_first")).select(F.col("_first._row").alias("_row"))
    gone = cut(judged.join(stays, "_row", "left_anti").select(F.col("_row").alias(row)), "gone")
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans replaced by their kind; n_chars, where there is one, is that of the new text."""
    name = fresh(docs, "pii")
    found = find_pii(docs, out=name).withColumn("text", redact(F.col("text"), F.col(name)))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast("long"))
    return found.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids; decoding gives the text back, as decoded_ok says."""
    keyed = docs.select(F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).alias("_key"), "text")
    out = encode_decode(keyed, piece_model_file(), key="_key")
    return out.select("_key.doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", (F.sha2("decoded", 256) == F.col("_key.sha")).alias("decoded_ok"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate_groups),
    ("decontamination", decontamination),
    ("pii", pii),
    ("tokens", tokens),
]

#: SQL has no expression for these stages; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of a folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
