"""Files as rows, and their text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.sources import parsers

#: Read as they are, by Column expressions.
NATIVE = (".txt", ".md", ".markdown")
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def read_files(spark: SparkSession, path: str | list[str], streaming: bool = False, files_per_trigger: int = 30, done: str = "off", archive: str = "", bytes_per_trigger: int = 0) -> DataFrame:
    """path, modificationTime, length, content of the files below a path.  A micro-batch of
    a stream has so many files, or so many bytes where these are given.  A stream leaves files that a later micro-batch has gone beyond where they are (done = off), deletes
    them (delete) or moves them to the folder archive (archive)."""
    if streaming:
        rows = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("cleanSource", done)
        rows = rows.option("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else rows.option("maxFilesPerTrigger", files_per_trigger)
        return (rows.option("sourceArchiveDir", archive) if archive else rows).load(path)
    return spark.read.format("binaryFile").load(path)


def same_path(path: Column) -> Column:
    """A path as plain ones are written: the reader spells local ones with their scheme."""
    return F.regexp_replace(path, "^file:/+", "/")


def identify(files: DataFrame, namespace: str) -> DataFrame:
    """files with namespace, filename, format and file_hash; the id is the same
    whenever the same bytes come to the same namespace."""
    name = X.base_name(F.col("path"))
    return (
        files.withColumn("namespace", F.lit(namespace))
        .withColumn("filename", name)
        .withColumn("format", X.format_of(F.col("filename")))
        .withColumn("file_hash", X.file_hash(F.col("content")))
        .withColumn("id", stable_id(F.col("namespace"), F.col("file_hash")))
    )


def stable_id(*parts: Column) -> Column:
    """A UUID-shaped id from columns."""
    return F.regexp_replace(F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def problem_of(files: DataFrame, max_size_mb: int) -> Column:
    """Why a file is not taken in, or null."""
    ext = X.extension(F.col("filename"))
    return F.when(F.col("length") > max_size_mb * 1024 * 1024, F.concat(F.lit("file exceeds "), F.lit(str(max_size_mb)), F.lit(" MB"))).when(
        ~ext.isin(parsers.supported_extensions()), F.concat(F.lit('unsupported file format: "'), ext, F.lit('"'))
    )


def extract(files: DataFrame) -> DataFrame:
    """files with ``raw`` (text) and ``error`` in place of ``content``.

    Plain formats are decoded by a Column expression; the rest goes through Python in
    Arrow batches, so a batch of plain files never leaves the JVM."""
    ext = X.extension(F.col("filename"))
    plain = files.filter(ext.isin(*NATIVE)).withColumns({"raw": F.make_valid_utf8(F.col("content").cast("string")), "error": F.lit(None).cast("string")}).drop("content")
    rest = files.filter(~ext.isin(*NATIVE)).withColumn("_ext", ext)
    schema = rest.drop("content", "_ext").schema.add("raw", "string").add("error", "string")
    columns = [c for c in rest.columns if c not in ("content", "_ext")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str | None] = []
            errors: list[str | None] = []
            for content, e in zip(batch.column("content"), batch.column("_ext").to_pylist(), strict=True):
                try:
                    text = parsers.parse(e, content.as_py() or b"")
                    texts.append(text.encode("utf-8", "replace").decode())  # lone surrogates are no text
                    errors.append(None)
                except Exception as x:  # noqa: BLE001  a broken file is a row with an error, not a broken job
                    texts.append(None)
                    errors.append(f"{type(x).__name__}: {x}" if not isinstance(x, ValueError) else str(x))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=schema.names)

    return plain.unionByName(rest.mapInArrow(run, schema))


def html_text(html: Column) -> Column:
    """Text of simple pages by expressions alone: without scripts, styles and comments,
    one line for each stretch between tags; only the commonest entities are decoded."""
    bare = html
    for pattern in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->"):
        bare = F.regexp_replace(bare, pattern, "<x>")
    for entity, plain in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "‹LT›"), ("&gt;", "›GT‹")):
        bare = F.replace(bare, F.lit(entity), F.lit(plain))

    def line(piece: Column) -> Column:
        decoded = F.regexp_replace(piece, "&amp;?", "&")
        return X.trim(F.replace(F.replace(decoded, F.lit("‹LT›"), F.lit("<")), F.lit("›GT‹"), F.lit(">")))

    return F.array_join(F.array_remove(F.transform(F.split(bare, "<[^>]*>", -1), line), ""), "\n")
