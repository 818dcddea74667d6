"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that separate words in every contract of this package.
SPACES = "\\x20\\x09-\\x0D"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, as spark.checkpoint.dir names it.  Only a session
    on one machine (tests) may name none, and gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="siftline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as a Parquet table to the shared folder and read it back.

    That cuts the lineage: a lost executor costs only what was running, as the
    files are not on its own disk.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that cut has written, once nothing is left to be computed from them."""
    for df in tables:
        jvm = df.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(df.written_to)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


#: Below this many rows a table of statistics is broadcast; beyond it is shuffled.
BROADCAST_ROWS = 100_000


#: The same for a table of one number a row.
BROADCAST_NUMBERS = 1_000_000


def is_small(df: DataFrame) -> bool:
    """Whether a count shows that df has few enough rows to broadcast."""
    most = BROADCAST_NUMBERS if len(df.columns) == 1 and df.dtypes[0][1] == "bigint" else BROADCAST_ROWS
    return df.limit(most + 1).count() <= most


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is small."""
    return F.broadcast(df) if is_small(df) else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, name: str) -> str:
    """A name like this one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(column: str = "text") -> Column:
    """The text, null taken as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def strings(column: pa.Array, step: int = 512) -> Iterator[str | None]:
    """The texts of a column; only step of them are Python strings at a time."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def append_columns(df: DataFrame, text: str, make: Callable[[], Callable[[list[str | None]], list[pa.Array]]], fields: str) -> DataFrame:
    """df with columns that a function computes from the texts of a batch.

    make runs once in each task and gives the function; fields is the DDL of the new
    columns, whose names df must not have (see fresh).  No shuffle.
    """
    new = T.StructType.fromDDL(fields)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for whole in batches:
            for begin in range(0, len(whole), 512):
                batch = whole.slice(begin, 512)
                yield pa.RecordBatch.from_arrays([*batch.columns, *of(batch.column(at).to_pylist())], names=[*batch.schema.names, *new.names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *new.fields]))
