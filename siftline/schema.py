"""Tables of the document store, and the states of a document."""

from __future__ import annotations

from pyspark.sql import types as T

PENDING, PROCESSING, COMPLETED, FAILED = "pending", "processing", "completed", "failed"
STATUSES = (PENDING, PROCESSING, COMPLETED, FAILED)
UNFINISHED = (PENDING, PROCESSING)


def _struct(text: str) -> T.StructType:
    """name:type, with ! for columns that are never null."""
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(), "vector": T.ArrayType(T.FloatType()), "map": T.MapType(T.StringType(), T.StringType())}
    pairs = [p.split(":") for p in text.split()]
    return T.StructType([T.StructField(n, kinds[k.rstrip("!")], not k.endswith("!")) for n, k in pairs])


DOCUMENTS = _struct("id:string! namespace:string! filename:string! format:string! status:string! error:string chunk_count:int! file_hash:string file_path:string instance_id:string created_at:timestamp! updated_at:timestamp!")
#: One row for each change of a document; the latest of an id is its state.  attempt is that
#: of the chunks that count, batch_id the batch that works on it.  Where a vector could not be
#: had, tries counts, next_try says when to go on, and windows_of is the attempt of the texts.
EVENTS = T.StructType([*DOCUMENTS.fields, *_struct("seq:long deleted:boolean attempt:long batch_id:string tries:int next_try:timestamp windows_of:long").fields])
#: error: why a chunk has no vector.
CHUNKS = _struct("id:string! document_id:string! namespace:string! chunk_index:int! content:string! embedding:vector metadata:map created_at:timestamp attempt:long error:string")
#: Which hashes came to a namespace, and went.
HASHES = _struct("namespace:string! file_hash:string! id:string! seq:long deleted:boolean")
SEARCH_COLUMNS = ("chunk_id", "document_id", "namespace", "filename", "chunk_index", "content", "score", "metadata")
