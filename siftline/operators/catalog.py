"""Queries over the documents table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.schema import UNFINISHED

SORTABLE = ("created_at", "filename")
PAGE_SIZE = 10
#: Pages of up to this many rows are chosen by their keys first.
KEYS_FIRST = 1_000


def _filtered(documents: DataFrame, namespace: str, status: str = "") -> DataFrame:
    rows = documents.filter(F.col("namespace") == namespace)
    return rows.filter(F.col("status") == status) if status else rows


def list_documents(documents: DataFrame, namespace: str, status: str = "", sort_by: str = "created_at", sort_order: str = "DESC", limit: int = 0, offset: int = 0) -> DataFrame:
    """A page.  An unknown sort key means created_at, an unknown order DESC, a limit of
    0 or less ten rows; a negative offset is an error.  Equal keys go by id."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    key = F.col(sort_by if sort_by in SORTABLE else "created_at")
    order = key.asc() if sort_order.upper() == "ASC" else key.desc()
    rows, n = _filtered(documents, namespace, status), limit if limit > 0 else PAGE_SIZE
    if n > KEYS_FIRST:
        return rows.orderBy(order, "id").offset(offset).limit(n)
    # the page is chosen by keys alone, so that other columns are computed for its rows only
    ids = [r["id"] for r in rows.select("id", key).orderBy(order, "id").offset(offset).limit(n).collect()]
    return rows.filter(F.col("id").isin(ids)).orderBy(order, "id")


def seek_documents(documents: DataFrame, namespace: str, after: tuple[object, str] | None = None, status: str = "", sort_by: str = "created_at", sort_order: str = "DESC", limit: int = 0) -> DataFrame:
    """The page after a row, named by its key and id: no rows before it are sorted or
    counted, as a filter on the key leaves them out where they are read."""
    key, n = sort_by if sort_by in SORTABLE else "created_at", limit if limit > 0 else PAGE_SIZE
    up = sort_order.upper() == "ASC"
    rows = _filtered(documents, namespace, status)
    if after is not None:
        value, id = F.lit(after[0]), F.lit(after[1])
        beyond = F.col(key) > value if up else F.col(key) < value
        # the first condition alone is one that a scan can use
        rows = rows.filter(F.col(key) >= value if up else F.col(key) <= value).filter(beyond | ((F.col(key) == value) & (F.col("id") > id)))
    return rows.orderBy(F.col(key).asc() if up else F.col(key).desc(), "id").limit(n)


#: Ranges that are counted at a time, the rows that bounds are taken from, and how many rows
#: of one range are sorted.
RANGES, SAMPLE, SORTED = 32, 4_096, 100_000


def page_at(rows: DataFrame, key: str, id: str, offset: int, limit: int, descending: bool = False, sorted_rows: int = SORTED) -> DataFrame:
    """Rows offset to offset + limit of rows in the order of (key, id), however deep.

    Nothing is sorted whole: bounds are taken from a few rows, rows between bounds are
    counted in one pass without a shuffle of rows, and the range that holds the page is
    divided again until few rows are left.  Bounds are pairs of key and id, so a key that
    many rows share is divided, too.  Any bounds give right pages.  Filters on the key reach
    the scan.  Rows without key or id are on no page."""
    if offset < 0 or limit < 1:
        raise ValueError("offset must not be negative, limit must be positive")
    order = [F.col(key).desc() if descending else F.col(key).asc(), F.col(id).asc()]
    kept, skip = rows.filter(F.col(key).isNotNull() & F.col(id).isNotNull()), offset
    left = kept.count()
    while left > max(sorted_rows, 2 * limit):
        some = kept.select(key, id).orderBy(F.xxhash64(id), *order).limit(SAMPLE).collect()
        some = sorted(sorted(some, key=lambda r: r[id]), key=lambda r: r[key], reverse=descending)
        bounds = sorted({len(some) * k // RANGES for k in range(1, RANGES)})
        bounds = [(some[k][key], some[k][id]) for k in bounds]
        found = kept.groupBy(sum((_from(key, id, b, descending).cast("int") for b in bounds), F.lit(0)).alias("range")).agg(F.count(F.lit(1)).alias("n"))
        counts = {r["range"]: r["n"] for r in found.collect()}
        first = last = None
        before = 0
        for k in range(len(bounds) + 1):
            end = before + counts.get(k, 0)
            if first is None and end > skip:
                first, start = k, before
            before = end
            if end >= skip + limit:
                last = k
                break
        if first is None:
            return rows.limit(0)
        last = len(bounds) if last is None else last
        if first > 0:
            kept = kept.filter(_from(key, id, bounds[first - 1], descending))
        if last < len(bounds):
            kept = kept.filter(~_from(key, id, bounds[last], descending))
        now = sum(counts.get(k, 0) for k in range(first, last + 1))
        skip -= start
        if now == left:
            break  # the page needs them all
        left = now
    return kept.orderBy(*order).offset(skip).limit(limit)


def _from(key: str, id: str, bound: tuple, descending: bool) -> Column:
    """Whether a row is at a bound or behind it."""
    value, least = F.lit(bound[0]), F.lit(bound[1])
    reaches = F.col(key) <= value if descending else F.col(key) >= value
    return reaches & ((F.col(key) != value) | (F.col(id) >= least))


def count_documents(documents: DataFrame, namespace: str, status: str = "") -> DataFrame:
    return _filtered(documents, namespace, status).agg(F.count(F.lit(1)).alias("total"))


def get_document(documents: DataFrame, namespace: str, id: str) -> DataFrame:
    return documents.filter((F.col("id") == id) & (F.col("namespace") == namespace)).limit(1)


def find_by_hash(documents: DataFrame, namespace: str, file_hash: str) -> DataFrame:
    """At most one row, of any status."""
    return documents.filter((F.col("namespace") == namespace) & (F.col("file_hash") == file_hash)).orderBy("created_at", "id").limit(1)


def unfinished(documents: DataFrame, instance_id: str) -> DataFrame:
    """Documents that this instance took in and has not ended, oldest first."""
    mine = F.col("status").isin(*UNFINISHED) & F.col("file_path").isNotNull() & (F.col("instance_id") == instance_id)
    return documents.filter(mine).orderBy("created_at", "id")


def first_of_hash(arrivals: DataFrame, order: list[str]) -> DataFrame:
    """arrivals with ``arrival``, 1 for the first of each (namespace, file_hash)."""
    return arrivals.withColumn("arrival", F.row_number().over(Window.partitionBy("namespace", "file_hash").orderBy(*order)))


def new_documents(arrivals: DataFrame, documents: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new, conflicts): new are those whose hash no document of the namespace has and
    that come first among themselves."""
    known = documents.select("namespace", "file_hash").filter(F.col("file_hash").isNotNull()).distinct().withColumn("_known", F.lit(True))
    ranked = first_of_hash(arrivals, order).join(known, ["namespace", "file_hash"], "left")
    new = F.col("_known").isNull() & (F.col("arrival") == 1)
    return ranked.filter(new).drop("_known", "arrival"), ranked.filter(~new).drop("_known", "arrival")
