"""Policy expressions over payloads, deep pages, and files that nobody needs."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import access, catalog
from siftline.streaming import ingest

PAYLOADS = ['{"role": "admin", "level": 3, "groups": ["a", 2], "org": {"name": "en"}, "none": null, "ok": true}', '{"level": "high"}', '{"role": 7, "ok": false}', None, "no json", "[1]"]
#: expression: its value for each payload; None: can't be evaluated, so passed over
CASES = {
    'payload.role == "admin"': [True, None, False, None, None, None],
    'payload.role != "admin"': [False, None, True, None, None, None],
    "payload.level > 2": [True, None, None, None, None, None],
    "payload.level >= -1.5 && payload.level <= 3": [True, None, None, None, None, None],
    'payload.level == "high"': [False, True, None, None, None, None],
    '"a" in payload.groups': [True, None, None, None, None, None],
    "2 in payload.groups": [True, None, None, None, None, None],
    '"zz" in payload.groups': [False, None, None, None, None, None],
    'payload.role in ["admin", 7]': [True, None, True, None, None, None],
    '!(payload.role in ["admin"])': [False, None, True, None, None, None],
    "has(payload.role)": [True, False, True, None, None, False],
    "has(payload.org.name)": [True, None, None, None, None, None],
    'payload["org"]["name"].matches("^e")': [True, None, None, None, None, None],
    "payload.ok": [True, None, False, None, None, None],
    "!payload.ok || payload.level == 3": [True, None, True, None, None, None],
    "payload.none == null": [True, None, None, None, None, None],
    "payload.role != null": [True, None, True, None, None, None],
    "size(payload.groups) == 2": [True, None, None, None, None, None],
    "size(payload.role) != 2": [True, None, None, None, None, None],
    "payload.role.startsWith('ad') || payload.level == 'high'": [True, True, None, None, None, None],
    "payload.role.endsWith('n') && payload.role.contains('dmi')": [True, None, None, None, None, None],
    "payload.role == 'a && !b'": [False, None, False, None, None, None],
    '"name" in payload.org': [True, None, None, None, None, None],
    "true": [True] * 6,
    "false || payload.missing.field == 1": [None] * 6,
}


def test_expressions(spark):
    df = spark.createDataFrame(list(enumerate(PAYLOADS)), "i int, payload string").withColumn("v", F.try_parse_json("payload"))
    got = df.select("i", *[access.condition(e, F.col("v")).alias(str(k)) for k, e in enumerate(CASES)]).orderBy("i").collect()
    assert {e: [r[str(k)] for r in got] for k, e in enumerate(CASES)} == CASES


def test_what_is_no_policy_is_refused_when_the_plan_is_made(spark):
    for bad in ("payload.role ==", "role == 'x'", "payload.a == payload.b == 1", "len(payload.a)", "payload.a + 1", "__import__('os')", "payload['it\\'s'] == 1"):
        with pytest.raises(access.Refused):
            access.condition(bad, F.col("v"))


def test_rules_in_order(spark):
    requests = spark.createDataFrame([(i, p, t, n) for i, p in enumerate(PAYLOADS) for t, n in (("search_x", "a"), ("delete", ""), ("delete", "b"))], "i int, payload string, tool string, namespace string")
    rules = [("payload.absent == 1", ["*"], []), ("payload.level > 2", ["search_*"], ["a"]), ("payload.level == 'high'", [], ["b"])]
    before = spark.conf.get("spark.sql.ansi.enabled")
    got = {(r.i, r.tool, r.namespace): r.allowed for r in access.policy(requests, rules).collect()}
    assert {k for k, v in got.items() if v} == {(0, "search_x", "a"), (1, "delete", ""), (1, "delete", "b")}
    assert access.policy(requests, []).filter("allowed").count() == len(got)
    parsed = requests.withColumn("payload", F.try_parse_json("payload"))
    assert access.policy(parsed, rules).filter("allowed").count() == 3
    assert spark.conf.get("spark.sql.ansi.enabled") == before


@pytest.mark.parametrize("descending", [False, True])
def test_any_page_without_sorting_all(spark, descending):
    """A key that half of the rows share, and nulls, which are on no page."""
    rng = random.Random(2)
    rows = [(None if rng.random() < 0.02 else "hot" if rng.random() < 0.5 else f"k{rng.randrange(300)}", i) for i in range(5_000)]
    df = spark.createDataFrame(rows, "name string, id long").repartition(5)
    want = sorted((r for r in rows if r[0] is not None), key=lambda r: r[1])
    want = sorted(want, key=lambda r: r[0], reverse=descending)
    for offset, limit in ((0, 10), (999, 20), (2_345, 7), (len(want) - 3, 10), (len(want) + 5, 10)):
        got = [tuple(r) for r in catalog.page_at(df, "name", "id", offset, limit, descending, sorted_rows=200).collect()]
        assert got == want[offset : offset + limit]
    assert catalog.page_at(df.limit(0), "name", "id", 3, 2).count() == 0
    with pytest.raises(ValueError):
        catalog.page_at(df, "name", "id", -1, 2)


def test_a_deep_page_sorts_one_range(spark, tmp_path):
    spark.range(40_000).select(F.col("id"), (F.col("id") % 9_000).alias("key")).sort("key").repartitionByRange(8, "key").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    page = catalog.page_at(df, "key", "id", 30_000, 10, sorted_rows=2_000)
    assert [r.key for r in page.collect()] == sorted(i % 9_000 for i in range(40_000))[30_000:30_010]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and page.select(F.input_file_name()).distinct().count() <= 2


def test_pages_by_seeking(spark):
    docs = spark.createDataFrame([(str(i), "n", f"f{i % 7}", "failed" if i % 3 else "pending", i // 4) for i in range(60)], "id string, namespace string, filename string, status string, created_at int")
    for order, by in (("asc", "filename"), ("desc", "created_at")):
        want = [r.id for r in catalog.list_documents(docs, "n", sort_by=by, sort_order=order, limit=60).collect()]
        got, after = [], None
        while page := catalog.seek_documents(docs, "n", after, sort_by=by, sort_order=order, limit=7).collect():
            got += [r.id for r in page]
            after = (page[-1][by], page[-1].id)
        assert got == want


def test_orphans(spark, tmp_path):
    rows = [("file:/d/a.txt", 100), ("/d/b.txt", 100), ("file:///d/c.txt", 100), ("/d/new.txt", 0)]
    listing = spark.createDataFrame(rows, "path string, ago int").select("path", (F.current_timestamp() - F.make_dt_interval(secs=F.col("ago").cast("decimal(18,6)"))).alias("modificationTime"))
    docs = spark.createDataFrame([("/d/c.txt",), (None,), ("/d/a.txt",)], "file_path string")
    assert [r.path for r in ingest.orphans(listing, docs, 50.0).collect()] == ["/d/b.txt"]
    assert ingest.orphans(listing.limit(0), docs).count() == 0 and ingest.orphans(listing, docs.limit(0), 50.0).count() == 3
