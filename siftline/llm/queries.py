"""The queries of this package, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import read_table


def op1_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.decontamination import find_contamination

    return find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.passages import find_repeats

    return find_repeats(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.toxicity import score_documents

    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.quality import reject_outliers

    return reject_outliers(read_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.urls import filter_urls

    return filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"))


def op7_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.minhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=80)


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.sharding import shard_documents

    out = shard_documents(read_table(spark, sf_dir, "documents"), n_shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def piece_model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.piece_bpe import encode_decode

    out = encode_decode(read_table(spark, sf_dir, "documents"), piece_model_file())
    return out.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _digests(df: DataFrame, kinds: tuple[str, ...], spans: str, *more) -> DataFrame:
    """Counts of the base kinds and digests of sorted spans."""
    from siftline.llm.spans import listing

    def of(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    base = F.filter(spans, lambda s: s["rank"] < len(kinds))
    return df.select("doc_id", *[of(k).alias(f"n_{k}") for k in kinds], F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col(spans)).alias("spans"), *more)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.pii import BASE, find_pii

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = F.array_join(F.transform("pii", lambda s: F.format_string("%.1f", s["score"])), ",").alias("scores")
    return _digests(find_pii(docs), BASE, "pii", scores)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.secrets import BASE, find_secrets

    found = find_secrets(read_table(spark, sf_dir, "documents"))
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live")
    return _digests(found, BASE, "spans", live)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.fill_middle import fill_middle, restore

    out = fill_middle(read_table(spark, sf_dir, "documents"))
    restored = F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), restored)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from siftline.llm.token_counts import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_partial_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftline.llm.centroids import cluster_vectors

    return cluster_vectors(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: All pairs of documents with a shingle in common, and all that can be reached by links.
_NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
 ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' '))) END AS s FROM w),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
one_way AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
links AS (SELECT a, b FROM one_way UNION SELECT b, a FROM one_way),
reach AS (SELECT doc_id, doc_id AS low FROM sets UNION SELECT links.b, reach.low FROM reach JOIN links ON links.a = reach.doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT doc_id, min(low) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""


def _shards_sql(n_shards: int = 16, seed: int = 20_240_501, rounds: int = 6) -> str:
    """The Feistel network as a recursive query, a round for each step; what ends beyond the
    number of rows goes round again."""
    wrap = 2**64

    def mix(x: int) -> int:
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % wrap
        x = (x ^ x >> 27) * 0x94D049BB133111EB % wrap
        return x ^ x >> 31

    keys = ", ".join(f"{mix((k + seed * 0x9E3779B97F4A7C15) % wrap)}::UBIGINT" for k in range(1, rounds + 1))
    times = "(({})::UHUGEINT * {}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"
    return f"""WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
bytes AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
sizes AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(range(size - 1), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)), lambda c, b: xor(t[xor(c % 256, b) + 1], c >> 8)), 4294967295) AS text_crc32 FROM bytes, crc_table),
numbered AS (SELECT *, (row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::UBIGINT AS row, count(*) OVER () AS n FROM sizes),
shape AS (SELECT *, greatest(1, (length(bin(greatest(n - 1, 1))) + 1) // 2)::INT AS half FROM numbered),
walk AS (SELECT row, n, half, row >> half AS l, row % (1::UBIGINT << half) AS r, 0 AS k FROM shape
 UNION ALL SELECT row, n, half, CASE WHEN k = {rounds} THEN l ELSE r END, CASE WHEN k = {rounds} THEN r ELSE xor(l, xor(v, v >> 31) % (1::UBIGINT << half)) END, CASE WHEN k = {rounds} THEN 0 ELSE k + 1 END
 FROM (SELECT *, {times.format("xor(u, u >> 27)", 0x94D049BB133111EB)} AS v FROM (SELECT *, {times.format("xor(z, z >> 30)", 0xBF58476D1CE4E5B9)} AS u
 FROM (SELECT *, xor(r, [{keys}, 0::UBIGINT][k + 1]) AS z FROM walk WHERE k < {rounds} OR ((l << half) + r) >= n)))),
placed AS (SELECT row, (l << half) + r AS p FROM walk WHERE k = {rounds} AND ((l << half) + r) < n)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (p % {n_shards})::INT AS shard, (p // {n_shards})::BIGINT AS slot, NULL::INT AS grown_shard FROM numbered JOIN placed USING (row)"""


#: Units as a list of matches, so that cuts are lengths of lists.
_FILL_MIDDLE = r"""WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, sha256('42:' || doc_id) AS sha FROM documents),
h AS (SELECT *, len(units) AS n, ('0x' || sha[1:8])::BIGINT AS h1, ('0x' || sha[9:16])::BIGINT AS h2, ('0x' || sha[17:24])::BIGINT AS h3, ('0x' || sha[25:32])::BIGINT AS h4 FROM u),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, array_to_string(units[1:p], '') AS pre, array_to_string(units[p + 1:q], '') AS mid, array_to_string(units[q + 1:], '') AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
 sha256(t) AS restored_sha256 FROM c"""


def _clusters_sql(k: int = 8, rounds: int = 10, dimensions: int = 64) -> str:
    """Each round as a table of its own, its centroids after it."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1)::INT AS c, v FROM v ORDER BY c LIMIT {k})",
    ]
    distance = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := {distance}, c := c.c)) AS m FROM v, c{i} AS c GROUP BY r)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT c, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT m.c AS c, unnest(v) AS x, unnest(range({dimensions})) AS j FROM a{i} JOIN v USING (r)) GROUP BY c, j)")
            mean = "((s - ((s % n) + n) % n) // n)::BIGINT"
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT old.c, coalesce(n.v, old.v) AS v FROM c{i} AS old LEFT JOIN (SELECT c, list({mean} ORDER BY j) AS v FROM s{i} GROUP BY c) AS n USING (c))")
    last = f"""SELECT vec_id, m.c AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
 sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} AS c ON c.c = m.c"""
    return "WITH " + ",\n".join(parts) + "\n" + last


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others have brute-force tests."""
    return {"op7_minhash_bayes": _NEAR_DUPLICATES, "op8_feistel_shards": _shards_sql(), "op11_fill_middle": _FILL_MIDDLE, "op13_partial_distance": _clusters_sql()}
