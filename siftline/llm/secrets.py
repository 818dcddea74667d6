"""Secrets, told from copied examples by how many owners a value has.

Patterns find candidates in each text.  The hashes of all candidate values are counted
over the whole corpus: in how many repositories (documents) and by how many owners
(sources) a value occurs.  A value of at least ``EXAMPLE_OWNERS`` owners is a copied
example; the rest look live.  Base spans always stay; spans of the added kinds stay
where their value looks live.

Only hashes of candidates are shuffled, never texts.  The counts take two steps,
(hash, owner, repository) and then hash with partial sums, and the counts of values that
make up more than one in ``HOT`` of all spans, of which there are less than ``HOT``, are broadcast,
so neither a value in a third of all documents nor very many frequent ones make a hot task.

Null or empty texts have no spans; a null owner or repository counts as one of its own.
Very long texts are worked on whole.  A row that repeats a repository adds nothing to the
counts and has its own spans.  An empty table gives an empty one.  The result has three
columns whatever names docs has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import cut, let, text_of
from siftline.llm.spans import located, matches

KINDS = ("assign", "access", "hex", "jwt", "token", "pem")
BASE = KINDS[:3]
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+[A-Za-z0-9+/_.=-]++""",
    # shorter runs can't pass, and a later start in the same run is shorter still
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?:\G|(?<![0-9a-f]))[0-9a-f]{24,}+",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+",
    "token": r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{30,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+)",
    "pem": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}+",
}
NEEDS = {"access": "AKIA", "jwt": "eyJ", "pem": "PRIVATE KEY"}
_VALUE = r"""^.*?["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ASSIGN_CHARS = 6
EXAMPLE_OWNERS = 3
#: A value of more than one in so many of all spans is joined by broadcast; no result
#: depends on it.
HOT = 50_000
SPANS = "array<struct<start:int,rank:int,kind:string,end:int,hash:bigint>>"


def candidates(docs: DataFrame, text: str = "text", out: str = "found") -> DataFrame:
    """docs with a column of candidate spans and the hashes of their values."""
    body = text_of(text)

    def of(rank: int, kind: str) -> Column:
        found = matches(body, PATTERNS[kind])
        if kind in NEEDS:
            found = F.when(F.contains(body, F.lit(NEEDS[kind])), found).otherwise(F.array().cast("array<string>"))

        def secret(value: Column) -> Column:
            return F.regexp_extract(value, _VALUE, 1) if kind == "assign" else value

        def made(f: Column) -> Column:
            spans = located(body, PATTERNS[kind], f)
            if kind == "assign":
                spans = F.filter(spans, lambda s: F.length(secret(s["value"])) >= ASSIGN_CHARS)
            rows = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.xxhash64(secret(s["value"])).alias("hash")))
            return F.when(F.size(f) > 0, rows).otherwise(F.array().cast(SPANS))

        return let(found, made)

    return docs.withColumn(out, F.array_sort(F.concat(*[of(i, k) for i, k in enumerate(KINDS)])))


def find_secrets(docs: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """repo, owner and spans (start, rank, kind, end, hash, n_repos, n_owners, live)
    of every row; spans of added kinds only where they look live."""
    found = candidates(docs.select(F.col(repo).alias("repo"), F.col(owner).alias("owner"), F.col(text).alias("body")), "body")
    found = cut(found.select(F.monotonically_increasing_id().alias("row"), "repo", "owner", "found"), "candidates")
    single = found.filter(F.size("found") > 0).select("row", "repo", "owner", F.explode("found").alias("span"))
    owned = single.groupBy(F.col("span.hash").alias("hash"), "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    per_owner = owned.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n_repos"), F.sum("n").alias("n"))
    counts = cut(per_owner.groupBy("hash").agg(F.sum("n_repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n")), "counts")
    # values of more than one in HOT of all spans, less than HOT of them, go to the spans,
    # not the spans to them
    total = counts.agg(F.sum("n")).first()[0] or 0
    named, often = single.withColumn("hash", F.col("span.hash")), F.col("n") * HOT > total
    hot = F.broadcast(counts.filter(often))
    judged = named.join(hot, "hash").unionByName(named.join(hot.select("hash"), "hash", "left_anti").join(counts.filter(~often), "hash"))
    full = F.struct("span.start", "span.rank", "span.kind", "span.end", "span.hash", "n_repos", "n_owners", (F.col("n_owners") < EXAMPLE_OWNERS).alias("live"))
    spans = judged.select("row", full.alias("span")).groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    kept = F.filter("spans", lambda s: (s["rank"] < len(BASE)) | s["live"])
    kind = "array<struct<start:int,rank:int,kind:string,end:int,hash:bigint,n_repos:bigint,n_owners:bigint,live:boolean>>"
    out = found.select("row", "repo", "owner").join(spans, "row", "left")
    return out.select(F.col("repo").alias(repo), F.col("owner").alias(owner), F.coalesce(kept, F.array().cast(kind)).alias("spans"))
