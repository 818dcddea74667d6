"""URL filter: rules by host and path, and a language-model ratio for the rest.

The URLs that rules allow or block train one character model each, and the whole URL,
from scheme to fragment, is what is learnt and scored.  Both are
variable-order Markov models: every order from ``ORDER`` down to 0 is smoothed by the
next lower one with the weight that the number of distinct followers of a context
gives (Witten and Bell).  The score of a URL is the mean per character of log
p(blocked) - log p(allowed).  Training URLs are scored in FOLDS folds, by hash, each by the
models of the others, so all of them serve the limit, where both kinds would err equally
often (see calibrate).  All is DataFrame work: counts of windows of ORDER + 1
characters over all URLs, one join per order, one pass that sums.  The models reach the
URLs by broadcast, a row for each context: there are no more than ``SYMBOLS`` to the power
ORDER of these, 79,507, with FOLDS + 1 ratios for each of 43 followers, whatever the input.

Null URLs and URLs without ``://`` have an empty host and path and are allowed, whatever
their score; a null URL is scored as an empty one.  Very long URLs are scored whole;
repeated rows each have their verdict; an empty table gives an empty one; only the key
and the URL are read, so no other name can clash.  Ties between rules can't be, as rules
of equal length that fit one URL are equal.  With less than LEAST training URLs of either
kind all else is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import cut

ORDER = 3
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-_"
#: Before the first character and for any character outside the alphabet.
START, OTHER, END = "^", "*", "$"
SYMBOLS = len(ALPHABET) + 3
FOLDS = 4  # of the training URLs; each is scored by a model of the others
LEAST = 3  # training URLs of a kind
PRIOR = 20  # training URLs

#: Fixed values: (verdict, host, path prefix).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(url, pattern, 1), upper, upper.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits.
    rules are a list in the program, not a table."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(prefix))
        name, verdict = F.when(fits, F.lit(at + prefix)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _windows(text: Column) -> Column:
    """All windows of ORDER + 1 characters of the padded text, one ends at each."""
    folded = F.regexp_replace(F.lower(text), f"[^{ALPHABET.replace('-', '')}-]", OTHER)
    padded = F.concat(F.lit(START * ORDER), folded, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(folded) + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def ratios(windows: DataFrame) -> DataFrame:
    """windows: variant, window, allowed, blocked (counts; both may be 0).  Returns for each
    variant and window the log ratio of its last character, given what precedes."""
    kinds = ("allowed", "blocked")
    grams = [windows.groupBy("variant", F.substring("window", ORDER + 1 - k, k + 1).alias("gram")).agg(*[F.sum(c).alias(c) for c in kinds]) for k in range(ORDER)]
    grams.append(windows.withColumnRenamed("window", "gram"))
    model = None
    for k, gram in enumerate(grams):
        last = gram.withColumns({"context": F.substring("gram", 1, k), "shorter": F.substring("gram", 2, max(k, 1)) if k else F.lit("")})
        stats = gram.groupBy("variant", F.substring("gram", 1, k).alias("context")).agg(*[F.sum(c).alias(f"{c}_n") for c in kinds], *[F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_t") for c in kinds])
        both = last.join(stats, ["variant", "context"])
        if model is None:
            chance = {c: (F.col(c) + 1.0) / (F.col(f"{c}_n") + SYMBOLS) for c in kinds}
        else:
            both = both.join(model, ["variant", "shorter"])
            weight = {c: F.col(f"{c}_n") + F.col(f"{c}_t") for c in kinds}
            chance = {c: F.when(weight[c] > 0, (F.col(c) + F.col(f"{c}_t") * F.col(f"{c}_p")) / F.greatest(weight[c], F.lit(1))).otherwise(F.col(f"{c}_p")) for c in kinds}
        model = both.select("variant", F.col("gram").alias("shorter"), *[chance[c].alias(f"{c}_p") for c in kinds])
    return model.select("variant", F.col("shorter").alias("window"), (F.log("blocked_p") - F.log("allowed_p")).alias("ratio"))


def calibrate(scores: DataFrame) -> float | None:
    """scores: score, verdict of training URLs, each scored by a model without it.  The
    limit at which as many allowed URLs would lie beyond it as blocked ones below, by a
    normal distribution fitted to each kind, whose spread is drawn toward that of both with
    the weight of PRIOR URLs.  None, so that nothing is blocked, with less than LEAST URLs
    of a kind or where the blocked ones have no higher scores.  One row, whatever the input."""
    of = {kind: F.when(F.col("verdict") == kind, F.col("score")) for kind in ("allow", "block")}
    r = scores.agg(*[f(c).alias(f"{name}_{kind}") for kind, c in of.items() for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop))]).first()
    a, b = r["n_allow"], r["n_block"]
    if min(a, b) < LEAST or r["mean_block"] <= r["mean_allow"]:
        return None
    both = (a * r["var_allow"] + b * r["var_block"]) / (a + b)
    spread = {k: ((n * r[f"var_{k}"] + PRIOR * both) / (n + PRIOR)) ** 0.5 for k, n in (("allow", a), ("block", b))}
    total = spread["allow"] + spread["block"]
    if not total:
        return (r["mean_allow"] + r["mean_block"]) / 2
    return (r["mean_allow"] * spread["block"] + r["mean_block"] * spread["allow"]) / total


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, score, verdict of every row."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), host.alias("host"), path.alias("path"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")
    # all URLs without a rule are scored by the model of all training URLs
    rows = cut(rows.select("*", rule.alias("rule"), verdict.alias("by_rule")).withColumn("variant", F.when(F.col("by_rule").isNull(), FOLDS).otherwise(fold)), "urls")
    flat = rows.select("row", "by_rule", "variant", F.explode(_windows(F.col("url"))).alias("window"))
    kinds = {"allowed": "allow", "blocked": "block"}
    each = [F.count(F.when((F.col("by_rule") == kind) & (F.col("variant") == f), 1)).alias(f"{name}_{f}") for name, kind in kinds.items() for f in range(FOLDS)]
    counts = cut(flat.groupBy("window").agg(*each), "windows")

    def without(name: str, variant: int) -> Column:
        return sum((F.col(f"{name}_{f}") for f in range(FOLDS) if f != variant), F.lit(0)).alias(name)

    variants = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), *[without(name, v) for name in kinds]) for v in range(FOLDS + 1)]))
    table = ratios(counts.select("window", variants.alias("v")).select("v.variant", "window", "v.allowed", "v.blocked"))
    each = F.transform(F.array_sort(F.collect_list(F.struct("variant", "ratio"))), lambda r: r["ratio"])
    entries = F.collect_list(F.struct(F.substring("window", ORDER + 1, 1), "ratios"))
    packed = table.groupBy("window").agg(each.alias("ratios"))
    model = cut(packed.groupBy(F.substring("window", 1, ORDER).alias("context")).agg(F.map_from_entries(entries).alias("followers")), "model")
    pairs = flat.select("row", "variant", F.substring("window", 1, ORDER).alias("context"), F.substring("window", ORDER + 1, 1).alias("last"))
    ratio = F.element_at(F.element_at("followers", F.col("last")), F.col("variant") + 1)
    scores = pairs.join(F.broadcast(model), "context").groupBy("row").agg(F.round(F.avg(ratio), 9).alias("score"))
    judged = cut(rows.join(scores, "row", "left"), "scores")
    limit = calibrate(judged.filter(F.col("by_rule").isNotNull()).select("score", F.col("by_rule").alias("verdict")))
    by_score = F.lit("allow") if limit is None else F.when((F.col("score") >= limit) & (F.col("host") != ""), "block").otherwise("allow")
    return judged.select(F.col("key").alias(key), "host", "path", "rule", "score", F.coalesce("by_rule", by_score).alias("verdict"))
