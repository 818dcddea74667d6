"""Quality rules: counts per text, then robust multivariate outliers.

``text_stats`` counts words, word characters, symbols, repeated lines and words in
repeated 3-word windows, each within its own row.  ``reject_outliers`` estimates
location and scatter of the transformed counts by the minimum covariance determinant, per
language and source and over all rows: from each of ``STARTS`` first subsets (the rows
nearest to the medians, scaled by median deviations; and hashed samples), concentration
steps (mean and covariance of the subset, Mahalanobis distances of all, the nearest
``SUBSET`` of the rows are the next subset) are made: ``TRIALS`` for every start, then, from
the start of least determinant, until the group's determinant falls no more.  A group's mean, covariance and scale are drawn
toward those of all rows with the weight of ``PRIOR`` rows, so that small groups need no
threshold and large ones stand on their own.  Rows beyond ``CUTOFF`` in squared distance,
brought to a consistent scale by its median, are rejected.  All is DataFrame work; only
counts and sums are shuffled, in partial sums, never texts.

Null texts have no words and fail the base rule, as do all texts below ``MIN_WORDS``.
Null languages and sources count as empty ones.  Very long texts are counted whole.
Repeated rows each count; an empty table gives an empty one.  Equal distances are kept or
rejected together.  Only key, text, lang and source are read, so names of other columns
can't clash.  ``FLOOR`` is added to each deviation, so that a count that is constant in a
group does not make every other value an outlier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import SPACES, cut, let, small, text_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
PRIOR = 50.0  # rows
SUBSET = 0.75
STARTS = 3
SAMPLE = 0.1  # of the rows, in a first subset by hash
TRIALS = 2  # concentration steps of every start; the best one of each group goes on
#: A group's steps end when its log determinant falls by no more than this, or after STEPS.
TOLERANCE, STEPS = 1e-3, 20
#: A limit is off by one of so many of a group's rows, which moves the log determinant by about
#: six such parts (five normal features): less than TOLERANCE, or no step would be the last.
RANKS = 10_000
#: Squared distance; for five normal features it is passed by less than one row in 10^9.
CUTOFF = 50.0
#: Median of the chi-square distribution with five degrees of freedom.
CHI2_MEDIAN = 4.3515
FEATURES = ("f_words", "f_length", "f_symbols", "f_repeats", "f_lines")
FLOOR = (0.5, 0.1, 0.35, 0.6, 0.5)


def _repeats(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""

    def covered(order: Column) -> Column:
        """order: (hash, place) of all windows, sorted, so equal windows are adjacent."""

        def same(i: Column, j: Column) -> Column:
            return F.coalesce(F.get(order, i)["h"] == F.get(order, j)["h"], F.lit(False))

        twice = F.filter(order, lambda s, i: same(i, i + 1) | ((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2)))))

    def over(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, over))


def text_stats(text: Column) -> Column:
    """A struct of the counts of one text."""

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACES}]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeats(words).cast("long").alias("n_repeat_words"),
        )

    return let(F.array_remove(F.split(text, f"[{SPACES}]+", -1), ""), of)


def features(s: Column) -> list[Column]:
    words = F.greatest(s["n_words"], F.lit(1)).cast("double")
    return [
        F.log1p(words),
        F.log(F.greatest(s["word_chars"], F.lit(1)) / words),
        F.log1p(1000 * s["n_symbols"] / (s["word_chars"] + 1)),
        F.log1p(100 * s["n_repeat_words"] / words),
        F.log1p(100 * s["n_dup_lines"] / words),
    ]


_P = range(len(FEATURES))
_M = [f"m_{i}" for i in _P]
_C = [f"c_{i}_{j}" for i in _P for j in range(i + 1)]
_L = [f"l_{i}_{j}" for i in _P for j in range(i + 1)]
_ALL = ""  # the group of all rows


def moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the number of rows, means m_i and covariances c_ij."""
    sums = [F.count(F.lit(1)).alias("n"), *[F.avg(FEATURES[i]).alias(f"m_{i}") for i in _P]]
    return rows.groupBy(*keys).agg(*sums, *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c_{i}_{j}") for i in _P for j in range(i + 1)])


def factored(table: DataFrame) -> DataFrame:
    """table with the Cholesky factor l_ij of the covariance, the floor added to its
    diagonal, and the log determinant."""
    for i in _P:
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}") + (FLOOR[i] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            table = table.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}"))
    total = F.lit(0.0)
    for i in _P:
        total = total + 2 * F.log(F.col(f"l_{i}_{i}"))
    return table.withColumn("logdet", total)


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    ys: list[Column] = []
    for i, f in enumerate(FEATURES):
        y = F.col(f) - F.col(f"m_{i}")
        for j in range(i):
            y = y - F.col(f"l_{i}_{j}") * ys[j]
        ys.append(y / F.col(f"l_{i}_{i}"))
    total = F.lit(0.0)
    for y in ys:
        total = total + y * y
    return total


def _nearest(rows: DataFrame, share: float) -> DataFrame:
    """The rows of each group and start with the least distances d, by their share."""
    keys = ["group", "start"]
    limits = cut(rows.groupBy(*keys).agg(F.percentile_approx("d", share, RANKS).alias("limit")), "limits")
    return rows.join(small(limits), keys).filter(F.col("d") <= F.col("limit"))


def least_determinant(rows: DataFrame) -> DataFrame:
    """rows: group and FEATURES.  Per group n, m_i and c_ij of the subset of least
    determinant; n is the number of all its rows."""
    keys = ["group", "start"]
    medians = cut(rows.groupBy("group").agg(*[F.percentile_approx(f, 0.5, 1000).alias(f"m_{i}") for i, f in enumerate(FEATURES)]), "medians")
    centred = rows.join(small(medians), "group")
    spreads = cut(centred.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), *[F.percentile_approx(F.abs(F.col(f) - F.col(f"m_{i}")), 0.5, 1000).alias(f"s_{i}") for i, f in enumerate(FEATURES)]), "spreads")
    near = F.lit(0.0)
    for i, f in enumerate(FEATURES):
        near = near + F.pow((F.col(f) - F.col(f"m_{i}")) / (1.4826 * F.col(f"s_{i}") + FLOOR[i]), 2)
    chance = F.pmod(F.xxhash64("start", *FEATURES), F.lit(1_000_003)).cast("double")
    many = centred.join(small(spreads), "group").withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))))
    many = many.withColumn("d", F.when(F.col("start") == 0, near).otherwise(chance)).select(*keys, "d", *FEATURES)
    first = _nearest(many.filter("start = 0"), SUBSET).unionByName(_nearest(many.filter("start > 0"), SAMPLE))
    table = cut(factored(moments(first, keys)), "scatter")
    kept = [*keys, "logdet", *_M, *_C, *_L]

    def step(now: DataFrame) -> DataFrame:
        placed = rows.join(small(now.select(*keys, *_M, *_L)), "group").withColumn("d", _distance()).select(*keys, "d", *FEATURES)
        return cut(factored(moments(_nearest(placed, SUBSET), keys)), "scatter")

    for _ in range(TRIALS):
        table = step(table)
    table = cut(table.groupBy("group").agg(F.min_by(F.struct(*kept[1:]), F.struct("logdet", "start")).alias("best")).select("group", "best.*"), "scatter")
    ended = []
    for _ in range(STEPS):
        before = table.select("group", F.struct(*kept[1:]).alias("before"))
        both = cut(step(table).join(small(before), "group"), "moved")
        falls = F.col("before.logdet") - F.col("logdet") > TOLERANCE
        # a group whose determinant falls no more has ended, with the lesser of the two
        ended.append(both.filter(~falls).select("group", F.when(F.col("logdet") < F.col("before.logdet"), F.struct(*kept[1:])).otherwise(F.col("before")).alias("best")).select("group", "best.*"))
        table = cut(both.filter(falls).select("group", *kept[1:]), "scatter")
        if table.isEmpty():
            break
    table = reduce(DataFrame.unionByName, ended, table)
    return _sized(table, spreads)


def _sized(table: DataFrame, spreads: DataFrame) -> DataFrame:
    """Estimates with the number of all rows of the group."""
    sizes = spreads.select("group", F.col("rows").alias("n"))
    return cut(table.select("group", *_M, *_C).join(sizes, "group"), "estimates")


def _drawn(table: DataFrame, columns: list[str]) -> DataFrame:
    """table (group, n, columns) with each group drawn toward all rows."""
    parent = table.filter(F.col("group") == _ALL).first()
    if parent is None:
        return table.select("group", "n", *columns)
    weight = F.col("n") / (F.col("n") + PRIOR)
    return table.select("group", "n", *[(weight * F.col(c) + (1 - weight) * F.lit(parent[c])).alias(c) for c in columns])


def reject_outliers(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the counts, base_failed, distance (null where the base rule failed), kept."""
    base = docs.select(F.col(key).alias("key"), F.concat_ws("\t", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))).alias("group"), text_stats(text_of(text)).alias("s"))
    failed = (F.col("s.n_words") < MIN_WORDS) | (100 * F.col("s.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("s.n_words"))
    base = cut(base.select("*", failed.alias("base_failed")), "stats")
    rows = base.select("key", "group", "base_failed", "s.*", *[f.alias(n) for f, n in zip(features(F.col("s")), FEATURES, strict=True)])
    own = rows.filter(~F.col("base_failed")).select("group", *FEATURES)
    fit = cut(own.union(own.withColumn("group", F.lit(_ALL))), "fit")

    estimates = cut(factored(_drawn(least_determinant(fit), [*_M, *_C])), "drawn")
    placed = fit.join(small(estimates), "group")
    scales = cut(placed.groupBy("group").agg(F.count(F.lit(1)).alias("n"), (F.percentile_approx(_distance(), 0.5, 1000) / CHI2_MEDIAN).alias("scale")), "scales")
    scales = cut(_drawn(scales, ["scale"]).select("group", F.greatest("scale", F.lit(1.0)).alias("scale")), "scales")
    judged = rows.join(small(estimates.select("group", *_M, *_L)), "group", "left").join(small(scales), "group", "left")
    distance = F.when(~F.col("base_failed"), F.round(_distance() / F.col("scale"), 6))
    judged = judged.withColumn("distance", distance)
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)
    return judged.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
