"""Scores of answers against labels. An answer that is null is invalid: wrong in every score."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import running

INVALID = "(invalid)"
#: Resamples of a bootstrap, from which 2.5 and 97.5 percentiles are taken.
RESAMPLES = 2_000


def classes_of(df: DataFrame, *columns: str) -> DataFrame:
    """The distinct values of some columns, one row each (label)."""
    out = df.select(F.col(columns[0]).alias("label"))
    for c in columns[1:]:
        out = out.unionByName(df.select(F.col(c).alias("label")))
    return out.where("label IS NOT NULL").distinct()


def confusion(answers: DataFrame, labels: list[str]) -> DataFrame:
    """answers (truth, answer) -> (truth, answer, n) for every pair of classes and for invalid answers; 0 where there is none.

    A truth or an answer that is not one of `labels` is an error.
    """
    spark = answers.sparkSession
    counts = answers.groupBy("truth", F.coalesce("answer", F.lit(INVALID)).alias("answer")).count()
    known = F.col("truth").isin(*labels) & F.col("answer").isin(*labels, INVALID)
    counts = counts.withColumn("truth", F.when(known, F.col("truth")).otherwise(F.raise_error(F.concat(F.lit("not a class: "), F.coalesce("truth", F.lit("null")), F.lit(" / "), F.col("answer"))).cast("string")))
    grid = spark.createDataFrame([(t, a) for t in labels for a in [*labels, INVALID]], "truth string, answer string")  # as many rows as classes squared
    return grid.join(counts, ["truth", "answer"], "left").select("truth", "answer", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def class_scores(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(truth, answer, n) -> (label, support, answered, tp, precision, recall, f1), null where nothing is to divide by."""
    by = by or []
    rows = matrix.select(*by, F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("answered"), F.when(F.col("truth") == F.col("answer"), F.col("n")).otherwise(0).alias("tp"))
    columns = matrix.where(F.col("answer") != INVALID).select(*by, F.col("answer").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("answered"), F.lit(0).cast("long").alias("tp"))
    sums = rows.unionByName(columns).groupBy(*by, "label").agg(*[F.sum(c).cast("long").alias(c) for c in ("support", "answered", "tp")])
    divide = lambda a, b: F.try_divide(a.cast("double"), b)
    return sums.select("*", divide(F.col("tp"), F.col("answered")).alias("precision"), divide(F.col("tp"), F.col("support")).alias("recall"), divide(2 * F.col("tp"), F.col("answered") + F.col("support")).alias("f1"))


def macro_scores(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over the classes that occur as truth; what is undefined counts as 0."""
    mean = lambda c: F.avg(F.when(F.col("support") > 0, F.coalesce(c, F.lit(0.0))))
    return scores.groupBy(*(by or [])).agg(F.sum("support").alias("n"), F.sum("tp").alias("correct"), mean("recall").alias("balanced_accuracy"), mean("precision").alias("macro_precision"), mean("f1").alias("macro_f1"))


def summarize(answers: DataFrame, labels: list[str]) -> DataFrame:
    return macro_scores(class_scores(confusion(answers, labels)))


def top_k_answers(rankings: DataFrame) -> DataFrame:
    """(truth, ranked) -> (truth, answer): the truth itself where it is anywhere in the ranking, else invalid."""
    return rankings.select("truth", F.when(F.array_contains("ranked", F.col("truth")), F.col("truth")).alias("answer"))


def selective(answers: DataFrame) -> DataFrame:
    """(truth, answer, flag) -> coverage of all by valid answers that are flagged yes, and the share of wrong ones among them."""
    valid = F.col("answer").isNotNull() & F.col("flag").isin("yes", "no")
    covered = valid & (F.col("flag") == "yes")
    sums = answers.agg(F.count("*").alias("n"), F.count_if(valid).alias("valid"), F.count_if(covered).alias("covered"), F.count_if(covered & (F.col("truth") != F.col("answer"))).alias("covered_wrong"))
    return sums.select("*", F.try_divide(F.col("covered").cast("double"), F.col("n")).alias("coverage"), F.try_divide(F.col("covered_wrong").cast("double"), F.col("covered")).alias("selective_risk"))


def ranking_scores(hits: DataFrame, relevant: DataFrame, key: str, k: int) -> DataFrame:
    """hits (key, rank from 1, rel 0 or 1) and relevant (key, n_relevant) -> precision at k and binary nDCG at k (null if nothing is relevant)."""
    inside = F.when(F.col("rank") <= k, F.col("rel"))
    sums = hits.groupBy(key).agg(F.coalesce(F.sum(inside), F.lit(0)).alias("__hits"), F.coalesce(F.sum(inside / F.log2(F.col("rank") + 1)), F.lit(0.0)).alias("__gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_relevant"))), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + F.lit(1)))
    out = relevant.join(sums, key, "left")
    return out.select(key, (F.coalesce("__hits", F.lit(0)) / k).alias("precision_at_k"), F.when(F.col("n_relevant") > 0, F.coalesce("__gain", F.lit(0.0)) / ideal).alias("ndcg_at_k"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95 % score interval of a share; (0, 0) for n = 0."""
    p = F.try_divide(k.cast("double"), n)
    centre, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - spread)), F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), centre + spread))


def kappa(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(a, b) booleans -> Cohen's kappa; null for no rows or an expected agreement of 1."""
    share = lambda c: F.avg(c.cast("double"))
    sums = pairs.groupBy(*(by or [])).agg(F.count("*").alias("n"), share(F.col("a") == F.col("b")).alias("observed"), share(F.col("a")).alias("pa"), share(F.col("b")).alias("pb"))
    expected = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return sums.select(*(by or []), "n", "observed", F.when(expected != 1, (F.col("observed") - expected) / (1 - expected)).alias("kappa"))


def holm(tests: DataFrame, key: str) -> DataFrame:
    """(key, p) -> adjusted p of Holm's step-down correction; equal p in the order of key. One row for each test."""
    by = Window.orderBy("p", key)
    step = F.least(F.lit(1.0), (F.count("*").over(Window.partitionBy()) - F.row_number().over(by) + 1) * F.col("p"))
    return tests.withColumn("__step", step).select(key, "p", F.max("__step").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("adjusted"))


def _stirling_error(k: int) -> float:
    """ln k! without Stirling's formula of it, k > 0."""
    if k < 16:
        return math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / k**2) / k**2) / k**2) / k**2) / k


def lower_tail(n: int, m: int) -> float:
    """The chance of at most m heads in n throws, 2 * m <= n: exact fractions up to 1,000 throws, then to about twelve digits.

    The last term comes from the entropy and Stirling's errors (Loader's saddle point), without differences of large
    logarithms. Each term before it is the next one times a ratio that falls; terms end where all that are left, a
    geometric series at most, are below a double's last digit: some multiple of the root of n, however large n is.
    """
    if n <= 1_000:
        return sum(math.comb(n, k) for k in range(m + 1)) / 2**n
    if not m:
        return math.exp(-n * math.log(2))
    e = (n - 2 * m) / n
    bent = sum(e ** (2 * j) / (j * (2 * j - 1)) for j in range(1, 12)) if e < 0.1 else (1 - e) * math.log1p(-e) + (1 + e) * math.log1p(e)
    last = math.exp(_stirling_error(n) - _stirling_error(m) - _stirling_error(n - m) - n / 2 * bent) * math.sqrt(n / (2 * math.pi * m * (n - m)))
    total, term, k = 1.0, 1.0, m
    while k and term * k > 1e-17 * total * (n - 2 * k + 1):
        term *= k / (n - k + 1)
        total += term
        k -= 1
    return last * total


def mcnemar(only_a: Column, only_b: Column) -> Column:
    """Exact two-sided p-value of a split at least so uneven, 1 for no pairs; see lower_tail() for its digits."""

    @F.pandas_udf("double")
    def p(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            tails = ((int(x) + int(y), min(int(x), int(y))) for x, y in zip(a, b, strict=True))
            yield pd.Series([1.0 if n - 2 * m <= 1 else min(1.0, 2 * lower_tail(n, m)) for n, m in tails])

    return p(only_a, only_b)


def interval(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(lo, hi): the 2.5 and 97.5 percentiles with linear interpolation; null if any value is undefined."""
    ends = F.percentile(F.col(value), F.array(F.lit(0.025), F.lit(0.975)))
    out = values.groupBy(*by).agg(F.count_if(F.col(value).isNull()).alias("__gaps"), ends.alias("__ends"))
    return out.select(*by, F.when(F.col("__gaps") == 0, F.col("__ends")[0]).alias("lo"), F.when(F.col("__gaps") == 0, F.col("__ends")[1]).alias("hi"))


def _numbered(sums: DataFrame) -> DataFrame:
    """sums (truth, grp, ...) with j, the group's number in its class by name (from 0), and the class's number of groups; a class of many groups is numbered by ranges, in many tasks."""
    places = running(sums.withColumn("__one", F.lit(1)), ["truth"], ["grp"], "__one", "__place")
    groups = places.groupBy("truth").agg(F.count("*").alias("groups"))
    return places.withColumn("j", F.col("__place").cast("int") - 1).drop("__one", "__place").join(groups.withColumnRenamed("truth", "__truth"), F.col("truth").eqNullSafe(F.col("__truth"))).drop("__truth")


def bootstrap(answers: DataFrame, resamples: int = RESAMPLES, seed: str = "0") -> DataFrame:
    """answers (truth, grp, answer) -> (resample, balanced_accuracy): within each true class as many groups are drawn, with repeats, as it has.

    Rows are first summed to one count pair for each class and group. The j-th draw of a class in a resample takes the group
    whose number (in order of name) is a hash of seed, resample, class and j, so the draws are the same on any cluster.
    """
    sums = answers.groupBy("truth", "grp").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("answer")).alias("hit"))
    units = _numbered(sums)
    draws = units.select("truth", "j", "groups", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("resample"))
    name = F.concat_ws(":", F.lit(seed), "resample", "truth", "j")
    picked = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long") % F.col("groups")).cast("int")
    drawn = draws.select("truth", "resample", picked.alias("j")).join(units.select("truth", "j", "n", "hit"), ["truth", "j"])
    recall = drawn.groupBy("resample", "truth").agg((F.sum("hit") / F.sum("n")).alias("recall"))
    return recall.groupBy("resample").agg(F.avg("recall").alias("balanced_accuracy"))


def bootstrap_scores(answers: DataFrame, labels: list[str], resamples: int = RESAMPLES, seed: str = "0") -> DataFrame:
    """answers (truth, grp, answer, ranked, flag) -> (resample, score, value) for every score that gets an interval, by the draws of bootstrap().

    Scores: balanced_accuracy, macro_f1, top_k_balanced_accuracy, coverage, selective_risk (null where nothing is covered), and
    `recall x` of each class x that occurs as truth. `interval(..., "value", ["score"])` gives the intervals. A truth or an answer
    that is not one of `labels` is an error.
    """
    right = F.coalesce(F.col("truth") == F.col("answer"), F.lit(False))
    covered = F.col("answer").isNotNull() & (F.col("flag") == "yes")
    known = F.col("truth").isin(*labels) & F.coalesce(F.col("answer").isin(*labels), F.lit(True))
    truth = F.when(known, F.col("truth")).otherwise(F.raise_error(F.concat_ws(" / ", F.lit("not a class"), "truth", "answer")).cast("string"))
    counted = {"n": F.lit(True), "tp": right, "top": F.array_contains("ranked", F.col("truth")), "covered": covered, "wrong": covered & ~right}
    counted |= {f"answered{i}": F.col("answer") == x for i, x in enumerate(labels)}
    sums = answers.groupBy(truth.alias("truth"), "grp").agg(*[F.count_if(test).alias(c) for c, test in counted.items()])
    units = _numbered(sums)
    draws = units.select("truth", "j", "groups", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("resample")).repartition("resample")
    name = F.concat_ws(":", F.lit(seed), "resample", "truth", "j")
    picked = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long") % F.col("groups")).cast("int")
    drawn = draws.select("truth", "resample", picked.alias("j")).join(units.select("truth", "j", *counted), ["truth", "j"])
    of = lambda c, x: F.sum(F.when(F.col("truth") == x, F.col(c)).otherwise(0))
    by_class = [of(c, x).alias(f"{c}_{i}") for i, x in enumerate(labels) for c in ("n", "tp", "top")]
    r = drawn.groupBy("resample").agg(*by_class, *[F.sum(c).alias(c) for c in counted if c not in ("tp", "top")])
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    present = sum((F.col(f"n_{i}") > 0).cast("int") for i in range(len(labels)))
    mean = lambda value: F.try_divide(sum(F.coalesce(value(i), F.lit(0.0)) for i in range(len(labels))), present)
    f1 = lambda i: F.when(F.col(f"n_{i}") > 0, 2 * F.col(f"tp_{i}").cast("double") / (F.col(f"n_{i}") + F.col(f"answered{i}")))
    values = {"balanced_accuracy": mean(lambda i: share(f"tp_{i}", f"n_{i}")), "macro_f1": mean(f1), "top_k_balanced_accuracy": mean(lambda i: share(f"top_{i}", f"n_{i}")), "coverage": share("covered", "n"), "selective_risk": share("wrong", "covered")}
    values |= {f"recall {x}": share(f"tp_{i}", f"n_{i}") for i, x in enumerate(labels)}
    rows = r.select("resample", F.explode(F.array(*[F.struct(F.lit(k).alias("score"), v.alias("value")) for k, v in values.items()])).alias("x")).select("resample", "x.*")
    return rows.where(~F.startswith(F.col("score"), F.lit("recall ")) | F.col("value").isNotNull())


def paired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two runs (key, truth, answer) -> both_right, only_a, only_b, both_wrong over the questions that both have."""
    right = lambda df, name: df.select(key, F.coalesce(F.col("answer") == F.col("truth"), F.lit(False)).alias(name))
    both = right(a, "a").join(right(b, "b"), key)
    return both.agg(F.count_if(F.col("a") & F.col("b")).alias("both_right"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(~F.col("a") & F.col("b")).alias("only_b"), F.count_if(~F.col("a") & ~F.col("b")).alias("both_wrong"))
