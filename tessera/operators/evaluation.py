"""Scores of whole runs: summaries with intervals, subsets, paired comparisons with their gates, and tables of many runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import holds
from tessera.operators import metrics


def summary(answers: DataFrame, labels: list[str], resamples: int = metrics.RESAMPLES, seed: str = "0") -> DataFrame:
    """answers (truth, grp, answer, ranked, flag) -> (score, value, lo, hi): every score of a run and the intervals that there are.

    Shares of counts have Wilson's interval where every answer is a group of its own, and else, like the averages, that of
    the bootstrap over groups. Null answers are wrong and counted as invalid; a group that is null is one group.
    """
    matrix = metrics.confusion(answers.select("truth", "answer"), labels)
    classes = metrics.class_scores(matrix)
    top = metrics.summarize(metrics.top_k_answers(answers.select("truth", "ranked")), labels).select("balanced_accuracy")
    whole, chosen = metrics.summarize(answers, labels), metrics.selective(answers)
    groups = answers.agg(F.count("*").alias("n"), F.count_if(F.col("answer").isNull()).alias("invalid"), (F.count_distinct("grp") + F.max(F.col("grp").isNull().cast("int"))).alias("groups"))
    row = lambda score, value: F.struct(F.lit(score).alias("score"), value.cast("double").alias("value"))
    spread = lambda df, *rows: df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    parts = [
        spread(groups, row("n", F.col("n")), row("invalid", F.col("invalid")), row("invalid_rate", F.try_divide(F.col("invalid"), F.col("n"))), row("groups", F.col("groups"))),
        spread(whole, *[row(c, F.col(c)) for c in ("correct", "balanced_accuracy", "macro_precision", "macro_f1")]),
        spread(top, row("top_k_balanced_accuracy", F.col("balanced_accuracy"))),
        spread(chosen, *[row(c, F.col(c)) for c in ("coverage", "selective_risk")]),
        classes.select(F.explode(F.array(*[F.struct(F.concat_ws(" ", F.lit(c), "label").alias("score"), F.col(c).cast("double").alias("value")) for c in ("support", "answered", "precision", "recall", "f1")])).alias("r")).select("r.*"),
    ]
    values = parts[0]
    for part in parts[1:]:
        values = values.unionByName(part)
    drawn = metrics.interval(metrics.bootstrap_scores(answers, labels, resamples, seed), "value", ["score"])
    shares = classes.where("support > 0").select(F.concat_ws(" ", F.lit("recall"), "label").alias("score"), F.col("tp").alias("k"), F.col("support").alias("of"))
    counts = chosen.select(F.explode(F.array(F.struct(F.lit("coverage").alias("score"), F.col("covered").alias("k"), F.col("n").alias("of")), F.struct(F.lit("selective_risk").alias("score"), F.col("covered_wrong").alias("k"), F.col("covered").alias("of")))).alias("r")).select("r.*")
    lo, hi = metrics.wilson(F.col("k"), F.col("of"))
    exact = shares.unionByName(counts).where("of > 0").select("score", lo.alias("wilson_lo"), hi.alias("wilson_hi"))
    independent = groups.select((F.col("groups") == F.col("n")).alias("independent"))  # one row
    out = values.join(drawn, "score", "left").join(exact, "score", "left").join(F.broadcast(independent))
    pick = lambda end: F.when(F.col("independent"), F.coalesce(f"wilson_{end}", end)).otherwise(F.col(end)).alias(end)
    return out.select("score", "value", pick("lo"), pick("hi"))


def subset_scores(answers: DataFrame, labels: list[str], subsets: dict[str, Column]) -> DataFrame:
    """(subset, n, correct, balanced_accuracy, macro_precision, macro_f1) of all answers and of those that fit each of `subsets`.

    Typical subsets: classes large enough, all facts recorded, not refused. A null condition leaves a row out.
    """
    tagged = answers.select("*", F.explode(F.array_compact(F.array(F.lit("all"), *[F.when(fits, F.lit(name)) for name, fits in subsets.items()]))).alias("subset"))
    matrix = tagged.groupBy("subset", "truth", F.coalesce("answer", F.lit(metrics.INVALID)).alias("answer")).agg(F.count("*").alias("n"))
    return metrics.macro_scores(metrics.class_scores(matrix, ["subset"]), ["subset"])


def run_differences(a: DataFrame, b: DataFrame, equal: list[str]) -> DataFrame:
    """(problem): why two runs (one row each, with a status and the columns of `equal`) can't be compared question by question."""
    both = a.select(F.struct(*a.columns).alias("a")).join(b.select(F.struct(*b.columns).alias("b")))  # a row each
    rules = [F.when(~F.col(f"{s}.status").eqNullSafe(F.lit("complete")), F.lit(f"run {s} is not finished")) for s in ("a", "b")]
    rules += [F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(f"the runs differ in their {c}")) for c in equal]
    return both.select(F.explode(F.array_compact(F.array(*rules))).alias("problem"))


def paired_answers(a: DataFrame, b: DataFrame, key: str, subset: bool = False) -> DataFrame:
    """(key, truth, grp, a, b): the answers of two runs (key, truth, grp, answer) to the same questions.

    The runs must have answered the same questions with the same classes, each once; with `subset` one run's questions may
    be some of the other's. Anything else stops the step. A null key is a question of its own.
    """
    once = lambda df, n: df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias(f"n{n}"), F.first(F.struct("truth", "grp", "answer")).alias(f"x{n}"))
    left, right = once(a, 1), once(b, 2).withColumnRenamed("k", "k2")
    both = left.join(right, left["k"].eqNullSafe(right["k2"]), "full_outer")
    alone = both.agg(F.count_if(F.col("n2").isNull()).alias("a"), F.count_if(F.col("n1").isNull()).alias("b")).first()  # one row
    if (alone["a"] or alone["b"]) and not (subset and 0 in (alone["a"], alone["b"])):
        raise ValueError(f"the runs did not answer the same questions: {alone['a']} of the first and {alone['b']} of the second stand alone")
    wrong = F.when(F.col("n1") + F.col("n2") > 2, "answered twice").when(~F.col("x1.truth").eqNullSafe(F.col("x2.truth")), "another class")
    pairs = both.where("n1 IS NOT NULL AND n2 IS NOT NULL").where(holds(wrong.isNull(), F.concat_ws(": ", wrong, F.col("k").cast("string"))))
    return pairs.select(F.col("k").alias(key), "x1.truth", "x1.grp", F.col("x1.answer").alias("a"), F.col("x2.answer").alias("b"))


def paired_bootstrap(pairs: DataFrame, labels: list[str], resamples: int = metrics.RESAMPLES, seed: str = "0") -> DataFrame:
    """pairs (truth, grp, a, b) -> (resample, score, value): b minus a in balanced_accuracy and macro_f1, both by the same draws.

    The draws are those of metrics.bootstrap(): whole groups of a class, with repeats, as many as the class has.
    `metrics.interval(..., "value", ["score"])` gives the intervals.
    """
    sides = {s: metrics.bootstrap_scores(pairs.select("truth", "grp", F.col(s).alias("answer"), F.lit(None).cast("array<string>").alias("ranked"), F.lit(None).cast("string").alias("flag")), labels, resamples, seed) for s in ("a", "b")}
    some = {s: df.where(F.col("score").isin("balanced_accuracy", "macro_f1")).withColumnRenamed("value", s) for s, df in sides.items()}
    return some["a"].join(some["b"], ["resample", "score"]).select("resample", "score", (F.col("b") - F.col("a")).alias("value"))


def table_of_runs(scores: DataFrame, rows: str, columns: str, value: str, names: list[str]) -> DataFrame:
    """(rows, a column for each of `names`): one value for each pair, null where there is no run; two values for a pair stop the step."""
    cells = scores.groupBy(rows, columns).agg(F.count(value).alias("__n"), F.max(value).alias("__one"))
    alone = (F.col("__n") <= 1) | ~F.coalesce(F.col(columns).isin(*names), F.lit(False))
    sure = cells.where(holds(alone, F.concat(F.lit("two values for one cell: "), F.coalesce(F.col(rows).cast("string"), F.lit("null")))))
    return sure.groupBy(rows).pivot(columns, names).agg(F.max("__one"))


def shortcut_probe(votes: DataFrame, labels: list[str], positive: list[str]) -> DataFrame:
    """votes (view, truth, vote) -> (view, balanced_accuracy, positive_balanced_accuracy): how well a view alone tells the class, and whether it is one of `positive`."""
    matrix = lambda t, v: votes.groupBy("view", t.alias("truth"), v.alias("answer")).agg(F.count("*").alias("n"))
    score = lambda m, name: metrics.macro_scores(metrics.class_scores(m, ["view"]), ["view"]).select("view", F.col("balanced_accuracy").alias(name))
    kind = lambda c: F.when(F.col(c).isin(*positive), F.lit("positive")).otherwise(F.lit("other"))
    return score(matrix(F.col("truth"), F.col("vote")), "balanced_accuracy").join(score(matrix(kind("truth"), kind("vote")), "positive_balanced_accuracy"), "view")
