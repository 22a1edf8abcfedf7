"""Tables of reports: counts by class, funnels, coverage, agreement, samples and orders. Columns and conditions are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import running


def distinct_counts(df: DataFrame, by: list[str], counted: dict[str, Column], rows: str = "n") -> DataFrame:
    """(by, rows, a column for each of `counted`): how many rows and how many distinct values; nulls aren't counted, structs of keys are keys."""
    return df.groupBy(*by).agg(F.count("*").alias(rows), *[F.count_distinct(c).alias(name) for name, c in counted.items()])


def shared_keys(df: DataFrame, key: str, owner: str) -> DataFrame:
    """(key, owners): keys that several owners have."""
    return df.groupBy(key).agg(F.count_distinct(owner).alias("owners")).where("owners > 1")


def flags_by_class(df: DataFrame, label: str, classes: list[str], flags: dict[str, Column]) -> DataFrame:
    """(reason, a column for each class): how many rows of each class a flag holds for; a row may have several flags."""
    told = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in flags.items()]))
    return df.select(F.col(label).alias("__label"), F.explode(told).alias("reason")).groupBy("reason").pivot("__label", classes).count().na.fill(0)


def funnel(df: DataFrame, label: str, rules: dict[str, Column], kept: str = "kept", everything: str = "all") -> DataFrame:
    """(label, reason, n): rows by the first rule that fits, in the order given, for each class and for all."""
    first = reduce(lambda out, rule: out.when(rule[1], F.lit(rule[0])), rules.items(), F).otherwise(F.lit(kept))
    rolled = df.select(F.col(label).alias("__label"), first.alias("reason")).rollup("reason", "__label").agg(F.count("*").alias("n"), F.grouping("__label").alias("whole"), F.grouping("reason").alias("none"))
    return rolled.where("none = 0").select(F.when(F.col("whole") == 1, F.lit(everything)).otherwise(F.col("__label")).alias(label), "reason", "n")


def coverage(df: DataFrame, label: str, origin: Column, content: str, least: int) -> DataFrame:
    """(label, total, first_origin, other_origin, texts, meets): rows of each class by origin, distinct contents, and whether there are enough."""
    return df.groupBy(label).agg(F.count("*").alias("total"), F.count_if(origin).alias("first_origin"), F.count_if(~origin).alias("other_origin"), F.count_distinct(content).alias("texts"), (F.count("*") >= least).alias("meets"))


def tag_agreement(df: DataFrame, by: list[str], tagged: Column, truth: Column) -> DataFrame:
    """(by, n, recall, precision, base_rate, lift) of a tag against the truth; null where nothing is to divide by."""
    hit = F.count_if(tagged & truth).cast("double")
    precision, rate = F.try_divide(hit, F.count_if(tagged)), F.avg(truth.cast("int"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(hit, F.count_if(truth)).alias("recall"), precision.alias("precision"), rate.alias("base_rate"), F.try_divide(precision, rate).alias("lift"))


def go(df: DataFrame, label: str, per_class: int, classes: int, cases: int) -> DataFrame:
    """(cases, classes, build): whether there are enough cases, and enough classes of enough cases, to build a dataset."""
    sums = df.groupBy(label).agg(F.count("*").alias("n"))
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cases"), F.count_if(F.col("n") >= per_class).alias("classes")).withColumn("build", (F.col("cases") >= cases) & (F.col("classes") >= classes))


def upper_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, upper_median): the value at place n // 2 + 1. Values are counted first and dealt by ranges, so no group is in one task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("w"))
    upto = running(counts, [by], [value], "w", "upto")
    total = counts.groupBy(F.col(by).alias("__by")).agg(F.sum("w").alias("n"))
    both = upto.join(total, F.col(by).eqNullSafe(F.col("__by")))
    return both.where(F.col("upto") >= F.floor(F.col("n") / 2) + 1).groupBy(by).agg(F.min(value).alias("upper_median"))


def same_wrong_answer(answers: DataFrame, key: str, least: int = 2) -> DataFrame:
    """answers (key, truth, answer) -> (key, answer, n): questions that at least `least` runs answered, all with the same wrong answer."""
    sums = answers.groupBy(key).agg(F.count("*").alias("n"), F.count("answer").alias("given"), F.min("answer").alias("answer"), F.max("answer").alias("__max"), F.count_if(F.col("answer") == F.col("truth")).alias("right"))
    return sums.where((F.col("n") >= least) & (F.col("given") == F.col("n")) & (F.col("answer") == F.col("__max")) & (F.col("right") == 0)).select(key, "answer", "n")


def identical_groups(df: DataFrame, content: str, owner: str, label: str) -> DataFrame:
    """(groups, members, within_one, across, mixed): groups of equal contents, their rows, those of one owner, of several, and of several classes."""
    g = df.groupBy(content).agg(F.count("*").alias("n"), F.count_distinct(owner).alias("owners"), F.count_distinct(label).alias("classes")).where("n > 1")
    some = lambda test: F.sum(F.when(test, F.col("n")))
    return g.agg(F.count("*").alias("groups"), F.sum("n").alias("members"), some(F.col("owners") == 1).alias("within_one"), some(F.col("owners") > 1).alias("across"), F.coalesce(some(F.col("classes") > 1), F.lit(0)).alias("mixed"))


def by_first_appearance(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """(by, values): distinct values in the order in which they first appear; for values that are few."""
    first = df.groupBy(by, value).agg(F.min(order).alias("__first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("__first", value))), lambda x: x[value])
    return first.groupBy(by).agg(ordered.alias("values"))


def in_class_order(values: Column, classes: list[str]) -> Column:
    """Values in the order of a list of classes, then those outside it, sorted."""
    known = F.array(*map(F.lit, classes)).cast("array<string>")
    return F.concat(F.array_intersect(known, values), F.array_sort(F.array_except(values, known)))


def index_by_class(df: DataFrame, label: str, value: str, parts: dict[str, Column]) -> DataFrame:
    """(label, values, a count for each of `parts`): the distinct values of a class, sorted, and its rows by part; for values that are few."""
    return df.groupBy(label).agg(F.sort_array(F.collect_set(value)).alias("values"), *[F.count_if(test).alias(name) for name, test in parts.items()])


def hash_key(key: str, seed: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)


def hash_sample(df: DataFrame, by: str, key: str, seed: str, most: int) -> DataFrame:
    """(by, key, place): of each class the first `most` keys by a hash: the same sample on any cluster."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(hash_key(key, seed), key))
    return df.select(by, key, place.alias("place")).where(F.col("place") <= most)


def most_common(df: DataFrame, by: str, value: str, order: str, most: int) -> DataFrame:
    """(by, value, n): of each class the most common values, ties by first appearance. Counted before they are ranked."""
    sums = df.groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "__first", value))
    return sums.withColumn("__place", place).where(F.col("__place") <= most).select(by, value, "n")


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(both, only_a, only_b): how many distinct keys two tables share and have alone."""
    side = lambda df, name: df.select(key, F.lit(name).alias("__side"))
    held = side(a, "a").unionByName(side(b, "b")).groupBy(key).agg(F.max(F.col("__side") == "a").alias("a"), F.max(F.col("__side") == "b").alias("b"))
    return held.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(~F.col("a") & F.col("b")).alias("only_b"))


def respelled(value: Column, spelling: dict[str, str]) -> Column:
    """The value in upper case, with the spellings of a short list replaced."""
    known = F.create_map(*[F.lit(x) for pair in spelling.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.upper(value)), F.upper(value))


def year_span(df: DataFrame, by: str, year: Column) -> DataFrame:
    """(by, span): the first and the last year, `2001–2004`; one year alone where they are equal."""
    lo, hi = F.min(year).cast("string"), F.max(year).cast("string")
    return df.groupBy(by).agg(F.when(lo == hi, lo).otherwise(F.concat(lo, F.lit("–"), hi)).alias("span"))
