"""Profiles of tables whose cells are text: columns, gaps, levels, duplicates, disagreements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import is_gap
from tessera.sources.tables import running


def unpivoted(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column, value): one row for each cell of `columns`."""
    return df.unpivot(keys, [F.col(c).cast("string").alias(c) for c in columns], "column", "value")


def column_profile(df: DataFrame, columns: list[str], listed: int = 20) -> DataFrame:
    """(column, filled, empty, distinct, kind, low, median, high, listed): numbers where every filled cell is one and more than `listed` values occur, else the values with counts, if few.

    The values are counted first, so a column of few values moves few rows, and its list is bounded by `listed`.
    """
    counts = unpivoted(df, [], columns).groupBy("column", "value").agg(F.count("*").alias("n")).withColumn("gap", is_gap(F.col("value"))).withColumn("x", F.btrim("value").try_cast("double"))
    sums = counts.groupBy("column").agg(
        F.sum(F.when(~F.col("gap"), F.col("n")).otherwise(0)).alias("filled"), F.sum(F.when(F.col("gap"), F.col("n")).otherwise(0)).alias("empty"), F.count("*").alias("distinct"),
        F.count_if(~F.col("gap") & F.col("x").isNull()).alias("words"), F.min(F.when(~F.col("gap"), F.col("x"))).alias("low"), F.max(F.when(~F.col("gap"), F.col("x"))).alias("high"),
    )
    # The median comes from sums of counts by ranges, so that no column's values are gathered in one task.
    cells = counts.where(~F.col("gap") & F.col("x").isNotNull()).groupBy("column", "x").agg(F.sum("n").alias("w"))
    upto = running(cells, ["column"], ["x"], "w", "upto").join(sums.select("column", "filled"), "column")
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("x")))
    median = upto.groupBy("column").agg(((at(F.floor((F.col("filled") + 1) / 2)) + at(F.ceil((F.col("filled") + 1) / 2))) / 2).alias("median"))
    sums = sums.join(median, "column", "left")
    few = counts.join(sums.where(F.col("distinct") <= listed).select("column"), "column").groupBy("column").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "value"))).alias("v"))
    few = few.select("column", F.array_join(F.transform("v", lambda x: F.concat(x["value"], F.lit("="), (-x["n"]).cast("string"))), "; ").alias("listed"))
    numbers = (F.col("words") == 0) & (F.col("filled") > 0) & (F.col("distinct") > listed)
    kind = F.when(numbers, "numbers").when(F.col("distinct") <= listed, "values").otherwise("not listed")
    only = lambda c: F.when(numbers, F.col(c)).alias(c)
    return sums.join(few, "column", "left").select("column", "filled", "empty", "distinct", kind.alias("kind"), only("low"), only("median"), only("high"), "listed")


def column_levels(df: DataFrame, levels: list[tuple[str, list[str]]], columns: list[str], otherwise: str) -> DataFrame:
    """(column, level): the first of `levels` (name, key columns) at which the column has one value for each key; gaps count as values."""
    cells = unpivoted(df, sorted({k for _, keys in levels for k in keys}), columns).withColumn("value", F.coalesce("value", F.lit("")))
    out = None
    for rank, (name, keys) in enumerate(levels):
        fixed = cells.groupBy("column", *keys).agg(F.count_distinct("value").alias("n")).groupBy("column").agg((F.max("n") == 1).alias("fixed"))
        part = fixed.select("column", F.when(F.col("fixed"), rank).otherwise(len(levels)).alias("rank"))
        out = part if out is None else out.unionByName(part)
    names = F.array(*[F.lit(n) for n, _ in levels], F.lit(otherwise))
    return out.groupBy("column").agg(F.min("rank").alias("rank")).select("column", F.element_at(names, F.col("rank") + 1).alias("level"))


def gap_patterns(df: DataFrame, columns: list[str], label: str, top: int = 8) -> DataFrame:
    """(pattern, n, labels): sets of empty columns by number of rows, the `top` most common."""
    pattern = F.array_join(F.array_compact(F.array(*[F.when(is_gap(F.col(c)), F.lit(c)) for c in columns])), ",")
    sums = df.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels"))
    return sums.orderBy(F.desc("n"), "pattern").limit(top)


def filled_fields(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Mean, least and largest number of filled fields of a row."""
    n = sum(((~is_gap(F.col(c))).cast("int") for c in columns), F.lit(0))
    return df.select(by, n.alias("n")).groupBy(by).agg(F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


def duplicate_groups(df: DataFrame, content: str, same: dict[str, list[str]]) -> DataFrame:
    """(content, n, same_<name>...): contents that several rows have, and whether these agree in some columns."""
    tests = [(F.count_distinct(F.struct(*columns)) == 1).alias(f"same_{name}") for name, columns in same.items()]
    return df.groupBy(content).agg(F.count("*").alias("n"), *tests).where("n > 1")


def disagreements(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, values): keys with several recorded values of a column that should be one."""
    cells = unpivoted(df, [key], columns).where(~is_gap(F.col("value")))
    return cells.groupBy(key, "column").agg(F.collect_set("value").alias("v")).where(F.size("v") > 1).select(key, "column", F.array_join(F.sort_array("v"), "|").alias("values"))


def change_log(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, old, new): cells that differ, without gaps that were rewritten."""
    old, new = unpivoted(before, [key], columns).withColumnRenamed("value", "old"), unpivoted(after, [key], columns).withColumnRenamed("value", "new")
    return old.join(new, [key, "column"]).where(~is_gap(F.col("old")) & ~F.col("old").eqNullSafe(F.col("new")))


def reconciled(table: DataFrame, disk: DataFrame, key: str, content: str) -> DataFrame:
    """(key, state): missing (in the table alone), extra (on disk alone), changed or same; one row for each key, a null key is a key.

    Where a key repeats, it is the same if both sides hold the same contents, each as often.
    """
    mark = F.sum(F.xxhash64(content).cast("decimal(20,0)"))
    a, b = (df.groupBy(F.col(key).alias(k)).agg(F.count("*").alias(f"n{k}"), mark.alias(f"m{k}")) for df, k in ((table, "__a"), (disk, "__b")))
    state = F.when(F.col("n__b").isNull(), "missing").when(F.col("n__a").isNull(), "extra").when((F.col("n__a") == F.col("n__b")) & (F.col("m__a") == F.col("m__b")), "same").otherwise("changed")
    return a.join(b, F.col("__a").eqNullSafe(F.col("__b")), "full_outer").select(F.coalesce("__a", "__b").alias(key), state.alias("state"))


def exclusive_quartiles(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles by the exclusive method: position p(n + 1) among the sorted values, interpolated and held inside; null below two values.

    Values are counted first and dealt by ranges, so that no group is sorted or gathered in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("__by"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("w"))
    upto = running(counts, ["__by"], ["v"], "w", "upto")
    total = counts.groupBy(F.col("__by").alias("__of")).agg(F.sum("w").alias("n"))
    both = upto.join(total, F.col("__by").eqNullSafe(F.col("__of")))
    at, ends = {}, []
    for q in (1, 2, 3):
        lo = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(q * (F.col("n") + 1) / 4)))
        at |= {f"a{q}": F.min(F.when(F.col("upto") >= lo, F.col("v"))), f"b{q}": F.min(F.when(F.col("upto") >= lo + 1, F.col("v"))), f"s{q}": F.first(q * (F.col("n") + 1) / 4 - lo)}
        ends.append((F.col(f"a{q}") * (1 - F.col(f"s{q}")) + F.col(f"b{q}") * F.col(f"s{q}")).alias(f"q{q}"))
    return both.where("n > 1").groupBy("__by").agg(*[c.alias(name) for name, c in at.items()]).select(F.col("__by").alias(by), *ends)
