"""Joins that reconcile two tables: what is left out, what must match, what differs, and choices among several sources.

Keys are compared null-safe, so a null key is a key. Rows that repeat a key are joined each, unless the operator says otherwise.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.values import holds

#: Rows of a block of the comparison of pictures.
BLOCK_ROWS = 2_048


def _keyed(df: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    return df.select(*[F.col(k).alias(f"__{k}") for k in keys], *more)


def _same(keys: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])


def without(rows: DataFrame, drops: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys `drops` doesn't hold."""
    return rows.join(_keyed(drops, keys), _same(keys), "left_anti")


def only(rows: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys `kept` holds; of items and held-out cases, the leaks."""
    return rows.join(_keyed(kept, keys), _same(keys), "left_semi")


def totally_joined(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with the one row of `facts` of its keys; a row without facts, or with two, stops the step, whatever of the result is read."""
    more = [c for c in facts.columns if c not in keys]
    one = facts.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count("*").alias("__n"), F.first(F.struct(F.lit(1).alias("__one"), *more)).alias("__facts"))
    told = F.concat(F.lit("not one row for "), F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]))
    sure = rows.join(one, _same(keys), "left").where(holds(F.col("__n") == 1, told))
    return sure.select(*rows.columns, *[F.col("__facts")[c].alias(c) for c in more])


def matched(rows: DataFrame, facts: DataFrame, keys: list[str], found: str = "found") -> DataFrame:
    """Every row with the facts of its keys and whether there are any: unmatched rows stay, marked, to be listed apart."""
    more = [c for c in facts.columns if c not in keys]
    joined = rows.join(_keyed(facts, keys, *map(F.col, more), F.lit(True).alias("__found")), _same(keys), "left")
    return joined.select(*rows.columns, *more, F.coalesce("__found", F.lit(False)).alias(found))


def join_problems(a: DataFrame, b: DataFrame, keys: list[str], equal: list[str] = (), subset: bool = False) -> DataFrame:
    """(keys, problem): keys of the first table alone, of the second alone (not with `subset`), twice in one, or with other values of a column of `equal`."""
    side = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(f"__n{n}"), *[F.first(c).alias(f"__{c}{n}") for c in equal])
    second = side(b, 2)
    both = side(a, 1).join(second.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in second.columns if c not in keys]), _same(keys), "full_outer")
    rules = [F.when(F.col("__n2").isNull(), "only in the first"), F.when(F.col("__n1") > 1, "twice in the first"), F.when(F.col("__n2") > 1, "twice in the second")]
    rules += [] if subset else [F.when(F.col("__n1").isNull(), "only in the second")]
    there = F.col("__n1").isNotNull() & F.col("__n2").isNotNull()
    rules += [F.when(there & ~F.col(f"__{c}1").eqNullSafe(F.col(f"__{c}2")), f"another {c}") for c in equal]
    return both.select(*[F.coalesce(k, f"__{k}").alias(k) for k in keys], F.explode(F.array_compact(F.array(*rules))).alias("problem"))


def union_tagged(sources: dict[str, DataFrame], tag: str = "origin") -> DataFrame:
    """The rows of several tables of equal columns with the name of their table."""
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for name, df in sources.items()])


def first_per_class(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """Of each class the first `most` rows by `order`, which should tell rows apart."""
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__place") <= most).drop("__place")


def latest_versions(listing: DataFrame, path: str = "path") -> DataFrame:
    """(name, version, path): of each listed name the path of highest version, from paths `name.version[/...]`; other paths are left out."""
    parts = listing.select(F.regexp_extract(path, r"^([^/]*)\.(\d{1,9})(?:/|$)", 1).alias("name"), F.regexp_extract(path, r"^[^/]*\.(\d{1,9})(?:/|$)", 1).try_cast("int").alias("version"), F.col(path).alias("path"))
    return parts.where("version IS NOT NULL").groupBy("name").agg(F.max("version").alias("version"), F.max_by("path", F.struct("version", "path")).alias("path"))


def recomputed(rows: DataFrame, cache: DataFrame, keys: list[str], compute) -> DataFrame:
    """The results of all rows: those that `cache` (keys, results) holds for equal keys, and those of `compute` for the others."""
    known = totally_joined(only(rows, cache, keys), cache, keys)
    return known.unionByName(compute(without(rows, cache, keys)).select(*known.columns))


def finished_runs(runs: DataFrame, by: list[str], run: str, status: str = "status", done: str = "complete") -> DataFrame:
    """(by, run, problem): of each group its only finished run; with two or more the run is null and problem tells how many; groups without one are left out."""
    ended = runs.where(F.col(status) == done).groupBy(*by).agg(F.count("*").alias("__n"), F.max(run).alias("__run"))
    several = F.when(F.col("__n") > 1, F.concat(F.col("__n").cast("string"), F.lit(" finished runs")))
    return ended.select(*by, F.when(F.col("__n") == 1, F.col("__run")).alias(run), several.alias("problem"))


def same_pictures(a: DataFrame, b: DataFrame, key: str, most_bits: int = 16, most_colour: float = 5.0, most_shape: float = 0.02) -> DataFrame:
    """(a, b, bits): pictures (key, code, colour, width, height) of two tables that look the same: few different bits, near mean colours and shapes.

    The tables meet in blocks of BLOCK_ROWS rows as packed arrays: a task counts the different bits of all pairs of two
    blocks at once, and looks at the colours and shapes of those alone whose bits are near. With one table given twice, each
    pair comes in both orders and a picture meets itself. Pictures with a null among these columns meet none.
    """
    columns, kind = ["code", "colour", "width", "height"], dict(a.dtypes)[key]
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    a, b = a.where(whole), b.where(whole)
    m, n = (max(1, -(-df.count() // BLOCK_ROWS)) for df in (a, b))

    def deal(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return df.select(F.col(key).alias("key"), *columns, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    def met(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "bits": []})
        codes = lambda df: df["code"].to_numpy(np.int64).view(np.uint64)
        bits = np.bitwise_count(codes(x)[:, None] ^ codes(y)[None, :])
        i, j = np.nonzero(bits <= most_bits)
        size = lambda df, c, at: df[c].to_numpy(float)[at]
        other = size(y, "width", j) * size(x, "height", i)
        near = np.abs(size(x, "width", i) * size(y, "height", j) - other) <= most_shape * other
        i, j = i[near], j[near]
        colours = lambda df, at: np.array(df["colour"].to_list(), float).reshape(len(df), -1)[at]
        near = np.sqrt(((colours(x, i) - colours(y, j)) ** 2).mean(1)) <= most_colour
        i, j = i[near], j[near]
        return pd.DataFrame({"a": x["key"].to_numpy()[i], "b": y["key"].to_numpy()[j], "bits": bits[i, j].astype(np.int32)})

    return deal(a, "i", m, "j", n).groupBy("i", "j").cogroup(deal(b, "j", n, "i", m).groupBy("i", "j")).applyInPandas(met, f"a {kind}, b {kind}, bits int")


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, item): the rows that each check of a suite returns (its columns as text, joined by blanks); empty if all hold."""
    told = lambda df: F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in df.columns])
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("check"), told(df).alias("item")) for name, df in checks.items()])


def wrong_formats(cards: DataFrame, key: str, column: str, expected: str) -> DataFrame:
    """(key, found): runs whose answers have another format than `expected`; none given counts as another."""
    return cards.where(~F.col(column).eqNullSafe(F.lit(expected))).select(key, F.coalesce(column, F.lit("none")).alias("found"))


def picture_faults(made: DataFrame, key: str, least_psnr: float = 30.0, most_bytes: int = 4_000_000) -> DataFrame:
    """made (key, psnr, own_distance, nearest_other, bytes) -> (key, fault): made pictures that are too far from their originals, nearer to another, or too large."""
    rules = {"not like its original": F.col("psnr") < least_psnr, "another picture is as near": F.col("own_distance") >= F.col("nearest_other"), "too large": F.col("bytes") > most_bytes}
    return made.select(key, F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))).alias("fault"))
