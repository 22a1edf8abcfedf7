"""Exact top-k search by inner product: columnar branch and bound.

Candidates stand in vertical layout, one column of numbers for each dimension. A query adds up its scores dimension block
by dimension block; after each block, candidates whose score so far plus the largest that the remaining dimensions can
add (the product of the remaining lengths) falls below the k-th best known score are dropped, and the survivors are moved
together. Blocks of queries meet blocks of candidates in tasks of bounded size; the best k of each pair of blocks, with
ties, are merged by a window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Rows of a block of candidates and of queries.
ROWS, QUERIES = 16_384, 1_024
#: Dimensions that are added up before candidates are dropped.
STEP = 8
#: Sums of products below this are exact in doubles.
_EXACT = 2**52
_LONG = 2**63 - 1


def usable(vector: Column) -> Column:
    """Whether a vector is there, with numbers in it that are all finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def _search(query: np.ndarray, columns: np.ndarray, left: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best, and of all that tie with the k-th; `left`: of each step, the lengths of what remains of the candidates."""
    dims, n = columns.shape
    own = np.sqrt(np.append(np.cumsum((query.astype(float) ** 2)[::-1])[::-1], 0.0))
    slack = 1e-6 + 1e-12 * own[0] * np.sqrt((columns**2).sum(0).max())
    seed = query @ columns[:, : 4 * k]
    least = np.partition(seed, -k)[-k] if len(seed) >= k else -np.inf
    place, part = np.arange(n), np.zeros(n)
    for number, lo in enumerate(range(0, dims, STEP)):
        hi = min(dims, lo + STEP)
        block = columns[lo:hi] if len(place) == n else columns[lo:hi, place]
        part = part + query[lo:hi] @ block
        rest = own[hi] * left[number, place]
        if len(part) >= k:
            least = max(least, np.partition(part - rest, -k)[-k])
        alive = part + rest >= least - slack
        if not alive.all():
            place, part = place[alive], part[alive]
    return place, part


def _exact_scores(query: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Beyond what doubles hold exactly: whole numbers of any size, held within a long at the end."""
    scores = query.astype(object) @ columns.astype(object)
    return np.array([max(-_LONG - 1, min(_LONG, int(s))) for s in scores], np.int64)


def _blocks(k: int):
    def met(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"asked": [], "query_id": [], "vec_id": [], "row": [], "score": []}
        if len(queries) and len(rows):
            ids, number, columns = rows["vec_id"].to_numpy(), rows["row"].to_numpy(), np.ascontiguousarray(np.stack(rows["codes"].to_list()).T.astype(float))
            ends = [min(len(columns), lo + STEP) for lo in range(0, len(columns), STEP)]
            left = np.stack([np.sqrt((columns[hi:] ** 2).sum(0)) for hi in ends])
            for asked, query_id, codes in zip(queries["row"].to_list(), queries["vec_id"].to_list(), queries["codes"].to_list(), strict=True):
                query = np.asarray(codes, float)
                if np.abs(query).max() * np.abs(columns).max() * len(query) < _EXACT:
                    place, score = _search(query, columns, left, k + 1)
                    score = score.astype(np.int64)
                else:
                    place, score = np.arange(len(ids)), _exact_scores(query, columns)
                other = number[place] != asked
                place, score = place[other], score[other]
                best = np.lexsort((number[place], ids[place], -score))[:k]
                for name, values in (("asked", np.full(len(best), asked)), ("query_id", np.full(len(best), query_id)), ("vec_id", ids[place[best]]), ("row", number[place[best]]), ("score", score[best])):
                    out[name].append(values)
        return pd.DataFrame({c: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for c, v in out.items()})

    return met


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, scale: int = 64, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k largest inner products of floor(scale * vector) of every query with all other rows, ties to the smaller key.

    Vectors that are null, empty or hold null or non-finite numbers take no part, nor do rows with a null key. Vectors are
    compared with those of equal length. Rows that repeat a key, or a key and its numbers, are queries and candidates of
    their own: each finds the others, and query_id may then have several ranks 1. Scores beyond a long are held at its ends.
    All rows are searched exactly. Other columns are left out; an empty table gives no rows.
    """
    codes = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    plain = df.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("vec_id"), codes.alias("codes"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # A row is known by its number; it is written with it, so that it keeps it.
    plain = written(plain.withColumn("dim", F.size("codes")).withColumn("row", F.monotonically_increasing_id()))
    n, asking = plain.agg(F.count("*"), F.count_if("asks")).first()
    if not asking:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts, blocks = -(-n // rows), -(-asking // queries)
    dealt = lambda m, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = plain.where("asks").select("row", "vec_id", "codes", "dim", dealt(blocks, 1).alias("block"), every(parts).alias("part"))
    right = plain.select("row", "vec_id", "codes", "dim", dealt(parts, 2).alias("part"), every(blocks).alias("block"))
    group = ["dim", "part", "block"]
    near = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(_blocks(k), "asked long, query_id long, vec_id long, row long, score long")
    # A task's best go to a share of the query's first, so that no window holds all tasks of a large table.
    order = [F.desc("score"), F.asc("vec_id"), F.asc("row")]
    shares = max(1, parts // 64)
    if shares > 1:
        share = Window.partitionBy("asked", F.pmod(F.xxhash64("row"), F.lit(shares))).orderBy(*order)
        near = near.withColumn("__r", F.row_number().over(share)).where(F.col("__r") <= k).drop("__r")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
