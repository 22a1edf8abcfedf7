"""Toxicity: a linear classifier on character n-grams, each scaled by its naive Bayes log-count ratio.

A feature tells whether some word of a text holds the n-gram. The ratios come from the labelled texts (how many of either
class hold it), the weights from a logistic regression on the scaled features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.chargrams import TextSums, gram_counts, text_slabs
from tessera.llm.common import written
from tessera.llm.linear import fit_linear, flattened

#: The classifier is fitted on so many labelled rows at most: those of smallest hash.
MAX_ROWS = 10_000
#: Tasks of one step of the fit.
PARTS = 12
SIZES, BITS, SMOOTHING, MIN_TEXTS, MIN_RATIO, PENALTY, STEPS = (3, 4, 5), 18, 1.0, 3, 0.5, 1e-2, 80


@dataclass(frozen=True)
class Model:
    """Weights of the buckets of n-grams, the ratios multiplied in."""

    weights: np.ndarray
    intercept: float


def _words(text: str | None) -> list[str]:
    return list(set((text or "").lower().split()))


def _codes(texts: pd.Series) -> pd.Series:
    return pd.Series([np.flatnonzero(gram_counts(_words(t), SIZES, BITS)).astype(np.int32) for t in texts], dtype=object)


def _strong(ratio: np.ndarray):
    kept = ratio != 0

    @F.pandas_udf("array<int>")
    def strong(codes: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(c)[kept[np.asarray(c)]] for c in codes], dtype=object)

    return strong


def _weights(ratio: np.ndarray):
    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        numbers, codes = flattened(rows["codes"].to_list())
        used = np.flatnonzero(ratio)
        place = np.zeros(len(ratio), np.int64)
        place[used] = np.arange(len(used))
        codes = codes.astype(np.int64)
        w, intercept = fit_linear(numbers, place[codes], ratio[codes], 2 * rows["y"].to_numpy() - 1, len(used), "logistic", PENALTY, STEPS, 0.01)
        return pd.DataFrame({"code": np.append(used, -1).astype(np.int32), "weight": np.append(w * ratio[used], intercept)})

    return fitted


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Learn from the texts that `labels` marks 1 or 0; rows with a null label, key or text teach nothing, and a key marked both ways counts as 1.

    N-grams in fewer than MIN_TEXTS texts or with a ratio below MIN_RATIO either way are left out. With one class alone, the
    model gives its share (smoothed) to every text.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("__key")).agg(F.max(label).alias("y"))
    sample = marks.orderBy(F.xxhash64("__key"), "__key").limit(max_rows)
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    found = texts.join(F.broadcast(sample), "__key").orderBy(F.xxhash64("__key"), F.xxhash64("__text")).limit(2 * max_rows)  # sample: max_rows rows of two numbers; rows that repeat a key count up to as many again
    rows = written(found.repartition(PARTS, "__key", "__text").select("y", F.pandas_udf(_codes, "array<int>")("__text").alias("codes")))
    size = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # two rows
    ones, zeros = size.get(1, 0), size.get(0, 0)
    if not ones or not zeros:
        return Model(np.zeros(1 << BITS), float(np.log((ones + SMOOTHING) / (zeros + SMOOTHING))))
    hold = rows.select("y", F.explode("codes").alias("code")).groupBy("code").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    share = lambda n, all_: (F.col(n) + SMOOTHING) / (all_ + 2 * SMOOTHING)
    hold = hold.where(F.col("p") + F.col("q") >= MIN_TEXTS).select("code", F.log(share("p", ones) / share("q", zeros)).alias("r")).where(F.abs("r") >= MIN_RATIO)
    ratio = np.zeros(1 << BITS)
    kept = hold.toPandas()  # a row for each bucket at most
    ratio[kept["code"].to_numpy(np.int64)] = kept["r"].to_numpy()
    strong = _strong(ratio)
    weights = rows.select("y", strong("codes").alias("codes")).groupBy().applyInPandas(_weights(ratio), "code int, weight double").toPandas()  # the bounded sample in one task
    out = np.zeros(1 << BITS)
    at = weights["code"].to_numpy(np.int64)
    out[at[at >= 0]] = weights["weight"].to_numpy()[at >= 0]
    return Model(out, float(weights["weight"][at < 0].sum()))


def score(text: Column, model: Model) -> Column:
    """Probability (0 to 1) that the whole text is toxic; null and empty texts get that of a text without words."""
    weights, intercept = model.weights.astype(np.float32), model.intercept

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sums = TextSums(weights, SIZES, BITS)
        for texts in batches:
            parts = [sums.of([_words(t) for t in own]) for _, own in text_slabs(texts)]
            margins = np.concatenate([*parts, np.zeros(0)]) + intercept
            yield pa.array(np.round(1 / (1 + np.exp(-np.clip(margins, -30, 30))), 6))

    return scored(text)


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the key as text leaves `fold`; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """Add held_out (boolean), score (double) and predicted (1 from `threshold` on, else 0); labels of keys held out teach nothing.

    Repeated rows are scored each. Columns of these names that `docs` has already are replaced.
    """
    model = fit(docs.select(key, text), labels.where(~held_out(F.col(key))), key, text, max_rows=max_rows)
    keep = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    out = docs.select(*keep, held_out(F.col(key)).alias("held_out"), score(F.col(text), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
