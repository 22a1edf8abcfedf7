"""Language ID by hierarchy: the language family first, then one-versus-one linear support vector machines within it.

Features are the shares of hashed character n-grams among all n-grams of a text's words, so every margin is a sum over
the words divided by their number of n-grams. Each family has a machine of its own against all others; each pair of
languages of a family has one machine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.chargrams import WordSums, gram_counts, text_slabs
from tessera.llm.common import small_table, unused, written
from tessera.llm.linear import fit_linear, flattened

#: Families of languages by ISO 639-1 code; a language that is not named is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
#: The machines are fitted on so many texts of each language at most: those of smallest hash of key and text.
MAX_TEXTS = 2_000
#: With more languages than this, the machine of a family takes evenly fewer texts of each language outside it, one of every language at least, so that its sample stays bounded.
MANY_LANGUAGES = 16
#: Languages that are learned: those with most texts.
MOST_LANGUAGES = 1_000
#: Tasks of one step of a fit.
PARTS = 12
SIZES, BITS, PENALTY, STEPS = (1, 2, 3), 14, 1e-3, 80
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def _words(text: str | None) -> list[str]:
    if not text or not any(c.isalpha() for c in text):
        return []
    return _WORD.findall(text.lower())


def _features(texts: pd.Series) -> pd.DataFrame:
    counts = [gram_counts(_words(t), SIZES, BITS) for t in texts]
    codes = [np.flatnonzero(n) for n in counts]
    return pd.DataFrame({"codes": [c.astype(np.int32) for c in codes], "counts": [n[c].astype(np.int32) for n, c in zip(counts, codes, strict=True)]})


def _machine(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One machine from its bounded sample: a row for each weight that is not zero, and one for the intercept (code -1)."""
    numbers, codes = flattened(rows["codes"].to_list())
    counts = flattened(rows["counts"].to_list())[1]
    share = 100 * counts / np.bincount(numbers, counts, len(rows))[numbers]
    w, intercept = fit_linear(numbers, codes.astype(np.int64), share, rows["side"].to_numpy(float), 1 << BITS, "hinge", PENALTY, STEPS, 0.01)
    used = np.flatnonzero(w)
    return pd.DataFrame({"machine": np.int32(key[0]), "code": np.append(used, -1).astype(np.int32), "weight": np.append(100 * w[used], intercept)})


@dataclass(frozen=True)
class Model:
    """A column of `weights` and an intercept for each family, in order, then for each of `pairs` (the first language is on the positive side)."""

    families: tuple[str, ...]
    languages: dict[str, tuple[str, ...]]
    pairs: tuple[tuple[str, str], ...]
    weights: np.ndarray
    intercepts: np.ndarray


def bounded_sample(rows: DataFrame, max_texts: int, most_languages: int) -> DataFrame:
    """Of rows (lang, text, h) at most `max_texts` of each language, those of smallest h, with their place `r` in it (from 1); one of each at least.

    A language's rows are thinned by h first; where many rows share an h, which thinning keeps or drops together, the
    window's limit, which Spark applies before it shuffles, takes as many as there is room for.
    """
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).orderBy(F.desc("n"), "lang").limit(most_languages)
    share = lambda h: F.pmod(h, F.lit(1 << 30)) / (1 << 30)
    order = Window.partitionBy("lang").orderBy("place", "h", "text")
    kept = rows.join(F.broadcast(counts), "lang").where((share(F.col("h")) < 2 * max_texts / F.col("n")) | (F.col("h") == F.col("least")))  # counts: most_languages rows
    return kept.withColumn("place", share(F.col("h"))).withColumn("r", F.row_number().over(order)).where(F.col("r") <= max_texts).select("lang", "text", "h", "r")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_texts: int = MAX_TEXTS, many_languages: int = MANY_LANGUAGES, most_languages: int = MOST_LANGUAGES) -> Model | None:
    """Learn every language (the `most_languages` with most texts) from the rows whose language is not null and whose text has a letter; None if there is no such row."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key, text).alias("h"))
    spark = docs.sparkSession
    sample = bounded_sample(rows, max_texts, most_languages).repartition(PARTS, "h", "r")
    sample = written(sample.select("lang", "r", F.pandas_udf(_features, "codes array<int>, counts array<int>")("text").alias("x")).select("lang", "r", "x.*"))
    found = sorted(r["lang"] for r in sample.select("lang").distinct().collect())  # most_languages rows
    if not found:
        return None
    family = {x: FAMILY_OF.get(x, x) for x in found}
    families = tuple(sorted(set(family.values())))
    languages = {f: tuple(x for x in found if family[x] == f) for f in families}
    pairs = tuple(p for f in families for p in combinations(languages[f], 2))
    n = len(families)
    weights, intercepts = np.zeros((1 << BITS, n + len(pairs))), np.zeros(n + len(pairs))
    if len(found) == 1:
        return Model(families, languages, pairs, weights, intercepts + 1)
    # Of two families the second is the first one's plane, seen from the other side.
    few = max_texts if len(found) <= many_languages else max(1, many_languages * max_texts // len(found))
    sides = [(k, x, 1, max_texts) if family[x] == f else (k, x, -1, few) for k, f in enumerate(families) if n > 2 or n == 2 and k == 0 for x in found]
    sides += [(n + k, x, side, max_texts) for k, pair in enumerate(pairs) for x, side in zip(pair, (1, -1), strict=True)]
    sides = F.broadcast(small_table(spark, sides, "machine int, lang string, side int, most int"))  # families times languages rows, and the pairs
    got = sample.join(sides, "lang").where("r <= most").select("machine", "side", "codes", "counts").groupBy("machine").applyInPandas(_machine, "machine int, code int, weight double").toPandas()
    for machine, code, weight in zip(got["machine"], got["code"], got["weight"], strict=True):
        if code < 0:
            intercepts[machine] = weight
        else:
            weights[code, machine] = weight
    if n == 2:
        weights[:, 1], intercepts[1] = -weights[:, 0], -intercepts[0]
    if n == 1:
        intercepts[0] = 1.0
    return Model(families, languages, pairs, weights, intercepts)


def _decide(model: Model, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Best family; then the language of that family with most won pairs, of equal ones the one with the larger sum of margins, then the first."""
    n = len(model.families)
    sure = lambda m: 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
    best = margins[:, :n].argmax(1)
    names, score = [""] * len(margins), sure(margins[np.arange(len(margins)), best])
    for f, family in enumerate(model.families):
        rows, own = np.flatnonzero(best == f), model.languages[family]
        if not len(rows):
            continue
        wins, total = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
        least = np.full((len(rows), len(own)), np.inf)
        for p, (a, b) in enumerate(model.pairs):
            if a in own:
                m = margins[rows, n + p]
                for at, side in ((own.index(a), m), (own.index(b), -m)):
                    wins[:, at] += side > 0
                    total[:, at] += side
                    least[:, at] = np.minimum(least[:, at], side)
        pick = np.lexsort((-np.arange(len(own))[None, :] * np.ones_like(wins), total, wins), axis=1)[:, -1] if len(own) > 1 else np.zeros(len(rows), int)
        for row, k in zip(rows.tolist(), pick.tolist(), strict=True):
            names[row] = own[k]
        if len(own) > 1:
            score[rows] *= sure(least[np.arange(len(rows)), pick])
    return names, np.round(score, 6)


def predict(text: Column, model: Model | None) -> Column:
    """struct(lang_pred, score): `und` and 0 for texts that are null or have no letter, or if nothing was learned."""

    @F.arrow_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        columns = np.concatenate((model.weights, np.ones((1 << BITS, 1))), 1) if model else None  # the last counts n-grams
        sums = WordSums(columns, SIZES, BITS) if model else None
        for texts in batches:
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for lo, own in text_slabs(texts) if model else ():
                words = [_words(t) for t in own]
                rows = [lo + i for i, w in enumerate(words) if w]
                if rows:
                    total = sums.of([w for w in words if w])
                    names[rows], scores[rows] = _decide(model, total[:, :-1] / total[:, -1:] + model.intercepts)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], names=["lang_pred", "score"])

    return predicted(text)


def held_out(key: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the key as text leaves `fold`; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_texts: int = MAX_TEXTS, many_languages: int = MANY_LANGUAGES, most_languages: int = MOST_LANGUAGES) -> DataFrame:
    """Add held_out (boolean), lang_pred (string) and score (double) for each whole text; rows held out teach nothing.

    A machine learns from `max_texts` texts of each language of its family at most, and from `many_languages` times
    `max_texts` others, whatever the input. Null keys are not held out. Null texts and texts without a letter are `und` with
    score 0; long texts are read whole. Repeated rows are judged each, and each teaches while there is room. An empty table
    gives no rows. Columns of these names that `docs` has already are replaced.
    """
    model = fit(docs.where(~held_out(F.col(key))), text, lang, key, max_texts, many_languages, most_languages)
    keep = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    (own,) = unused([*keep, "held_out"], "told")
    out = docs.select(*keep, held_out(F.col(key)).alias("held_out"), predict(F.col(text), model).alias(own))
    return out.select(*keep, "held_out", f"{own}.lang_pred", f"{own}.score")
