"""Embedding whitening: principal directions by the singular value decomposition of centred distributed rows.

The rows of the fit list stand in a distributed row matrix of Spark MLlib; its singular values, squared and divided by the
number of rows, are the variances along the right singular vectors. Total variance comes from exact whole-number
deviations, not from the decomposition. Sums and deviations are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Vectors may have so many lengths (each length is whitened alone) and dimensions (a matrix of dimensions by dimensions is on the driver).
MOST_LENGTHS, MOST_DIMENSIONS = 16, 4_096
#: Below this share of the largest variance a component counts as one without variance: rounding leaves as much.
LEAST_VARIANCE = 1e-12
#: Whole numbers of an entry, before `offset`, stay below this.
_LARGEST = 2.0**52
_COLUMNS = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vector: Column, scale: int) -> Column:
    """Whether a vector is there, with numbers in it that are all finite, and whole numbers that doubles hold exactly once scaled."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < _LARGEST))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def _centred(x: Column, whole: list[int], part: list[float]) -> Column:
    """x - S/n: the whole part of the mean is taken off exactly, the rest in doubles."""
    return F.zip_with(x, F.arrays_zip(F.array(*map(F.lit, whole)).alias("w"), F.array(*map(F.lit, part)).alias("p")), lambda a, m: (a - m["w"]).cast("double") - m["p"])


def _projected(x: pa.Array, whole: np.ndarray, part: np.ndarray, planes: np.ndarray) -> np.ndarray:
    rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
    return ((rows - whole).astype(float) - part) @ planes


def _gram(whole: np.ndarray, part: np.ndarray, planes: np.ndarray, mean: np.ndarray):
    """Sums over batches of whitened numbers and of their products, centred by `mean`: an array of sums, then products, a task."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = planes.shape[1]
        total = np.zeros(k + k * k)
        for batch in batches:
            w = _projected(batch.column(0), whole, part, planes) - mean
            total += np.concatenate([w.sum(0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(total), dtype=np.int32)), "value": pa.array(total)})

    return summed


def _rows(n: int, rest: np.ndarray, whole: np.ndarray, part: np.ndarray, planes: np.ndarray):
    """Column function: struct(deviation, whitened) of arrays of whole numbers."""

    @F.arrow_udf("deviation long, whitened array<double>")
    def of(x: pa.Array) -> pa.Array:
        k = planes.shape[1]
        if not len(x):
            return pa.StructArray.from_arrays([pa.array([], pa.int64()), pa.array([], pa.list_(pa.float64()))], names=["deviation", "whitened"])
        rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        off = rows - whole
        largest = n * int(np.abs(off).max()) + n
        if largest * largest * rows.shape[1] < 2**63:
            deviation = pa.array(((off * n - rest) ** 2).sum(1))
        else:
            sums = [sum((n * int(a) - int(r)) ** 2 for a, r in zip(row, rest, strict=True)) for row in off]
            deviation = pa.array([s if s < 2**63 else None for s in sums], pa.int64())
        white = (off.astype(float) - part) @ planes
        return pa.StructArray.from_arrays([deviation, pa.ListArray.from_arrays(np.arange(0, (len(x) + 1) * k, k, dtype=np.int32), pa.array(white.ravel()))], names=["deviation", "whitened"])

    return of


def _whitened(rows: DataFrame, dim: int, components: int) -> DataFrame:
    """The result for rows (vec_id, x) whose vectors all have `dim` entries."""
    if dim > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {dim} entries: at most {MOST_DIMENSIONS} are decomposed")
    fit = written(rows.select("x").distinct())
    wide = lambda i: F.sum(F.get("x", F.lit(i)).cast("decimal(20,0)"))
    n, *sums = fit.agg(F.count("*"), *[wide(i) for i in range(dim)]).first()
    sums = [int(s) for s in sums]
    whole, rest = [s // n for s in sums], [s % n for s in sums]
    part = [r / n for r in rest]
    centred = MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(_centred(F.col("x"), whole, part)).alias("v")), "v")
    # All `dim` singular values at once are found by dense algebra, to double precision; fewer would be iterated for.
    svd = RowMatrix(centred, n, dim).computeSVD(dim, computeU=False, rCond=0.0)
    variances = svd.s.toArray() ** 2 / n
    k = min(components, int((variances > LEAST_VARIANCE * variances.max(initial=0)).sum()))
    # The sum of (n * x - S)^2 over the fit list, exact unless it has more than 38 digits.
    off = F.zip_with("x", F.arrays_zip(F.array(*map(F.lit, whole)).alias("w"), F.array(*map(F.lit, rest)).alias("r")), lambda a, m: (a - m["w"]).cast("decimal(17,0)") * F.lit(n).cast("decimal(19,0)") - m["r"].cast("decimal(19,0)"))
    square = F.aggregate(off, F.lit(0).cast("double"), lambda t, d: t + d.cast("double") * d.cast("double"))
    exact = F.aggregate(off, F.lit(0).cast("decimal(38,0)"), lambda t, d: F.try_add(t, F.try_multiply(d, d).cast("decimal(38,0)")).cast("decimal(38,0)"))
    total = fit.select(F.when(F.count(exact) == n, F.try_sum(exact)).alias("exact"), F.sum(square).alias("near")).first() if k else None
    if not k:
        return rows.sparkSession.createDataFrame([], _SCHEMA)
    deviation = int(total["exact"]) if total["exact"] is not None else total["near"]
    trace = deviation / n**3 if isinstance(deviation, int) else float(deviation) / float(n) ** 3
    planes = svd.V.toArray()[:, :k] / np.sqrt(variances[:k])
    arrays = np.array(whole, np.int64), np.array(part)

    def gram(mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = fit.mapInArrow(_gram(*arrays, planes, mean), "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()  # k + k * k numbers
        flat = np.array([r["value"] for r in got]) / n
        return flat[:k], flat[k:].reshape(k, k)

    error = float(np.abs(gram(gram(np.zeros(k))[0])[1] - np.eye(k)).max())
    explained = F.array(*[F.lit(float(v / trace)) for v in variances[:k]])
    found = rows.select("vec_id", F.explode(F.array(_rows(n, np.array(rest, np.int64), *arrays, planes)("x"))).alias("r"))
    out = found.select("vec_id", "r.deviation", F.posexplode("r.whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, "at").alias("explained"), F.lit(error).alias("identity_error"))


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, component from 1, n, deviation, whitened, explained, identity_error) for each row and each of the first `components` principal components.

    Vectors become whole numbers x = floor(scale * entry) + offset. The fit list holds each distinct x once: n vectors with
    sums S by dimension. deviation: the exact sum of (n * x - S)^2, null beyond a long. whitened: x - S/n along the
    component, over the square root of its variance e. explained: e over the total variance. identity_error: how far the
    covariance of `whitened` over the fit list is from the identity, at most.
    Vectors that are null, empty, or hold null, non-finite or too large entries (2^52 once scaled) give no rows; nor do
    components without variance (below LEAST_VARIANCE of the largest), so none are left where all vectors are equal. Repeated rows and rows with a null key are
    each given. Vectors of each length are whitened alone, among their own. Other columns are left out.
    """
    plain = df.where(usable(F.col(vector), scale)).select(F.col(key).alias("vec_id"), F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale) + F.lit(offset).cast("long")).alias("x"))
    lengths = plain.groupBy(F.size("x").alias("dim")).count().limit(MOST_LENGTHS + 1).collect()
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    out = df.sparkSession.createDataFrame([], _SCHEMA) if not lengths else None
    for dim in sorted(r["dim"] for r in lengths):
        one = _whitened(plain.where(F.size("x") == dim), dim, components)
        out = one if out is None else out.unionByName(one)
    return out.select(*_COLUMNS)
