"""Embedding near-dedup: an exact metric range join of unit vectors, within equal labels.

Cosine c of unit vectors is the distance sqrt(2 - 2c), so near pairs lie within a radius. Pivots cut space into cells; each
vector is at home in the cell of its nearest pivot alone, and the vectors of a cell form blocks. Two blocks are compared
only if the triangle inequality lets them be near for every pivot (the distances of either from it lie within the radius of
one another), and of their vectors only those that it lets reach the other block. The blocks of a label are dealt into
parts; each two parts meet in one task, so a vector is sent as often as there are parts, however little the pivots tell
apart. Equal vectors are one representative with a count. No pair leaves a task: for each vector only the number of its
links, and a link to the smallest key that it reaches inside the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import connected_components, cut, written
from tessera.llm.topk_search import usable
from tessera.operators.graph import LINKS_AT_ONCE, local_stars

#: Vectors of one block of a cell, about.
BLOCK = 2_048
#: Pivots are one for so many representatives, between 1 and MAX_PIVOTS; they are sent to all tasks.
ROWS_PER_PIVOT, MAX_PIVOTS = 4_096, 256
#: Bytes of a part of a label's vectors; where that makes more than SIDES parts, there are SIDES, until they would be over MOST_BYTES.
PART_BYTES, SIDES, MOST_BYTES = 4_000_000, 12, 16_000_000
#: Room for rounding in bounds, which keep too much rather than too little: distances are held in single precision.
_SLACK = 1e-6


def _units(v: np.ndarray, length: np.ndarray) -> np.ndarray:
    return v.astype(np.float64) / length[:, None]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equally long lists of numbers as the rows of a matrix."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def _far(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * units @ pivots.T))


def _pivots_of(pivots: dict[int, np.ndarray], dim: int) -> np.ndarray:
    return pivots[dim] if dim in pivots else np.eye(1, dim)


def _at_home(pivots: dict[int, np.ndarray]):
    """Rows (v, length, dim, ...) with the number of their nearest pivot, BLOCK rows at a time."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            cell = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                for lo in range(0, len(rows), BLOCK):
                    some = pa.array(rows[lo : lo + BLOCK])
                    units = _units(_matrix(batch["v"].take(some)), batch["length"].take(some).to_numpy())
                    cell[rows[lo : lo + BLOCK]] = _far(units, _pivots_of(pivots, int(dim))).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return placed


def _local_roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id reachable inside two blocks, by rows of left ids and columns of right ids; `ids`: left ids, then right ids."""
    n, root = len(linked), ids.copy()
    while True:
        before = root.copy()
        right = np.where(linked, root[:n, None], np.iinfo(np.int64).max).min(0)
        root[n:] = np.minimum(root[n:], right)
        left = np.where(linked, root[None, n:], np.iinfo(np.int64).max).min(1)
        root[:n] = np.minimum(root[:n], left)
        if (before == root).all():
            return root


class _Side:
    """The rows of one part by their blocks: units in single precision, and distances from the pivots with their bounds."""

    def __init__(self, rows: pa.Table, pivots: np.ndarray) -> None:
        rows = rows.sort_by([("cell", "ascending"), ("block", "ascending")])
        self.ids, self.copies, self.length, cell, block = (rows[c].to_numpy() for c in ("id", "copies", "length", "cell", "block"))
        self.v = _matrix(rows["v"])
        ends = [0, *np.flatnonzero(np.diff(cell) | np.diff(block)) + 1, len(cell)]
        self.blocks = [slice(lo, hi) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
        self.rough, self.far = np.empty(self.v.shape, np.float32), np.empty((len(cell), len(pivots)), np.float32)
        for some in self.blocks:
            units = self.units(some)
            self.rough[some], self.far[some] = units, _far(units, pivots)
        self.low, self.high = (np.array([f(self.far[some], 0) for some in self.blocks]) for f in (np.min, np.max))
        self.links = np.zeros(len(cell), np.int64)

    def units(self, rows: slice | np.ndarray) -> np.ndarray:
        return _units(self.v[rows], self.length[rows])

    def near(self, block: int, low: np.ndarray, high: np.ndarray, radius: float) -> np.ndarray:
        """Rows of a block that may be within the radius of a block with these bounds."""
        far = self.far[self.blocks[block]]
        return np.flatnonzero(((far >= low - radius) & (far <= high + radius)).all(1)) + self.blocks[block].start


def _join(cosine: float, pivots: dict[int, np.ndarray]):
    radius = np.float32(math.sqrt(max(0.0, 2 - 2 * cosine)) + _SLACK)

    def joined(key: tuple, rows: pa.Table) -> pa.Table:
        dim, i, j = (int(key[n].as_py()) for n in (0, 2, 3))
        sides = {x: _Side(rows.filter(pa.array(rows["part"].to_numpy() == x)), _pivots_of(pivots, dim)) for x in np.unique(rows["part"].to_numpy())}
        stars, held = [], 0
        if i in sides and j in sides:
            left, right = sides[i], sides[j]
            least = np.float32(cosine - 1.2e-7 * (dim + 4))  # more than rounding may take off a product in single precision
            for p in range(len(left.blocks)):
                apart = np.maximum(right.low - left.high[p], left.low[p] - right.high).max(1)
                for q in np.flatnonzero(apart <= radius):
                    if i == j and q < p:
                        continue
                    a, b = left.near(p, right.low[q], right.high[q], radius), right.near(q, left.low[p], left.high[p], radius)
                    rough = left.rough[a] @ right.rough[b].T >= least
                    if i == j and p == q:
                        rough &= a[:, None] != b[None, :]
                    a, b = a[rough.any(1)], b[rough.any(0)]
                    linked = (left.units(a) @ right.units(b).T >= cosine) & (left.ids[a][:, None] != right.ids[b][None, :])
                    if not linked.any():
                        continue
                    left.links[a] += (linked @ right.copies[b].astype(float)).astype(np.int64)
                    if i != j or p != q:
                        right.links[b] += (left.copies[a].astype(float) @ linked).astype(np.int64)
                    some, other = linked.any(1), linked.any(0)
                    both = np.concatenate((left.ids[a[some]], right.ids[b[other]]))
                    root = _local_roots(linked[np.ix_(some, other)], both)
                    stars.append((both[both != root], root[both != root]))
                    held += len(both)
                    if held > LINKS_AT_ONCE:
                        stars, held = [local_stars(*map(np.concatenate, zip(*stars, strict=True)))], 0
        u, v = local_stars(*map(np.concatenate, zip(*stars, strict=True))) if stars else (np.zeros(0, np.int64),) * 2
        ids, links = (np.concatenate([getattr(side, name)[side.links > 0] for side in sides.values()]) for name in ("ids", "links"))
        return pa.table({"id": np.concatenate((ids, u)), "links": np.concatenate((links, np.zeros(len(u), np.int64))), "root": np.concatenate((ids, v))})

    return joined


def _pivots(reps: DataFrame) -> dict[int, np.ndarray]:
    """For each of the 16 most common lengths of vectors: the units of smallest hash. Other lengths have one pivot, the first axis. Bounded by 16 * MAX_PIVOTS vectors."""
    wanted = {r["dim"]: min(MAX_PIVOTS, max(1, math.ceil(r["count"] / ROWS_PER_PIVOT))) for r in reps.groupBy("dim").count().orderBy(F.desc("count")).limit(16).collect()}
    units = reps.withColumn("unit", F.transform("v", lambda x: x.cast("double") / F.col("length")))
    return {dim: np.array([r["unit"] for r in units.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(n).select("unit").collect()]) for dim, n in wanted.items()}


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """(key, n_links, component_id, kept) for every row: links join rows of equal, non-null label with cosine >= `cosine` in double precision.

    Vectors that are null, empty, zero or hold null or non-finite numbers, and rows with a null label or null key link with
    nothing: n_links 0, component_id their own key, kept true (where the key is null: null and false). Vectors of different
    lengths don't link. A key that several rows bear gives a row for each; those of equal vector link with one another, and all take
    part under the same key.
    """
    spark = df.sparkSession
    single = isinstance(df.schema[vector].dataType, T.ArrayType) and isinstance(df.schema[vector].dataType.elementType, T.FloatType)
    numbers = F.col(vector) if single else F.transform(F.col(vector), lambda x: x.cast("double"))  # single precision is sent as such
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & usable(F.col(vector)))
    rows = rows.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), numbers.alias("v")).withColumn("length", length).where("length > 0")
    # Equal numbers are one class; a vector that fills a third of all rows is summed up before the shuffle.
    classes = written(rows.groupBy("label", "v").agg(F.min("key").alias("id"), F.count("*").alias("copies"), F.first("length").alias("length")))
    reps = classes.select("id", "label", "copies", "length", F.size("v").alias("dim"), "v")
    pivots = _pivots(reps)
    if not pivots:
        return df.select(F.col(key), F.lit(0).cast("long").alias("n_links"), F.col(key).cast("long").alias("component_id"), F.col(key).isNotNull().alias("kept"))
    homes = written(reps.mapInArrow(_at_home(pivots), T.StructType([*reps.schema.fields, T.StructField("cell", T.IntegerType())])))
    group = ["dim", "label"]
    cells = homes.groupBy(*group, "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    held = F.count("*") * F.col("dim") * (4 if single else 8)
    parts = F.greatest(F.least(F.ceil(held / PART_BYTES), F.lit(SIDES)), F.ceil(held / MOST_BYTES)).cast("int").alias("parts")
    cells = cells.join(homes.groupBy(*group).agg(parts), group)
    dealt = homes.join(written(cells), [*group, "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("part", F.pmod(F.hash("cell", "block"), "parts"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = dealt.select(*group, "id", "copies", "length", "v", "cell", "block", "part", other)
    dealt = dealt.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other")
    met = written(dealt.groupBy(*group, "i", "j").applyInArrow(_join(cosine, pivots), "id long, links long, root long"))
    components = connected_components(met.select(F.col("id").alias("u"), F.col("root").alias("v")))
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    found = cut(reps.select("id", "copies").join(links, "id", "left").join(components, "id", "left").select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("c")))
    members = rows.join(classes.select("label", "v", "id"), ["label", "v"]).join(found, "id").select(F.col("key").alias("__key"), "n", "c")
    members = members.groupBy("__key").agg(F.max("n").alias("__n"), F.min("c").alias("__c"))
    out = df.join(members, F.col(key) == F.col("__key"), "left")
    component = F.coalesce("__c", F.col(key).cast("long"))
    return out.select(F.col(key), F.coalesce("__n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col(key) == component, F.lit(False)).alias("kept"))
