"""Connected components of links between ids, and decisions about the clusters that they form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import cut

#: Links that a task contracts at once; as many or fewer are finished in one task.
LINKS_AT_ONCE = 500_000
#: Tasks that the links of one hub are dealt to.
SALTS = 16


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links, every id that is not the smallest of its component, with the smallest."""
    ids, number = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = number[: len(u)], number[len(u) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(ids)))
    return ids[below], ids[root[below]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of at most about LINKS_AT_ONCE at a time, replaced by links to the smallest id that these reach."""
    held, rows, schema = [], 0, None
    for batch in batches:
        schema = batch.schema
        held.append(batch)
        rows += batch.num_rows
        if rows >= LINKS_AT_ONCE:
            yield _stars_of(held, schema)
            held, rows = [], 0
    if held:
        yield _stars_of(held, schema)


def _stars_of(held: list[pa.RecordBatch], schema: pa.Schema) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    u, v = local_stars(table["u"].to_numpy(), table["v"].to_numpy())
    return pa.RecordBatch.from_arrays([pa.array(u, schema.field("u").type), pa.array(v, schema.field("v").type)], names=["u", "v"])


def _salt(of: str) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(SALTS)).cast("int")


def _salted(df: DataFrame) -> DataFrame:
    """Every row once for each salt, so that the rows that it is joined with need not meet in one task."""
    return df.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links between ids -> (id, component): the smallest id reachable, for every id that a link names.

    Each task first contracts the links that it holds, so that a large cluster leaves it as one link for each id. Few
    links left (LINKS_AT_ONCE) are finished by one task; else passes of alternating large and small stars replace links by
    links to the smallest neighbour, with partial minima before the shuffle and the links of a hub dealt over SALTS tasks.
    Self-links and repeated links don't matter; rows with a null end are left out.
    """
    kind = edges.schema["u"].dataType.simpleString()
    contract = lambda df: df.mapInArrow(_contracted, f"u {kind}, v {kind}")
    # The shuffle also keeps the task that contracts apart from a Python function that made the links.
    e = cut(contract(edges.select("u", "v").where("u <> v").distinct()))
    state = None
    while True:
        count, check = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if count <= LINKS_AT_ONCE:
            e = cut(contract(e.coalesce(1)))
            break
        if (count, check) == state:
            break
        state = (count, check)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        centers = _salted(e.select("v").distinct().join(low.withColumnRenamed("u", "v"), "v").where("m < v"))
        large = e.withColumn("salt", _salt("u")).join(centers, ["v", "salt"], "left").select("u", F.coalesce("m", "v").alias("v")).where("u <> v")
        large = contract(large).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x"))
        small = large.withColumn("salt", _salt("v")).join(_salted(low.where("m < x")), ["u", "salt"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(contract(small.unionByName(low.select("u", F.col("m").alias("v")))).distinct())
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("id")))


def cluster_decisions(items: DataFrame, links: DataFrame) -> DataFrame:
    """items (id, label, content) and links (u, v) -> (cluster, id, decision, reason) of every item in a cluster of two or more.

    Labels that disagree drop the whole cluster; else the smallest id stays and the others go, as identical copies where
    all contents are equal, else as near copies.
    """
    members = items.join(connected_components(links), "id")
    facts = members.groupBy("component").agg(F.count_distinct("label").alias("labels"), F.count_distinct("content").alias("contents"))
    df = members.join(facts, "component")
    apart, kept = F.col("labels") > 1, F.col("id") == F.col("component")
    reason = F.when(apart, "conflicting_labels").when(kept, "kept_one_of_cluster").when(F.col("contents") == 1, "identical_copy").otherwise("near_copy")
    return df.select(F.col("component").alias("cluster"), "id", F.when(kept & ~apart, "keep").otherwise("drop").alias("decision"), reason.alias("reason"))


def split_groups(owners: DataFrame, links: DataFrame) -> DataFrame:
    """owners (id) and links (u, v) between them -> (id, split_group): G_ and the smallest owner that links reach."""
    found = connected_components(links)
    return owners.join(found, "id", "left").select("id", F.concat(F.lit("G_"), F.coalesce("component", "id").cast("string")).alias("split_group"))


def first_of_each(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """Of rows with equal `key`, the first by `order`: exact dedup in which the first source wins."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
