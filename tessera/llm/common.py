"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.graph import connected_components
from tessera.sources.tables import cut, new_path, read, shared_folder, written

__all__ = ["bucketed", "connected_components", "cut", "nullable", "read", "shared_folder", "slabs", "small_table", "unused", "written"]


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """`df` as a table in the shared folder, with the rows of a value of `column` in one of `buckets`: grouping by it needs no shuffle.

    The catalog forgets the table at once; its files stay until intermediates() ends.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", new_path(spark)).bucketBy(buckets, column).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of few rows from Arrow data: of a list Spark would make it by Python workers of their own, which then stay."""
    fields = T.StructType.fromDDL(schema).fields
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    made = spark.createDataFrame(pa.table({f.name: pa.array(c) for f, c in zip(fields, columns, strict=True)}))
    return made.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def unused(columns: list[str], *names: str) -> list[str]:
    """Names for columns that an operator adds for itself: each of `names`, lengthened until no column of the caller bears it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed everywhere, as Arrow data that Python makes has it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType))
    return kind


def slabs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges [lo, hi) whose sizes add up to `limit` at most; a larger single item is a range of its own."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)
