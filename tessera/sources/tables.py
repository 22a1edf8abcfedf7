"""Reading tables, and folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_csv(spark: SparkSession, path: str, columns: list[str], exact: bool = True) -> DataFrame:
    """A CSV table whose cells all are text; its header must be `columns` (or hold them, if not `exact`). A byte-order mark is dropped."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.removeprefix("\ufeff") for c in df.columns])
    if (df.columns != columns) if exact else not set(columns) <= set(df.columns):
        raise ValueError(f"{path}: the header is {df.columns}, not {columns}")
    return df


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line. The last line of a file is left out if it is cut off (broken, and no line end after it); any other broken line is an error.

    Blank lines are left out. Only the few broken lines are looked at again, each with the end of its file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    parsed = lines.withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("whole", F.coalesce(F.json_array_length(F.concat(F.lit("["), "value", F.lit("]"))) == 1, F.lit(False)))
    broken = parsed.where(~F.col("whole") & (F.btrim("value") != "")).select("value", "file").limit(10_001).collect()
    files = {r["file"] for r in broken}
    if len(broken) > 10_000 or len(files) < len(broken) or any(not _cut_off(spark, r["file"], r["value"]) for r in broken):
        raise ValueError(f"{path}: a line before the last is not JSON")
    return parsed.where("whole").select("row.*")


def _cut_off(spark: SparkSession, file: str, line: str) -> bool:
    """Whether a file ends with this line, without a line end: only as many bytes as the line has are read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(file)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    size, want = fs.getFileStatus(place).getLen(), len(line.encode())
    stream = fs.open(place)
    try:
        start = max(0, size - want - 1)
        stream.seek(start)
        tail = bytes(b & 0xFF for b in stream.readNBytes(size - start))
    finally:
        stream.close()
    return tail == line.encode() or tail[1:] == line.encode() and tail[:1] in (b"\n", b"\r")


def write_partitioned(df: DataFrame, path: str, *columns: str) -> None:
    """Parquet by folders of `columns`; only the folders that `df` has rows for are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


#: Paths that new_path() gave in this process, for intermediates() to delete.
_MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir.

    Only where that is unset on a local master, as in tests, a folder is made; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.getCheckpointDir() and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return named or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and read from the shared folder; for frames of few bytes. Spark deletes the files with the frame if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder for a table in parquet that intermediates() deletes."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    _MADE.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """Like cut(), but as a compressed table of columns, which stays until intermediates() ends."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """On leaving, deletes the tables that written() and new_path() made inside: for drivers that run many operators and have saved their results by then."""
    before = len(_MADE)
    try:
        yield
    finally:
        deleted(spark, *_MADE[before:])
        del _MADE[before:]


def placed(df: DataFrame, *keys: Column, place: str = "place") -> DataFrame:
    """`df` with the place (from 1) of every row in the order of `keys`, which should tell all rows apart.

    Rows are dealt by ranges of the keys and numbered within each range; a range starts after the rows of those before it.
    """
    names = [f"__key{i}" for i in range(len(keys))]
    dealt = df.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)]).repartitionByRange(*names)
    dealt = written(dealt.withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))  # a row for each range
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    number = F.row_number().over(Window.partitionBy("__range").orderBy(*names))
    return dealt.join(F.broadcast(starts), "__range").withColumn(place, F.col("__start") + number).drop("__range", "__start", *names)


def running(df: DataFrame, by: list[str], order: list[str], weight: str, out: str) -> DataFrame:
    """`df` with the sum of `weight` over the rows of equal `by` up to each row, in the order of `order`, which should tell rows of a group apart.

    Rows are dealt by ranges of `by` and `order`, so a group that holds most rows is in many tasks; each range adds the sums of those before it.
    """
    dealt = written(df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "__range").agg(F.sum(weight).alias("__sum"))  # a row for each range, and for each group
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("__range").alias("__r"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    own = F.sum(weight).over(Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("__range") == F.col("__r")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
    return dealt.withColumn("__own", own).join(starts, same).withColumn(out, F.col("__start") + F.col("__own")).select(*df.columns, out)
