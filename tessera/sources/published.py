"""A sink that writes what changed and commits by one rename.

A published folder holds data in units (the rows of equal values of some columns) and numbered manifests. A manifest names
the folder and the content hash of every unit. Publishing writes only units whose hash is new, under a name that no manifest
has, then puts the next manifest in place by a rename: readers see the old state or the new one, also after a crash.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Units of a published folder, each a line of its manifest.
MOST_UNITS = 100_000
_MANIFEST = re.compile(r"(\d{10})\.json")


@dataclass(frozen=True)
class Report:
    """What a call did: units written, units left as they were, units that are gone, folders deleted that no manifest names."""

    written: int
    unchanged: int
    removed: int
    deleted: int


class _Folder:
    """The folder through Hadoop's file systems, as Spark's own paths are."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        place = self._at(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(place)) if self.fs.exists(place) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(b & 0xFF for b in stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._at(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, name: str, to: str) -> None:
        if self.fs.exists(self._at(to)) or not self.fs.rename(self._at(name), self._at(to)):
            raise FileExistsError(f"{self.path}/{to}: another call published in the meantime")

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


def _newest(folder: _Folder) -> tuple[int, dict]:
    numbers = [int(m[1]) for m in map(_MANIFEST.fullmatch, folder.names("manifests")) if m]
    return (max(numbers), json.loads(folder.read(f"manifests/{max(numbers):010}.json"))) if numbers else (0, {"units": {}})


def unit_hashes(df: DataFrame, by: list[str]) -> DataFrame:
    """(unit, hash): of each group of equal `by`, null-safe, a hash of its rows that doesn't depend on their order; repeated rows count.

    The hash is the number of rows with two sums of 60 bits of their SHA-256, so that a large unit is summed up before it is shuffled.
    """
    row = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    bits = lambda at: F.conv(F.substring("__row", at, 15), 16, 10).cast("decimal(38,0)")
    unit = F.sha2(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}), 256)
    sums = df.select(unit.alias("unit"), row.alias("__row")).groupBy("unit").agg(F.count("*").alias("n"), F.sum(bits(1)).alias("a"), F.sum(bits(16)).alias("b"))
    return sums.select("unit", F.concat_ws("-", "n", "a", "b").alias("hash"))


def publish(df: DataFrame, path: str, by: list[str], file_format: str = "parquet", options: dict[str, str] | None = None) -> Report:
    """Make `path` hold the rows of `df`, in units of equal `by`; only units with new content are written.

    Readers of read_published() see all of the state before or all of the state after. What an interrupted call left, and
    data that the manifest no longer names, is deleted by the next call that ends. A change of columns writes all units. Two
    calls at once: one fails at its commit. `file_format` and `options` are those of Spark's writer; CSV and JSON keep what
    these formats can (a text cell of no characters comes back from CSV as null). An empty table publishes an empty state.
    """
    spark, folder = df.sparkSession, _Folder(df.sparkSession, path)
    number, old = _newest(folder)
    known = old["units"] if (old.get("schema"), old.get("format"), old.get("options")) == (json.loads(df.schema.json()), file_format, options or {}) else {}
    hashes = {r["unit"]: r["hash"] for r in unit_hashes(df, by).limit(MOST_UNITS + 1).collect()}
    if len(hashes) > MOST_UNITS:
        raise ValueError(f"more than {MOST_UNITS} units")
    new = sorted(u for u, h in hashes.items() if known.get(u, {}).get("hash") != h)
    removed = sorted(set(old["units"]) - set(hashes))
    units = {u: known[u] for u in hashes if u not in new}
    if new:
        version = f"{number + 1:010}-{uuid.uuid4().hex}"
        unit = F.sha2(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}), 256)
        changed = df.withColumn("__unit", unit)
        if units:
            changed = changed.join(F.broadcast(spark.createDataFrame([(u,) for u in new], "__unit string")), "__unit", "left_semi")  # MOST_UNITS rows
        changed.write.partitionBy("__unit").format(file_format).options(**(options or {})).save(f"{path}/data/{version}")
        units |= {u: {"hash": hashes[u], "folder": f"data/{version}/__unit={u}"} for u in new}
    if new or removed or not number or (old.get("schema"), old.get("format")) != (json.loads(df.schema.json()), file_format):
        text = json.dumps({"schema": json.loads(df.schema.json()), "format": file_format, "options": options or {}, "units": units}, sort_keys=True)
        waiting = f"manifests/{uuid.uuid4().hex}.waiting"
        folder.write(waiting, text)
        folder.rename(waiting, f"manifests/{number + 1:010}.json")
    return Report(len(new), len(hashes) - len(new), len(removed), _cleaned(folder))


def _cleaned(folder: _Folder) -> int:
    """Delete what the newest manifest doesn't name."""
    number, newest = _newest(folder)
    named = {u["folder"] for u in newest["units"].values()}
    stale = []
    for version in folder.names("data"):
        units = [f"data/{version}/{n}" for n in folder.names(f"data/{version}") if n.startswith("__unit=")]
        gone = [u for u in units if u not in named]
        stale += [f"data/{version}"] if len(gone) == len(units) else gone
    stale += [f"manifests/{n}" for n in folder.names("manifests") if n != f"{number:010}.json"]
    for name in stale:
        folder.delete(name)
    return sum(name.startswith("data/") for name in stale)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest state of a published folder; a folder without one is an error."""
    folder = _Folder(spark, path)
    number, newest = _newest(folder)
    if not number:
        raise FileNotFoundError(f"{path}: nothing is published there")
    schema = T.StructType.fromJson(newest["schema"])
    places = [f"{path}/{u['folder']}" for u in newest["units"].values()]
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(newest["format"]).options(**newest["options"]).load(places)
