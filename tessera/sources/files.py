"""Files of a tree as rows: one by name, an inventory with hashes and media headers, texts, and the members of archives."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, name, size, content) of every file below `root` whose name fits `glob`. A file is one row: 2 GB at most. Spark's reader passes over files of no bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "content")


def find_one(spark: SparkSession, root: str, name: str) -> str:
    """The path of the only file of that name below `root`; none, or two, are an error that tells the paths."""
    found = sorted(r["path"] for r in files(spark, root, name).select("path").limit(10).collect())
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found) or 'no'} files named {name} below {root}: {found}")
    return found[0]


def _number(content: Column, at: int, n: int, little: bool = False) -> Column:
    octets = [F.hex(F.substring(content, at + i, 1)) for i in range(n)]
    return F.conv(F.concat(*(reversed(octets) if little else octets)), 16, 10).cast("int")


def jpeg_size(content: bytes) -> tuple[int, int] | None:
    """(width, height) from the first frame header; None where there is none."""
    at = 2
    while at + 9 <= len(content) and content[at] == 0xFF:
        kind = content[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
        at += 2 if kind in (0xFF, 0x01) or 0xD0 <= kind <= 0xD8 else 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    return None


def _frames():
    @F.arrow_udf("struct<width: int, height: int>")
    def frames(contents: pa.Array) -> pa.Array:
        sizes = [jpeg_size(c.as_py()) if c.is_valid else None for c in contents]
        return pa.array([None if s is None else {"width": s[0], "height": s[1]} for s in sizes], pa.struct([("width", pa.int32()), ("height", pa.int32())]))

    return frames


def inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, name, size, sha256, media, width, height) of every file: its hash and what its first bytes tell.

    media: png, gif, jpeg, pdf or zip by the marks that these formats begin with, else null; width and height of pictures,
    null where their header is cut off.
    """
    c = F.col("content")
    # The bytes that formats begin with.
    marks = {"png": "89504E470D0A1A0A", "gif": "474946", "jpeg": "FFD8FF", "pdf": "25504446", "zip": "504B0304"}
    media = F.coalesce(*[F.when(F.startswith(F.hex(F.substring(c, 1, 8)), F.lit(mark)), F.lit(name)) for name, mark in marks.items()])
    found = files(spark, root, glob).withColumn("media", media)
    sized = found.withColumn("frame", _frames()(F.when(F.col("media") == "jpeg", c)))
    whole = lambda n: F.length(c) >= n
    side = lambda png, gif, jpeg: F.when((F.col("media") == "png") & whole(24), _number(c, png, 4)).when((F.col("media") == "gif") & whole(10), _number(c, gif, 2, True)).otherwise(F.col(f"frame.{jpeg}"))
    return sized.select("path", "name", "size", F.sha2("content", 256).alias("sha256"), "media", side(17, 7, "width").alias("width"), side(21, 9, "height").alias("height"))


def texts(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """(path, name, text, words) of text files; one that is not UTF-8 stops the step."""
    found = files(spark, root, glob).withColumn("text", F.decode("content", "UTF-8"))
    return found.select("path", "name", "text", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("words"))


def _members(suffix: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for rows in _read(content.as_py(), suffix):
                    yield pa.RecordBatch.from_pydict({"archive": pa.array([path] * len(rows), pa.string()), "member": pa.array([m for m, _, _ in rows], pa.string()), "content": pa.array([c for _, c, _ in rows], pa.binary()), "problem": pa.array([p for _, _, p in rows], pa.string())})

    return of


def _read(content: bytes, suffix: str, most: int = 16 << 20) -> Iterator[list[tuple[str | None, bytes | None, str | None]]]:
    """The members of an archive, read as a stream, in lists of bounded size; what can't be read is a row with a problem, and ends the archive if its own frame is broken."""
    rows: list[tuple[str | None, bytes | None, str | None]] = []
    size = 0
    try:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as archive:
            for member in archive:
                if not member.isfile() or not member.name.endswith(suffix):
                    continue
                data = archive.extractfile(member).read()
                rows.append((member.name, data, None))
                size += len(data)
                if size > most:
                    yield rows
                    rows, size = [], 0
    except (tarfile.TarError, EOFError, OSError, ValueError) as e:
        rows.append((None, None, f"the rest can't be read: {type(e).__name__}"))
    if rows:
        yield rows


def archive_members(spark: SparkSession, root: str, glob: str = "*.tar.gz", suffix: str = ".xml") -> DataFrame:
    """(archive, member, content, problem): the files of archives (tar, also packed) whose names end with `suffix`.

    An archive is unpacked as a stream in one task. Where it is cut off or broken, the members before are given, and one
    more row, without a member, tells the problem.
    """
    return files(spark, root, glob).select("path", "content").mapInArrow(_members(suffix), "archive string, member string, content binary, problem string")


def unreadable(members: DataFrame) -> DataFrame:
    """(archive, read, problems): of each archive how many members were read and how many problems there were."""
    return members.groupBy("archive").agg(F.count("member").alias("read"), F.count("problem").alias("problems"))
