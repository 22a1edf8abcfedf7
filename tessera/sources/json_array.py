"""One huge JSON array, read by many tasks in bounded memory, and arrays written by partitions.

Spark's text source cuts a file into blocks of bytes, and each block into pieces that end with a closing brace. What a
block does to a scanner, as a map from its state at the block's start (outside a string or inside one) to the state at its
end and the change of depth, is found without knowing that state. The maps of all blocks, composed in order, tell every
block its state, and a second pass cuts it into elements. An element that crosses blocks is put together from its parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.values import holds
from tessera.sources.tables import written

#: Blocks of all files, each a row on the driver: 25 TB in blocks of 128 MB.
MOST_BLOCKS = 200_000
_END = b"}"
_CHANGE = np.zeros(256, np.int8)
#: Bytes that are scanned at once; a longer piece is scanned alone.
SLAB = 1 << 20
_CHANGE[[ord("["), ord("{")]], _CHANGE[[ord("]"), ord("}")]] = 1, -1


def _scanned(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of a text that begins outside a string or inside one, but after no backslash: its bytes, and how many string marks stand up to each."""
    chars = np.frombuffer(text, np.uint8)
    marks = chars == ord('"')
    slashes = np.flatnonzero(chars == ord("\\"))
    if len(slashes):  # every second one of a run escapes what follows it
        begins = np.append(True, np.diff(slashes) > 1)
        place = np.arange(len(slashes))
        first = np.maximum.accumulate(np.where(begins, place, 0))
        after = slashes[(place - first) % 2 == 0] + 1
        marks[after[after < len(chars)]] = False
    return chars, np.cumsum(marks, dtype=np.int32)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    """The pieces of batches (value, file, block) by block; a block may come in several parts."""
    for batch in batches:
        values, files, blocks = (batch.column(i) for i in range(3))
        values, keys = values.cast(pa.large_binary()).to_pylist(), list(zip(files.to_pylist(), blocks.to_pylist(), strict=True))
        lo = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[lo]:
                yield keys[lo], values[lo:i]
                lo = i


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes, bool]]:
    """(block, text, last): texts of a block in order, all pieces but the block's last with their closing brace."""
    held = None
    for key, pieces in _pieces(batches):
        if held and held[0] == key:
            yield key, held[1] + _END, False
        elif held:
            yield held[0], held[1], True
        lo = size = 0
        for i, piece in enumerate(pieces[:-1]):
            size += len(piece) + 1
            if size > SLAB or i == len(pieces) - 2:
                yield key, _END.join(pieces[lo : i + 1]) + _END, False
                lo, size = i + 1, 0
        held = key, pieces[-1]
    if held:
        yield held[0], held[1], True


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (file, block, string0, depth0, string1, depth1) a block: the state at its end and the change of depth, for either state at its start."""
    state = [(0, 0), (1, 0)]
    for key, text, last in _joined(batches):
        chars, marks = _scanned(text)
        total, change = (int(marks[-1]) if len(marks) else 0), _CHANGE[chars]
        even = int(change[marks % 2 == 0].sum(dtype=np.int64))
        both = even, int(change.sum(dtype=np.int64)) - even
        state = [((s + total) % 2, d + both[s]) for s, d in state]
        if last:
            (s0, d0), (s1, d1) = state
            yield pa.RecordBatch.from_pydict({"file": [key[0]], "block": [key[1]], "string0": pa.array([s0], pa.int32()), "depth0": [d0], "string1": pa.array([s1], pa.int32()), "depth1": [d1]})
            state = [(0, 0), (1, 0)]


def _parts(starts: dict[tuple[str, int], tuple[int, int, bool]]):
    """Rows (file, block, number, begin, end, text): what stands between separators in a block, and the separators before and after it (empty: the block's end)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        string = depth = number = 0
        carried: list[bytes] = []
        fresh, before = True, ""
        for key, text, last in _joined(batches):
            if fresh:
                (string, depth, final), number, carried, before = starts[key], 0, [], ""
            fresh = last
            text += _END if last and not final else b""
            chars, marks = _scanned(text)
            outside = (marks + string) % 2 == 0
            change = np.where(outside, _CHANGE[chars], 0)
            level = np.cumsum(change, dtype=np.int32) + np.int32(depth)
            at_top = outside & (np.minimum(level, level - change) < 1)
            if np.isin(chars[at_top], list(b" \t\r\n[]"), invert=True).any() or (level < 0).any():
                raise ValueError(f"{key[0]}: text outside the array")
            # The separators: the array's own brackets, and the commas right inside it.
            cuts = np.flatnonzero(at_top & np.isin(chars, list(b"[]")) | outside & (level == 1) & (chars == ord(","))).tolist()
            texts, lo = [], 0
            for at in cuts:
                texts.append(b"".join([*carried, text[lo:at]]))
                carried, lo = [], at + 1
            carried.append(text[lo:])
            after = [chr(chars[at]) for at in cuts]
            begins = [before, *after]
            if last:
                texts.append(b"".join(carried))
                after.append("")
            if texts:
                n = len(texts)
                yield pa.RecordBatch.from_pydict({"file": [key[0]] * n, "block": [key[1]] * n, "number": pa.array(range(number, number + n), pa.int64()), "begin": begins[:n], "end": after, "text": pa.array(texts, pa.binary()).cast(pa.string())})
                number, before = number + n, begins[-1]
            string, depth = (string + (int(marks[-1]) if len(marks) else 0)) % 2, int(level[-1]) if len(level) else depth

    return of


def _starts(maps: list, name: str) -> dict[tuple[str, int], tuple[int, int, bool]]:
    """(inside a string, depth, whether it is the file's last) at the start of each block, by composing the maps of those before it."""
    if len(maps) > MOST_BLOCKS:
        raise ValueError(f"{name}: more than {MOST_BLOCKS} blocks")
    out: dict[tuple[str, int], tuple[int, int, bool]] = {}
    maps = sorted(maps, key=lambda r: (r["file"], r["block"]))
    string = depth = 0
    for i, r in enumerate(maps):
        if not i or maps[i - 1]["file"] != r["file"]:
            string = depth = 0
        last = i + 1 == len(maps) or maps[i + 1]["file"] != r["file"]
        out[(r["file"], r["block"])] = string, depth, last
        string, depth = (r["string1"], depth + r["depth1"]) if string else (r["string0"], depth + r["depth0"])
        if not last and not string:
            depth -= 1  # the brace that ends the block's last piece
        if last and (string or depth):
            raise ValueError(f"{r['file']}: the array is cut off")
    return out


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, number, element): the elements of the JSON array that each file at `path` holds, as text, in the order of the three.

    A file that is cut off, or holds anything but one array, is an error; an empty array has no elements, nor has a file of no
    bytes. Memory is bounded by the largest element and the largest stretch without a closing brace.
    """
    lines = spark.read.option("lineSep", _END.decode()).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    maps = lines.mapInArrow(_maps, "file string, block long, string0 int, depth0 long, string1 int, depth1 long").limit(MOST_BLOCKS + 1).collect()
    starts = _starts(maps, path)
    parts = lines.mapInArrow(_parts(starts), "file string, block long, number long, begin string, end string, text string")
    place = ["file", "block", "number"]
    whole = parts.where("begin <> '' AND end <> ''").select(*place, "begin", "end", "text")
    # The first and the last part of a block belong to elements that cross its ends: each to the block whose last part begins it.
    ends = written(parts.where("begin = '' OR end = ''"))
    before = Window.partitionBy("file").orderBy("block", "number").rowsBetween(Window.unboundedPreceding, 0)
    owners = ends.select(*place, F.coalesce(F.last(F.when(F.col("begin") != "", F.col("block")), ignorenulls=True).over(before), F.lit(-1)).alias("own"))  # two rows a block, without texts
    told = ends.join(owners, place).groupBy("file", "own").agg(F.array_sort(F.collect_list(F.struct("block", "number", "begin", "end", "text"))).alias("p"))
    one = told.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["number"].alias("number"), F.col("p")[0]["begin"].alias("begin"), F.element_at("p", -1)["end"].alias("end"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    every = whole.unionByName(one).withColumn("element", F.regexp_replace("text", r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    # Besides elements there are only the blanks before the array and behind it, and what an empty array holds.
    blank = F.col("element") == ""
    outer = blank & ((F.col("begin") == "") & (F.col("end") == "[") | (F.col("begin") == "]") & (F.col("end") == "") | (F.col("begin") == "[") & (F.col("end") == "]"))
    element = ~blank & F.col("begin").isin("[", ",") & F.col("end").isin(",", "]")
    return every.where(holds(outer | element, F.concat("file", F.lit(": not one array, or an element is missing")))).where(element).select(*place, "element")


def read_json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The elements, objects of `schema`, of the JSON array in each file at `path`; an element that is no JSON stops the step. See json_elements().

    Fields that an object lacks are null, others are left out.
    """
    found = json_elements(spark, path)
    valid = F.coalesce(F.json_array_length(F.concat(F.lit("["), "element", F.lit("]"))) == 1, F.lit(False))
    told = F.concat(F.lit("an element is not JSON: "), F.left("element", F.lit(80)))
    return found.where(holds(valid, told)).select(F.from_json("element", schema).alias("row")).select("row.*")


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = None
    for batch in batches:
        texts = batch.column(0).to_pylist()
        if texts:
            yield pa.RecordBatch.from_pydict({"value": ["[" if before is None else before + ",", *[t + "," for t in texts[:-1]]]})
            before = texts[-1]
    yield pa.RecordBatch.from_pydict({"value": [*(["["] if before is None else [before]), "]"]})


def write_json_array(df: DataFrame, path: str) -> None:
    """A JSON array of objects a partition, each a file of the folder `path`; null fields are left out."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(_arrays, "value string").write.text(path)
