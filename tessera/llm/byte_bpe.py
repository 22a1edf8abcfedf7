"""Byte-level BPE: texts to token ids by way of a table of distinct pre-tokens, and ids back to bytes.

Texts are cut into pre-tokens and packed into pieces of a million pre-tokens or so, in which each position holds the code of
a word of that piece. The words are shuffled by a hash of the word, every distinct word is encoded once, and its ids go
back to the pieces that hold it, where they are put in place by position. A word that fills half of all texts is one entry
for each piece, and what moves is packed and compressed, so the shuffles stay below the size of the input.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bucketed, nullable, slabs, unused
from tessera.llm.pretokens import pretokens

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of a piece, unless one text is longer.
PIECE_CHARS = 8_000_000
#: Tokens of a chunk of a piece's results, unless one text has more.
CHUNK_TOKENS = 250_000
_END = b"\xff"  # no byte of UTF-8


def default_ranks() -> str:
    return public_tokenizers.path(RANKS)


@cache
def token_bytes(ranks_file: str) -> dict[bytes, int]:
    """The token-byte table, of the size of a vocabulary."""
    with open(ranks_file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _shrunk(a: np.ndarray) -> bytes:
    """Byte planes of 32-bit numbers, compressed."""
    return zstandard.compress(np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _grown(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _packer(buckets: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        pa.default_memory_pool().release_unused()  # what the worker's earlier stages left
        for batch in batches:
            column = batch["text"]
            for lo, hi in slabs(pc.utf8_length(column).to_pylist(), PIECE_CHARS):
                known: dict[str, int] = {}
                codes, counts = array("I"), []  # four bytes a pre-token, and one slab of texts as Python's at a time
                for i in range(lo, hi):
                    before = len(codes)
                    codes.extend(known.setdefault(w, len(known)) for w in pretokens(column[i].as_py()))
                    counts.append(len(codes) - before)
                words = [w.encode() for w in known]
                bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
                order = sorted(range(len(words)), key=lambda i: (bucket[i], words[i]))
                place = np.empty(len(words), np.uint32)
                place[order] = np.arange(len(words), dtype=np.uint32)
                flat = place[np.frombuffer(codes, np.uint32)] if codes else np.zeros(0, np.uint32)
                parts, at = [], np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
                for b in range(buckets):
                    if at[b] < at[b + 1]:
                        parts.append({"bucket": b, "words": zstandard.compress(_END.join(words[i] for i in order[at[b] : at[b + 1]]), 3)})
                yield pa.RecordBatch.from_pydict({
                    "piece": pa.array([number], pa.int64()), "rows": pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), pa.concat_arrays([batch["row"].slice(lo, hi - lo)])),
                    "counts": pa.array([_shrunk(np.array(counts))], pa.binary()), "codes": pa.array([_shrunk(flat)], pa.binary()),
                    "parts": pa.array([parts], pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())]))),
                })
                number += 1

    return pack


def _encoder(ranks_file: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_bytes(ranks_file), special_tokens={})
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            sizes, ids = [], []
            for packed in batch["words"].to_pylist():
                words = zstandard.decompress(packed).split(_END)
                for w in words:
                    if w not in known:
                        known[w] = tokenizer.encode_ordinary(w.decode())
                got = [known[w] for w in words]
                sizes.append(_shrunk(np.fromiter(map(len, got), np.uint32, len(got))))
                ids.append(_shrunk(np.fromiter((i for g in got for i in g), np.uint32, sum(map(len, got)))))
            yield pa.RecordBatch.from_pydict({"piece": batch["piece"], "bucket": batch["bucket"], "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary())})

    return encode


def _taken(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `ids` of the words `codes`, one after another, and their lengths."""
    starts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    n = sizes[codes].astype(np.int64)
    shift = np.repeat(starts[codes] - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n, n)
    return ids[shift + np.arange(len(shift))], n


@cache
def _decoder(ranks_file: str):
    """ids -> bytes, by the token-byte table laid out in one run."""
    tokens = sorted((rank, token) for token, rank in token_bytes(ranks_file).items())
    size, body = np.zeros(tokens[-1][0] + 1, np.int64), np.frombuffer(b"".join(t for _, t in tokens), np.uint8)
    for rank, token in tokens:
        size[rank] = len(token)
    return lambda ids: None if ids is None else _taken(body, size, np.frombuffer(ids, "<u4"))[0].tobytes()


def _assembler(ranks_file: str | None):
    def assemble(pieces: pa.Table, words: pa.Table) -> pa.Table:
        words = words.sort_by("bucket")
        join = lambda column: np.concatenate([_grown(b) for b in words[column].to_pylist()] or [np.zeros(0, np.uint32)])
        sizes, ids, out = join("sizes"), join("ids"), []
        pa.default_memory_pool().release_unused()  # what the worker's earlier stages left
        for i in range(pieces.num_rows):
            counts, codes = _grown(pieces["counts"][i].as_py()), _grown(pieces["codes"][i].as_py())
            flat, n = _taken(ids, sizes, codes)
            ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))].tolist()
            raw = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
            rows = pieces["rows"].chunk(0) if pieces["rows"].num_chunks == 1 else pieces["rows"].combine_chunks()
            values = rows[i].values
            for lo, hi in slabs(np.diff(ends).tolist(), CHUNK_TOKENS):  # a chunk is a batch on its way to Spark
                own = [raw[4 * a : 4 * b].tobytes() for a, b in zip(ends[lo:hi], ends[lo + 1 : hi + 1], strict=True)]
                table = {"row": values.slice(lo, hi - lo), "ids": pa.array(own, pa.binary()), "n_tokens": pa.array(np.diff(ends[lo : hi + 1]).astype(np.int64))}
                out.append(pa.table(table | ({"decoded": pa.array(map(_decoder(ranks_file), own), pa.binary())} if ranks_file else {})))
        return pa.concat_tables(out)

    return assemble


def encode_texts(df: DataFrame, ranks_file: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", decoded: str | None = None) -> DataFrame:
    """Replace `text` by its token ids (binary: little-endian unsigned 32-bit integers) and their number (long).

    decoded: a column for the bytes that the ids stand for, decoded in the tasks that put the ids together. Null and empty
    texts have no ids. Other columns stay, but those named like an added one are replaced. The ranks file must be at the
    same place on every executor.
    """
    keep = [c for c in df.columns if c not in (text, ids, n_tokens, decoded)]
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.struct(F.lit(0).alias(unused(keep, "some")[0]), *keep).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    row = nullable(rows.schema["row"].dataType)
    parts = T.ArrayType(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("words", T.BinaryType())]))
    schema = T.StructType([T.StructField("piece", T.LongType()), T.StructField("rows", T.ArrayType(row)), T.StructField("counts", T.BinaryType()), T.StructField("codes", T.BinaryType()), T.StructField("parts", parts)])
    pieces = bucketed(rows.mapInArrow(_packer(buckets), schema), "piece", buckets)  # so that codes are stored once and not shuffled
    words = pieces.select("piece", F.explode("parts").alias("p")).select("piece", "p.bucket", "p.words").repartition(buckets, "bucket")
    encoded = words.mapInArrow(_encoder(ranks_file), "piece long, bucket int, sizes binary, ids binary")
    added = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), *([T.StructField("decoded", T.BinaryType())] if decoded else [])]
    out = T.StructType([T.StructField("row", row), *added])
    joined = pieces.drop("parts").groupBy("piece").cogroup(encoded.groupBy("piece")).applyInArrow(_assembler(ranks_file if decoded else None), out)
    return joined.select(*[F.col("row").getField(c).alias(c) for c in keep], F.col("ids").alias(ids), F.col("n_tokens").alias(n_tokens), *([F.col("decoded").alias(decoded)] if decoded else []))


def decode_ids(ids: Column, ranks_file: str) -> Column:
    """The bytes (binary) that the ids stand for: each id is looked up in the token-byte table. Null stays null."""

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(map(_decoder(ranks_file), batch.to_pylist()), pa.binary())

    return decoded(ids)
