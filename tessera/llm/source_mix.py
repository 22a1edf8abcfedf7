"""Mixing sources to target weights.

The words of a source, text after text, are one stream that is cut into blocks of fixed length. The output is dealt in
shards of slots: each shard draws multinomial counts of the sources, and what the draws of all shards exceed or miss of a
source's share is dealt anew, so that every source comes within a block of its target. The n-th slot of a source takes
pass n / blocks of a pseudorandom permutation of its block numbers, at n mod blocks; slots and blocks are joined by number.
All draws are functions of the seed, the shard and the source, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, small_table, unused, written

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, slots of a shard.
BLOCK_WORDS, SHARD_SLOTS = 64, 4_096
#: Weights of the sources in order, repeating; a source is taken so many times at most.
WEIGHTS, MOST_TIMES = (1, 2, 3), 3
#: Columns that the rows get.
ADDED = ("size", "source_size", "target", "number", "place")
#: Rows of one chunk of a running sum.
_CHUNK = 50_000


def running_total(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str, spread: Column) -> DataFrame:
    """Add the sum of `value` over the rows before, within `keys`, chunk by chunk so that no task holds all rows of a key.

    `spread`: a column whose hash deals the rows into chunks; rows follow one another by chunk, then by `order`.
    """
    chunks = max(1, df.count() // _CHUNK)
    chunk, part, ahead, inside = unused(df.columns, "chunk", "part", "ahead", "inside")
    df = df.withColumn(chunk, F.pmod(F.xxhash64(spread, F.lit(7)), F.lit(chunks)))
    before = F.sum(part).over(Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1))
    sums = df.groupBy(*keys, chunk).agg(F.sum(value).alias(part)).withColumn(ahead, F.coalesce(before, F.lit(0))).drop(part)
    within = F.sum(value).over(Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(inside, F.coalesce(within, F.lit(0))).join(sums, [*keys, chunk]).withColumn(out, F.col(inside) + F.col(ahead)).drop(inside, ahead, chunk)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """(source, source_size) -> also weight, number (of the source in order) and target (double).

    Targets share the total size by weight and stop at `most` times the source's size; the excess is reshared by weight
    until none is above. So every target is the smaller of that bound and a level times the weight: the level that the
    total asks for once the sources with the smallest bound for their weight are full.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    df = sizes.withColumn("number", (F.row_number().over(ordered) - 1).cast("int"))
    df = df.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("double"))
    df = df.withColumn("bound", F.col("source_size").cast("double") * most)
    filling = Window.orderBy(F.col("bound") / F.col("weight"), "number")
    full = F.coalesce(F.sum("bound").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    df = df.withColumn("level", (total - full) / open_weight)
    # The first source that its level doesn't fill sets the level of all that follow.
    level = F.max(F.when(F.col("bound") >= F.col("level") * F.col("weight"), F.col("level"))).over(Window.partitionBy())
    level = F.coalesce(level, F.max(F.col("bound") / F.col("weight")).over(Window.partitionBy()))
    return df.withColumn("target", F.least(F.col("bound"), level * F.col("weight"))).drop("bound", "level")


def _draws(shares: list[float], seed: int, slots: int, last: int):
    """Multinomial counts of each shard: (shard, number of the source, count)."""

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"].tolist():
                counts = np.random.Generator(np.random.Philox(key=[seed, shard])).multinomial(min(slots, last - shard * slots), shares)
                yield pd.DataFrame({"shard": np.full(len(counts), shard), "number": np.arange(len(counts), dtype=np.int32), "count": counts})

    return drawn


def _permuted(place: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Images of `place` under permutations of range(n) chosen by `key`: a Feistel network, walked until it lands inside."""
    half = np.ceil(np.log2(np.maximum(n, 4)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, left = place.astype(np.uint64), np.ones(len(place), bool)
    while left.any():
        h, m, k = half[left], mask[left], key[left]
        a, b = out[left] >> h, out[left] & m
        for turn in range(4):
            f = (b + k + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
            a, b = b, a ^ ((f >> np.uint64(31)) & m)
        out[left] = (a << h) | b
        left = left & (out >= n.astype(np.uint64))
    return out.astype(np.int64)


def _to_blocks(seed: int):
    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, count = b["blocks"].to_numpy(np.int64), b["nth"].to_numpy(np.int64)
            turn = count // n
            key = (b["number"].to_numpy(np.uint64) * np.uint64(1_000_003) + turn.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed)
            yield pd.DataFrame({"shard": b["shard"], "number": b["number"], "turn": turn, "block": _permuted(count % n, n, key)})

    return mapped


def plan(sources: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS, slots: int = SHARD_SLOTS) -> DataFrame:
    """Slots of the mix: (shard, number, turn, block) from (number, source_size, target). Sources without words take no part.

    The counts of sources (one number for each source) are the only thing that the driver sees.
    """
    spark = sources.sparkSession
    blocks = F.ceil(F.col("source_size") / block_words)
    times = F.floor(F.col("target") / F.col("source_size"))
    rest = F.least(blocks, F.round((F.col("target") - times * F.col("source_size")) / block_words))
    wanted = cut(sources.where("source_size > 0").select("number", blocks.alias("blocks"), (times * blocks + rest).cast("long").alias("wanted")))
    rows = wanted.orderBy("number").collect()
    total = sum(r["wanted"] for r in rows)
    if not total:
        return small_table(spark, [], "shard long, number int, turn long, block long")
    counts = {r["number"]: r["wanted"] for r in rows}
    shares = [counts.get(i, 0) / total for i in range(max(counts) + 1)]
    shares = [s / sum(shares) for s in shares]
    draws = spark.range(-(-total // slots)).mapInPandas(_draws(shares, seed, slots, total), "shard long, number int, count long")
    draws = written(draws.where("count > 0"))
    draws = running_total(draws, ["number"], [F.col("shard")], "count", "from", F.col("shard"))
    draws = draws.join(F.broadcast(wanted), "number")  # a row for each source, as on the driver
    kept = draws.select("shard", "number", "blocks", "from", F.least("count", F.greatest(F.lit(0), F.col("wanted") - F.col("from"))).alias("keep"), "count")
    fill = kept.where("keep > 0").select("shard", "number", "blocks", "from", "keep")
    # Slots beyond a source's share go, in order, to the sources that the draws left short.
    drawn = {r["number"]: r["n"] for r in draws.groupBy("number").agg(F.sum("count").alias("n")).collect()}  # a row for each source
    short, at = [], 0
    for r in rows:
        lack = max(0, r["wanted"] - drawn.get(r["number"], 0))
        if lack:
            short.append((at, at + lack, r["number"], r["blocks"], drawn.get(r["number"], 0)))
            at += lack
    if short:
        spare = kept.where("keep < count").select("shard", (F.col("count") - F.col("keep")).alias("over"), F.lit(0).alias("one"))
        spare = running_total(spare, ["one"], [F.col("shard"), F.col("over")], "over", "begin", F.col("shard"))
        lacks = F.broadcast(small_table(spark, short, "lo long, hi long, number int, blocks long, drawn long"))  # a row for each source
        spare = spare.withColumn("end", F.col("begin") + F.col("over"))
        dealt = spare.join(lacks, (F.col("begin") < F.col("hi")) & (F.col("end") > F.col("lo")))
        lo, hi = F.greatest("begin", "lo"), F.least("end", "hi")
        fill = fill.unionByName(dealt.select("shard", "number", "blocks", (F.col("drawn") + lo - F.col("lo")).alias("from"), (hi - lo).alias("keep")))
    nth = F.explode(F.sequence(F.col("from"), F.col("from") + F.col("keep") - 1))
    return fill.select("shard", "number", "blocks", nth.alias("nth")).mapInPandas(_to_blocks(seed), "shard long, number int, turn long, block long")


def mix_sources(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """The rows with size, source_size, target, number (of the source) and place; and the spans of the mix (number, place, shard, turn, first, words).

    size: words ([^\\x20\\x09-\\x0D]+) of the whole text, 0 if null. place: number of words of the source before the text;
    with the source's number it names a row that has words. A span is a run of `words` words of one row, from word
    `first` (from 0), that a block of the mix holds, in pass `turn` over the source. Null sources are one source, ordered last.
    Rows of size 0 have no span; rows that repeat a key count each. No row is taken more than 3 times. Columns of the names
    added that `df` has already are replaced.
    """
    keep = [c for c in df.columns if c not in ADDED]
    rows = df.select(*keep, F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    narrow = cut(rows.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size")))
    sources = cut(targets(narrow))
    (own,) = unused([*keep, *ADDED], "of")
    numbered = rows.join(F.broadcast(sources.select(F.col("source").alias(own), "source_size", "target", "number")), F.col(source).eqNullSafe(F.col(own))).drop(own)  # a row for each source
    spread = F.xxhash64(key, text)
    placed = running_total(numbered, ["number"], [F.col(key), F.col("size"), spread], "size", "place", spread)
    slots = plan(sources, seed, block_words)
    first, last = F.floor(F.col("place") / block_words), F.floor((F.col("place") + F.col("size") - 1) / block_words)
    parts = placed.where("size > 0").select("number", "place", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest("place", F.col("block") * block_words)
    end = F.least(F.col("place") + F.col("size"), (F.col("block") + 1) * block_words)
    spans = parts.join(slots, ["number", "block"]).select("number", "place", "shard", "turn", (begin - F.col("place")).alias("first"), (end - begin).alias("words"))
    return placed, spans


def _cut_words():
    import re

    word = re.compile(WORD)

    @F.pandas_udf("string")
    def pieces(texts: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(texts, runs, strict=True):
            at = [m.span() for m in word.finditer(t)]
            own = sorted((r["first"], r["first"] + r["words"]) for r in own)
            joined = []
            for a, b in own:  # neighbours are one run, with the white space between them
                if joined and joined[-1][1] == a:
                    joined[-1][1] = b
                else:
                    joined.append([a, b])
            whole = len(joined) == 1 and joined[0] == [0, len(at)]
            out.append(t if whole else "\n".join(t[at[a][0] : at[b - 1][1]] for a, b in joined))
        return pd.Series(out, dtype=object)

    return pieces


def mixed_documents(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """The mix as documents with the columns of `df`: of each row and each pass over its source, the text that is taken in it."""
    clashing = [c for c in df.columns if c in ADDED]
    apart = dict(zip(clashing, unused(df.columns, *[f"own_{c}" for c in clashing]), strict=True))
    (runs,) = unused([*df.columns, *ADDED, "turn", *apart.values()], "runs")
    placed, spans = mix_sources(df.withColumnsRenamed(apart), key, text, source, seed)
    taken = spans.groupBy("number", "place", "turn").agg(F.collect_list(F.struct("first", "words")).alias(runs))
    mixed = placed.where("size > 0").join(taken.drop("turn"), ["number", "place"]).withColumn(text, _cut_words()(F.col(text), runs))
    return mixed.select(*[F.col(apart.get(c, c)).alias(c) for c in df.columns])
