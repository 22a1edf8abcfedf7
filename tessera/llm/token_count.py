"""Token counts: texts of usual size are encoded as they are, huge ones in overlapping chunks that are spliced.

The model's pieces hold a space (or its escape U+2581) only at their start or as runs of spaces, so no merge crosses the
place between a non-space and a following space: a boundary there is proven to be one of the whole text as well. Chunks
are rows of their own, so that one huge text is encoded by many tasks. Two neighbours are spliced at the first such
boundary that both have in their overlap; where they have none, the text is encoded again with wider overlaps, up to the
whole text in one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, unused

MODEL = "piece_bpe_32k.model"
SPACES = (" ", "▁")


def _load(model_file: str) -> sentencepiece.SentencePieceProcessor:
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lstrip("▁")
        assert "▁" not in piece, f"{model_file}: a piece holds a space after a non-space, so chunks can't be spliced"
    return model


def _counted(model_file: str):
    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for texts in batches:
            yield pd.Series([len(model.encode(t)) for t in texts], dtype="int64")

    return counted


def _bounds(model_file: str, overlap: int):
    """Chunks -> tokens in all, and the proven boundaries in the first and last `overlap` characters: where, and tokens before."""

    @F.pandas_udf("n long, bounds array<struct<at: long, before: long>>")
    def bounds(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = _load(model_file)
        for offsets, chunks in batches:
            rows = []
            for offset, chunk in zip(offsets, chunks, strict=True):
                found, n, raw, at, done = [], 0, chunk.encode(), 0, 0
                for n, p in enumerate(model.encode(chunk, return_type="proto").pieces):
                    at += len(raw[done : p.begin].decode()) if p.begin > done else 0
                    done = max(done, p.begin)
                    if 0 < at < len(chunk) and chunk[at] in SPACES and chunk[at - 1] not in SPACES and (at <= overlap or at >= len(chunk) - overlap):
                        found.append({"at": offset + at, "before": n})
                rows.append((len(model.encode(chunk)), found))
            yield pd.DataFrame(rows, columns=["n", "bounds"])

    return bounds


def _huge(texts: DataFrame, model_file: str, step: int, overlap: int) -> DataFrame:
    """(sha, text) -> (sha, n_tokens); null where some neighbours had no common boundary."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - F.lit(overlap) - F.lit(1)), F.lit(step))
    chunks = texts.select("sha", "text", F.posexplode(starts).alias("k", "start"))
    chunks = chunks.select("sha", "k", F.col("start").cast("long").alias("start"), F.expr(f"substring(text, start + 1, {step + overlap})").alias("chunk"))
    chunks = chunks.repartition("sha", "k").withColumn("e", _bounds(model_file, overlap)("start", "chunk"))
    by_text = chunks.groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("k", "e"))).alias("c"))
    spliced = """transform(sequence(1, size(c)), i -> if(i = size(c), struct(c[i - 1].e.n as here, 0L as there),
        try_element_at(transform(filter(c[i - 1].e.bounds, x -> exists(c[i].e.bounds, y -> y.at = x.at)),
            x -> struct(x.before as here, filter(c[i].e.bounds, y -> y.at = x.at)[0].before as there)), 1)))"""
    total = "if(exists(s, x -> x is null), null, aggregate(s, 0L, (a, x) -> a + x.here - x.there))"
    return by_text.select("sha", F.expr(spliced).alias("s")).select("sha", F.expr(total).alias("n_tokens"))


def count_tokens(df: DataFrame, model_file: str, text: str = "text", out: str = "n_tokens", huge: int = 40_000, step: int = 16_000, overlap: int = 1_000) -> DataFrame:
    """Add the number of tokens (long) that the sentencepiece model has for each whole text; null counts as empty: 0.

    `huge`: characters beyond which a text is cut into chunks of step + overlap characters. Equal huge texts are encoded
    once, also where a row is repeated. A column `out` that `df` has already is replaced. An empty table gives no rows.
    """
    assert step > 2 * overlap, "cuts must follow one another"
    keep = [c for c in df.columns if c != out]
    body = F.coalesce(F.col(text), F.lit(""))
    usual = df.where(F.length(body) <= huge).select(*keep, _counted(model_file)(body).alias(out))
    big = df.where(F.length(body) > huge)
    texts = big.select(F.sha2(F.col(text), 256).alias("sha"), F.col(text).alias("text")).dropDuplicates(["sha"])
    found = cut(_huge(texts, model_file, step, overlap))
    left = found.where("n_tokens is null").select("sha")
    while not left.isEmpty():
        step, overlap = 4 * step, 4 * overlap
        again = cut(_huge(texts.join(left, "sha", "left_semi"), model_file, step, overlap))
        found = found.where("n_tokens is not null").unionByName(again)
        left = again.where("n_tokens is null").select("sha")
    sha, n = unused(df.columns, "sha", "n")
    found = found.where("n_tokens is not null").select(F.col("sha").alias(sha), F.col("n_tokens").alias(n))
    big = big.withColumn(sha, F.sha2(F.col(text), 256)).join(found, sha, "left").select(*keep, F.col(n).alias(out))
    return usual.unionByName(big)


def default_model() -> str:
    return public_tokenizers.path(MODEL)
