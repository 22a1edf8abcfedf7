"""A training corpus from documents: toxic texts and texts of no sure language go, one of each near-duplicate group stays, sources are mixed, texts are encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, jaccard_join, language_id, source_mix, toxicity
from tessera.llm.common import read
from tessera.sources.tables import deleted, intermediates, new_path

#: Texts whose language is judged with less than this go.
LEAST_LANGUAGE_SCORE = 0.3
#: Near duplicates: runs of five words, a similarity of 0.8.
WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the labels of held-out documents teach nothing.

    Every row is judged by its own text: repeated rows go or stay together, null and empty texts get the score of a text
    without features. Without labels nothing is toxic. An empty table stays empty.
    """
    return toxicity.score_toxicity(docs, read(spark, sf_dir, "labels")).where("predicted = 0").select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is judged with some certainty.

    Null texts and texts without letters go, as their language can't be told. Repeated rows are judged alike. An empty
    table, or one without a label to learn from, gives no rows.
    """
    judged = language_id.identify_languages(docs)
    return judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest doc_id.

    Each row is judged by its own text, also where rows share a doc_id or have none; of rows equal in doc_id and text one
    stays. Null and blank texts are no near duplicates and stay. An empty table stays empty.
    """
    return jaccard_join.first_of_near_copies(docs, words=WORDS, percent=PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by target weights: a row for each pass in which a document is taken, with the text taken.

    Documents without words are never taken; a null source is a source of its own; repeated rows are documents of their
    own. An empty table stays empty.
    """
    mixed = source_mix.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else mixed


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids (little-endian unsigned 32-bit integers) and n_tokens of every text, and whether decoding gives the text back.

    A null text has no ids and a null round_trip. Each repeated row is encoded. An empty table stays empty.
    """
    ranks = byte_bpe.default_ranks()
    encoded = byte_bpe.encode_texts(docs.select("doc_id", "source", F.sha2("text", 256).alias("text_sha256"), "text"), ranks, decoded="decoded")
    same = F.sha2("decoded", 256) == F.col("text_sha256")
    return encoded.select("doc_id", "source", "ids", "n_tokens", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("jaccard_join", drop_near_copies),
    ("source_mix", mix),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage wrote for itself goes with its end, and its result when the next one is there."""
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        out = new_path(spark)
        with intermediates(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            deleted(spark, before)
        before = out
    return docs


#: A trained classifier and pseudorandom draws: SQL can't express the stages; the tests hold them against plain versions.
ORACLE_SQL = None
