"""Sentences, prefix cuts and passages of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import sentences, word_count
from tessera.operators.graph import first_of_each
from tessera.operators.overlap import clean_of
from tessera.sources.tables import written


def sentence_rows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, pos, sentence): the sentences of each text, from 0."""
    return df.select(*keys, F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))


def prefix_cut(df: DataFrame, key: str, text: str, reveals, starts) -> DataFrame:
    """(key, question): the text up to its first sentence that reveals, from its first starting sentence if one before that reveals already.

    `reveals` and `starts`: columns of a sentence. Keys must tell rows apart; a null text gives an empty question.
    """
    one = lambda name, column: F.explode(F.array(column)).alias(name)  # noqa: E731  computed once, however often it is used
    cut = df.select(key, one("__s", sentences(F.coalesce(F.col(text), F.lit("")))))
    marks = cut.select(key, "__s", one("__r", F.transform("__s", reveals)), one("__start", F.greatest(F.array_position(F.transform("__s", starts), True) - 1, F.lit(0))))
    early = F.array_position("__r", True)
    marks = marks.withColumn("__first", F.when((early > 0) & (early <= F.col("__start")), F.col("__start")).otherwise(0).cast("int"))
    shown = F.array_position(F.slice("__r", F.col("__first") + 1, F.size("__r")), True).cast("int")
    n = F.when(shown > 0, shown - 1).otherwise(F.size("__s"))
    return marks.select(key, F.array_join(F.slice("__s", F.col("__first") + 1, n), " ").alias("question"))


def window_confirms(rows: DataFrame, key: str, cue: Column, names: Column, ahead: int = 2) -> DataFrame:
    """(key, confirmed): whether a sentence with a cue, or one of the next `ahead`, names the class. rows: key, pos, sentence."""
    following = Window.partitionBy(key).orderBy("pos").rowsBetween(0, ahead)
    hit = rows.withColumn("__cue", cue).withColumn("__named", F.max(names.cast("int")).over(following))
    return hit.groupBy(key).agg((F.max((F.col("__cue") & (F.col("__named") == 1)).cast("int")) == 1).alias("confirmed"))


def neighbour_rule(rows: DataFrame, key: str, here: Column, near: Column) -> DataFrame:
    """(key, holds): whether some sentence fits `here` and it or a neighbour fits `near`."""
    around = Window.partitionBy(key).orderBy("pos").rowsBetween(-1, 1)
    hit = rows.withColumn("__near", F.max(near.cast("int")).over(around)).withColumn("__here", here)
    return hit.groupBy(key).agg((F.max((F.col("__here") & (F.col("__near") == 1)).cast("int")) == 1).alias("holds"))


def _packed(parts: Column, most: int, glue: str) -> Column:
    """Parts in order, joined while a passage stays within `most` words."""
    start = F.array().cast("array<struct<text: string, words: int>>")

    def add(done: Column, part: Column) -> Column:
        n = word_count(part).cast("int")
        last = F.element_at(done, -1)
        joined = F.struct(F.concat(last["text"], F.lit(glue), part).alias("text"), (last["words"] + n).alias("words"))
        alone = F.array(F.struct(part.alias("text"), n.alias("words")))
        return F.when((F.size(done) > 0) & (F.coalesce(last["words"], F.lit(0)) + n <= most), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, alone))

    return F.aggregate(parts, start, add)


def passages(df: DataFrame, keys: list[str], text: str = "text", most: int = 300, shortest: int = 20) -> DataFrame:
    """(keys, pos, passage, words): paragraphs (lines) joined while they stay within `most` words; longer ones are cut at sentence ends first; short passages go."""
    pieces = lambda p: F.when(word_count(p) <= most, F.array(p)).otherwise(F.transform(_packed(sentences(p), most, " "), lambda x: x["text"]))
    paragraphs = F.filter(F.transform(F.split(F.col(text), "\n"), F.btrim), lambda p: p != "")
    split = df.select(*keys, F.explode(F.array(F.flatten(F.transform(paragraphs, pieces)))).alias("__pieces"))
    rows = split.select(*keys, F.posexplode(_packed(F.col("__pieces"), most, "\n\n")).alias("pos", "p"))
    return rows.select(*keys, "pos", F.col("p.text").alias("passage"), F.col("p.words").alias("words")).where(F.col("words") >= shortest)


def library(df: DataFrame, questions: DataFrame, key: str, rank: list, text: str = "text", question: str = "text", item: str = "item_id", run: int = 12, section: str | None = None) -> DataFrame:
    """(key, [section,] number, passage_id, passage, words, sha): the passages of documents without those that share a run of words with a question, then without repeats, numbered within each document.

    Of repeats the first by `rank`, section and place stays. With `section`, a document has a row for each section, in the
    order of that column, and no passage joins two sections.
    """
    keys = [key] + ([section] if section else [])
    cut = written(passages(df, keys, text))
    clean = clean_of(cut.withColumnRenamed("passage", "text"), questions.select(item, F.col(question).alias("text")), key, item, "text", run)
    order = [F.asc(c) for c in [*keys[1:], "pos"]]
    first = first_of_each(clean.withColumn("sha", F.sha2("text", 256)), ["sha"], [*rank, *order])
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    out = first.withColumn("number", number)
    return out.select(*keys, "number", F.format_string("%s-%03d", F.col(key).cast("string"), "number").alias("passage_id"), F.col("text").alias("passage"), "words", "sha")
