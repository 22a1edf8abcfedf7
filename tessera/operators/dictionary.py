"""Names of a dictionary in texts: greedy, longest first, in any order of words, without overlap."""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import name_key, tokens

#: Names that a dictionary may hold.
MOST_NAMES = 10_000


def dictionary(terms: DataFrame) -> DataFrame:
    """terms (class, term, counts) with the key of each name; a counting name of two classes, or a name twice in a class, is an error."""
    keyed = terms.withColumn("key", name_key(F.col("term")))
    wrong = keyed.groupBy("key").agg(F.count_distinct(F.when(F.col("counts") == "yes", F.col("class"))).alias("owners"), F.count("*").alias("n"), F.count_distinct("class").alias("classes")).where("owners > 1 OR n > classes")
    if not wrong.isEmpty():
        raise ValueError(f"names that belong to two classes or stand twice in one: {[r['key'] for r in wrong.limit(5).collect()]}")
    return keyed


class Names:
    """A dictionary as constants of a plan: the keys of its names by length, and what each stands for."""

    def __init__(self, terms: DataFrame):
        rows = dictionary(terms).limit(MOST_NAMES + 1).collect()
        if len(rows) > MOST_NAMES:
            raise ValueError(f"more than {MOST_NAMES} names")
        self.entries: dict[str, dict] = {}
        for r in rows:
            entry = self.entries.setdefault(r["key"], {"classes": [], "every": [], "other": r["term"]})
            entry["every"].append(r["class"])
            if r["counts"] == "yes":
                entry["classes"].append(r["class"])
        self.entries.pop("", None)
        self.single = sorted({w for key in self.entries for w in key.split()})
        self.lengths = sorted({len(k.split()) for k in self.entries}, reverse=True)

    def of_length(self, n: int) -> list[str]:
        return [k for k in self.entries if len(k.split()) == n]

    def known(self) -> Column:
        return F.from_json(F.lit(json.dumps(self.entries)), "map<string, struct<classes: array<string>, every: array<string>, other: string>>")


_SPANS = "array<struct<start: int, end: int, key: string>>"


def step(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a column that is computed once, however often it is used: an exploded array of one."""
    return df.withColumn(name, F.explode(F.array(column)))


def candidates(df: DataFrame, names: Names, words: str, out: str) -> DataFrame:
    """Add every span (start, end after the last word, key) of `words` that holds a name's words in any order: longer ones first, then earlier ones."""
    w, size = F.col(words), F.size(words)
    places = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.try_element_at(w, i).isin(names.single))
    df = step(df, "__some", F.when(size > 0, places).otherwise(F.array().cast("array<int>")))

    def of_length(n: int) -> Column:
        within = F.filter(F.col("__some"), lambda i: i + n - 1 <= size)
        keyed = F.transform(within, lambda i: F.struct(i.alias("start"), (i + n).alias("end"), F.array_join(F.array_sort(F.slice(w, i, n)), " ").alias("key")))
        return F.filter(keyed, lambda s: s["key"].isin(names.of_length(n)))

    return step(df, out, F.concat(F.array().cast(_SPANS), *map(of_length, names.lengths))).drop("__some")


def without_overlap(spans: Column) -> Column:
    """Of spans in order those that no span taken before overlaps."""
    free = lambda taken, s: ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))
    return F.aggregate(spans, F.array().cast(_SPANS), lambda t, s: F.when(free(t, s), F.concat(t, F.array(s))).otherwise(t))


def _first_free(spans: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(spans), 0).to_pylist()
    rows = spans.flatten()
    ends, kept, at, marked = [0], [], 0, set()
    places = list(zip(rows.field("start").to_pylist(), rows.field("end").to_pylist(), strict=True))
    for size in sizes:
        marked.clear()
        for i in range(at, at + size):
            own = range(*places[i])
            if marked.isdisjoint(own):
                marked.update(own)
                kept.append(i)
        at += size
        ends.append(len(kept))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows.take(pa.array(kept, pa.int64())))


def taken(spans: Column) -> Column:
    """without_overlap() for texts of many spans: the words that are taken are marked, so that no span is compared with others."""
    @F.arrow_udf(_SPANS)
    def free(spans: pa.Array) -> pa.Array:
        return _first_free(spans)

    return free(spans)


def classes_of(spans: Column, names: Names) -> Column:
    """The classes that the names of spans count for, once for each span."""
    return F.flatten(F.transform(spans, lambda s: F.element_at(names.known(), s["key"])["classes"]))


def others_of(spans: Column, names: Names) -> Column:
    """The names of spans that count for no class, sorted."""
    known = F.transform(spans, lambda s: F.element_at(names.known(), s["key"]))
    return F.array_sort(F.array_distinct(F.transform(F.filter(known, lambda e: F.size(e["classes"]) == 0), lambda e: e["other"])))


def named(df: DataFrame, terms: DataFrame, text: str = "text", last: bool = False, out: str = "named") -> DataFrame:
    """Add struct(classes map<string, long>, others array<string>): how often a text names each class, and the names that count for none.

    A span of words is a name if it holds the name's words in any order. Longer names come first, then earlier spans, and
    spans don't overlap. last: only spans that end with the text count, though others take their words. A null text names
    nothing. The dictionary is a hand-made list of at most MOST_NAMES names, which goes into the plan as a constant.
    """
    names = Names(terms)
    found = step(df, "__words", F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")))
    found = step(candidates(found, names, "__words", "__found"), "__spans", taken(F.col("__found")))
    counted = F.filter("__spans", lambda s: s["end"] == F.size("__words") + 1) if last else F.col("__spans")
    found = step(step(found, "__counted", counted), "__classes", classes_of(F.col("__counted"), names))
    times = F.map_from_entries(F.transform(F.array_distinct("__classes"), lambda c: F.struct(c, F.size(F.filter("__classes", lambda x: x == c)).cast("long"))))
    return found.withColumn(out, F.struct(times.alias("classes"), others_of(F.col("__counted"), names).alias("others"))).select(*df.columns, out)


def starts_with_any(words: Column, beginnings: list[str]) -> Column:
    """Whether a word begins with one of some beginnings."""
    return F.exists(words, lambda w: F.exists(F.array(*map(F.lit, beginnings)), lambda b: F.startswith(w, b)))


def term_counts(text: Column, terms: list[str]) -> Column:
    """How many of some terms the lower-cased text holds."""
    return F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(text), t)))


def only_kind(text: Column, patterns: dict[str, str]) -> Column:
    """The name of the one pattern that matches; null if none or several do."""
    hits = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items()]))
    return F.when(F.size(hits) == 1, F.try_element_at(hits, F.lit(1)))


def reasons(text: Column, wanted: list[str], unwanted: dict[str, str]) -> Column:
    """Why a caption is left out: the names of what it lacks or holds, in a fixed order; empty if it stays."""
    lacks = [F.when(~text.rlike(p), F.lit(f"lacks {i}")) for i, p in enumerate(wanted, 1)]
    holds = [F.when(text.rlike(p), F.lit(name)) for name, p in unwanted.items()]
    return F.array_compact(F.array(*lacks, *holds))
