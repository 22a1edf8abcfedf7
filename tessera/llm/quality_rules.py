"""Quality rules: a decision list learned from labelled statistics of texts, by column functions alone.

Sequential covering: a rule grows, condition by condition, on two thirds of the labelled rows (the threshold of largest
information gain first), is pruned on the last third, and the rows that it covers go before the next rule is learned. The
list is applied as one ordered conditional expression. Every count of a step is a Spark aggregate over the bounded sample.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

#: A word is a run of anything but these white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: The list is learned from so many labelled rows at most: those of smallest hash.
MAX_ROWS = 20_000
#: Thresholds tried for each statistic, conditions of a rule, and rules of a list.
THRESHOLDS, MOST_CONDITIONS, MOST_RULES = 32, 4, 12
#: A rule is taken if so large a share of the rows it covers, of those it was not grown on, is bad, and if it covers so many bad ones there.
LEAST_PRECISION, LEAST_COVERED = 0.9, 3
#: Names of the statistics that conditions are about.
STATISTICS = ("words", "word_length", "symbols_per_word", "marks_per_word", "capitals_per_letter", "digits_per_letter", "distinct_per_word", "repeats_per_word", "repeated_lines", "words_per_line")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with `value` computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more: windows meet by hash, those that meet are compared themselves."""
    window = lambda i: F.array_join(F.slice(words, i, 3), " ")  # noqa: E731  words hold no blanks
    hashed = lambda: F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))
    same = lambda rows, j, x, field: F.coalesce(F.get(rows, j)[field] == x[field], F.lit(False))
    met = lambda rows, field: F.filter(rows, lambda x, j: same(rows, j - 1, x, field) | same(rows, j + 1, x, field))  # noqa: E731  beside an equal one
    numbered = lambda hashes: F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))
    exact = lambda rows: bound(F.sort_array(F.transform(rows, lambda x: F.struct(window(x["i"]).alias("w"), x["i"].alias("i")))), lambda own: met(own, "w"))
    starts = lambda hashes: bound(bound(numbered(hashes), lambda rows: met(rows, "h")), lambda rows: F.sort_array(F.transform(exact(rows), lambda x: x["i"])))
    covered = lambda s: F.aggregate(F.transform(s, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(s, j + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda t, x: t + x)
    twice = lambda hashes: F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), bound(starts(hashes), covered)).otherwise(0)
    return F.when(F.size(words) >= 4, bound(hashed(), twice)).otherwise(0).cast("long")


def measured(docs: DataFrame, text: str = "text", out: str = "measures") -> DataFrame:
    """Add struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, more): counts of the whole text, and `more`, counts that only statistics use.

    A null or blank text counts 0 everywhere.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    lines = F.filter(F.split(t, "\n"), lambda line: F.rlike(line, F.lit(WORD)))
    of_lines = bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("lines"), F.size(F.array_distinct(x)).cast("long").alias("distinct_lines")))
    chars = lambda w: F.length(F.array_join(w, ""))
    of_words = bound(
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(F.size(w).cast("long").alias("words"), chars(w).cast("long").alias("chars"), F.size(F.array_distinct(w)).cast("long").alias("distinct_words"), _repeated_words(w).alias("repeated")),
    )
    of_letters = bound(F.regexp_replace(t, r"[^\p{L}]+", ""), lambda x: F.struct(F.length(x).cast("long").alias("letters"), F.regexp_count(x, F.lit(r"\p{Lu}")).cast("long").alias("capitals")))
    whole = F.struct(of_lines.alias("l"), of_words.alias("w"), of_letters.alias("a"), count(f"[{SYMBOLS}]").alias("symbols"), count(r"\p{Nd}").alias("digits"))
    more = lambda s: F.struct((s["w"]["chars"] - s["a"]["letters"] - s["digits"]).alias("marks"), s["a"]["letters"].alias("letters"), s["a"]["capitals"].alias("capitals"), s["digits"].alias("digits"), s["w"]["distinct_words"].alias("distinct_words"), s["l"]["lines"].alias("lines"))
    made = bound(whole, lambda s: F.struct(s["w"]["words"].alias("n_words"), s["w"]["chars"].alias("word_chars"), s["symbols"].alias("n_symbols"), (s["l"]["lines"] - s["l"]["distinct_lines"]).alias("n_dup_lines"), s["w"]["repeated"].alias("n_repeat_words"), more(s).alias("more")))
    return docs.withColumn(out, made)


def statistics(m: Column) -> list[Column]:
    """The values of STATISTICS from measures; null where they are shares of nothing."""
    share = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    n, more = m["n_words"], m["more"]
    return [n.cast("double"), share(m["word_chars"], n), share(m["n_symbols"], n), share(more["marks"], n), share(more["capitals"], more["letters"]), share(more["digits"], more["letters"]),
            share(more["distinct_words"], n), share(m["n_repeat_words"], n), share(m["n_dup_lines"], more["lines"]), share(n, more["lines"])]


@dataclass(frozen=True)
class Condition:
    """A statistic that reaches a threshold, or (above: False) stays below it. A null statistic fits no condition."""

    statistic: int
    threshold: float
    above: bool

    def column(self, values: list[Column]) -> Column:
        v = values[self.statistic]
        return F.coalesce(v >= self.threshold if self.above else v < self.threshold, F.lit(False))

    def __str__(self) -> str:
        return f"{STATISTICS[self.statistic]} {'>=' if self.above else '<'} {self.threshold:.6g}"


#: Conditions that must all hold.
Rule = tuple[Condition, ...]


def fits(rule: Rule, values: list[Column]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column(values)
    return out


def _grown(rows: DataFrame, values: list[Column], cuts: list[list[float]]) -> Rule:
    """Conditions of largest gain one after another, until no good row is left in, nothing gains, or there are MOST_CONDITIONS."""
    rule: Rule = ()
    reached = lambda v, c: F.when(v.isNotNull(), F.size(F.filter(F.array(*map(F.lit, c)).cast("array<double>"), lambda t: t <= v)))  # noqa: E731  how many thresholds
    place = F.array(*[reached(v, c) for v, c in zip(values, cuts, strict=True)])
    while len(rule) < MOST_CONDITIONS:
        inside = rows.where(fits(rule, values)).select("bad", F.posexplode(place).alias("s", "b")).where("b IS NOT NULL")
        cells = inside.groupBy("s", "b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
        upto = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy("s")
        sums = cells.select("s", "b", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"below_{c}") for c in "pn"], *[F.sum(c).over(whole).alias(f"all_{c}") for c in "pn"])
        sides = sums.select("s", "b", "all_p", "all_n", F.explode(F.array(F.struct(F.lit(False).alias("above"), F.col("below_p").alias("p"), F.col("below_n").alias("n")), F.struct(F.lit(True).alias("above"), (F.col("all_p") - F.col("below_p")).alias("p"), (F.col("all_n") - F.col("below_n")).alias("n")))).alias("x")).select("*", "x.*")
        purity = lambda p, n: F.log2(F.col(p) / (F.col(p) + F.col(n)))
        gain = F.col("p") * (purity("p", "n") - purity("all_p", "all_n"))
        # A first cell below which nothing lies has no threshold; whole counts leave out rows without the statistic, so a gain is over those that have it.
        best = sides.where("b > 0 AND p > 0").withColumn("gain", F.round(gain, 9)).where("gain > 0").orderBy(F.desc("gain"), "s", "b", "above").first()
        if best is None:
            break
        rule += (Condition(best["s"], cuts[best["s"]][best["b"] - 1], best["above"]),)
        if not best["n"]:
            break
    return rule


def _plain(rule: Rule) -> Rule:
    """Without conditions that a later, tighter one of the same statistic and side makes idle."""
    return tuple(c for i, c in enumerate(rule) if not any((c.statistic, c.above) == (x.statistic, x.above) for x in rule[i + 1 :]))


def _pruned(rows: DataFrame, values: list[Column], rule: Rule) -> Rule | None:
    """The first conditions of a rule that do best on rows it was not grown on; None if they don't do well enough."""
    begun = [rule[: i + 1] for i in range(len(rule))]
    counts = rows.agg(*[F.count_if(fits(r, values) & (F.col("bad") if bad else ~F.col("bad"))).alias(f"c{i}_{int(bad)}") for i, r in enumerate(begun) for bad in (True, False)]).first() if begun else ()
    best = None
    for i, r in enumerate(begun):
        p, n = counts[2 * i], counts[2 * i + 1]
        if p >= LEAST_COVERED and p >= LEAST_PRECISION * (p + n) and (best is None or (p - n) / (p + n) > best[0]):
            best = (p - n) / (p + n), r
    return best and best[1]


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> list[Rule]:
    """Rules for texts that `labels` marks 0 (bad) against those it marks 1, in the order in which they are to be tried.

    Rows with a null label, key or text teach nothing; a key marked both ways counts as good. At most `max_rows` keys, and
    of rows that repeat keys twice as many, are learned from, in one task; fewer labels give fewer rules, one class alone none.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("__key")).agg((F.max(label) == 0).alias("bad"))
    sample = marks.orderBy(F.xxhash64("__key"), "__key").limit(max_rows)
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    found = texts.join(F.broadcast(sample), "__key")  # max_rows rows of a key and a flag
    values = measured(found, "__text", "m").select("bad", F.xxhash64("__key", "__text").alias("h"), F.array(*statistics(F.col("m"))).alias("v"))
    rows = written(values.orderBy("h", "bad", "v").limit(2 * max_rows)).coalesce(1)
    columns = [F.col("v")[i] for i in range(len(STATISTICS))]
    shares = [i / (THRESHOLDS + 1) for i in range(1, THRESHOLDS + 1)]
    # Thresholds follow the values of bad and of good rows, so that a rare kind of either has some of its own.
    spread = rows.groupBy("bad").agg(*[F.percentile_approx(c, F.array(*map(F.lit, shares)), 10_000).alias(f"q{i}") for i, c in enumerate(columns)]).collect()  # two rows
    cuts = [sorted({x for r in spread for x in (r[f"q{i}"] or ())}) for i in range(len(columns))]
    pruning = F.pmod("h", F.lit(3)) == 2
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        left = rows.where(~F.coalesce(_any(rules, columns), F.lit(False)))
        rule = _pruned(left.where(pruning), columns, _grown(left.where(~pruning), columns, cuts))
        if rule is None:
            break
        rules.append(_plain(rule))
    return rules


def _any(rules: list[Rule], values: list[Column]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | fits(r, values)
    return out


def decided(measures: Column, rules: list[Rule]) -> Column:
    """The text of the first rule that fits, null if none does: an ordered conditional expression."""
    values, out = statistics(measures), F.when(F.lit(False), F.lit(""))
    for rule in rules:
        out = out.when(fits(rule, values), F.lit(" and ".join(map(str, rule))))
    return out


def judge_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", least_words: int = 50, most_repeated: int = 50, max_rows: int = MAX_ROWS) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean) and rule (string) for each whole text.

    base_failed: fewer than `least_words` words, or more than `most_repeated` percent of them in repeated windows of three.
    kept: neither that, nor does a learned rule fit; `rule` is the one that does. Null and blank texts count 0 and fail.
    Repeated rows are judged alike; an empty table gives no rows, no labels give no rules. Columns of these names are replaced.
    """
    rules = learn(docs.select(key, text), labels, key, text, label, max_rows)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    keep = [c for c in docs.columns if c not in (*counts, "base_failed", "kept", "rule")]
    packed = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"))
    found = measured(packed.withColumn("text", F.col("row")[text]), "text", "m").select("row", F.explode(F.array("m")).alias("m"))  # computed once for all rules
    failed = (F.col("m.n_words") < least_words) | (100 * F.col("m.n_repeat_words") > most_repeated * F.col("m.n_words"))
    judged = found.select("row", *[F.col("m")[c].alias(c) for c in counts], failed.alias("base_failed"), decided(F.col("m"), rules).alias("rule"))
    return judged.select("row.*", *counts, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
