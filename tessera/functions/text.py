"""Column functions on text: words, shingles, sentences, figures and years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: British spellings and the American ones.
SPELLING = (("naev", "nev"), ("haem", "hem"), ("oedem", "edem"), ("seborrhoe", "seborrhe"), ("tumour", "tumor"), ("oesophag", "esophag"))
#: Plurals that the rules miss.
IRREGULAR = {"nevi": "nevus", "lentigines": "lentigo"}
#: Short forms after which a full stop ends no sentence.
ABBREVIATIONS = ("e.g.", "i.e.", "dr.", "mr.", "mrs.", "ms.", "vs.", "approx.", "fig.", "figs.", "no.", "al.", "st.", "ca.")
_LONGEST = max(map(len, ABBREVIATIONS))


def plain_words(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def singular(word: Column) -> Column:
    n = F.length(word)
    out = F
    for plural, one in IRREGULAR.items():
        out = out.when(word == plural, one)
    return (
        out.when(word.endswith("oses") & (n > 6), F.concat(F.left(word, n - 4), F.lit("osis")))
        .when(word.endswith("ies") & (n > 5), F.concat(F.left(word, n - 3), F.lit("y")))
        .when(word.endswith("s") & ~(word.endswith("ss") | word.endswith("is") | word.endswith("us")) & (n > 3), F.left(word, n - 1))
        .otherwise(word)
    )


def tokens(text: Column) -> Column:
    """Words in order: lower case, no possessive, American spelling, singular."""
    t = F.regexp_replace(F.replace(F.lower(text), F.lit("’"), F.lit("'")), r"(?U)'s\b", "")
    for british, american in SPELLING:
        t = F.replace(t, F.lit(british), F.lit(american))
    return F.transform(F.regexp_extract_all(t, F.lit("([a-z0-9]+)"), F.lit(1)), singular)


def name_key(text: Column) -> Column:
    """The words of a name in sorted order: spelling, order, plural and punctuation don't matter."""
    return F.array_join(F.sort_array(tokens(text)), " ")


def shingles(words: Column, n: int) -> Column:
    """Runs of n words, each joined by blanks, with repeats; none where there are fewer words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Sentences, cut after . ! ? before white space and a capital, digit, bracket or quote, unless the stop ends a short form."""
    parts = F.split(text, r"(?<=[.!?])(?U:\s+)(?=[A-Z0-9(\[\"'“])")
    ends_short = lambda s: F.lower(F.regexp_extract(F.right(s, F.lit(_LONGEST + 1)), r"([^\s(\[\"'“]*)$", 1)).isin(*ABBREVIATIONS)
    # Joined by a blank after a short form and else by a line end, then cut again: a list that grows sentence by sentence would be copied for each.
    marked = F.array_join(F.transform(parts, lambda s: F.concat(s, F.when(ends_short(s), " ").otherwise("\n"))), "")
    return F.split(F.regexp_replace(marked, r"[ \n]\z", ""), r"(?<=[.!?])\n(?=[A-Z0-9(\[\"'“])")


def word_count(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def first_year(text: Column) -> Column:
    """The first 19xx or 20xx that follows no digit; empty if there is none."""
    return F.regexp_extract(text, r"(?<!\d)((?:19|20)\d\d)", 1)


def cited_figures(text: Column) -> Column:
    """Numbers of the figures that a text cites."""
    return F.regexp_extract_all(text, F.lit(r"(?i)\bfig(?:ure)?s?\.?\s*(\d+)"), F.lit(1))


def contains_phrase(words: Column, phrase: str) -> Column:
    """Whether the words of the phrase stand together, in order."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(f" {phrase} ")


def short_list(values: Column, n: int = 10) -> Column:
    """The first n distinct values in order, and how many more there are."""
    all_ = F.sort_array(F.array_distinct(values))
    more = F.when(F.size(all_) > n, F.concat(F.lit(", and "), (F.size(all_) - n).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.array_join(F.slice(all_, 1, n), ", "), more)


def normalised_answer(text: Column) -> Column:
    """Lower case, without marks, a leading `answer:`, and white space or stops at the ends; white space is one blank."""
    t = F.regexp_replace(F.lower(F.btrim(text)), r"[*_`]+", "")
    t = F.regexp_replace(F.btrim(t), r"^(final\s+)?(diagnosis|answer)\s*:\s*", "")
    return F.regexp_replace(F.btrim(t, F.lit(" \t\r\n\"'-.")), r"(?U)\s+", " ")
