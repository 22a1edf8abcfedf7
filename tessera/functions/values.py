"""Column functions on cells that are kept as text: gaps, vocabularies, numbers, licences, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as a gap, trimmed and in upper case.
GAPS = ("", "NAN", "NA", "N/A", "NONE", "NULL", "UNK", "UNKNOWN")
NOT_RECORDED = "not recorded"


def is_gap(value: Column) -> Column:
    return value.isNull() | F.upper(F.btrim(value)).isin(*GAPS)


def controlled(value: Column, allowed: list[str], gap_allowed: bool = True) -> Column:
    """The value of a controlled vocabulary, trimmed and in upper case; a gap becomes `not recorded`; null: not in the vocabulary."""
    known = F.upper(F.btrim(value))
    out = F.when(is_gap(value), F.lit(NOT_RECORDED) if gap_allowed else F.lit(None).cast("string"))
    return out.when(known.isin(*allowed), known)


def must_be(value: Column, allowed: list[str], gap_allowed: bool = True) -> Column:
    """controlled(), but a value outside the vocabulary (or a gap where none is allowed) stops the step if the column is read; only_allowed() always does."""
    known = controlled(value, allowed, gap_allowed)
    return F.when(known.isNull(), F.raise_error(F.concat(F.lit("not in the vocabulary: "), F.coalesce(value, F.lit("null")))).cast("string")).otherwise(known)


def holds(test: Column, otherwise: Column) -> Column:
    """True where `test` holds; elsewhere, also where it is null, the step stops with the text `otherwise`.

    For where(): a filter stays in the plan when a check inside a column goes with the column.
    """
    return F.when(test, True).otherwise(F.raise_error(otherwise).cast("boolean"))


def only_allowed(df: DataFrame, column: str, allowed: list[str], gap_allowed: bool = True) -> DataFrame:
    """`df` with controlled() values of `column`; a value outside the vocabulary stops the step, whatever of the result is read."""
    known = controlled(F.col(column), allowed, gap_allowed)
    told = F.concat(F.lit("not in the vocabulary: "), F.coalesce(column, F.lit("null")))
    return df.where(holds(known.isNotNull(), told)).withColumn(column, known)


def number(value: Column) -> Column:
    return F.btrim(value).try_cast("double")


def age_flag(value: Column) -> Column:
    """Why an age is implausible (not a whole number, or outside 0 to 120); null if it isn't, or is a gap."""
    n = F.btrim(value).try_cast("int")
    return F.when(is_gap(value), F.lit(None).cast("string")).when(n.isNull(), "not a whole number").when((n < 0) | (n > 120), "outside 0 to 120")


def size_flag(value: Column) -> Column:
    """Why a diameter is implausible; null if it isn't, or is a gap."""
    n = F.btrim(value).try_cast("double")
    return F.when(is_gap(value), F.lit(None).cast("string")).when(n.isNull(), "not a number").when(n == 0, "zero").when(n < 0, "negative")


def licence_kind(licence: Column) -> Column:
    v = F.lower(licence)
    return (
        F.when(v.contains("publicdomain/zero") | v.contains("cc0"), "CC0")
        .when(v.contains("/by-nc"), "CC BY-NC (any)")
        .when(v.contains("creativecommons.org/licenses/by"), "CC BY (any, no NC)")
        .when(F.coalesce(licence, F.lit("")) == "", "not stated")
        .otherwise(F.concat(F.lit("other: "), licence))
    )


def natural_key(uid: Column) -> Column:
    """Sort key of ids like 12-3: the parts in order, numbers by value and before words."""
    return F.transform(F.split(uid, "-"), lambda p: F.struct(F.when(p.rlike("^[0-9]+$"), 0).otherwise(1).alias("word"), F.coalesce(p.try_cast("long"), F.lit(0)).alias("n"), F.when(p.rlike("^[0-9]+$"), "").otherwise(p).alias("s")))


def question_of(path: Column) -> Column:
    """The path without what follows its last dot."""
    return F.regexp_replace(path, r"\.[^.]*$", "")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)[^\w.-]", "_")


def percent(share: Column) -> Column:
    """A share as a percentage with one digit, ties to even; `-` for none."""
    return F.coalesce(F.format_string("%.1f", F.bround(share * 100, 1)), F.lit("-"))
