"""Strict reading of answers in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The keys of an answer.
KEYS = ("differential", "evidence_sufficient", "reason", "claims", "evidence")
_FORM = "differential array<string>, evidence_sufficient string, reason string, claims array<struct<statement: string, evidence: array<string>>>, evidence array<string>"


def _kind(v: Column, path: str) -> Column:
    """Type of what stands at a path of a variant: STRING, ARRAY<...>, OBJECT<...>, ...; null if nothing does."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _first_unknown(items: Column, ids: Column) -> Column:
    return F.try_element_at(F.filter(items, lambda e: ~F.array_contains(ids, e)), F.lit(1))


def read_answers(df: DataFrame, labels: list[str], text: str = "answer", evidence_ids: Column | None = None, differential: int = 3, most_claims: int = 3) -> DataFrame:
    """Add struct(diagnosis, differential, evidence_sufficient, reason, claims) and invalid: why an answer can't be read, by the first rule that it breaks.

    Forgiven: white space and a code fence around the object, case and spacing of class names and of yes and no, and a claim
    without evidence. Null and blank answers are empty answers.
    """
    ids = evidence_ids if evidence_ids is not None else F.array().cast("array<string>")
    size = min(differential, len(labels))
    body = F.regexp_replace(F.regexp_replace(F.btrim(F.col(text), F.lit(" \t\r\n")), r"(?is)^```(?:json)?\s*(.*?)\s*```$", "$1"), r"^\s+|\s+$", "")
    rows = df.withColumn("__body", body).withColumn("__v", F.try_parse_json(F.concat(F.lit("["), "__body", F.lit("]")))).withColumn("__a", F.from_json("__body", _FORM))
    # What follows the object, if anything does, breaks the list that holds it or makes it longer.
    alone = F.try_variant_get(F.col("__v"), "$[1]", "variant").isNull()
    v, a = F.when(alone, F.try_variant_get(F.col("__v"), "$[0]", "variant")), F.col("__a")
    keys = F.coalesce(F.json_object_keys("__body"), F.array().cast("array<string>"))
    missing, extra = F.array_sort(F.array_except(F.array(*map(F.lit, KEYS)), keys)), F.array_sort(F.array_except(keys, F.array(*map(F.lit, KEYS))))
    told = F.array_join(F.concat(F.transform(missing, lambda k: F.concat(F.lit("missing key "), k)), F.transform(extra, lambda k: F.concat(F.lit("key not asked for: "), k))), "; ")
    plain = lambda s: F.regexp_replace(F.btrim(F.lower(s), F.lit(" \t\r\n")), r"\s+", " ")
    known = F.create_map(*[x for label in labels for x in (F.lit(" ".join(label.lower().split())), F.lit(label))])
    classes = F.transform(a["differential"], lambda d: known[plain(d)])
    outside = F.try_element_at(F.filter(a["differential"], lambda d: known[plain(d)].isNull()), F.lit(1))
    flag = F.lower(F.btrim(a["evidence_sufficient"], F.lit(" \t\r\n")))
    blank = lambda s: F.coalesce(F.btrim(s, F.lit(" \t\r\n")), F.lit("")) == ""
    strings = lambda path: F.coalesce(_kind(v, path).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))
    claims = F.try_variant_get(v, "$.claims", "array<variant>")
    claim_keys = lambda c: F.coalesce(F.json_object_keys(F.to_json(c)), F.array().cast("array<string>"))
    shape = F.forall(claims, lambda c: F.array_contains(claim_keys(c), "statement") & (F.size(F.array_except(claim_keys(c), F.array(F.lit("statement"), F.lit("evidence")))) == 0))
    spoken = F.forall(claims, lambda c: (F.coalesce(F.schema_of_variant(F.try_variant_get(c, "$.statement", "variant")), F.lit("")) == "STRING") & ~blank(F.try_variant_get(c, "$.statement", "string")))
    listed = F.forall(claims, lambda c: ~F.array_contains(claim_keys(c), "evidence") | F.coalesce(F.schema_of_variant(F.try_variant_get(c, "$.evidence", "variant")).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False)))
    cited = _first_unknown(F.flatten(F.transform(a["claims"], lambda c: F.coalesce(c["evidence"], F.array().cast("array<string>")))), ids)
    n = F.coalesce(F.size(claims), F.lit(-1))
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    rules = [
        (blank(F.col(text)), F.lit("empty answer")),
        (v.isNull() | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), F.lit("not one JSON object")),
        (told != "", told),
        (~strings("$.differential") | (F.coalesce(F.size(a["differential"]), F.lit(-1)) != size), F.lit(f"the differential is not a list of {size} class names")),
        (F.exists(classes, lambda c: c.isNull()), F.concat(F.lit("not a class of the list: "), quoted(outside))),
        (F.size(F.array_distinct(classes)) != size, F.lit("the differential names a class twice")),
        ((F.coalesce(_kind(v, "$.evidence_sufficient"), F.lit("")) != "STRING") | ~F.coalesce(flag.isin("yes", "no"), F.lit(False)), F.lit("evidence_sufficient is not yes or no")),
        ((F.coalesce(_kind(v, "$.reason"), F.lit("")) != "STRING") | blank(a["reason"]), F.lit("no reason given")),
        ((n < 1) | (n > most_claims), F.lit(f"claims is not a list of 1 to {most_claims} claims")),
        (~shape, F.lit("a claim must have the key statement, may have the key evidence, and no other")),
        (~spoken, F.lit("a claim has no statement")),
        (~listed, F.lit("a claim's evidence is not a list of passage ids")),
        (cited.isNotNull(), F.concat(F.lit("a claim relies on a passage the run did not give: "), quoted(cited))),
        (~strings("$.evidence"), F.lit("evidence is not a list of passage ids")),
        (_first_unknown(a["evidence"], ids).isNotNull(), F.concat(F.lit("evidence names a passage the run did not give: "), quoted(_first_unknown(a["evidence"], ids)))),
    ]
    why = F
    for broken, reason in rules:
        why = why.when(broken, reason)
    rows = rows.withColumn("invalid", why.otherwise(F.lit(None).cast("string")))
    good = F.struct(classes[0].alias("diagnosis"), classes.alias("differential"), flag.alias("evidence_sufficient"), F.btrim(a["reason"], F.lit(" \t\r\n")).alias("reason"), a["claims"].alias("claims"))
    return rows.withColumn("read", F.when(F.col("invalid").isNull(), good)).drop("__body", "__v", "__a")
