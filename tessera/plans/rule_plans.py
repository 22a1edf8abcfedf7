"""Queries on the rules of titles and case texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import plain_words
from tessera.operators import rules
from tessera.operators.dictionary import step
from tessera.plans.registry import Registry
from tessera.sources.tables import read

registry = Registry()
query = registry.query

WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
PADDED = f"' ' || array_to_string({WORDS}, ' ') || ' '"
TERMS = [("license", "license", "yes"), ("license", "apache license", "yes"), ("public", "general public license", "yes"), ("rights", "all rights reserved", "no"), ("rights", "public license", "no"), ("mood", "pathetic loser", "yes"), ("mood", "idiot", "yes")]


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, "class string, term string, counts string")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text and the plain words of each document."""
    return step(read(spark, sf_dir, "documents").select("doc_id", "text"), "w", plain_words(F.col("text")))


@query("""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Case 2. A ' || doc_id % 90 || '-year-old man and a ' || (doc_id % 7 + 20) || ' year old Danish lady.' ELSE 'Case 1: a ' || doc_id % 90 || ' yr-old boy' || CASE WHEN doc_id % 5 = 0 THEN '; both patients' ELSE '' END END AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 90 <> doc_id % 7 + 20 THEN 2 ELSE 1 END::INTEGER AS ages, doc_id % 5 = 0 AND doc_id % 3 <> 0 OR doc_id % 3 = 0 AND doc_id % 90 <> doc_id % 7 + 20 AS several FROM t""")
def T20_ages_and_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    two = F.concat(F.lit("Case 2. A "), i % 90, F.lit("-year-old man and a "), i % 7 + 20, F.lit(" year old Danish lady."))
    one = F.concat(F.lit("Case 1: a "), i % 90, F.lit(" yr-old boy"), F.when(i % 5 == 0, "; both patients").otherwise(""))
    t = F.when(i % 3 == 0, two).otherwise(one)
    return read(spark, sf_dir, "documents").select("doc_id", F.size(rules.ages(t)).alias("ages"), rules.several_patients(t).alias("several"))


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
d AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: w[i : i + 2] = ['all', 'rights', 'reserved']) AS three, list_filter(range(1, len(w) + 1), lambda i: w[i : i + 1] = ['apache', 'license']) AS two FROM w),
c AS (SELECT doc_id, len(w) AS n, list_distinct(flatten([list_transform(three, lambda i: i), list_transform(three, lambda i: i + 1), list_transform(three, lambda i: i + 2), list_transform(two, lambda i: i), list_transform(two, lambda i: i + 1)])) AS gone FROM d)
SELECT doc_id, n - len(gone) AS n FROM c""")
def T21_without_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rules.without_phrases(F.col("w"), ["all rights reserved", "apache license"])
    return words(spark, sf_dir).select("doc_id", F.size(kept).cast("long").alias("n"))


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), i AS (SELECT doc_id, w, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'license')) AS i FROM w),
n AS (SELECT doc_id, len(list_filter(range(greatest(1, i - 6), i), lambda j: w[j] IN ('under', 'no'))) = 0 AND len(list_filter(range(greatest(1, i - 7), i - 1), lambda j: w[j] = 'subject' AND w[j + 1] = 'to')) = 0 AS free FROM i)
SELECT doc_id, coalesce(bool_or(free), false) AS named FROM w LEFT JOIN n USING (doc_id) GROUP BY 1""")
def T23_named_not_negated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("doc_id", rules.named_not_negated(F.col("w"), ["license"], ["under", "no", "subject to"]).alias("named"))


@query(f"""SELECT doc_id, regexp_matches({PADDED}, ' ((license|licenses|licensees) (apache|apaches|apachees)|(apache|apaches|apachees) (license|licenses|licensees)|(idiot|idiots|idiotes)) ') AS named FROM documents""")
def T24_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", rules.names_a_variant(F.col("text"), ["Apache License", "idiot"]).alias("named"))


@query("""SELECT doc_id, trim(CASE WHEN doc_id % 3 = 0 THEN text || ' ' || lang ELSE text || ' ' || source || ' ' || lang END) AS part FROM documents""")
def T26_case_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = lambda label, text: F.struct(label.cast("string").alias("label"), text.alias("text"))
    case = F.col("doc_id") % 3 == 0
    sections = F.array(section(F.when(case, "CASE REPORT"), F.col("text")), section(F.lit("METHODS"), F.col("source")), section(F.when(case, "The patient"), F.col("lang")))
    return read(spark, sf_dir, "documents").select("doc_id", rules.case_part(sections, "(?i)case|patient").alias("part"))


@query(f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN contains({PADDED}, ' apache license ') THEN 'apache license' END, CASE WHEN contains({PADDED}, ' idiot ') THEN 'idiot' END, CASE WHEN regexp_matches(text, '\\bMIT\\b') THEN 'MIT' END], lambda x: x IS NOT NULL), '; ') AS found FROM documents""")
def T31_diagnosis_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.diagnosis_words(F.col("text"), ["apache license", "idiot"], ["MIT"])
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(found, "; ").alias("found"))


@query("""SELECT p_partkey, 'Name: ' || p_name || chr(10) || 'Brand {x} $1 \\: ' || p_brand || '.' AS prompt FROM part""")
def P14_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = "Name: {name}\n{brand}."
    values = {"name": F.col("p_name"), "brand": F.concat(F.lit("Brand {x} $1 \\: "), F.col("p_brand"))}
    return read(spark, sf_dir, "part").select("p_partkey", rules.filled(template, values).alias("prompt"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN p_size || ' year; 3 month' ELSE p_size || ' year' END AS age FROM part""")
def P17_age_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    value = F.when(F.col("p_size") % 4 == 1, F.concat(F.lit("[["), n, F.lit('.0, "year"], [3, "month"]]'))).when(F.col("p_size") % 4 != 0, F.concat(F.lit("[["), n, F.lit(', "year"]]')))
    return read(spark, sf_dir, "part").select("p_partkey", rules.age_list(value).alias("age"))


@query("""WITH v AS (SELECT p_partkey, (p_size - 25) / 64 AS d, p_size / 64 AS lo, CASE WHEN p_size % 5 <> 0 THEN (p_size + 3) / 64 END AS hi, p_size / 20000 AS p FROM part)
SELECT p_partkey, printf('%+.1f', round_even(d * 100, 1)) || ' points' AS points, CASE WHEN hi IS NULL THEN '-' ELSE printf('%.1f', round_even(lo * 100, 1)) || '–' || printf('%.1f', round_even(hi * 100, 1)) END AS ends,
    CASE WHEN p < 0.001 THEN '< 0.001' ELSE printf('%.3f', round_even(p, 3)) END AS p FROM v""")
def P21_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    ends = rules.interval_text(n / 64, F.when(n % 5 != 0, (n + 3) / 64))
    return read(spark, sf_dir, "part").select("p_partkey", rules.points((n - 25) / 64).alias("points"), ends.alias("ends"), rules.p_text(n / 20000).alias("p"))


@query()
def T09_T11_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = rules.TitleLists(marks={"a place": ["commercial use"]}, looks_like=["all"], bare=["license"], endings=("ense",), lesions=("idiot",))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "text")
    found = rules.judged(docs, terms(spark), lists, {"mood": ["LO"]})
    return found.select("doc_id", "judged.class", F.array_join("judged.named", "; ").alias("named"), F.array_join("judged.marks", "; ").alias("marks"), "judged.full_names", "judged.short_names")


@query(f"""SELECT doc_id, len(list_filter({WORDS}, lambda w: w IN ('license', 'licenses', 'mit', 'mits') OR starts_with(w, 'copyright'))) > 0 OR regexp_matches(text, '\\bGNUs?\\b') AS says FROM documents""")
def T13_T14_T16_says(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = rules.names_class(read(spark, sf_dir, "documents").select("doc_id", "text"), terms(spark), "license", ["MIT"], cues=["copyright"])
    return named.select("doc_id", rules.says(F.col("names"), F.col("text"), F.array(F.lit("GNU"))).alias("says"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ApL' ELSE 'GNUL' END AS short_forms FROM documents WHERE doc_id % 3 <> 2")
def T15_short_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, each with a sentence that defines a short form of the class, or of something else."""
    i, t = F.col("doc_id"), F.concat("text", F.lit(" . "))
    text = F.concat(t, F.when(i % 3 == 0, " the Apache License (ApL), used").when(i % 3 == 1, " GNULs (the license)").otherwise(" XYZ (other)"))
    found = rules.defined_short_forms(read(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "doc_id", terms(spark), "license")
    return found.select("doc_id", F.array_join("short_forms", "; ").alias("short_forms"))


@query(f"""WITH w AS (SELECT doc_id, list_transform({WORDS}, lambda x: CASE WHEN x IN ('alls', 'rights', 'reserveds', 'generals', 'publics', 'licenses') THEN left(x, -1) ELSE x END) AS w FROM documents),
f AS (SELECT doc_id, len(list_filter(range(1, len(w) - 1), lambda i: list_sort(w[i : i + 2]) = ['all', 'reserved', 'right'])) > 0 AS rights,
    len(list_filter(range(1, len(w)), lambda i: list_sort(w[i : i + 1]) = ['license', 'public'] AND list_sort(w[greatest(i - 1, 1) : i + 1]) <> ['general', 'license', 'public'] AND list_sort(w[i : i + 2]) <> ['general', 'license', 'public'])) > 0 AS public FROM w)
SELECT doc_id, concat_ws('; ', CASE WHEN rights THEN 'all rights reserved' END, CASE WHEN public THEN 'public license' END) AS conditions FROM f""")
def T30_other_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.other_conditions(read(spark, sf_dir, "documents").select("doc_id", "text"), terms(spark))
    return found.select("doc_id", F.array_join("conditions", "; ").alias("conditions"))
