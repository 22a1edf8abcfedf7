"""Queries on words, sentences, passages, dictionaries and answers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.functions.values import natural_key
from tessera.operators import answers, dictionary, passages
from tessera.plans.registry import Registry
from tessera.sources.tables import placed, read

registry = Registry()
query = registry.query

PLAIN = "regexp_replace(replace(lower(text), '’', ''''), '''s\\b', '', 'g')"
for british, american in fn.SPELLING:
    PLAIN = f"replace({PLAIN}, '{british}', '{american}')"
SINGULAR = """CASE WHEN w = 'nevi' THEN 'nevus' WHEN w = 'lentigines' THEN 'lentigo' WHEN w LIKE '%oses' AND length(w) > 6 THEN left(w, -4) || 'osis'
    WHEN w LIKE '%ies' AND length(w) > 5 THEN left(w, -3) || 'y' WHEN w LIKE '%s' AND NOT (w LIKE '%ss' OR w LIKE '%is' OR w LIKE '%us') AND length(w) > 3 THEN left(w, -1) ELSE w END"""
#: The possessive rule knows letters of all languages; the SQL's knows a-z alone, so texts with an apostrophe before other letters are left to the tests.
TOKENS = f"SELECT doc_id, list_transform(regexp_extract_all({PLAIN}, '[a-z0-9]+'), lambda w: {SINGULAR}) AS words FROM documents"
SENTENCES = r"""cut AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9(\["''“])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM documents)"""
ROWS = f"{SENTENCES}, rows AS (SELECT doc_id, unnest(s) AS sentence, unnest(range(len(s))) AS pos FROM cut)"


@query(f"WITH t AS ({TOKENS}) SELECT doc_id, len(words)::INTEGER AS n, md5(array_to_string(words, ' ')) AS digest FROM t")
def T01_T02_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(fn.tokens(F.col("text")))).alias("w"))
    return words.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@query(f"WITH t AS ({TOKENS.replace('documents', '(SELECT p_partkey AS doc_id, p_name AS text FROM part)')}) SELECT doc_id AS p_partkey, array_to_string(list_sort(words), ' ') AS key FROM t")
def T03_name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", fn.name_key(F.col("p_name")).alias("key"))


@query("""SELECT doc_id, contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ', ' apache license ') AS found FROM documents""")
def T08_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(fn.plain_words(F.col("text")))).alias("w"))
    return words.select("doc_id", fn.contains_phrase(F.col("w"), "apache license").alias("found"))


SHORT = ", ".join(f"'{x}'" for x in fn.ABBREVIATIONS)
#: Sentences with the rule on short forms: a piece after one that ends with a short form belongs to the sentence before.
MERGED = f"""{SENTENCES}, pieces AS (SELECT doc_id, unnest(s) AS piece, unnest(range(len(s))) AS i FROM cut),
starts AS (SELECT *, lower(regexp_extract(lag(piece) OVER (PARTITION BY doc_id ORDER BY i), '([^\\s(\\["''“]*)$', 1)) IN ({SHORT}) AS joined FROM pieces),
numbered AS (SELECT *, sum(CASE WHEN coalesce(joined, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM starts),
sentences AS (SELECT doc_id, pos, string_agg(piece, ' ' ORDER BY i) AS sentence FROM numbered GROUP BY ALL)"""


@query(f"WITH {MERGED} SELECT doc_id, count(*)::INTEGER AS n, md5(string_agg(sentence, '|' ORDER BY pos)) AS digest FROM sentences GROUP BY 1")
def T12_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(fn.sentences(F.col("text")))).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split without the rule on short forms, as the SQL does."""
    marked = F.split("text", r"(?<=[.!?])\s+(?=[A-Z0-9(\[\"'“])")
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(marked).alias("pos", "sentence"))


@query(f"""WITH {ROWS}, w AS (SELECT doc_id, contains(lower(sentence), 'license') AS cue, max(contains(sentence, ' and ')::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS named FROM rows)
SELECT doc_id, bool_or(cue AND named = 1) AS confirmed FROM w GROUP BY 1""")
def T22_window_confirms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sentence")
    return passages.window_confirms(sentences(spark, sf_dir), "doc_id", F.lower(s).contains("license"), s.contains(" and "))


@query(f"""WITH {ROWS}, w AS (SELECT doc_id, contains(sentence, ' by ') AS here, max(contains(sentence, ' are ')::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM rows)
SELECT doc_id, bool_or(here AND near = 1) AS holds FROM w GROUP BY 1""")
def T18_T19_neighbour_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sentence")
    return passages.neighbour_rule(sentences(spark, sf_dir), "doc_id", s.contains(" by "), s.contains(" are "))


@query(f"""WITH {MERGED}, m AS (SELECT doc_id, pos, sentence, contains(lower(sentence), 'license') AS r, contains(sentence, ' is ') AS s FROM sentences),
f AS (SELECT doc_id, coalesce(min(pos) FILTER (s), 0) AS start, count(*) AS n FROM m GROUP BY 1),
g AS (SELECT f.doc_id, n, CASE WHEN count(*) FILTER (r AND pos < start) > 0 THEN any_value(start) ELSE 0 END AS first FROM f JOIN m USING (doc_id) GROUP BY ALL),
h AS (SELECT g.doc_id, first, coalesce(min(pos) FILTER (r AND pos >= first), any_value(n)) AS last FROM g JOIN m USING (doc_id) GROUP BY ALL)
SELECT h.doc_id, coalesce(string_agg(sentence, ' ' ORDER BY pos) FILTER (pos >= first AND pos < last), '') AS question FROM h JOIN m USING (doc_id) GROUP BY 1""")
def T17_prefix_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.prefix_cut(read(spark, sf_dir, "documents"), "doc_id", "text", lambda s: F.lower(s).contains("license"), lambda s: s.contains(" is "))


@query("""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents), n AS (SELECT doc_id, list_sum([contains(t, x)::INTEGER FOR x IN ['license', 'copyright', 'rights', 'permission']])::INTEGER AS terms,
    contains(t, 'apache') AS a, contains(t, 'mit license') AS m, contains(t, 'gnu') AS g FROM t)
SELECT doc_id, terms, CASE WHEN a::INTEGER + m::INTEGER + g::INTEGER = 1 THEN CASE WHEN a THEN 'apache' WHEN m THEN 'mit' ELSE 'gnu' END END AS kind FROM n""")
def T28_T29_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    kinds = {"apache": "(?i)apache", "mit": "(?i)mit license", "gnu": "(?i)gnu"}
    return read(spark, sf_dir, "documents").select("doc_id", dictionary.term_counts(t, ["license", "copyright", "rights", "permission"]).alias("terms"), dictionary.only_kind(t, kinds).alias("kind"))


@query("""WITH c AS (SELECT doc_id, text, list_filter([CASE WHEN NOT contains(text, 'the') THEN 'lacks 1' END, CASE WHEN contains(text, '@') THEN 'address' END, CASE WHEN contains(text, '###') THEN 'marks' END], lambda x: x IS NOT NULL) AS r FROM documents)
SELECT doc_id, array_to_string(r, '; ') AS reasons, len(r) = 0 AS kept FROM c""")
def T27_I07_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    why = dictionary.reasons(F.col("text"), ["the"], {"address": "@", "marks": "###"})
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(why, "; ").alias("reasons"), (F.size(why) == 0).alias("kept"))


@query()
def T06_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [("licence", "license", "yes"), ("licence", "apache license", "yes"), ("gnu", "gnu general public license", "yes"), ("insult", "idiot", "yes"), ("insult", "pathetic loser", "yes"), ("rights", "all rights reserved", "no")]
    terms = spark.createDataFrame(names, "class string, term string, counts string")
    found = dictionary.named(read(spark, sf_dir, "documents").select("doc_id", "text"), terms)
    return found.select("doc_id", F.to_json("named.classes").alias("classes"), F.array_join("named.others", "; ").alias("others"))


@query("SELECT doc_id, id, row_number() OVER (ORDER BY n, source, doc_id) AS place FROM (SELECT doc_id, source, doc_id % 50 AS n, doc_id % 50 || '-' || source AS id FROM documents)", also=("P18_natural_order",))
def P18_natural_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", (F.col("doc_id") % 50).cast("string"), "source").alias("id"))
    return placed(ids, natural_key(F.col("id")), F.col("doc_id"))


@query()
def N09_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = passages.passages(read(spark, sf_dir, "documents"), ["doc_id"])
    return cut.select("doc_id", "pos", "words", F.sha2("passage", 256).alias("sha"))


@query()
def N11_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = passages.library(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", [F.asc("doc_id")])
    return made.select("doc_id", "number", "words", "sha")


@query()
def N01_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, q = F.col("event_id"), F.lit('"')
    ranked = F.concat(q, F.col("event_type"), F.lit('", "other", "'), F.when(k % 7 == 0, "other").otherwise("none"), q)
    body = F.concat(F.lit('{"differential": ['), ranked, F.lit('], "evidence_sufficient": "'), F.when(k % 5 == 0, "maybe").otherwise(" Yes "), F.lit('", "reason": "r", "claims": [{"statement": "s"}], "evidence": []'), F.when(k % 11 == 0, ', "more": 1}').otherwise("}"))
    events = read(spark, sf_dir, "events").select("event_id", F.when(k % 13 == 0, F.col("props")).otherwise(body).alias("answer"))
    labels = ["click", "purchase", "view", "signup", "other", "none"]
    return answers.read_answers(events, labels).select("event_id", "invalid", "read.diagnosis", "read.evidence_sufficient")
