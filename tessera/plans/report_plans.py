"""Queries on counts, keys and joins of the reports, and their SQL.

Where an operator compares two tables, the second is made from the first by a rule on ids, as the test tables hold one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import short_list
from tessera.operators import constraints, joins, reports
from tessera.operators.overlap import linked_members
from tessera.plans.registry import Registry
from tessera.sources.tables import placed, read

registry = Registry()
query = registry.query


@query("SELECT lang, count(*) AS texts, count(DISTINCT source) AS sources, count(DISTINCT (source, doc_id % 7)) AS lesions FROM documents GROUP BY 1")
def A04_P08_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lesion = F.struct("source", (F.col("doc_id") % 7).alias("n"))
    return reports.distinct_counts(read(spark, sf_dir, "documents"), ["lang"], {"sources": F.col("source"), "lesions": lesion}, "texts")


@query("SELECT l_partkey AS part, count(DISTINCT l_suppkey) AS owners FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def A09_shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.shared_keys(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), "l_suppkey"), "part", "l_suppkey")


@query("""WITH f AS (SELECT lang, unnest(list_filter([CASE WHEN length(text) < 200 THEN 'short' END, CASE WHEN contains(text, '@') THEN 'address' END, CASE WHEN contains(text, '###') THEN 'marks' END], lambda x: x IS NOT NULL)) AS reason FROM documents)
SELECT reason, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM f GROUP BY 1""")
def A11_A16_flags_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return reports.flags_by_class(read(spark, sf_dir, "documents"), "lang", ["de", "en", "es", "fr"], {"short": F.length(t) < 200, "address": t.contains("@"), "marks": t.contains("###")})


@query("""SELECT lang, count(*) AS total, count(*) FILTER (source IN ('src0', 'src1')) AS first_origin, count(*) FILTER (source NOT IN ('src0', 'src1')) AS other_origin, count(DISTINCT text) AS texts, count(*) >= 110 AS meets FROM documents GROUP BY 1""")
def A18_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("lang", "source", F.sha2("text", 256).alias("sha"))
    return reports.coverage(docs, "lang", F.col("source").isin("src0", "src1"), "sha", 110)


@query("""WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, n_chars AS upper_median FROM r WHERE r = n // 2 + 1""")
def A22_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.upper_median(read(spark, sf_dir, "documents"), "source", "n_chars")


@query("""WITH g AS (SELECT text, count(*) AS n, count(DISTINCT source) AS owners, count(DISTINCT lang) AS classes FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT count(*) AS groups, sum(n)::BIGINT AS members, (sum(n) FILTER (owners = 1))::BIGINT AS within_one, (sum(n) FILTER (owners > 1))::BIGINT AS across, coalesce(sum(n) FILTER (classes > 1), 0)::BIGINT AS mixed FROM g""")
def A24_identical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha"), "source", "lang")
    return reports.identical_groups(docs, "sha", "source", "lang")


@query("""WITH f AS (SELECT lang, source, min(doc_id) AS first FROM documents GROUP BY ALL) SELECT lang, string_agg(source, '; ' ORDER BY first) AS sources FROM f GROUP BY 1""")
def A26_U04_by_first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.by_first_appearance(read(spark, sf_dir, "documents"), "lang", "source", "doc_id")
    return found.select("lang", F.array_join("values", "; ").alias("sources"))


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256('0:' || doc_id), doc_id) AS place FROM documents", also=("A31_hash_order",))
def A31_hash_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.sha2(F.concat(F.lit("0:"), F.col("doc_id").cast("string")), 256)
    return placed(read(spark, sf_dir, "documents").select("doc_id"), h, F.col("doc_id"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT (SELECT count(*) FROM a SEMI JOIN b USING (k)) AS both, (SELECT count(*) FROM a ANTI JOIN b USING (k)) AS only_a, (SELECT count(*) FROM b ANTI JOIN a USING (k)) AS only_b""")
def U03_key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return reports.key_sets(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), "o_custkey")


@query("""SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def J01_J08_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers, nations = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_mktsegment", "n_name")


@query("""WITH k AS (SELECT doc_id, source, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT doc_id, source, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS class,
    CASE WHEN text IS NULL OR source IS NULL THEN 0 ELSE count(source) OVER (PARTITION BY text) - count(source) OVER (PARTITION BY text, source) END AS n_links FROM k""")
def J04_linked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled document with its class of equal texts and the number of its links, which are to members of other sources: a row a document, not a row a pair."""
    known = joins.only(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ["doc_id"])
    return linked_members(known, "doc_id", "source").select(F.col("k").alias("doc_id"), F.col("g").alias("source"), "class", "n_links")


@query("""WITH a AS (SELECT doc_id AS q, source AS g, lang FROM documents WHERE doc_id % 6 <> 0), b AS (SELECT doc_id AS q, CASE WHEN doc_id % 25 = 0 THEN 'other' ELSE source END AS g, lang FROM documents WHERE doc_id % 10 <> 0 AND lang <> 'fr')
SELECT q::VARCHAR AS item, CASE WHEN b.g IS NULL THEN 'only in the first' WHEN a.g IS NULL THEN 'only in the second' ELSE 'another group' END AS problem FROM a FULL JOIN b USING (q) WHERE b.g IS NULL OR a.g IS NULL OR a.g <> b.g
UNION ALL SELECT lang, 'the answer option is only in the first' FROM (SELECT DISTINCT lang FROM a) ANTI JOIN b USING (lang)""")
def J18_view_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, i = read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "q"), F.col("q")
    b = docs.where((i % 10 != 0) & (F.col("lang") != "fr")).withColumn("source", F.when(i % 25 == 0, "other").otherwise(F.col("source")))
    return constraints.view_problems(docs.where(i % 6 != 0), b, "q", "source", "lang")


@query("SELECT source, lang, n_chars, count(*) AS runs, min(doc_id) AS first FROM documents GROUP BY ALL HAVING count(*) > 1")
def J28_two_runs_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("source", "lang", "n_chars").agg(F.count("*").alias("runs"), F.min("doc_id").alias("first")).where("runs > 1")


@query("""SELECT p_partkey, p_retailprice / p_size AS ratio, CASE upper(p_brand) WHEN 'BRAND#11' THEN 'BRAND#1' ELSE upper(p_brand) END AS brand FROM part""")
def P04_P13_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = reports.respelled(F.col("p_brand"), {"BRAND#11": "BRAND#1"})
    return read(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / F.col("p_size")).alias("ratio"), brand.alias("brand"))


@query("""SELECT o_custkey, min(year(o_orderdate)) || '–' || max(year(o_orderdate)) AS span FROM orders GROUP BY 1""")
def P23_year_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate")
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat(F.min(year).cast("string"), F.lit("–"), F.max(year).cast("string")).alias("span"))


@query("""WITH s AS (SELECT lang, list_sort(list(DISTINCT source)) AS s FROM documents GROUP BY 1)
SELECT lang, array_to_string(s[1:3], ', ') || CASE WHEN len(s) > 3 THEN ', and ' || (len(s) - 3) || ' more' ELSE '' END AS examples FROM s""")
def P22_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.collect_set("source").alias("s")).select("lang", short_list(F.col("s"), 3).alias("examples"))


@query("""SELECT o_custkey, CASE WHEN min(year(o_orderdate)) = max(year(o_orderdate)) THEN min(year(o_orderdate))::VARCHAR ELSE min(year(o_orderdate)) || '–' || max(year(o_orderdate)) END AS span FROM orders GROUP BY 1""")
def P23_year_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.year_span(read(spark, sf_dir, "orders"), "o_custkey", F.year("o_orderdate"))


@query("""WITH s AS (SELECT lang, list_sort(list(DISTINCT source)) AS s FROM documents GROUP BY 1)
SELECT lang, array_to_string(list_concat(list_filter(['src3', 'none', 'src1'], lambda x: list_contains(s, x)), list_filter(s, lambda x: NOT list_contains(['src3', 'none', 'src1'], x))), '; ') AS sources FROM s""")
def U04_in_class_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.index_by_class(read(spark, sf_dir, "documents"), "lang", "source", {})
    return found.select("lang", F.array_join(reports.in_class_order(F.col("values"), ["src3", "none", "src1"]), "; ").alias("sources"))
