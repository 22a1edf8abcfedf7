"""Queries on tables of text cells, joins and reports, and their SQL.

The clinical records stand in customers: an id, a nation (the lesion), a segment (the label), and cells with gaps made by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import values
from tessera.functions.text import first_year
from tessera.operators import profile, reports
from tessera.operators.graph import first_of_each
from tessera.plans.registry import Registry
from tessera.sources.tables import read, running

registry = Registry()
query = registry.query
CELLS = ["balance", "nation", "segment", "age", "size"]

RECORDS = """records AS (SELECT c_custkey AS id, c_nationkey AS owner, c_mktsegment AS label,
    CASE WHEN c_custkey % 7 = 0 THEN ' na ' ELSE floor(c_acctbal)::BIGINT::VARCHAR END AS balance, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey::VARCHAR END AS nation,
    CASE WHEN c_custkey % 13 = 0 THEN 'Unknown' ELSE lower(c_mktsegment) END AS segment, CASE WHEN c_custkey % 17 = 0 THEN 'old' ELSE (c_custkey % 140 - 5)::VARCHAR END AS age,
    CASE WHEN c_custkey % 19 = 0 THEN '' ELSE (c_custkey % 9 - 2)::VARCHAR END AS size FROM customer)"""
GAP = "coalesce(upper(trim({0})) IN ('', 'NAN', 'NA', 'N/A', 'NONE', 'NULL', 'UNK', 'UNKNOWN'), true)"
UNPIVOT = f"""cells AS (SELECT id, owner, label, k AS "column", v AS value FROM (SELECT id, owner, label, unnest(['balance', 'nation', 'segment', 'age', 'size']) AS k, unnest([balance, nation, segment, age, size]) AS v FROM records))"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_nationkey").alias("owner"), F.col("c_mktsegment").alias("label"),
        F.when(k % 7 == 0, " na ").otherwise(F.floor("c_acctbal").cast("long").cast("string")).alias("balance"),
        F.when(k % 11 != 0, F.col("c_nationkey").cast("string")).alias("nation"), F.when(k % 13 == 0, "Unknown").otherwise(F.lower("c_mktsegment")).alias("segment"),
        F.when(k % 17 == 0, "old").otherwise((k % 140 - 5).cast("string")).alias("age"), F.when(k % 19 == 0, "").otherwise((k % 9 - 2).cast("string")).alias("size"),
    )


@query(f"""WITH {RECORDS}, {UNPIVOT}, c AS (SELECT "column", value, count(*) AS n, {GAP.format("value")} AS gap FROM cells GROUP BY ALL),
s AS (SELECT "column", sum(n) FILTER (NOT gap)::BIGINT AS filled, coalesce(sum(n) FILTER (gap), 0)::BIGINT AS empty, count(*) AS distinct, bool_and(gap OR try_cast(value AS DOUBLE) IS NOT NULL) AS numbers FROM c GROUP BY 1)
SELECT "column", filled, empty, "distinct", CASE WHEN numbers AND "distinct" > 20 THEN 'numbers' WHEN "distinct" <= 20 THEN 'values' ELSE 'not listed' END AS kind,
    CASE WHEN numbers AND "distinct" > 20 THEN (SELECT min(try_cast(value AS DOUBLE)) FROM cells x WHERE x."column" = s."column" AND NOT {GAP.format("value")}) END AS low,
    CASE WHEN numbers AND "distinct" > 20 THEN (SELECT median(try_cast(value AS DOUBLE)) FROM cells x WHERE x."column" = s."column" AND NOT {GAP.format("value")}) END AS median,
    CASE WHEN numbers AND "distinct" > 20 THEN (SELECT max(try_cast(value AS DOUBLE)) FROM cells x WHERE x."column" = s."column" AND NOT {GAP.format("value")}) END AS high,
    CASE WHEN "distinct" <= 20 THEN (SELECT string_agg(value || '=' || n, '; ' ORDER BY n DESC, value) FROM c WHERE c."column" = s."column") END AS listed FROM s""".replace("AS distinct", 'AS "distinct"'))
def A01_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_profile(records(spark, sf_dir), CELLS)


@query(f"""WITH {RECORDS}, {UNPIVOT}, o AS (SELECT "column", max(n) AS n FROM (SELECT "column", owner, count(DISTINCT coalesce(value, '')) AS n FROM cells GROUP BY ALL) GROUP BY 1),
l AS (SELECT "column", max(n) AS n FROM (SELECT "column", owner, label, count(DISTINCT coalesce(value, '')) AS n FROM cells GROUP BY ALL) GROUP BY 1)
SELECT "column", CASE WHEN o.n = 1 THEN 'owner' WHEN l.n = 1 THEN 'lesion' ELSE 'row' END AS level FROM o JOIN l USING ("column")""")
def A02_column_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_levels(records(spark, sf_dir), [("owner", ["owner"]), ("lesion", ["owner", "label"])], CELLS, "row")


@query("""SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY 1""")
def A03_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().na.fill(0)


@query("SELECT n AS rows, count(*) AS owners FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def A05_histogram_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("rows")).groupBy("rows").agg(F.count("*").alias("owners"))


@query(f"""WITH {RECORDS}, p AS (SELECT label, list_filter([{", ".join(f"CASE WHEN {GAP.format(c)} THEN '{c}' END" for c in CELLS)}], lambda x: x IS NOT NULL) AS p FROM records)
SELECT array_to_string(p, ',') AS pattern, count(*) AS n, count(DISTINCT label) AS labels FROM p GROUP BY 1 ORDER BY n DESC, pattern LIMIT 8""")
def A06_gap_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.gap_patterns(records(spark, sf_dir), CELLS, "label")


@query(f"""WITH {RECORDS}, n AS (SELECT label, {" + ".join(f"(NOT {GAP.format(c)})::INTEGER" for c in CELLS)} AS n FROM records) SELECT label, round(avg(n), 9) AS mean, min(n) AS least, max(n) AS most FROM n GROUP BY 1""")
def A07_filled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.filled_fields(records(spark, sf_dir), CELLS, "label").withColumn("mean", F.round("mean", 9))


@query("""SELECT sha256(text) AS sha, count(*) AS n, count(DISTINCT source) = 1 AS same_source, count(DISTINCT lang || '/' || source) = 1 AS same_both FROM documents GROUP BY 1 HAVING count(*) > 1""")
def A08_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha"), "source", "lang")
    return profile.duplicate_groups(docs, "sha", {"source": ["source"], "both": ["lang", "source"]})


@query(f"""WITH {RECORDS}, {UNPIVOT} SELECT owner, "column", array_to_string(list_sort(list(DISTINCT value)), '|') AS values FROM cells WHERE "column" IN ('nation', 'segment') AND NOT {GAP.format("value")} GROUP BY ALL HAVING count(DISTINCT value) > 1""")
def A10_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.disagreements(records(spark, sf_dir), "owner", ["nation", "segment"])


@query("""WITH r AS (SELECT p_brand AS brand, p_size::DOUBLE AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
q AS (SELECT *, unnest([1, 2, 3]) AS q FROM r), p AS (SELECT *, greatest(1, least(n - 1, floor(q * (n + 1) / 4))) AS lo FROM q),
s AS (SELECT brand, q, sum(CASE WHEN r = lo THEN v * (1 - (q * (n + 1) / 4 - lo)) WHEN r = lo + 1 THEN v * (q * (n + 1) / 4 - lo) END) AS x FROM p WHERE n > 1 GROUP BY ALL)
SELECT brand, round(max(x) FILTER (q = 1), 6) AS q1, round(max(x) FILTER (q = 2), 6) AS q2, round(max(x) FILTER (q = 3), 6) AS q3 FROM s GROUP BY 1""")
def A14_exclusive_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.exclusive_quartiles(read(spark, sf_dir, "part").withColumnRenamed("p_brand", "brand"), "p_size", "brand")
    return out.select("brand", *[F.round(q, 6).alias(q) for q in ("q1", "q2", "q3")])


@query("""WITH f AS (SELECT lang, CASE WHEN length(text) < 200 THEN 'too short' WHEN contains(text, '@') THEN 'holds an address' WHEN contains(lower(text), 'license') THEN 'holds a licence' ELSE 'kept' END AS reason FROM documents)
SELECT coalesce(lang, 'all') AS lang, reason, count(*) AS n FROM f GROUP BY ROLLUP (reason, lang) HAVING reason IS NOT NULL""")
def A15_A17_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return reports.funnel(read(spark, sf_dir, "documents"), "lang", {"too short": F.length(t) < 200, "holds an address": t.contains("@"), "holds a licence": F.lower(t).contains("license")})


@query("""WITH d AS (SELECT lang, contains(text, 'license') OR contains(text, 'License') AS tagged, length(text) > 1500 AS truth FROM documents)
SELECT lang, count(*) AS n, round(count(*) FILTER (tagged AND truth) / nullif(count(*) FILTER (truth), 0), 9) AS recall, round(count(*) FILTER (tagged AND truth) / nullif(count(*) FILTER (tagged), 0), 9) AS precision,
    round(avg(truth::INTEGER), 9) AS base_rate, round(count(*) FILTER (tagged AND truth) / nullif(count(*) FILTER (tagged), 0) / avg(truth::INTEGER), 9) AS lift FROM d GROUP BY 1""")
def A19_tag_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    out = reports.tag_agreement(read(spark, sf_dir, "documents"), ["lang"], t.contains("license") | t.contains("License"), F.length(t) > 1500)
    return out.select("lang", "n", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "base_rate", "lift")])


@query("""SELECT lang, array_to_string(list_sort(list(DISTINCT source)), '; ') AS sources, count(*) FILTER (doc_id % 10 < 6) AS train, count(*) FILTER (doc_id % 10 = 6) AS val, count(*) FILTER (doc_id % 10 > 6) AS test FROM documents GROUP BY 1""")
def A25_index_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("doc_id") % 10
    found = reports.index_by_class(read(spark, sf_dir, "documents"), "lang", "source", {"train": part < 6, "val": part == 6, "test": part > 6})
    return found.withColumn("sources", F.array_join("values", "; ")).drop("values")


@query("SELECT lang, doc_id, n::INTEGER AS place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || doc_id)) AS n FROM documents) WHERE n <= 10")
def A30_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.hash_sample(read(spark, sf_dir, "documents"), "lang", "doc_id", "7", 10)


@query(f"""WITH {RECORDS} SELECT id, {GAP.format("balance")} AS gap, CASE WHEN {GAP.format("segment")} THEN 'not recorded' WHEN upper(trim(segment)) IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN upper(trim(segment)) END AS segment,
    CASE WHEN {GAP.format("age")} THEN NULL WHEN try_cast(age AS INTEGER) IS NULL THEN 'not a whole number' WHEN try_cast(age AS INTEGER) NOT BETWEEN 0 AND 120 THEN 'outside 0 to 120' END AS age_flag,
    CASE WHEN {GAP.format("size")} THEN NULL WHEN size::DOUBLE = 0 THEN 'zero' WHEN size::DOUBLE < 0 THEN 'negative' END AS size_flag, try_cast(trim(balance) AS DOUBLE) AS number FROM records""")
def P01_P07_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select(
        "id", values.is_gap(F.col("balance")).alias("gap"), values.controlled(F.col("segment"), ["BUILDING", "MACHINERY", "HOUSEHOLD"]).alias("segment"),
        values.age_flag(F.col("age")).alias("age_flag"), values.size_flag(F.col("size")).alias("size_flag"), values.number(F.col("balance")).alias("number"),
    )


@query(f"""WITH {RECORDS} SELECT id, 'segment' AS "column", segment AS old, 'machines' AS new FROM records WHERE segment = 'machinery'""")
def P05_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = records(spark, sf_dir)
    after = before.withColumn("segment", F.when(F.col("segment") == "machinery", "machines").when(values.is_gap(F.col("segment")), values.NOT_RECORDED).otherwise(F.col("segment")))
    return profile.change_log(before, after, "id", CELLS)


@query("""SELECT page_id, regexp_replace(url, '\\.[^.]*$', '') AS question, coalesce(nullif(regexp_extract(url, '(^|[^0-9])((19|20)[0-9][0-9])', 2), ''), '') AS year,
    regexp_replace(url, '[^\\p{L}\\p{N}_.-]', '_', 'g') AS name,
    CASE WHEN contains(lower(url), 'cc0') THEN 'CC0' WHEN contains(lower(url), '/by-nc') THEN 'CC BY-NC (any)' ELSE 'other: ' || url END AS licence FROM pages""")
def P09_P20_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", values.question_of(u).alias("question"), first_year(u).alias("year"), values.safe_name(u).alias("name"), values.licence_kind(u).alias("licence"))


@query("""WITH t AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 9 <> 0), d AS (SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 8 <> 0)
SELECT doc_id, CASE WHEN d.h IS NULL THEN 'missing' WHEN t.h IS NULL THEN 'extra' WHEN t.h = d.h THEN 'same' ELSE 'changed' END AS state FROM t FULL JOIN d USING (doc_id)""")
def S22_J06_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    table = docs.where(i % 9 != 0).select("doc_id", F.sha2("text", 256).alias("h"))
    disk = docs.where(i % 8 != 0).select("doc_id", F.sha2(F.when(i % 4 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("h"))
    return profile.reconciled(table, disk, "doc_id", "h")


@query("SELECT source, sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint FROM (SELECT source, doc_id || chr(9) || lang AS line FROM documents) GROUP BY 1")
def S24_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("source", F.concat_ws("\t", F.col("doc_id").cast("string"), "lang").alias("line"))
    return lines.groupBy("source").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("fingerprint"))


@query("""WITH p AS (SELECT 'text used twice' AS problem, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)
SELECT * FROM p UNION ALL SELECT 'shorter than 20 characters', doc_id, 1 FROM documents WHERE length(text) < 20""")
def S23_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    twice = docs.groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    short = docs.where(F.length("text") < 20).select(F.lit("shorter than 20 characters").alias("problem"), F.col("doc_id").alias("first"), F.lit(1).cast("long").alias("n"))
    return twice.select(F.lit("text used twice").alias("problem"), "first", "n").unionByName(short)


@query("""SELECT doc_id, lang, coalesce(quality, -1)::INTEGER AS quality FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def J10_J17_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    kept = docs.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    return kept.join(labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("""WITH u AS (SELECT 'documents' AS origin, 1 AS place, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', 2, item_id, text FROM benchmark)
SELECT origin, id, row_number() OVER (PARTITION BY origin ORDER BY id)::INTEGER AS number FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY place, id) AS n FROM u) WHERE n = 1""")
def U02_A29_union_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = lambda table, key, place: read(spark, sf_dir, table).select(F.lit(table).alias("origin"), F.lit(place).alias("place"), F.col(key).alias("id"), F.sha2("text", 256).alias("sha"))
    both = tagged("documents", "doc_id", 1).unionByName(tagged("benchmark", "item_id", 2))
    first = first_of_each(both, ["sha"], [F.asc("place"), F.asc("id")])
    return running(first.select("origin", "id", F.lit(1).alias("one")), ["origin"], ["id"], "one", "number").select("origin", "id", F.col("number").cast("int").alias("number"))

@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT sum(n)::BIGINT AS cases, count(*) FILTER (n >= 200) AS classes, sum(n) >= 800 AND count(*) FILTER (n >= 200) >= 3 AS build FROM c""", also=("A21_go",))
def A21_go_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.go(read(spark, sf_dir, "documents"), "lang", 200, 3, 800)


@query("""SELECT md5(text) AS digest, min(lang) AS answer, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT lang) = 1 AND min(lang) <> 'en'""", also=("A23_same_wrong_answer",))
def A23_same_wrong_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = read(spark, sf_dir, "documents").select(F.md5("text").alias("digest"), F.lit("en").alias("truth"), F.col("lang").alias("answer"))
    return reports.same_wrong_answer(answers, "digest")


@query("""WITH s AS (SELECT lang, source, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL)
SELECT lang, source, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, first) AS place FROM s) WHERE place <= 6""", also=("A34_most_common",))
def A34_most_common_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.most_common(read(spark, sf_dir, "documents"), "lang", "source", "doc_id", 6)
