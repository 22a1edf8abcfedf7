"""Queries on joins that reconcile two tables, and their SQL.

The second table is made from the first by a rule on ids, as the test tables hold one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import values
from tessera.operators import joins, overlap
from tessera.plans.registry import Registry
from tessera.sources.tables import read

registry = Registry()
query = registry.query


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", *columns)


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def J02_without_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.without(documents(spark, sf_dir, "lang"), read(spark, sf_dir, "labels").where("quality = 0"), ["doc_id"])


@query("SELECT doc_id, quality, toxic, lang FROM labels JOIN documents USING (doc_id) WHERE quality = 0")
def J03_dropped_with_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    drops = read(spark, sf_dir, "labels").where("quality = 0").select("doc_id", "quality", "toxic")
    return joins.totally_joined(drops, documents(spark, sf_dir, "lang"), ["doc_id"])


@query("""WITH a AS (SELECT doc_id FROM documents WHERE doc_id % 13 <> 0), b AS (SELECT doc_id FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 40 = 1)
SELECT doc_id, 'only in the first' AS problem FROM a ANTI JOIN b USING (doc_id) UNION ALL SELECT DISTINCT doc_id, 'only in the second' FROM b ANTI JOIN a USING (doc_id)
UNION ALL SELECT doc_id, 'twice in the second' FROM b GROUP BY 1 HAVING count(*) > 1""")
def J05_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return joins.join_problems(docs.where(F.col("doc_id") % 13 != 0), docs.where(F.col("doc_id") % 11 != 0).unionByName(docs.where(F.col("doc_id") % 40 == 1)), ["doc_id"])


@query("SELECT doc_id, lang, source, upper(lang) = upper(l2) AS agrees FROM documents JOIN (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'xx' ELSE lang END AS l2 FROM documents) USING (doc_id)")
def J07_all_must_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = documents(spark, sf_dir, "lang").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "xx").otherwise(F.col("lang")).alias("l2"))
    return joins.totally_joined(documents(spark, sf_dir, "lang", "source"), other, ["doc_id"]).select("doc_id", "lang", "source", (F.upper("lang") == F.upper("l2")).alias("agrees"))


@query("""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 30 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 45 = 0 THEN 'none' ELSE source END AS source FROM documents)
SELECT doc_id, 'another lang' AS problem FROM documents a JOIN b USING (doc_id) WHERE a.lang <> b.lang UNION ALL SELECT doc_id, 'another source' FROM documents a JOIN b USING (doc_id) WHERE a.source <> b.source""")
def J09_equal_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "lang", "source")
    flags = docs.withColumn("lang", F.when(F.col("doc_id") % 30 == 0, "xx").otherwise(F.col("lang"))).withColumn("source", F.when(F.col("doc_id") % 45 == 0, "none").otherwise(F.col("source")))
    return joins.join_problems(docs, flags, ["doc_id"], ["lang", "source"])


@query("SELECT conv_id, turn, length(text) AS n, role FROM conversations JOIN (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn % 2 = 0) USING (conv_id, turn)")
def J11_on_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return joins.only(turns, turns.where("turn % 2 = 0"), ["conv_id", "turn"]).select("conv_id", "turn", F.length("text").alias("n"), "role")


@query("""SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_linenumber = 2 AND b.l_orderkey = lineitem.l_orderkey AND b.l_partkey = lineitem.l_partkey AND b.l_suppkey = lineitem.l_suppkey)""")
def J12_without_on_three_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    lines = read(spark, sf_dir, "lineitem")
    return joins.without(lines.select(*keys), lines.where("l_linenumber = 2"), keys)


@query("SELECT documents.doc_id, lang, quality, labels.doc_id IS NOT NULL AS found FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id")
def J13_unmatched_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.matched(documents(spark, sf_dir, "lang"), read(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"])


@query("SELECT doc_id, source FROM documents WHERE text NOT IN (SELECT text FROM benchmark)")
def J14_without_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda table, *c: read(spark, sf_dir, table).select(*c, F.sha2("text", 256).alias("sha"))
    return joins.without(digest("documents", "doc_id", "source"), digest("benchmark"), ["sha"]).select("doc_id", "source")


@query("""WITH a AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 17 <> 0), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 23 = 0 THEN text || ' ' ELSE text END) AS sha FROM documents WHERE doc_id % 19 <> 0)
SELECT doc_id, CASE WHEN b.sha IS NULL THEN 'only in the first' WHEN a.sha IS NULL THEN 'only in the second' ELSE 'another sha' END AS problem FROM a FULL JOIN b USING (doc_id) WHERE a.sha IS DISTINCT FROM b.sha""")
def J15_equal_keys_and_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "text")
    a = docs.where(F.col("doc_id") % 17 != 0).select("doc_id", F.sha2("text", 256).alias("sha"))
    b = docs.where(F.col("doc_id") % 19 != 0).select("doc_id", F.sha2(F.when(F.col("doc_id") % 23 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("sha"))
    return joins.join_problems(a, b, ["doc_id"], ["sha"])


@query("SELECT doc_id, source FROM documents WHERE text IN (SELECT text FROM documents WHERE doc_id % 10 = 7) AND doc_id % 10 <> 7")
def J16_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    return joins.only(docs.where(F.col("doc_id") % 10 != 7), docs.where(F.col("doc_id") % 10 == 7), ["sha"]).select("doc_id", "source")


@query("SELECT doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 25")
def S15_first_of_each_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.first_per_class(documents(spark, sf_dir, "lang", "n_chars"), ["lang"], [F.desc("n_chars"), F.asc("doc_id")], 25)


@query("""WITH v AS (SELECT 'P' || doc_id // 7 AS name, (doc_id * 37 % 11)::INTEGER AS version, doc_id FROM documents), p AS (SELECT *, name || '.' || version || '/' || doc_id || '.json' AS path FROM v)
SELECT name, max(version) AS version, arg_max(path, (version, path)) AS path FROM p GROUP BY 1""")
def S16_latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("P"), F.floor(F.col("doc_id") / 7).cast("string"))
    path = F.concat(name, F.lit("."), (F.col("doc_id") * 37 % 11).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".json"))
    return joins.latest_versions(documents(spark, sf_dir).select(path.alias("path")))


@query("SELECT doc_id, md5(text) AS hash, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE length(text) END::INTEGER AS size FROM documents")
def S20_recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "text").withColumn("hash", F.md5("text"))
    cache = rows.where(F.col("doc_id") % 3 == 0).select("doc_id", "hash", F.lit(-1).alias("size"))
    found = joins.recomputed(rows, cache, ["doc_id", "hash"], lambda df: df.withColumn("size", F.length("text")))
    return found.select("doc_id", "hash", "size")


@query("SELECT doc_id AS id, md5(text) AS digest, 'documents' AS origin FROM documents UNION ALL SELECT item_id, md5(text), 'benchmark' FROM benchmark")
def U01_union_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda table, key: read(spark, sf_dir, table).select(F.col(key).alias("id"), F.md5("text").alias("digest"))
    return joins.union_tagged({"documents": of("documents", "doc_id"), "benchmark": of("benchmark", "item_id")})


@query("""WITH r AS (SELECT c_nationkey AS dataset, c_mktsegment AS model, c_custkey AS run, CASE WHEN c_custkey % 4 = 0 THEN 'complete' ELSE 'running' END AS status FROM customer)
SELECT dataset, model, CASE WHEN count(*) = 1 THEN max(run) END AS run, CASE WHEN count(*) > 1 THEN count(*) || ' finished runs' END AS problem FROM r WHERE status = 'complete' GROUP BY ALL""")
def J28_finished_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("c_custkey") % 4 == 0, "complete").otherwise("running")
    runs = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("dataset"), F.col("c_mktsegment").alias("model"), F.col("c_custkey").alias("run"), status.alias("status"))
    return joins.finished_runs(runs, ["dataset", "model"], "run")


PICTURES = """pictures AS (SELECT vec_id AS id, list_sum([CASE WHEN embedding[i] > 0 THEN (1::HUGEINT << (i - 1)) ELSE 0 END FOR i IN range(1, 65)])::HUGEINT AS code,
    [(vec_id % 7)::DOUBLE, (vec_id % 5)::DOUBLE, 3.0::DOUBLE] AS colour, 600 + vec_id % 4 AS width, 400 AS height FROM embeddings)"""
LOOK = """bit_count(xor(a.code, b.code)) <= 16 AND abs(a.width * b.height - b.width * a.height) <= 0.02::DOUBLE * b.width * a.height
    AND sqrt(((a.colour[1] - b.colour[1]) ** 2 + (a.colour[2] - b.colour[2]) ** 2 + (a.colour[3] - b.colour[3]) ** 2) / 3) <= {colour}"""


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").select(i.alias("id"), overlap.sign_code(F.col("embedding")).alias("code"), F.array((i % 7).cast("double"), (i % 5).cast("double"), F.lit(3.0)).alias("colour"), (600 + i % 4).alias("width"), F.lit(400).alias("height"))


@query(f"WITH {PICTURES} SELECT a.id AS a, b.id AS b, bit_count(xor(a.code, b.code))::INTEGER AS bits FROM pictures a JOIN pictures b ON a.id < b.id AND {LOOK.format(colour=2.0)}")
def J25_same_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pictures(spark, sf_dir)
    return joins.same_pictures(p, p, "id", most_colour=2.0).where("a < b")


@query(f"WITH {PICTURES} SELECT a.id AS a, b.id AS b, bit_count(xor(a.code, b.code))::INTEGER AS bits FROM pictures a JOIN pictures b ON a.id % 2 = 0 AND b.id % 2 <> 0 AND {LOOK.format(colour=9.0)}")
def J26_picture_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pictures(spark, sf_dir)
    return joins.same_pictures(p.where("id % 2 = 0"), p.where("id % 2 <> 0"), "id", most_colour=9.0)


@query("""WITH p AS (SELECT vec_id AS id, 25 + vec_id % 60 AS psnr, vec_id % 9 AS own, vec_id % 13 + 3 AS other, 3900000 + vec_id % 70 * 2000 AS bytes FROM embeddings)
SELECT id, 'not like its original' AS fault FROM p WHERE psnr < 30 UNION ALL SELECT id, 'another picture is as near' FROM p WHERE own >= other UNION ALL SELECT id, 'too large' FROM p WHERE bytes > 4000000""")
def I05_picture_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    made = read(spark, sf_dir, "embeddings").select(i.alias("id"), (25 + i % 60).alias("psnr"), (i % 9).alias("own_distance"), (i % 13 + 3).alias("nearest_other"), (3_900_000 + i % 70 * 2_000).alias("bytes"))
    return joins.picture_faults(made, "id")


@query("""SELECT 'text used twice' AS "check", md5(text) AS item FROM documents GROUP BY text HAVING count(*) > 1 UNION ALL SELECT 'label without a document', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'page without a scheme', page_id::VARCHAR FROM pages WHERE NOT contains(url, '://') UNION ALL SELECT 'a role that is not known', conv_id || ' ' || turn FROM conversations WHERE role NOT IN ('user', 'assistant')""")
def O09_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, pages, turns = (read(spark, sf_dir, t) for t in ("documents", "labels", "pages", "conversations"))
    return joins.violations({
        "text used twice": docs.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n")).where("n > 1").select("digest"),
        "label without a document": joins.without(labels, docs, ["doc_id"]).select("doc_id"),
        "page without a scheme": pages.where(~F.contains("url", F.lit("://"))).select("page_id"),
        "a role that is not known": turns.where("role NOT IN ('user', 'assistant')").select("conv_id", "turn"),
    })


@query("""SELECT c_custkey, CASE WHEN c_custkey % 8 = 0 THEN 'none' ELSE c_mktsegment END AS found FROM customer WHERE c_custkey % 8 = 0 OR c_mktsegment <> 'BUILDING'""")
def N03_wrong_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 8 != 0, F.col("c_mktsegment")).alias("format"))
    return joins.wrong_formats(cards, "c_custkey", "format", "BUILDING")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'not recorded' ELSE upper(c_mktsegment) END AS segment FROM customer""")
def P03_controlled_or_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.when(F.col("c_custkey") % 6 != 0, F.concat(F.lit(" "), F.lower("c_mktsegment"))).otherwise("n/a")
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return values.only_allowed(read(spark, sf_dir, "customer").select("c_custkey", cell.alias("segment")), "segment", segments)
