"""Queries on overlap, near copies, groups and splits, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph, overlap, splits
from tessera.plans.registry import Registry
from tessera.sources.tables import read

registry = Registry()
query = registry.query

RUNS = """SELECT DISTINCT {key}, {more} array_to_string(w[i : i + {n} - 1], ' ') AS run
    FROM (SELECT {key}, {more} w, unnest(range(1, len(w) - {n} + 2)) AS i FROM (SELECT {key}, {more} regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {table}))"""


def runs(table: str, key: str, n: int = 12, more: str = "") -> str:
    return RUNS.format(table=table, key=key, n=n, more=more)


@query(f"""
WITH d AS ({runs("documents", "doc_id")}), b AS ({runs("benchmark", "item_id")})
SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (run) GROUP BY ALL""")
def J20_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query(f"""
WITH d AS ({runs("documents", "doc_id")}), b AS ({runs("benchmark", "item_id")})
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM d WHERE run IN (SELECT run FROM b))""")
def J20_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.clean_of(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "item_id").select("doc_id", "source")


@query(f"""
WITH c AS (SELECT min(doc_id) AS doc_id, min(source) AS s1, max(source) AS s2 FROM documents GROUP BY text),
d AS (SELECT * FROM ({runs("documents", "doc_id")}) JOIN c USING (doc_id)), n AS (SELECT doc_id, count(*) AS size FROM d GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared, min(x.run) AS first_run FROM d x JOIN d y ON x.run = y.run AND x.doc_id <= y.doc_id AND (x.s1 <> x.s2 OR y.s1 <> y.s2 OR x.s1 <> y.s1) GROUP BY ALL)
SELECT a, b, shared, round(shared / least(m.size, n.size), 6) AS ratio, first_run FROM p JOIN n m ON m.doc_id = a JOIN n ON n.doc_id = b WHERE shared / least(m.size, n.size) >= 0.1""")
def J21_containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of equal texts, each by its smallest doc_id, and of a class with itself where its members are of several sources; J21_classes has the members."""
    return overlap.linked_classes(read(spark, sf_dir, "documents"), "doc_id", "source").withColumn("ratio", F.round("ratio", 6))


@query("SELECT doc_id, source, min(doc_id) OVER (PARTITION BY text) AS class FROM documents")
def J21_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.text_classes(read(spark, sf_dir, "documents"), "doc_id", "source").select(F.col("k").alias("doc_id"), F.col("g").alias("source"), "class")


CODES = "SELECT vec_id, label, list_sum([CASE WHEN embedding[i] > 0 THEN (1::HUGEINT << (i - 1)) ELSE 0 END FOR i IN range(1, 65)])::HUGEINT AS code FROM embeddings"
DISTANCE = "bit_count(xor(a.code, b.code))::INTEGER"


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", overlap.sign_code(F.col("embedding")).alias("code"))


@query(f"""
WITH c AS (SELECT min(vec_id) AS vec_id, code FROM ({CODES}) GROUP BY code) SELECT a.vec_id AS a, b.vec_id AS b, {DISTANCE} AS distance FROM c a JOIN c b ON a.vec_id < b.vec_id WHERE {DISTANCE} <= 16""")
def J23_hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of equal codes, each by its smallest vec_id; J23_classes has the members."""
    return overlap.near_codes(codes(spark, sf_dir), "vec_id", "code", 16)[0]


@query(f"WITH c AS ({CODES}) SELECT vec_id, min(vec_id) OVER (PARTITION BY code) AS class FROM c WHERE code IS NOT NULL")
def J23_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.code_classes(codes(spark, sf_dir), "vec_id", "code").select(F.col("k").alias("vec_id"), "class")


@query(f"""
WITH c AS ({CODES}) SELECT a.vec_id, min({DISTANCE})::INTEGER AS distance FROM c a JOIN c b ON a.vec_id <> b.vec_id GROUP BY 1""")
def J24_nearest_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = codes(spark, sf_dir)
    return overlap.nearest(c, c, "vec_id", "code", 1, codes=True).select("vec_id", F.col("distance").cast("int").alias("distance"))


@query(f"""
WITH c AS ({CODES}), d AS (SELECT a.vec_id, min({DISTANCE}) AS d FROM c a JOIN c b ON a.vec_id <> b.vec_id GROUP BY 1)
SELECT CASE WHEN d = 0 THEN '0' WHEN d <= 8 THEN '1-8' WHEN d <= 16 THEN '9-16' WHEN d <= 24 THEN '17-24' ELSE '25 or more' END AS bin, count(*) AS n FROM d GROUP BY 1""")
def A12_distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("distance")
    bins = F.when(d == 0, "0").when(d <= 8, "1-8").when(d <= 16, "9-16").when(d <= 24, "17-24").otherwise("25 or more")
    return J24_nearest_other(spark, sf_dir).groupBy(bins.alias("bin")).agg(F.count("*").alias("n"))


KNN = """
WITH e AS (SELECT vec_id, label, embedding FROM embeddings),
d AS (SELECT q.vec_id, b.label, b.vec_id AS other, list_sum([(q.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2 FOR i IN range(1, 65)]) AS d FROM e q JOIN e b ON q.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), other) AS n FROM d),
v AS (SELECT vec_id, label, count(*) AS votes FROM r WHERE n <= 15 GROUP BY ALL)
SELECT vec_id, arg_min(label, (-votes) * 1000 + label)::INTEGER AS vote FROM v GROUP BY 1"""


@query(KNN)
def J27_knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    near = overlap.nearest(e, e, "vec_id", "embedding", 15)
    labels = e.select(F.col("vec_id").alias("other"), "label")
    votes = near.join(labels, "other").groupBy("vec_id", "label").count()
    return votes.groupBy("vec_id").agg(F.min_by("label", F.struct(-F.col("count"), F.col("label"))).cast("int").alias("vote"))


NEAR = f"c AS ({CODES}), links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM c a JOIN c b ON a.vec_id <> b.vec_id WHERE {DISTANCE} <= 18)"
COMPONENTS = f"""WITH RECURSIVE {NEAR}, reach(u, v) AS (SELECT u, u FROM links UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u), parts AS (SELECT u AS id, min(v) AS component FROM reach GROUP BY 1)"""


def near_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.hamming_links(codes(spark, sf_dir), "vec_id", "code", 18)


@query(f"{COMPONENTS} SELECT id, component FROM parts")
def G01_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(near_links(spark, sf_dir))


@query(f"{COMPONENTS} SELECT vec_id AS id, 'G_' || coalesce(component, vec_id) AS split_group FROM embeddings LEFT JOIN parts ON vec_id = id")
def G02_split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.split_groups(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), near_links(spark, sf_dir))


@query(f"""{COMPONENTS},
m AS (SELECT component, id, label, code FROM parts JOIN c ON id = vec_id),
f AS (SELECT component, count(DISTINCT label) AS labels, count(DISTINCT code) AS contents FROM m GROUP BY 1)
SELECT component AS cluster, id, CASE WHEN labels = 1 AND id = component THEN 'keep' ELSE 'drop' END AS decision,
       CASE WHEN labels > 1 THEN 'conflicting_labels' WHEN id = component THEN 'kept_one_of_cluster' WHEN contents = 1 THEN 'identical_copy' ELSE 'near_copy' END AS reason
FROM m JOIN f USING (component)""")
def A13_cluster_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = codes(spark, sf_dir).select(F.col("vec_id").alias("id"), "label", F.col("code").alias("content"))
    return graph.cluster_decisions(items, near_links(spark, sf_dir))


@query("""
SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS n FROM documents) WHERE n = 1""")
def A28_first_of_equal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    return graph.first_of_each(docs, ["sha"], [F.asc("source"), F.asc("doc_id")]).select("doc_id", "source")


@query("""
SELECT doc_id, source, (('0x' || substr(sha256('7:fold:' || source), 1, 8))::BIGINT % 5)::INTEGER AS fold FROM documents""")
def G05_hash_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "source", splits.hash_fold(F.col("source"), "7", 5).alias("fold"))


@query("""
WITH r AS (SELECT lang, source, CASE WHEN doc_id % 10 = 3 THEN 'val' WHEN doc_id % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM documents WHERE NOT (lang = 'es' AND doc_id % 10 = 3)),
g AS (SELECT * FROM (SELECT DISTINCT lang FROM r), (SELECT DISTINCT split FROM r))
SELECT 'group in two splits' AS problem, source AS item FROM r GROUP BY source HAVING count(DISTINCT split) > 1
UNION ALL SELECT CASE WHEN split = 'train' THEN 'class without training rows' ELSE 'class missing from a split' END, lang || '/' || split FROM g ANTI JOIN r USING (lang, split)""")
def G06_split_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("doc_id") % 10 == 3, "val").when(F.col("doc_id") % 10 < 7, "train").otherwise("test")
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", split.alias("split")).where("NOT (lang = 'es' AND doc_id % 10 = 3)")
    return splits.split_problems(rows, "source", "lang", "split")


@query()
def G03_greedy_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.greedy_split(read(spark, sf_dir, "documents"), "source", "lang", "7")


@query()
def G04_capped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.capped_split(read(spark, sf_dir, "documents"), "source", "lang", "7")
