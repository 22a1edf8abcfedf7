"""Queries on scores, and their SQL.

A document's true class is its language, its answer a fixed rule on words; the group is its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import metrics
from tessera.plans.registry import Registry
from tessera.sources.tables import read

registry = Registry()
query = registry.query
LABELS = ["de", "en", "es", "fr"]

ANSWERS = """answers AS (SELECT doc_id, lang AS truth, source AS grp,
    CASE WHEN doc_id % 17 = 0 THEN NULL WHEN contains(text, ' the ') THEN 'en' WHEN contains(text, ' der ') THEN 'de' WHEN contains(text, ' les ') THEN 'fr' ELSE 'es' END AS answer,
    CASE WHEN doc_id % 5 = 0 THEN 'no' WHEN doc_id % 31 = 0 THEN NULL ELSE 'yes' END AS flag FROM documents)"""
MATRIX = f"""{ANSWERS}, labels AS (SELECT unnest(['de', 'en', 'es', 'fr']) AS label),
matrix AS (SELECT t.label AS truth, a.label AS answer, count(doc_id) AS n FROM labels t CROSS JOIN (SELECT label FROM labels UNION ALL SELECT '(invalid)') a
    LEFT JOIN answers ON truth = t.label AND coalesce(answer, '(invalid)') = a.label GROUP BY ALL)"""
SCORES = f"""{MATRIX}, scores AS (SELECT label, (SELECT sum(n) FROM matrix WHERE truth = label)::BIGINT AS support, (SELECT sum(n) FROM matrix WHERE answer = label)::BIGINT AS answered,
    (SELECT sum(n) FROM matrix WHERE answer = label AND truth = label)::BIGINT AS tp FROM labels),
rates AS (SELECT *, tp / nullif(answered, 0) AS precision, tp / nullif(support, 0) AS recall, 2 * tp / nullif(answered + support, 0) AS f1 FROM scores)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, i = F.col("text"), F.col("doc_id")
    answer = F.when(i % 17 == 0, F.lit(None).cast("string")).when(t.contains(" the "), "en").when(t.contains(" der "), "de").when(t.contains(" les "), "fr").otherwise("es")
    flag = F.when(i % 5 == 0, "no").when(i % 31 == 0, F.lit(None).cast("string")).otherwise("yes")
    return read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("truth"), F.col("source").alias("grp"), answer.alias("answer"), flag.alias("flag"))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query(f"WITH {MATRIX} SELECT truth, answer, n FROM matrix")
def M01_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(answers(spark, sf_dir), LABELS)


@query(f"WITH {SCORES} SELECT label, support, answered, tp, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM rates")
def M02_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_scores(metrics.confusion(answers(spark, sf_dir), LABELS)))


@query(f"""WITH {SCORES} SELECT sum(support)::BIGINT AS n, sum(tp)::BIGINT AS correct, round(avg(coalesce(recall, 0)) FILTER (support > 0), 9) AS balanced_accuracy,
    round(avg(coalesce(precision, 0)) FILTER (support > 0), 9) AS macro_precision, round(avg(coalesce(f1, 0)) FILTER (support > 0), 9) AS macro_f1 FROM rates""")
def M03_macro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.summarize(answers(spark, sf_dir), LABELS))


@query(f"""WITH {ANSWERS}, r AS (SELECT truth, CASE WHEN answer IS NOT NULL THEN list_distinct([answer, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'fr' END]) END AS ranked FROM answers)
SELECT round(avg(hit), 9) AS balanced_accuracy FROM (SELECT truth, avg(coalesce(list_contains(ranked, truth), false)::INTEGER) AS hit FROM r GROUP BY 1)""")
def M04_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr")
    ranked = F.when(F.col("answer").isNotNull(), F.array_distinct(F.array("answer", second)))
    top = metrics.top_k_answers(answers(spark, sf_dir).select("truth", ranked.alias("ranked")))
    return rounded(metrics.summarize(top, LABELS).select("balanced_accuracy"))


@query(f"""WITH {ANSWERS}, s AS (SELECT count(*) AS n, count(*) FILTER (answer IS NOT NULL AND flag IS NOT NULL) AS valid, count(*) FILTER (answer IS NOT NULL AND flag = 'yes') AS covered,
    count(*) FILTER (answer IS NOT NULL AND flag = 'yes' AND answer <> truth) AS covered_wrong FROM answers)
SELECT *, round(covered / n, 9) AS coverage, round(covered_wrong / covered, 9) AS selective_risk FROM s""")
def M05_selective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.selective(answers(spark, sf_dir)))


RANKED = "hits AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, (lang = 'en')::INTEGER AS rel FROM documents)"


@query(f"""WITH {RANKED}, rel AS (SELECT source, sum(rel) AS n_relevant FROM hits GROUP BY 1),
g AS (SELECT source, sum(rel) FILTER (rank <= 10) / 10 AS p, sum(rel / log2(rank + 1)) FILTER (rank <= 10) AS dcg FROM hits GROUP BY 1),
i AS (SELECT source, sum(1 / log2(r + 1)) AS ideal FROM rel, range(1, 11) t(r) WHERE r <= n_relevant GROUP BY 1)
SELECT source, round(p, 9) AS precision_at_k, round(dcg / ideal, 9) AS ndcg_at_k FROM g LEFT JOIN i USING (source)""")
def M06_M07_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    hits = read(spark, sf_dir, "documents").select("source", F.row_number().over(order).alias("rank"), (F.col("lang") == "en").cast("int").alias("rel"))
    relevant = read(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "en").cast("int").alias("n_relevant"))
    return rounded(metrics.ranking_scores(hits.where("rank <= 10"), relevant, "source", 10))


@query(f"""WITH {SCORES}, w AS (SELECT label, tp / support AS p, support AS n, 1.96::DOUBLE AS z FROM rates WHERE support > 0)
SELECT label, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 9) AS lo,
    round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 9) AS hi FROM w""")
def M08_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.class_scores(metrics.confusion(answers(spark, sf_dir), LABELS)).where("support > 0")
    lo, hi = metrics.wilson(F.col("tp"), F.col("support"))
    return rounded(scores.select("label", lo.alias("lo"), hi.alias("hi")))


@query("SELECT c_mktsegment AS segment, round(quantile_cont(c_acctbal, 0.025), 6) AS lo, round(quantile_cont(c_acctbal, 0.975), 6) AS hi FROM customer GROUP BY 1")
def M10_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("value"))
    out = metrics.interval(rows, "value", ["segment"])
    return out.select("segment", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(f"""WITH {ANSWERS}, s AS (SELECT truth, grp, count(*) AS n, count(*) FILTER (answer = truth) AS hit FROM answers GROUP BY ALL),
u AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY grp) - 1 AS j, count(*) OVER (PARTITION BY truth) AS groups FROM s),
d AS (SELECT truth, b, ('0x' || substr(sha256('0:' || b || ':' || truth || ':' || j), 1, 8))::BIGINT % groups AS j FROM u, range(1, 2001) t(b)),
r AS (SELECT b, truth, sum(hit) / sum(n) AS recall FROM d JOIN u USING (truth, j) GROUP BY ALL)
SELECT b::INTEGER AS resample, round(avg(recall), 9) AS balanced_accuracy FROM r GROUP BY 1""")
def M12_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.bootstrap(answers(spark, sf_dir)))


ANSWERED = ", ".join(f"count(*) FILTER (answer = '{x}') AS a_{x}" for x in LABELS)
DRAWN = ", ".join(f"sum(a_{x}) AS a_{x}" for x in LABELS)


@query(f"""WITH {ANSWERS}, s AS (SELECT truth, grp, count(*) AS n, count(*) FILTER (answer = truth) AS tp, count(*) FILTER (answer IS NOT NULL AND truth IN (answer, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'fr' END, 'es')) AS top,
    count(*) FILTER (answer IS NOT NULL AND flag = 'yes') AS covered, count(*) FILTER (answer IS NOT NULL AND flag = 'yes' AND answer <> truth) AS wrong, {ANSWERED} FROM answers GROUP BY ALL),
u AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY grp) - 1 AS j, count(*) OVER (PARTITION BY truth) AS groups FROM s),
d AS (SELECT truth, b, ('0x' || substr(sha256('0:' || b || ':' || truth || ':' || j), 1, 8))::BIGINT % groups AS j FROM u, range(1, 2001) t(b)),
c AS (SELECT b, truth, sum(n) AS n, sum(tp) AS tp, sum(top) AS top FROM d JOIN u USING (truth, j) GROUP BY ALL),
t AS (SELECT b, sum(n) AS n, sum(covered) AS covered, sum(wrong) AS wrong, {DRAWN} FROM d JOIN u USING (truth, j) GROUP BY ALL),
f AS (SELECT b, c.truth, 2 * c.tp / (c.n + CASE c.truth {" ".join(f"WHEN '{x}' THEN a_{x}" for x in LABELS)} END) AS f1 FROM c JOIN t USING (b)),
v AS (SELECT b, 'balanced_accuracy' AS score, avg(tp / n) AS value FROM c GROUP BY b UNION ALL SELECT b, 'top_k_balanced_accuracy', avg(top / n) FROM c GROUP BY b UNION ALL SELECT b, 'macro_f1', avg(f1) FROM f GROUP BY b
    UNION ALL SELECT b, 'coverage', covered / n FROM t UNION ALL SELECT b, 'selective_risk', wrong / nullif(covered, 0) FROM t UNION ALL SELECT b, 'recall ' || truth, tp / n FROM c)
SELECT b::INTEGER AS resample, score, round(value, 9) AS value FROM v""")
def M12_bootstrap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr")
    ranked = F.when(F.col("answer").isNotNull(), F.array_distinct(F.array(F.col("answer"), second, F.lit("es"))))
    return rounded(metrics.bootstrap_scores(answers(spark, sf_dir).withColumn("ranked", ranked), LABELS))


def two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = answers(spark, sf_dir).select("doc_id", "truth", "answer")
    return a, a.select("doc_id", "truth", F.when(F.col("doc_id") % 3 == 0, "en").otherwise(F.col("answer")).alias("answer"))


@query(f"""WITH {ANSWERS}, b AS (SELECT coalesce(answer = truth, false) AS a, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE answer END = truth, false) AS b FROM answers)
SELECT count(*) FILTER (a AND b) AS both_right, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS both_wrong FROM b""")
def M18_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.paired(*two_runs(spark, sf_dir), "doc_id")


@query()
def M14_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.paired(*two_runs(spark, sf_dir), "doc_id")
    return table.select("only_a", "only_b", metrics.mcnemar(F.col("only_a"), F.col("only_b")).alias("p"))


P_VALUES = "tests AS (SELECT source, (('0x' || substr(sha256(source), 1, 6))::BIGINT % 1000) / 20000 AS p FROM (SELECT DISTINCT source FROM documents))"


@query(f"""WITH {P_VALUES}, s AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, source) + 1) * p) AS step FROM tests)
SELECT source, round(p, 9) AS p, round(max(step) OVER (ORDER BY p, source), 9) AS adjusted FROM s""")
def M15_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = read(spark, sf_dir, "documents").select("source").distinct()
    p = F.conv(F.substring(F.sha2("source", 256), 1, 6), 16, 10).cast("long") % 1000 / 20000
    return rounded(metrics.holm(tests.withColumn("p", p), "source"))


@query("""WITH p AS (SELECT source, quality = 1 AS a, length(text) > 1000 AS b FROM labels JOIN documents USING (doc_id)),
s AS (SELECT source, count(*) AS n, avg((a = b)::INTEGER) AS o, avg(a::INTEGER) AS pa, avg(b::INTEGER) AS pb FROM p GROUP BY 1)
SELECT source, n, round(o, 9) AS observed, round(CASE WHEN pa * pb + (1 - pa) * (1 - pb) <> 1 THEN (o - pa * pb - (1 - pa) * (1 - pb)) / (1 - pa * pb - (1 - pa) * (1 - pb)) END, 9) AS kappa FROM s""")
def A20_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id")
    return rounded(metrics.kappa(both.select("source", (F.col("quality") == 1).alias("a"), (F.length("text") > 1000).alias("b")), ["source"]))


@query(f"""WITH {ANSWERS}, m AS (SELECT grp, truth, count(*) AS support, count(*) FILTER (answer = truth) AS tp FROM answers GROUP BY ALL)
SELECT grp, sum(support)::BIGINT AS n, sum(tp)::BIGINT AS correct, round(avg(tp / support), 9) AS balanced_accuracy FROM m GROUP BY 1""")
def A33_scores_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = answers(spark, sf_dir).groupBy("grp", "truth", F.coalesce("answer", F.lit(metrics.INVALID)).alias("answer")).agg(F.count("*").alias("n"))
    out = metrics.macro_scores(metrics.class_scores(matrix, ["grp"]), ["grp"])
    return rounded(out.select("grp", "n", "correct", "balanced_accuracy"))


@query(f"""WITH {ANSWERS}, small AS (SELECT truth FROM answers GROUP BY 1 HAVING count(*) < 120)
SELECT round(avg(r), 9) AS balanced_accuracy, count(*) AS classes FROM (SELECT truth, avg(coalesce(answer = truth, false)::INTEGER) AS r FROM answers ANTI JOIN small USING (truth) GROUP BY 1)""")
def M17_without_small_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir)
    large = a.groupBy("truth").count().where("count >= 120").select("truth")
    recall = a.join(large, "truth").groupBy("truth").agg(F.avg(F.coalesce(F.col("answer") == F.col("truth"), F.lit(False)).cast("int")).alias("r"))
    return recall.agg(F.round(F.avg("r"), 9).alias("balanced_accuracy"), F.count("*").alias("classes"))
