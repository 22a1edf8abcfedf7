"""Queries on the scores of whole runs, and their SQL.

As in metric_plans, a document's true class is its language, its answer a fixed rule on words; the group is its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluation, metrics, selection
from tessera.plans.metric_plans import ANSWERS, LABELS, SCORES, answers, rounded, two_runs
from tessera.plans.registry import Registry
from tessera.sources.tables import read

registry = Registry()
query = registry.query

RANKED = "CASE WHEN answer IS NOT NULL THEN [answer, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'fr' END, 'es'] END"


def drawn(name: str, answer: str) -> str:
    """CTEs that draw groups as metrics.bootstrap() does, for the answers of one run: c_ (class) and t_ (whole) sums of each resample, v_ the scores."""
    answered = ", ".join(f"count(*) FILTER ({answer} = '{x}') AS a_{x}" for x in LABELS)
    sums = ", ".join(f"sum(a_{x}) AS a_{x}" for x in LABELS)
    of_class = "CASE truth " + " ".join(f"WHEN '{x}' THEN a_{x}" for x in LABELS) + " END"
    return f"""s_{name} AS (SELECT truth, grp, count(*) AS n, count(*) FILTER ({answer} = truth) AS tp, count(*) FILTER (list_contains({RANKED}, truth)) AS top,
    count(*) FILTER (answer IS NOT NULL AND flag = 'yes') AS covered, count(*) FILTER (answer IS NOT NULL AND flag = 'yes' AND answer <> truth) AS wrong, {answered} FROM answers GROUP BY ALL),
u_{name} AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY grp) - 1 AS j, count(*) OVER (PARTITION BY truth) AS groups FROM s_{name}),
d_{name} AS (SELECT truth, b, ('0x' || substr(sha256('0:' || b || ':' || truth || ':' || j), 1, 8))::BIGINT % groups AS j FROM u_{name}, range(1, 2001) t(b)),
c_{name} AS (SELECT b, truth, sum(n) AS n, sum(tp) AS tp, sum(top) AS top FROM d_{name} JOIN u_{name} USING (truth, j) GROUP BY ALL),
t_{name} AS (SELECT b, sum(n) AS n, sum(covered) AS covered, sum(wrong) AS wrong, {sums} FROM d_{name} JOIN u_{name} USING (truth, j) GROUP BY ALL),
f_{name} AS (SELECT b, truth, 2 * tp / (c_{name}.n + {of_class}) AS f1 FROM c_{name} JOIN t_{name} USING (b)),
v_{name} AS (SELECT b, 'balanced_accuracy' AS score, avg(tp / n) AS value FROM c_{name} GROUP BY b UNION ALL SELECT b, 'macro_f1', avg(f1) FROM f_{name} GROUP BY b
    UNION ALL SELECT b, 'top_k_balanced_accuracy', avg(top / n) FROM c_{name} GROUP BY b UNION ALL SELECT b, 'coverage', covered / n FROM t_{name}
    UNION ALL SELECT b, 'selective_risk', wrong / nullif(covered, 0) FROM t_{name} UNION ALL SELECT b, 'recall ' || truth, tp / n FROM c_{name})"""


ENDS = "CASE WHEN count(value) = count(*) THEN round(quantile_cont(value, 0.025), 9) END AS lo, CASE WHEN count(value) = count(*) THEN round(quantile_cont(value, 0.975), 9) END AS hi"


@query(f"""WITH {SCORES}, {drawn("a", "answer")}, i AS (SELECT score, {ENDS} FROM v_a GROUP BY 1),
h AS (SELECT count(*) AS n, count(*) FILTER (answer IS NULL) AS invalid, count(DISTINCT grp) AS groups, count(*) FILTER (answer IS NOT NULL AND flag = 'yes') AS covered,
    count(*) FILTER (answer IS NOT NULL AND flag = 'yes' AND answer <> truth) AS wrong FROM answers),
x AS (SELECT 'n' AS score, n::DOUBLE AS value FROM h UNION ALL SELECT 'invalid', invalid FROM h UNION ALL SELECT 'invalid_rate', invalid / n FROM h UNION ALL SELECT 'groups', groups FROM h
    UNION ALL SELECT 'coverage', covered / n FROM h UNION ALL SELECT 'selective_risk', wrong / nullif(covered, 0) FROM h UNION ALL SELECT 'correct', sum(tp) FROM rates
    UNION ALL SELECT 'balanced_accuracy', avg(coalesce(recall, 0)) FILTER (support > 0) FROM rates UNION ALL SELECT 'macro_precision', avg(coalesce(precision, 0)) FILTER (support > 0) FROM rates
    UNION ALL SELECT 'macro_f1', avg(coalesce(f1, 0)) FILTER (support > 0) FROM rates
    UNION ALL SELECT 'top_k_balanced_accuracy', avg(hit) FROM (SELECT truth, avg(coalesce(list_contains({RANKED}, truth), false)::INTEGER) AS hit FROM answers GROUP BY 1)
    UNION ALL SELECT 'support ' || label, support FROM rates UNION ALL SELECT 'answered ' || label, answered FROM rates UNION ALL SELECT 'precision ' || label, precision FROM rates
    UNION ALL SELECT 'recall ' || label, recall FROM rates UNION ALL SELECT 'f1 ' || label, f1 FROM rates)
SELECT score, round(value, 9) AS value, lo, hi FROM x LEFT JOIN i USING (score)""")
def M16_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr")
    ranked = F.when(F.col("answer").isNotNull(), F.array("answer", second, F.lit("es")))
    return rounded(evaluation.summary(answers(spark, sf_dir).withColumn("ranked", ranked), LABELS))


@query(f"""WITH {ANSWERS}, {drawn("a", "answer")}, {drawn("b", "CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE answer END")},
p AS (SELECT score, v_b.value - v_a.value AS value FROM v_a JOIN v_b USING (b, score) WHERE score IN ('balanced_accuracy', 'macro_f1'))
SELECT score, {ENDS} FROM p GROUP BY 1""")
def M13_paired_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_runs(spark, sf_dir)
    groups = answers(spark, sf_dir).select("doc_id", "grp")
    pairs = evaluation.paired_answers(a.join(groups, "doc_id"), b.join(groups, "doc_id"), "doc_id")
    return rounded(metrics.interval(evaluation.paired_bootstrap(pairs, LABELS), "value", ["score"]))


@query(f"""WITH {ANSWERS}, large AS (SELECT truth FROM answers GROUP BY 1 HAVING count(*) >= 120),
t AS (SELECT 'all' AS subset, * FROM answers UNION ALL SELECT 'without small classes', * FROM answers WHERE truth IN (FROM large) UNION ALL SELECT 'all facts recorded', * FROM answers WHERE doc_id % 4 <> 0
    UNION ALL SELECT 'not refused', * FROM answers WHERE doc_id % 17 <> 0),
l AS (SELECT subset, truth AS label FROM t UNION SELECT subset, answer FROM t WHERE answer IS NOT NULL),
r AS (SELECT l.subset, label, count(*) FILTER (truth = label) AS support, count(*) FILTER (answer = label) AS answered, count(*) FILTER (truth = label AND answer = label) AS tp FROM l JOIN t ON l.subset = t.subset GROUP BY ALL)
SELECT subset, sum(support)::BIGINT AS n, sum(tp)::BIGINT AS correct, round(avg(tp / support) FILTER (support > 0), 9) AS balanced_accuracy, round(avg(coalesce(tp / nullif(answered, 0), 0)) FILTER (support > 0), 9) AS macro_precision,
    round(avg(2 * tp / (answered + support)) FILTER (support > 0), 9) AS macro_f1 FROM r GROUP BY 1""")
def M17_subset_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir)
    sizes = a.groupBy(F.col("truth").alias("t")).agg((F.count("*") >= 120).alias("large"))
    subsets = {"without small classes": F.col("large"), "all facts recorded": F.col("doc_id") % 4 != 0, "not refused": F.col("doc_id") % 17 != 0}
    return rounded(evaluation.subset_scores(a.join(sizes, F.col("truth") == F.col("t")), LABELS, subsets))


@query("""WITH a AS (SELECT 'test' AS split, min(lang) AS first, count(*) AS questions FROM documents), b AS (SELECT 'val' AS split, min(lang) AS first, count(*) AS questions FROM documents WHERE doc_id % 2 = 0)
SELECT 'run b is not finished' AS problem UNION ALL SELECT 'the runs differ in their split' FROM a, b WHERE a.split <> b.split UNION ALL SELECT 'the runs differ in their first' FROM a, b WHERE a.first <> b.first
UNION ALL SELECT 'the runs differ in their questions' FROM a, b WHERE a.questions <> b.questions""")
def M18_run_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = lambda df, status, split: df.agg(F.lit(status).alias("status"), F.lit(split).alias("split"), F.min("lang").alias("first"), F.count("*").alias("questions"))
    docs = read(spark, sf_dir, "documents")
    return evaluation.run_differences(card(docs, "complete", "test"), card(docs.where("doc_id % 2 = 0"), "running", "val"), ["split", "first", "questions"])


@query(f"""WITH {ANSWERS} SELECT doc_id, truth, grp, answer AS a, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE answer END AS b FROM answers WHERE doc_id % 4 <> 0""")
def J19_paired_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (run.join(answers(spark, sf_dir).select("doc_id", "grp"), "doc_id") for run in two_runs(spark, sf_dir))
    return evaluation.paired_answers(a, b.where("doc_id % 4 <> 0"), "doc_id", subset=True)


@query("""WITH s AS (SELECT source, lang, avg(n_chars) AS v FROM documents WHERE NOT (lang = 'fr' AND source IN (SELECT min(source) FROM documents)) GROUP BY ALL)
SELECT source, round(max(v) FILTER (lang = 'de'), 6) AS de, round(max(v) FILTER (lang = 'en'), 6) AS en, round(max(v) FILTER (lang = 'es'), 6) AS es, round(max(v) FILTER (lang = 'fr'), 6) AS fr FROM s GROUP BY 1""")
def A33_table_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("source", "lang", "n_chars")
    first = docs.agg(F.min("source").alias("first"))  # one row
    cells = docs.join(F.broadcast(first)).where("NOT (lang = 'fr' AND source = first)").groupBy("source", "lang").agg(F.round(F.avg("n_chars"), 6).alias("v"))
    return evaluation.table_of_runs(cells, "source", "lang", "v", LABELS)


@query(f"""WITH {ANSWERS}, v AS (SELECT 'words' AS view, truth, answer AS vote FROM answers UNION ALL SELECT 'length', lang, CASE WHEN n_chars % 3 = 0 THEN 'en' WHEN n_chars % 3 = 1 THEN 'de' ELSE 'fr' END FROM documents),
a AS (SELECT view, truth, avg(coalesce(vote = truth, false)::INTEGER) AS r FROM v GROUP BY ALL),
b AS (SELECT view, truth IN ('en', 'de') AS t, avg((coalesce(vote IN ('en', 'de'), false) = (truth IN ('en', 'de')))::INTEGER) AS r FROM v GROUP BY ALL)
SELECT view, round((SELECT avg(r) FROM a WHERE a.view = w.view), 9) AS balanced_accuracy, round((SELECT avg(r) FROM b WHERE b.view = w.view), 9) AS positive_balanced_accuracy FROM (SELECT DISTINCT view FROM v) w""")
def G08_shortcut_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = answers(spark, sf_dir).select(F.lit("words").alias("view"), "truth", F.col("answer").alias("vote"))
    n = F.col("n_chars") % 3
    length = read(spark, sf_dir, "documents").select(F.lit("length").alias("view"), F.col("lang").alias("truth"), F.when(n == 0, "en").when(n == 1, "de").otherwise("fr").alias("vote"))
    votes = words.unionByName(length).withColumn("vote", F.coalesce("vote", F.lit(metrics.INVALID)))
    return rounded(evaluation.shortcut_probe(votes, LABELS, ["en", "de"]))


FORMS = """a AS (SELECT doc_id AS path, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 'en' END AS prediction, CASE WHEN doc_id % 7 = 0 THEN ['en', 'en'] WHEN doc_id % 11 = 0 THEN ['en', 'xx'] WHEN doc_id % 12 = 0 THEN NULL ELSE ['en', 'de'] END AS differential,
    CASE WHEN doc_id % 13 = 0 THEN 'maybe' ELSE 'yes' END AS flag, CASE WHEN doc_id % 17 = 0 THEN [] ELSE ['c'] END AS claims, CASE WHEN doc_id % 19 = 0 THEN ['p1'] ELSE [] END AS evidence, CASE WHEN doc_id % 23 = 0 THEN 'refused' ELSE 'stop' END AS finish_reason FROM documents)"""


@query(f"""WITH {FORMS} SELECT path, 'the differential is not different classes' AS problem FROM a WHERE prediction IS NOT NULL AND (differential IS NULL OR len(list_distinct(differential)) < len(differential) OR NOT list_has_all(['de', 'en', 'es', 'fr'], differential))
UNION ALL SELECT path, 'the flag is not yes or no' FROM a WHERE prediction IS NOT NULL AND flag NOT IN ('yes', 'no') UNION ALL SELECT path, 'no claim' FROM a WHERE prediction IS NOT NULL AND len(claims) = 0
UNION ALL SELECT path, 'evidence without retrieval' FROM a WHERE prediction IS NOT NULL AND len(evidence) > 0 UNION ALL SELECT path, 'a refused question with a diagnosis' FROM a WHERE prediction IS NOT NULL AND finish_reason = 'refused'
UNION ALL SELECT path, 'an invalid answer holds more than its reason' FROM a WHERE prediction IS NULL AND (differential IS NOT NULL OR flag IS NOT NULL OR claims IS NOT NULL)""")
def N02_answer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, words = F.col("doc_id"), lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    saved = read(spark, sf_dir, "documents").select(
        i.alias("path"), F.when(i % 6 != 0, "en").alias("prediction"), F.when(i % 7 == 0, words("en", "en")).when(i % 11 == 0, words("en", "xx")).when(i % 12 != 0, words("en", "de")).alias("differential"),
        F.when(i % 13 == 0, "maybe").otherwise("yes").alias("flag"), F.when(i % 17 == 0, words()).otherwise(words("c")).alias("claims"), F.when(i % 19 == 0, words("p1")).otherwise(words()).alias("evidence"),
        F.when(i % 23 == 0, "refused").otherwise("stop").alias("finish_reason"),
    )
    return selection.answer_form_problems(saved, LABELS)


@query(f"""WITH {ANSWERS}, r AS (SELECT coalesce(answer = truth, false) AS a, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE answer END = truth, false) AS b FROM answers),
n AS (SELECT count(*) FILTER (a AND NOT b) AS x, count(*) FILTER (b AND NOT a) AS y FROM r)
SELECT x AS only_a, y AS only_b, round(least(1, 2 * (SELECT sum(exp(lgamma(x + y + 1) - lgamma(k + 1) - lgamma(x + y - k + 1) - (x + y) * ln(2))) FROM range(0, least(x, y) + 1) t(k))), 6) AS p FROM n""")
def M14_exact_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.paired(*two_runs(spark, sf_dir), "doc_id")
    return table.select("only_a", "only_b", F.round(metrics.mcnemar(F.col("only_a"), F.col("only_b")), 6).alias("p"))
