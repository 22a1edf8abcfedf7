"""Whitening, quality rules and ranked search against plain versions, on small tables with awkward rows."""

import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_rules, treap_search, whitening
from tessera.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_whitening_agrees_with_plain_eigenvectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 6)) * [4, 3, 2, 1, 0.5, 0.2]
    vectors = [v.tolist() for v in base] + [base[0].tolist()] * 30  # a hot vector counts once in the fit list
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    rows += [(3, base[3].tolist(), "x"), (None, base[4].tolist(), None), (200, None, "x"), (201, [1.0] * 5 + [None], "x"), (202, [1.0] * 5 + [math.nan], "x"), (203, [1.0] * 5 + [math.inf], "x"), (204, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string")  # a clashing extra column
    got = whitening.whiten(df, components=4).collect()
    used = [(k, np.floor(64 * np.array(v)).astype(np.int64) + 1_000_000) for k, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    fit = np.unique(np.stack([x for _, x in used]), axis=0)
    n, total = len(fit), fit.sum(0)
    values, axes = np.linalg.eigh((fit - total / n).T @ (fit - total / n) / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 4 * len(used) and {r.n for r in got} == {n} and {r.component for r in got} == {1, 2, 3, 4}
    assert Counter((r.vec_id, r.deviation) for r in got) == Counter((k, int(((n * x - total) ** 2).sum())) for k, x in used for _ in range(4))
    for c in range(4):
        mine = {(r.vec_id, r.deviation): r.whitened for r in got if r.component == c + 1}
        plain = {(k, int(((n * x - total) ** 2).sum())): float((x - total / n) @ axes[:, c] / np.sqrt(values[c])) for k, x in used}
        sign = np.sign(sum(mine[k] * plain[k] for k in plain))
        assert all(abs(mine[k] - sign * plain[k]) < 1e-8 for k in plain)
        assert all(abs(r.explained - values[c] / values.sum()) < 1e-12 for r in got if r.component == c + 1)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_without_variance_and_of_several_lengths(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(df([])).count() == 0
    assert whitening.whiten(df([(1, None), (2, [])])).count() == 0
    assert whitening.whiten(df([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    got = whitening.whiten(df([(1, [0.0, 1.0]), (2, [2.0, 1.0]), (3, [5.0]), (4, [6.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 9), round(r.explained, 9)) for r in got) == [(1, 1, 2, 128**2, 1.0, 1.0), (2, 1, 2, 128**2, 1.0, 1.0), (3, 1, 2, 64**2, 1.0, 1.0), (4, 1, 2, 64**2, 1.0, 1.0)]
    flat = whitening.whiten(df([(i, [float(i), 2.0 * i, float(i % 3), 0.0]) for i in range(40)])).collect()  # two dimensions of four
    assert {r.component for r in flat} == {1, 2} and flat[0].identity_error < 1e-9 and abs(sum(r.explained for r in flat[:2]) - 1) < 1e-12
    large = whitening.whiten(df([(1, [-3e8, 0.0]), (2, [3e8, 1.0])])).collect()
    assert {r.deviation for r in large} == {None} and all(abs(abs(r.whitened) - 1) < 1e-9 for r in large)


def plain_measures(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = Counter(windows)
    covered = {j for i, w in enumerate(windows) if twice[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def quality_tables(spark):
    """Shouting and symbols are bad, prose is good; a few labels are wrong."""
    rng = random.Random(5)
    words = "the of and a to in that is was he for it with as his on be at by i".split()
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = prose(60 + i % 30)
        rows.append((i, (text.upper() if i % 8 == 0 else " ".join(w + "##" for w in text.split())) if bad else text))
        labels.append((i, int(not bad) if i % 97 else int(bad)))
    return rows, labels


def test_quality_rules(spark):
    rows, labels = quality_tables(spark)
    long = " ".join(f"w{i % 30_000}" for i in range(40_000))
    extra = [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "a b c a b c a"), (1004, "x\n\nx\n y\nx"), (1005, "x x x x x"), (1006, long), (1007, "é" * 70 + " ü|<>"), (None, "to be or not to be " * 30), (1008, "a b c"), (1, rows[1][1])]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("rule", F.lit(1)).withColumn("row", F.lit(2)).withColumn("m", F.lit(3))
    marks = spark.createDataFrame(labels + [(None, 0), (5, None), (7, 5)], "doc_id long, quality int")
    got = quality_rules.judge_quality(df, marks).collect()
    assert len(got) == len(rows) + len(extra) and {(r.row, r.m) for r in got} == {(2, 3)}
    for r in got:
        n, chars, symbols, dup, repeated = plain_measures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeated), r.doc_id
        failed = n < 50 or 100 * repeated > 50 * n
        assert r.base_failed == failed and r.kept == (not failed and r.rule is None)
        if r.doc_id is not None and r.doc_id < 400:
            assert (r.rule is None) == (r.doc_id % 4 != 0), r.rule


def test_quality_rules_hold_on_texts_that_were_not_learned_from(spark):
    rows, labels = quality_tables(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality_rules.judge_quality(df, spark.createDataFrame([x for x in labels if x[0] % 2 == 0 or x[0] % 3 == 0], "doc_id long, quality int")).where("doc_id % 2 = 1 AND doc_id % 3 > 0").collect()
    assert sum(r.rule is None for r in got) == len(got)
    few = quality_rules.learn(df, spark.createDataFrame(labels, "doc_id long, quality int"), max_rows=30)
    assert len(few) <= 2
    none = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert quality_rules.learn(df, none) == [] and quality_rules.learn(df, none.where("false")) == []
    assert quality_rules.judge_quality(df.where("false"), none).count() == 0


def test_rule_conditions_are_ordered(spark):
    first = (quality_rules.Condition(0, 3.0, True),)
    second = (quality_rules.Condition(0, 2.0, True), quality_rules.Condition(2, 0.5, False))
    m = quality_rules.measured(spark.createDataFrame([("a b c",), ("a b",), ("a# b#",), (None,)], "text string"))
    got = {r.text: r.x for r in m.select("text", quality_rules.decided(F.col("measures"), [first, second]).alias("x")).collect()}
    assert got == {"a b c": "words >= 3", "a b": "words >= 2 and symbols_per_word < 0.5", "a# b#": None, None: None}


def plain_search(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    counts = [(d, Counter(term.findall(lower(t)))) for d, t in docs]
    counts = [(d, c, c.total()) for d, c in counts if c]
    n, total, df = len(counts), sum(s for *_, s in counts), Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(term.findall(lower(text))), []
        for d, c, size in counts:
            m = 100 - 75 + 75 * size * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("limits", [{}, {"block": 16}, {"block": 16, "most_terms": 20}, {"block": 1}])
def test_ranked_search(spark, limits, monkeypatch):
    if limits.get("block") == 16:
        monkeypatch.setattr(treap_search, "_FRONTIER", 64)
    rng = random.Random(8)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(300)] + ["Éa", "ÉA", "x1", "日本"]
    text = lambda n: rng.choice([" ", "-", ". "]).join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(120)]
    docs += [(300 + i, docs[5][1]) for i in range(30)] + [(7, docs[7][1]), (None, docs[5][1]), (400, None), (401, ""), (402, " .-! "), (403, text(3_000))]
    items = [(i, text(rng.randrange(1, 12))) for i in range(12)] + [(50, docs[5][1]), (51, "unknown"), (52, None), (53, ""), (54, "W1 w1 w1 x1"), (54, "W1 w1 w1 x1"), (None, "w2")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("part", F.lit(1))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    got = treap_search.search(df, asked, **limits).collect()
    assert Counter(map(tuple, got)) == plain_search(docs, items, 10)


def test_ranked_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert treap_search.search(docs, items).count() == 0
    assert treap_search.search(items.select(F.col("item_id").alias("doc_id"), "text"), items.where("false")).count() == 0


def test_treaps_are_in_search_and_heap_order():
    rng = np.random.default_rng(1)
    terms = np.sort(rng.integers(0, 5, 200))
    impacts = rng.integers(0, 9, 200)
    left, right, roots = treap_search.treaps(terms, impacts)
    for root in roots.tolist():
        def walk(i):
            if i < 0:
                return []
            for c in (left[i], right[i]):
                assert c < 0 or impacts[c] <= impacts[i]
            return [*walk(left[i]), i, *walk(right[i])]

        assert walk(root) == np.flatnonzero(terms == terms[root]).tolist()
    assert len(roots) == len(set(terms.tolist()))


@here
def test_ranked_search_agrees_with_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert Counter(map(tuple, QUERIES["op13_ranked_search"](spark, SF).collect())) == Counter(con.sql(ORACLE["op13_ranked_search"]).fetchall())


@here
def test_queries_return_what_their_contracts_name(spark):
    docs, vectors = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/embeddings.parquet")
    rules = QUERIES["op12_quality_rules"](spark, SF)
    assert rules.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"] and rules.count() == docs.count()
    white = QUERIES["op11_embedding_whitening"](spark, SF)
    assert white.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and white.count() == 16 * vectors.count()
