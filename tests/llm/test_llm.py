"""The ten operators and the pipeline against plain versions, on small tables with awkward rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import byte_bpe, embedding_dedup, jaccard_join, language_id, license_scan, pretokens, source_mix, token_count, topk_search, toxicity, url_filter
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WORDS = "the of and der die das les une que con para los tion ing ent heit keit".split()


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "er", "a", "x", "é"]) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def awkward(spark):
    """Null, empty, blank, repeated and long texts, null columns, a repeated row."""
    rng = random.Random(4)
    long = text_of(rng, 60_000)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", None, 3), (4, "One", "en", "b", 3), (4, "One", "en", "b", 3), (5, "ONE", "de", "b", 3), (6, long, "en", "a", len(long)), (None, "x y z", "fr", "c", 5), (7, "12 34 !!", "fr", "c", 8)]
    return documents(spark, rows)


def test_url_rules_and_globs(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    rng = random.Random(2)
    hosts = ["com", "a.com", "example.com", "x.example.com", "www.example.com", "a.www.example.com", "notexample.com", "NET", "m.net", "xnet", "casino.org", ""]
    paths = ["", "/", "/en/", "/en/x", "/EN/", "/es/1?q=/fr/", "/fr/#x", "/wp-login.php", "?a=/en/", "#/en/"]
    urls = [f"{s}{rng.choice(hosts)}{rng.choice(paths)}" for s in ("http://", "https://", "", "a://b://") for _ in range(60)] + [None, "", "x" * 100_000, "http://" + "com/" * 5_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[1]), u
        assert got[i].verdict == (best[2] if best else "block" if re.search(r"^[^/]*casino[^/]*/|/wp-login\.php", host + path) else "allow"), u


def test_pretokens_and_byte_bpe(spark):
    ranks = byte_bpe.default_ranks()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.token_bytes(ranks), special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é'sS tll'1２ \t\n\u00a0-—😀") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["it's we'll I'd 'x  <|endoftext|>", "a" * 20_000]
    import regex

    for t in texts:
        assert pretokens.pretokens(t) == regex.findall(public_tokenizers.PATTERN, t)
    df = awkward(spark).unionByName(documents(spark, [(100 + i, t, "en", "a", 0) for i, t in enumerate(texts)])).withColumn("n_tokens", F.lit("clash"))
    out = byte_bpe.encode_texts(df.repartition(3), ranks).withColumn("bytes", byte_bpe.decode_ids(F.col("ids"), ranks)).collect()
    wanted = Counter((r.doc_id, (r.text or "").encode()) for r in df.collect())
    assert Counter((r.doc_id, bytes(r.bytes)) for r in out) == wanted
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(bytes(r.bytes).decode()) and r.n_tokens == len(r.ids) // 4
    assert byte_bpe.encode_texts(df.where("false"), ranks).count() == 0


def test_token_counts_with_chunks(spark):
    model = token_count.default_model()
    plain = sentencepiece.SentencePieceProcessor(model_file=model)
    rng = random.Random(3)
    texts = [text_of(rng, 3_000), "x" * 5_000, " " * 3_000 + "a", "é▁ <s> " * 800, "<unk>\n\n 1  2", ""]
    df = awkward(spark).unionByName(documents(spark, [(100 + i, t, None, None, 0) for i, t in enumerate(texts)]))
    got = token_count.count_tokens(df, model, huge=1_000, step=700, overlap=60).collect()
    assert len(got) == df.count() and all(r.n_tokens == len(plain.encode(r.text or "")) for r in got)


def test_license_scan(spark):
    rng = random.Random(8)
    mit = license_scan.TEMPLATES["mit"]
    texts = [None, "", "MIT License, cc BY cc by; MIT\nlicense", "x " + mit, text_of(rng, 200) + " apache license", mit[: len(mit) // 2], "Apache-License gnu general public licenses"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        places = [(a, label) for p, label in license_scan.PHRASES.items() for n in [len(p.split())] for a in range(len(words) - n + 1) if words[a : a + n] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min((a for a, _ in places), default=None), max((a for a, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places})) and 0 <= r.score <= 1
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert "mit" in got[3].labels and "mit" in got[5].labels and got[4].labels == "apache"


def test_license_phrases_of_one_word_and_spans(spark):
    df = spark.createDataFrame([("x foo y",), ("foo",), (None,)], "text string").withColumn("spans", F.lit("clash"))
    got = license_scan.scan_licenses(df, phrases={"foo": "f"}).collect()
    assert [(r.n_base, r.first_word, r.base_labels) for r in got] == [(1, 1, "f"), (1, 0, "f"), (0, None, "")]
    assert license_scan.scan_licenses(df.where("false")).count() == 0
    rng = random.Random(3)
    body = [f"w{i}" for i in range(900)]
    templates = {"long": " ".join(body), "other": " ".join(rng.choices("abcdef", k=60))}
    # A template in 150 short runs, twice in one text.
    cut = [w for i in range(0, 900, 6) for w in [*body[i : i + 6], "zz"]]
    texts = [" ".join(cut + ["q"] * 2000 + cut), *(" ".join(rng.choices("abcdef", k=80)) for _ in range(30))]
    rows = license_scan.scan_licenses(spark.createDataFrame([(x,) for x in texts], "text string"), phrases={}, templates=templates).collect()
    assert [(s.first_word, s.last_word, s.covered) for s in sorted(rows[0].spans)] == [(0, len(cut) - 2, 1.0), (len(cut) + 2000, 2 * len(cut) + 1998, 1.0)]
    for r in rows[1:]:
        words, scores = r.text.split(), {}
        for label, t in templates.items():
            t, runs = t.split(), []
            sizes = [max((n for n in range(1, e + 2) if any(words[e - n + 1 : e + 1] == b[i : i + n] for b in (x.split() for x in templates.values()) for i in range(len(b) - n + 1))), default=0) for e in range(len(words))]
            for e, n in enumerate(sizes):
                if n >= 5 and (e + 1 == len(words) or sizes[e + 1] != n + 1):
                    ends = [i + n - 1 for i in range(len(t) - n + 1) if t[i : i + n] == words[e - n + 1 : e + 1]]
                    if ends:
                        runs.append((e - n + 1, e, ends[0] - n + 1, ends[0]))
            cover = []
            for i, (a, e, ta, te) in enumerate(runs):
                cover.append(max([e - a + 1] + [cover[j] + min(te - max(y, ta - 1), e - max(x, a - 1)) for j, (_, x, _, y) in enumerate(runs[:i]) if y < te and x < e and a - x <= len(t)]))
            scores[label] = min(1.0, max(cover, default=0) / len(t))
        assert r.score == (best if (best := max(scores.values())) >= 0.3 else 0) and r.labels == ",".join(sorted(x for x, c in scores.items() if c >= 0.3))


def test_ngrams_of_words_of_any_length(monkeypatch):
    from tessera.llm import chargrams

    rng = random.Random(1)
    words = ["".join(rng.choices("abcé😀", k=n)) for n in (1, 2, 3, 40, 64, 65, 300, 1000, 2)]
    plain = {(i, n): Counter(f" {w} "[j : j + n] for j in range(len(w) + 3 - n) if n > 1 or 0 < j <= len(w)) for i, w in enumerate(words) for n in (1, 2, 3, 5)}
    for window in (10, 100, 250_000):
        monkeypatch.setattr(chargrams, "WINDOW", window)
        counts = {n: Counter() for n in (1, 2, 3, 5)}
        for n in counts:
            for number, _ in chargrams.gram_parts(words, (n,), 18):
                counts[n].update(number.tolist())
            assert counts[n] == Counter({i: sum(plain[i, n].values()) for i in range(len(words)) if sum(plain[i, n].values())})
        total = chargrams.gram_counts(words, (1, 2, 3, 5), 18)
        if window == 10:
            first = total
        assert (total == first).all() and (total > 0).sum() > 0.98 * len({g for c in plain.values() for g in c})
        sums = chargrams.WordSums(np.arange(1 << 18)[:, None], (3, 5), 18).of([words, words[:2], []])
        assert sums[2, 0] == 0 and sums[0, 0] == (chargrams.gram_counts(words, (3, 5), 18) * np.arange(1 << 18)).sum()
        seen = chargrams.TextSums(np.ones(1 << 18), (3, 5), 18).of([words, [], words[3:4]])
        assert seen[0] == (chargrams.gram_counts(words, (3, 5), 18) > 0).sum() and seen[1] == 0


@here
def test_toxicity_learns_and_holds_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rng = random.Random(6)
    made = [(10_000 + i, text_of(rng, 80) + (" you stupid idiot " if i % 3 == 0 else " "), "en", "a", 0) for i in range(600)]
    df = docs.select("doc_id", "text").unionByName(documents(spark, made).select("doc_id", "text")).unionByName(awkward(spark).select("doc_id", "text")).withColumn("score", F.lit("clash"))
    marks = labels.unionByName(spark.createDataFrame([(10_000 + i, 1, int(i % 3 == 0)) for i in range(600)] + [(None, 1, 1), (10_001, 1, None)], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, marks).collect()}
    own = [got[10_000 + i] for i in range(600)]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in own)
    right = [r.predicted == int((r.doc_id - 10_000) % 3 == 0) for r in own if r.held_out]
    assert sum(right) >= 0.98 * len(right) and got[2].score == got[3].score
    flipped = marks.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.score_toxicity(df, flipped).where("doc_id = 10002").first().score == got[10_002].score
    assert toxicity.score_toxicity(df, marks.where("false")).where("score < 0 OR score > 1").count() == 0


@here
def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    df = docs.unionByName(awkward(spark))
    got = language_id.identify_languages(df).collect()
    assert len(got) == df.count()
    by = [r for r in got if r.held_out and r.lang and r.text and len(r.text) > 200]
    assert sum(r.lang_pred == r.lang for r in by) >= 0.9 * len(by)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert {r.lang_pred for r in language_id.identify_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.lang_pred for r in language_id.identify_languages(docs.withColumn("lang", F.lit("xx"))).collect()} == {"xx"}


def test_language_id_learns_every_language(spark):
    rng, rows = random.Random(5), []
    for k in range(70):  # each has letters of its own; the last ones have fewest texts
        letters = [chr(0x4E00 + 10 * k + i) for i in range(8)]
        rows += [(1000 * k + i, " ".join("".join(rng.choices(letters, k=4)) for _ in range(30)), f"q{k:02}", "web", 1) for i in range(14 if k < 60 else 10)]
    got = language_id.identify_languages(documents(spark, rows)).where("held_out").collect()
    assert {r.lang for r in got} >= {f"q{k}" for k in range(60, 70)}
    right = Counter(r.lang for r in got if r.lang_pred == r.lang)
    assert all(right[x] for x in {r.lang for r in got}) and sum(right.values()) >= 0.95 * len(got)


def test_language_sample_is_bounded_whatever_the_keys(spark):
    rng, rows = random.Random(6), []
    text = lambda: text_of(rng, 5)
    rows += [(None, text(), "a") for _ in range(300)] + [(7, text(), "b") for _ in range(300)] + [(8, "one text", "c")] * 300 + [(i, text(), "d") for i in range(300)] + [(9, "one", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).repartition(5)
    n = {r.lang: r["count"] for r in language_id.bounded_sample(df, 30, 100).groupBy("lang").count().collect()}
    assert n["a"] == n["b"] == n["d"] == 30 and n["c"] == 30 and n["e"] == 1
    assert set(language_id.bounded_sample(df, 1, 100).select("lang").toPandas()["lang"]) == {"a", "b", "c", "d", "e"}
    assert {r.lang for r in language_id.bounded_sample(df, 30, 2).collect()} == {"a", "b"}
    own = next(i for i in range(1_000, 2_000) if zlib.crc32(str(i).encode()) % 3 != 1)
    same = documents(spark, [(own, f"das ist ein satz {i}", "de", "x", 1) for i in range(90)] + [(i, f"esto es una frase {i}", "es", "x", 1) for i in range(6, 90)])
    got = language_id.identify_languages(same.withColumn("lang_pred", F.lit(1)).withColumn("r", F.lit("clash")).withColumn("h", F.lit("clash")), max_texts=30).collect()
    assert len(got) == 174 and {r.lang_pred for r in got if r.lang == "de"} == {"de"} and {r.r for r in got} == {"clash"}


def plain_targets(sizes):
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, left = {}, total
    while True:
        rest = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = 3.0 * sizes[s]
            left -= full[s]


def test_source_mix(spark):
    rng = random.Random(7)
    rows = [(i, text_of(rng, rng.choice([0, 5, 40, 300])), "en", rng.choice(["a", "a", "a", "b", "B", "é", None]), 0) for i in range(700)] + [(900, text_of(rng, 30), "en", "tiny", 0), (901, None, "en", "none", 0)]
    df = documents(spark, rows).unionByName(awkward(spark)).withColumn("size", F.lit("clash"))
    found = []
    for n in (3, 5):
        placed, spans = source_mix.mix_sources(df.repartition(n), block_words=8)
        taken = spans.groupBy("number", "place").agg(F.sum("words").alias("taken"))
        found.append(placed.join(taken, ["number", "place"], "left").select("doc_id", "source", "text", "size", "source_size", "target", "place", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).alias("taken")).collect())
    got, again = found
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((r.doc_id, r.size, r.taken) for r in again)
    sizes = Counter()
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and r.taken <= 3 * r.size
        sizes[r.source] += r.size
    wanted, sums = plain_targets(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, wanted[r.source], abs_tol=1e-6)
        sums[r.source] += r.taken
    assert all(abs(sums[s] - wanted[s]) <= 24 for s in sizes)
    mixed = source_mix.mixed_documents(df)
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] - wanted[s]) <= 200 for s in sizes)
    assert source_mix.mixed_documents(df.where("false")).count() == 0


def plain_components(ids, links):
    up = {i: i for i in range(len(ids))}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in links:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(ids))]


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(spark, words, percent):
    rng = random.Random(11)
    passage, texts = text_of(rng, 40), []
    for _ in range(60):
        base = text_of(rng, rng.choice([1, 2, 3, 6, 30, 120, 400])).split()
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(["q", "zz", "the"])
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy))
    texts += [passage + " " + text_of(rng, 60) for _ in range(20)] + ["", " ", None, "é È", "É È"]
    df = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df.repartition(3), words=words, percent=percent).collect()}

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}

    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    wanted = plain_components([1000 - i for i in range(len(texts))], links)
    assert got == {1000 - i: (len(s), c) for i, (s, c) in enumerate(zip(sets, wanted))}
    assert len(set(wanted)) < len(wanted) - 20


def test_jaccard_join_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 400)
    rng = random.Random(12)
    base, rows = text_of(rng, 80).split(), []
    for i in range(60):
        rows.append((i, " ".join(base + ["k" + str(i)])))
    for i in range(60, 80):  # about three in four shingles in common: candidates that don't link
        rows.append((i, " ".join(base[:66] + text_of(rng, 14).split())))
    df = spark.createDataFrame(rows + [(90, None), (None, "x"), (91, "x"), (91, "x")], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(df).collect())
    assert all(got[i, 0] == 1 for i in range(60)) and all(c != 0 for (i, c) in got if i is not None and i >= 60)
    assert got[90, 90] == 1 and got[None, 91] == 1 and got[91, 91] == 2
    assert jaccard_join.jaccard_components(df.where("false")).count() == 0


def test_embedding_dedup(spark):
    rng = np.random.default_rng(3)
    rows, key = [], 0
    for _ in range(40):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 8))):
            rows.append((key, (base + rng.normal(size=16) * rng.choice([0, 0.05, 0.2])).tolist(), int(rng.integers(0, 2))))
            key += 1
    rows += [(key, rows[0][1], rows[0][2]), (key + 1, [0.0] * 16, 0), (key + 2, None, 0), (key + 3, [1.0, None], 0), (key + 4, [math.nan] * 16, 0), (key + 5, rows[1][1], None), (key + 6, [1e30, 1e30], 1), (key + 7, [1.0, 1.0], 1), (None, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = [(k, np.array(v) / np.linalg.norm(v), y) for k, v, y in rows if k is not None and v and y is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = [(i, j) for i in range(len(good)) for j in range(i) if good[i][2] == good[j][2] and len(good[i][1]) == len(good[j][1]) and good[i][1] @ good[j][1] >= 0.98]
    n = Counter(x for pair in links for x in pair)
    comp = plain_components([g[0] for g in good], links)
    wanted = {k: (0, k, True) for k, _, _ in rows if k is not None} | {g[0]: (n[i], comp[i], comp[i] == g[0]) for i, g in enumerate(good)}
    for pivots, block in ((4096, 2048), (8, 16)):
        embedding_dedup.ROWS_PER_PIVOT, embedding_dedup.BLOCK = pivots, block
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
        assert got.pop(None) == (0, None, False) and got == wanted
    embedding_dedup.ROWS_PER_PIVOT, embedding_dedup.BLOCK = 4096, 2048
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0
    assert len(links) > 40


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embedding_dedup_sends_vectors_by_parts(spark, monkeypatch, kind):
    """Vectors nearly at right angles, which pivots tell little of: no table holds a vector for each cell that it may reach, and parts find all links."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(400, 64))
    vectors[300:] = vectors[:100] + rng.normal(size=(100, 64)) * rng.choice([0.02, 0.15, 0.3], size=(100, 1))
    vectors = vectors.astype(np.float32 if kind == "float" else float)
    df = spark.createDataFrame([(i, v.tolist(), int(i == 7)) for i, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>, label int")
    for name, value in {"ROWS_PER_PIVOT": 8, "BLOCK": 16, "PART_BYTES": 20_000, "SIDES": 4, "MOST_BYTES": 15_000}.items():
        monkeypatch.setattr(embedding_dedup, name, value, raising=False)
    made, written = [], embedding_dedup.written
    monkeypatch.setattr(embedding_dedup, "written", lambda df: made.append(written(df)) or made[-1])
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    units = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    links = [(i, j) for i, j in np.argwhere(units @ units.T >= 0.98).tolist() if i < j and 7 not in (i, j)]
    n, comp = Counter(x for pair in links for x in pair), plain_components(list(range(400)), links)
    assert got == {i: (n[i], comp[i]) for i in range(400)} and 30 < len(links) < 100
    assert max(m.count() for m in made) <= 400


def test_topk_search(spark):
    rng = np.random.default_rng(5)
    rows = [(i, np.round(rng.normal(size=24), 1).tolist()) for i in range(300)] + [(300, None), (301, [1.0, math.inf]), (302, [0.1, -0.2]), (320, [3.0, 4.0]), (340, [1e12] * 24), (0, None)]
    rows += [(1, rows[1][1]), (1, rows[2][1]), (20, rows[20][1]), (20, rows[20][1]), (40, rows[7][1])]  # keys that repeat, with their numbers and with others
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("row", F.lit(0)).withColumn("codes", F.lit("clash"))
    stored = sorted((r.vec_id, tuple(r.embedding)) for r in df.where("embedding IS NOT NULL").collect() if all(map(math.isfinite, r.embedding)))
    good = [(k, [math.floor(64 * x) for x in v]) for k, v in stored]
    wanted = []
    for own, (k, q) in enumerate(good):
        if k % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for j, (i, v) in enumerate(good) if j != own and len(v) == len(q))[:7]
            wanted += [(k, r, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(scores, 1)]
    for n, q in ((16_384, 1_024), (50, 4)):
        got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk_search.search(df, F.col("vec_id") % 20 == 0, k=7, rows=n, queries=q).collect()]
        assert sorted(got) == sorted(wanted)
    assert topk_search.search(df.where("false"), F.lit(True)).count() == 0


def test_pipeline_keeps_one_of_near_copies_whatever_their_ids(spark):
    rng = random.Random(13)
    base = text_of(rng, 60)
    rows = [(3, base), (5, base + " extra"), (5, text_of(rng, 60)), (7, base + " one"), (None, base + " two"), (None, text_of(rng, 60)), (5, text_of(rng, 60))]
    rows += [(8, base.replace("e", "E")), (9, "a b"), (9, "a b"), (2, "A  B"), (11, None), (11, None), (12, " "), (None, "only"), (None, "only")]
    df = documents(spark, [(i, t, "en", "a", 1) for i, t in rows]).withColumn("tree", F.lit("clash"))
    kept = corpus_pipeline.drop_near_copies(spark, df.repartition(5), "")
    assert kept.columns == df.columns
    wanted = [rows[0], rows[2], rows[5], rows[6], (2, "A  B"), (11, None), (11, None), (12, " "), (None, "only")]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(wanted)
    assert corpus_pipeline.drop_near_copies(spark, df.where("false"), "").count() == 0


@here
def test_jaccard_join_agrees_with_its_sql(spark):
    import duckdb

    from tessera.llm.queries import ORACLE

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    wanted = Counter(con.sql(ORACLE["op8_jaccard_join"]).fetchall())
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op8_jaccard_join"](spark, SF).collect()) == wanted


@here
def test_scores_and_languages_agree_with_a_plain_reading_of_the_weights(spark):
    from tessera.llm import chargrams

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    df = docs.unionByName(awkward(spark)).unionByName(documents(spark, [(500, "a" * 70_000 + "ß" * 5, "de", "a", 1), (501, "stupid", "en", "a", 1)]))
    model = toxicity.fit(docs.where(~toxicity.held_out(F.col("doc_id"))), labels.where(~toxicity.held_out(F.col("doc_id"))))
    for r in df.select("text", toxicity.score(F.col("text"), model).alias("score")).collect():
        held = {w for w in (r.text or "").lower().split()}
        present = chargrams.gram_counts(sorted(held), toxicity.SIZES, toxicity.BITS) > 0
        assert math.isclose(r.score, 1 / (1 + math.exp(-max(-30, min(30, model.weights.astype(np.float32)[present].sum(dtype=float) + model.intercept)))), abs_tol=2e-6)
    model = language_id.fit(docs)
    sure = lambda m: 1 / (1 + math.exp(-max(-30, min(30, 2 * m))))
    for r in df.select("text", language_id.predict(F.col("text"), model).alias("x")).collect():
        words = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        if not words:
            assert (r.x.lang_pred, r.x.score) == ("und", 0)
            continue
        counts = chargrams.gram_counts(words, language_id.SIZES, language_id.BITS)
        m = (counts @ model.weights) / counts.sum() + model.intercepts
        n = len(model.families)
        family = model.families[int(np.argmax(m[:n]))]
        own = model.languages[family]
        beats = {a: [m[n + k] if p[0] == a else -m[n + k] for k, p in enumerate(model.pairs) if a in p] for a in own}
        best = max(own, key=lambda a: (sum(x > 0 for x in beats[a]), sum(beats[a]), -own.index(a)))
        wanted = sure(m[model.families.index(family)]) * (sure(min(beats[best])) if len(own) > 1 else 1)
        assert r.x.lang_pred == best and math.isclose(r.x.score, wanted, abs_tol=2e-6)


@here
def test_pipeline_stages_of_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark, []), SF).count() == 0


@here
def test_pipeline_runs_on_what_each_stage_kept(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "jaccard_join", "source_mix", "byte_bpe"]
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    odd = awkward(spark)
    now = docs.unionByName(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        assert now.columns == docs.columns
        kept.append(now.collect())
    texts = [t for r in kept[2] for t in [(r.text or "").lower().split()] if len(t) >= 5]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    assert not any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert len({r.doc_id for r in kept[1]}) >= 0.9 * len({r.doc_id for r in kept[0] if r.text and any(c.isalpha() for c in r.text)})
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert all(r.round_trip for r in last) and len(last) == len(kept[3])


OWN_NAMES = ["judged", "some", "scan", "told", "of", "chunk", "part", "ahead", "inside", "runs", "sha", "n", "mark", "keep_key", "keep_mark", "row", "turn", "number", "place", "size", "own_size", "first_of_near_copies", "__", "__s", "__scan", "__n", "__mark", "__judged", "__lang"]


@here
@pytest.mark.parametrize("operator", [
    lambda df: url_filter.judge_urls(df.withColumn("url", F.lit("http://a.com/en/"))),
    lambda df: byte_bpe.encode_texts(df, byte_bpe.default_ranks(), decoded="decoded"),
    lambda df: license_scan.scan_licenses(df),
    lambda df: token_count.count_tokens(df, token_count.default_model(), huge=20, step=12, overlap=4).withColumnRenamed("n_tokens", "tokens"),
    lambda df: language_id.identify_languages(df),
    lambda df: source_mix.mixed_documents(df),
    lambda df: jaccard_join.first_of_near_copies(df),
])
def test_columns_that_bear_the_names_of_inner_ones_stay(spark, operator):
    df = documents(spark, [(i, f"das ist ein {i} langer satz mit worten {i}", "de", "a", 9) for i in range(12)])
    for name in OWN_NAMES:
        df = df.withColumn(name, F.lit(f"of {name}"))
    got = operator(df).collect()
    assert len(got) >= 10 and all(r[name] == f"of {name}" for r in got for name in OWN_NAMES)
    assert {r.doc_id for r in got} <= set(range(12)) and len({r.doc_id for r in got}) >= 4


@here
def test_registered_queries_return_what_their_contracts_name(spark):
    columns = {
        "op1": ["page_id", "host", "path", "rule", "verdict"], "op2": ["doc_id", "held_out", "score", "predicted"], "op3": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op4": ["doc_id", "size", "source_size", "target", "taken"], "op5": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        "op6": ["doc_id", "held_out", "lang_pred", "score"], "op7": ["vec_id", "n_links", "component_id", "kept"], "op8": ["doc_id", "n_shingles", "component_id"],
        "op9": ["query_id", "rank", "vec_id", "score"], "op10": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op11": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"], "op12": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"], "op13": ["item_id", "rank", "doc_id", "score"],
    }
    assert {n.split("_")[0] for n in QUERIES} == set(columns)
    got = QUERIES["op3_byte_bpe"](spark, SF)
    assert got.columns == columns["op3"]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.token_bytes(byte_bpe.default_ranks()), special_tokens={})
    for r in got.collect():
        ids = own.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    for name in ("op1_url_filters", "op5_license_scans", "op10_token_counts", "op4_source_mix"):
        assert QUERIES[name](spark, SF).columns == columns[name.split("_")[0]]
