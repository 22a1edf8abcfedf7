"""Ranked lexical search: an inverted treap for each term, all treaps of a query traversed together.

Each block of documents has a treap for each term: its postings are in search order by document and in heap order by
impact. A query starts with the whole block as one interval and the roots of its terms' treaps. The sum of the impacts
at the roots bounds the score of every document of an interval; intervals that can't enter the k best go whole. Of the
others the document under the heaviest root is scored, and the interval is cut there. The best of all blocks are merged
by windows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import small_table, written

#: A term is a run of ASCII letters, digits and characters beyond ASCII; in UTF-8 these are the bytes from 0x80 on.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Documents of a block, and distinct terms of all queries that are searched for in one pass over the documents.
BLOCK, MOST_TERMS = 4_096, 500_000
#: Fixed values of the ranking: thousandths of a weight, of a term's impact, and the part of the length in it.
_LENGTH_SHARE = 75
#: Intervals that a query handles at once, times its terms.
_FRONTIER = 1 << 14


def terms_of(text: Column) -> Column:
    """The terms of a text in order; only A to Z are lower-cased. None if it is null."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(TERM), F.lit(0))


def _postings(numbers: dict[bytes, int]):
    """Batches of (doc_id, text) to (doc_id, n, terms, times): how many terms a text has, and which of `numbers` how often."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, times, ends = [], [], [], [0]
            for text in batch.column(1).cast(pa.large_binary()):
                counts = Counter(_TERM.findall((text.as_py() or b"").lower()))
                held = sorted((numbers[t], c) for t, c in counts.items() if t in numbers)
                sizes.append(counts.total())
                terms.extend(t for t, _ in held)
                times.extend(c for _, c in held)
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (terms, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    return of


def treaps(terms: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right children (-1: none) of each posting, and the places of all roots, for postings in order of term and document.

    The parent is the nearer in rank of the next postings of the same term, on either side, with a larger impact (of equal
    ones the earlier counts as larger); these are found for all postings at once by jumping over smaller ones.
    """
    n = len(terms)
    places = np.arange(n)
    larger = lambda a, b: (terms[a] != terms[b]) | (impacts[a] > impacts[b]) | ((impacts[a] == impacts[b]) & (a < b))  # noqa: E731  another term ends the search

    def beside(step: int) -> np.ndarray:
        next_ = places + step
        todo = places[(next_ >= 0) & (next_ < n)]
        while len(todo):
            todo = todo[~larger(next_[todo], todo)]
            next_[todo] = next_[next_[todo]]
            todo = todo[(next_[todo] >= 0) & (next_[todo] < n)]
        inside = (next_ >= 0) & (next_ < n)
        inside[inside] = terms[next_[inside]] == terms[inside]
        return np.where(inside, next_, -1)

    before, after = beside(-1), beside(1)
    both = (before >= 0) & (after >= 0)
    nearer = larger(np.where(both, after, 0), np.where(both, before, 0)) if n else np.zeros(0, bool)
    parent = np.where(both, np.where(nearer, before, after), np.maximum(before, after))
    left, right = np.full(n, -1), np.full(n, -1)
    low, high = (parent > places), (parent >= 0) & (parent < places)
    left[parent[low]], right[parent[high]] = places[low], places[high]
    return left, right, places[parent < 0]


class Block:
    """The treaps of the terms of one block of documents, which are numbered in order of their ids."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, size: int):
        order = np.lexsort((docs, terms))
        self.terms, self.docs, self.impacts, self.size = terms[order], docs[order], impacts[order], size
        self.left, self.right, roots = treaps(self.terms, self.impacts)
        self.root = dict(zip(self.terms[roots].tolist(), roots.tolist(), strict=True))
        self.places = self.terms.astype(np.int64) * size + self.docs

    def best(self, terms: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best of a query; equal scores by document."""
        known = np.array([t in self.root for t in terms.tolist()], bool)
        terms, times = terms[known].astype(np.int64), times[known]
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(terms):
            return found, scores
        lo, hi = np.array([0]), np.array([self.size])
        nodes = np.array([[self.root[t] for t in terms.tolist()]])
        bound = (self.impacts[nodes] * times).sum(1)
        width = max(1, _FRONTIER // len(terms))
        while len(lo):
            least = scores[-1] if len(scores) == k else 1
            alive = bound >= least
            order = np.argsort(-bound[alive], kind="stable")
            lo, hi, nodes, bound = lo[alive][order], hi[alive][order], nodes[alive][order], bound[alive][order]
            now, later = slice(None, width), slice(width, None)
            a, b, at = lo[now], hi[now], nodes[now]
            if not len(a):
                break
            weight = np.where(at >= 0, self.impacts[at] * times, -1)
            pivot = self.docs[at[np.arange(len(at)), weight.argmax(1)]]
            found, scores = self._kept(found, scores, pivot, self._scores(pivot, terms, times), k)
            parts = [self._inside(at, x, y) for x, y in ((a, pivot), (pivot + 1, b))]
            lo = np.concatenate([a, pivot + 1, lo[later]])
            hi = np.concatenate([pivot, b, hi[later]])
            bounds = [(np.where(p >= 0, self.impacts[p], 0) * times).sum(1) for p in parts]
            nodes, bound = np.concatenate([*parts, nodes[later]]), np.concatenate([*bounds, bound[later]])
        return found, scores

    def _inside(self, nodes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """From each node down its treap to the first node whose document is in [lo, hi): the root of what the interval holds."""
        width = nodes.shape[1]
        out = nodes.ravel().copy()
        todo = np.flatnonzero(out >= 0)
        while len(todo):
            now, row = out[todo], todo // width
            docs = self.docs[now]
            under, over = docs < lo[row], docs >= hi[row]
            away = under | over
            todo, now, under = todo[away], now[away], under[away]
            out[todo] = np.where(under, self.right[now], self.left[now])
            todo = todo[out[todo] >= 0]
        return out.reshape(nodes.shape)

    def _scores(self, docs: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        wanted = terms[None, :] * self.size + docs[:, None]
        at = np.minimum(np.searchsorted(self.places, wanted), len(self.places) - 1)
        return (np.where(self.places[at] == wanted, self.impacts[at], 0) * times).sum(1)

    def _kept(self, found: np.ndarray, scores: np.ndarray, docs: np.ndarray, new: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        docs, new = np.concatenate([found, docs[new > 0]]), np.concatenate([scores, new[new > 0]])
        order = np.lexsort((docs, -new))[:k]
        return docs[order], new[order]


def impact(times: np.ndarray, weights: np.ndarray, lengths: list[int], n: int, total: int) -> np.ndarray:
    """w * ((1000000000 * tf) div (1000 * tf + 8 * m)), with m = 100 - 75 + (75 * length * N) div L."""
    m = np.array([100 - _LENGTH_SHARE + _LENGTH_SHARE * length * n // total for length in lengths], np.int64)
    return weights * ((1_000_000_000 * times) // (1000 * times + 8 * m))


def _search(queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n: int, total: int, k: int):
    """A block's documents to the k best (query, doc_id, score) of each query."""
    def of(docs: pa.Table) -> pa.Table:
        docs = docs.combine_chunks().sort_by([("doc_id", "ascending")])  # nulls last
        sizes = docs["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        flat = lambda c: docs[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        terms, times = flat("terms"), flat("times").astype(np.int64)
        lengths = docs["n"].to_pylist()
        rows = np.repeat(np.arange(len(docs)), sizes)
        m_of = impact(times, weights[terms], [lengths[r] for r in rows.tolist()], n, total)
        block = Block(terms, rows, m_of, len(docs))
        out = [(q, *block.best(t, c, k)) for q, (t, c) in enumerate(queries)]
        query = np.concatenate([np.full(len(d), q, np.int32) for q, d, _ in out] or [np.zeros(0, np.int32)])
        found, scores = (np.concatenate([x[i] for x in out] or [np.zeros(0)]).astype(np.int64) for i in (1, 2))
        return pa.table({"query": query, "doc_id": docs["doc_id"].take(pa.array(found)), "score": scores})

    return of


def _one_pass(docs: DataFrame, items: DataFrame, k: int, block: int) -> DataFrame:
    """The result for items (item_id, terms) whose distinct terms are MOST_TERMS at most, or that are one row."""
    spark = docs.sparkSession
    rows = items.collect()  # MOST_TERMS terms at most, however large the table of items: search() deals them out
    numbers = {t: i for i, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
    queries = []
    for r in rows:
        counts = sorted(Counter(numbers[t] for t in r["terms"]).items())
        queries.append((np.array([t for t, _ in counts], np.int64), np.array([c for _, c in counts], np.int64)))
    packed = {t.encode(): i for t, i in numbers.items()}
    postings = written(docs.mapInArrow(_postings(packed), "doc_id long, n long, terms array<int>, times array<int>"))
    n, total = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    held = postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # a row for each term of the queries at most
    weights = np.zeros(len(numbers), np.int64)
    for r in held:
        weights[r["t"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["count"] + 1)))
    parts = -(-n // block)
    with_terms = postings.where(F.size("terms") > 0).withColumn("part", F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(parts)))
    near = with_terms.groupBy("part").applyInArrow(_search(queries, weights, n, total, k), "query int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # A block's best go to a share of their query first, so that no window holds all blocks of a large table.
    shares = max(1, parts // 64)
    if shares > 1:
        share = Window.partitionBy("query", F.pmod(F.xxhash64("doc_id"), F.lit(shares))).orderBy(*order)
        near = near.withColumn("r", F.row_number().over(share)).where(F.col("r") <= k).drop("r")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    ids = small_table(spark, [(i, r["item_id"]) for i, r in enumerate(rows)], "query int, item_id long")
    return ranked.join(F.broadcast(ids), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")  # ids: a row for each item of the pass


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", k: int = 10, block: int = BLOCK, most_terms: int = MOST_TERMS) -> DataFrame:
    """(item_id, rank from 1, doc_id, score): the k documents of largest score above 0 for each item, equal scores by ascending doc_id.

    Score: the sum over the item's terms, repeats included, of w * ((1000000000 * tf) div (1000 * tf + 8 * m)), where
    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))), m = 100 - 75 + (75 * n * N) div L, N documents hold a term, L terms
    stand in all, n in the document, and tf times the term. All documents are searched exactly.
    Null and empty texts have no terms and are never found; items without known terms give no rows. Repeated rows are
    documents and items of their own; null ids stand after all others. Other columns are left out.
    Items are dealt into passes so that about `most_terms` terms are searched for at once; each pass reads all documents.
    """
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item).cast("long").alias("item_id"), terms_of(F.col(text)).alias("terms")).where(F.size("terms") > 0)
    asked = written(asked)
    n, rows = asked.agg(F.coalesce(F.sum(F.size("terms").cast("long")), F.lit(0)), F.count("*")).first()
    if not rows:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    passes = min(rows, -(-n // most_terms))
    if passes == 1:
        return _one_pass(plain, asked, k, block)
    dealt = written(asked.withColumn("pass", F.pmod(F.xxhash64("item_id", "terms"), F.lit(passes))))
    out = None
    for i in range(passes):
        one = _one_pass(plain, dealt.where(F.col("pass") == i).drop("pass"), k, block)
        out = one if out is None else out.unionByName(one)
    return out
