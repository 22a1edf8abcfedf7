"""N-gram Jaccard join of whole texts: exact links and their components.

Shingles are ordered by the number of sets that hold them, rarest first. Two sets that link share one of their rarest
n - ceil(t n) + 1 shingles, so only these are indexed, and of these only the ones that a second set holds. Most texts have
enough shingles of their own to need no posting at all; what copies share is found wherever it stands in the corpus.

Texts are cut into shingles once, in pieces. A piece sends its keys by ranges of hashes to be counted and gets back those
that other sets hold too; keys that many texts of one piece hold travel as one count, so that a passage of a third of all
texts weighs one posting a piece. What comes back is all that links can be made of: the inverted lists, joined as chains of
texts of like size rather than as pairs, give candidate groups, and in each group the T-occurrence search (DivideSkip)
merges the short inverted lists of a text by a heap, probes the long ones by binary search, and keeps the texts that reach
the overlap asked for. A text is first searched among one text of each tree found so far, and among the others only while
its group is in several trees. Groups too large for a task are searched in blocks.

Hashes have 56 bits; a count is wrong only if two different shingles of the two texts compared share one.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, cut, slabs, unused, written

#: Bytes of the texts of a piece, unless one text is longer.
PIECE_BYTES = 4_000_000
#: Bytes of the texts whose keys one range of hashes counts.
RANGE_BYTES = 16_000_000
#: From so many texts of a piece on, a key is sent as a count without its texts.
LOCALLY_FREQUENT = 16
#: Shingles that a task of the search holds, and those of a block of a group that is larger than a task.
TASK_SHINGLES, BLOCK_SHINGLES = 1_000_000, 100_000
#: From so many candidates on, the long lists are probed for all of them at once.
MANY_FOUND = 16
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_HALF, _DROPPED = np.uint64(32), np.uint64(8)
#: Kinds of rows between pieces and ranges: postings, counts of locally frequent keys, their postings, and the piece's texts.
POSTINGS, COUNTS, FREQUENT, TEXTS = range(4)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _HALF)) * _D
    h = (h ^ (h >> _HALF)) * _A
    return h ^ (h >> _HALF)


def shingle_sets(texts: list[bytes | None], words: int = 3) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct runs of `words` words, A-Z in lower case; of fewer words, one hash of all."""
    split = [(t or b"").lower().split() for t in texts]
    known: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    number = np.fromiter((known.setdefault(w, len(known)) for ws in split for w in ws), np.int64, sizes.sum())
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))[number] if known else np.zeros(0, np.uint64)
    factors = _mix(np.arange(1, words + 1, dtype=np.uint64) * _B)
    runs = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        runs += hashes[k : k + len(runs)] * factors[k]
    runs, out, at = _mix(runs) >> _DROPPED, [], 0
    for n in sizes.tolist():
        if n >= words:
            out.append(np.unique(runs[at : at + n - words + 1]))
        elif n:
            whole = np.array([n], np.uint64) * _C
            for k in range(n):
                whole += hashes[at + k : at + k + 1] * factors[k]
            out.append(_mix(whole) >> _DROPPED)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _packed(a: np.ndarray) -> bytes:
    """Byte planes of whole numbers, compressed."""
    return zstandard.compress(np.ascontiguousarray(a, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(b), dtype=np.uint64)


def _by_range(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """The ranges of hashes that sorted keys fall in, and their places."""
    at = np.searchsorted(((keys >> np.uint64(24)) * np.uint64(ranges)) >> _HALF, np.arange(ranges + 1).astype(np.uint64)).tolist()
    return ((r, slice(i, j)) for r, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if i < j)


_ROWS = pa.schema([("range", pa.int32()), ("piece", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("values", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64())), ("marks", pa.list_(pa.binary())), ("digests", pa.list_(pa.binary()))])
_ROWS_SQL = "range int, piece long, kind int, keys binary, values binary, counts binary, ids array<long>, marks array<binary>, digests array<binary>"


def _first_of(digests: list[bytes | None]) -> np.ndarray:
    """Of each text the number of the first text of the piece with an equal set."""
    first: dict[bytes | None, int] = {}
    return np.fromiter((i if d is None else first.setdefault(d, i) for i, d in enumerate(digests)), np.int64, len(digests))


def _read_pieces(ranges: int, words: int):
    """Rows of (doc_id, mark, text) -> the keys of each piece by ranges, and what is known of its texts."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi in slabs(pc.fill_null(pc.binary_length(batch["text"]), 0).to_pylist(), PIECE_BYTES):
                sets = shingle_sets(batch["text"].slice(lo, hi - lo).to_pylist(), words)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                first = _first_of(digests)
                own = np.flatnonzero(first == np.arange(len(sets)))
                keys = np.concatenate([sets[i] for i in own])
                holders = np.repeat(own, [len(sets[i]) for i in own])
                order = np.argsort(keys, kind="stable")
                keys, holders = keys[order], holders[order].astype(np.uint64)
                starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
                counts = np.diff(np.append(starts, len(keys)))
                many = counts >= LOCALLY_FREQUENT
                in_many = np.repeat(many, counts)
                rows = [(r, POSTINGS, _packed_keys(keys[~in_many][at]), _packed(holders[~in_many][at]), None) for r, at in _by_range(keys[~in_many], ranges)]
                rows += [(r, COUNTS, _packed_keys(keys[starts][many][at]), None, _packed(counts[many][at])) for r, at in _by_range(keys[starts][many], ranges)]
                at = zlib.crc32(str(piece).encode()) % ranges
                rows.append((at, FREQUENT, _packed_keys(keys[in_many]), _packed(holders[in_many]), None))
                rows.append((at, TEXTS, None, None, _packed(np.fromiter(map(len, sets), np.int64, len(sets)))))
                lone = [None] * (len(rows) - 1)
                part = batch.slice(lo, hi - lo)
                r, kind, k, v, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip((r, [piece] * len(rows), kind, k, v, c, [*lone, part["doc_id"].to_pylist()], [*lone, part["mark"].to_pylist()], [*lone, digests]), _ROWS, strict=True)], schema=_ROWS)
                piece += hi - lo

    return pieces


def _counted(rows: pa.Table) -> pa.Table:
    """Of one range: the postings whose key a second set holds, with the number of sets that do; all else as it is."""
    kinds = rows["kind"].to_pylist()
    asked = [i for i, k in enumerate(kinds) if k in (POSTINGS, COUNTS)]
    cols = {c: rows[c].to_pylist() for c in ("piece", "keys", "values", "counts")}
    keys = [_unpacked_keys(cols["keys"][i]) for i in asked]
    ends = np.cumsum([0, *map(len, keys)]).tolist()
    all_keys = np.concatenate([np.zeros(0, np.uint64), *keys])
    weight = np.ones(len(all_keys), np.int32)
    for i, lo, hi in zip(asked, ends[:-1], ends[1:], strict=True):
        if kinds[i] == COUNTS:
            weight[lo:hi] = _unpacked(cols["counts"][i])
    order = np.argsort(all_keys, kind="stable").astype(np.int32)
    keys, held = [all_keys[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)], np.zeros(len(order), np.int32)
    if len(order):
        in_order = all_keys[order]
        starts = np.flatnonzero(np.append(True, in_order[1:] != in_order[:-1]))
        held[order] = np.repeat(np.add.reduceat(weight[order], starts), np.diff(np.append(starts, len(order))))
    out = []
    for i, k, lo, hi in zip(asked, keys, ends[:-1], ends[1:], strict=True):
        n = held[lo:hi]
        if kinds[i] == COUNTS:
            out.append((cols["piece"][i], COUNTS, cols["keys"][i], None, _packed(n)))
        elif (n > 1).any():
            out.append((cols["piece"][i], POSTINGS, _packed_keys(k[n > 1]), _packed(_unpacked(cols["values"][i])[n > 1]), _packed(n[n > 1])))
    passed = rows.filter(pc.is_in(rows["kind"], pa.array([FREQUENT, TEXTS], pa.int32())))
    done = list(zip(*out, strict=True)) or [()] * 5
    none = [None] * len(out)
    mine = pa.Table.from_arrays([pa.array(a, f.type) for a, f in zip((none, *done, none, none, none), _ROWS, strict=True)], schema=_ROWS)
    return pa.concat_tables([mine, passed.cast(_ROWS)])


_PIECES = """texts array<struct<node: long, doc_id: long, mark: binary, n: long, digest: binary>>, links array<struct<u: long, v: long>>,
    sets array<struct<node: long, hashes: binary>>, parts array<struct<range: int, keys: binary, nodes: binary, low: binary, high: binary>>"""
_LINK = pa.struct([("u", pa.int64()), ("v", pa.int64())])
_PIECES_ARROW = pa.schema([
    ("texts", pa.list_(pa.struct([("node", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.binary()), ("n", pa.int64()), ("digest", pa.binary())]))),
    ("links", pa.list_(_LINK)),
    ("sets", pa.list_(pa.struct([("node", pa.int64()), ("hashes", pa.binary())]))),
    ("parts", pa.list_(pa.struct([("range", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary()), ("low", pa.binary()), ("high", pa.binary())]))),
])


def _prefixes(ranges: int, percent: int):
    """Of one piece: its texts, the sets that may link, and the runs of texts of like size in each inverted list of prefixes."""

    def prefixes(rows: pa.Table) -> pa.Table:
        kinds = rows["kind"].to_pylist()
        cols = {c: rows[c].to_pylist() for c in ("keys", "values", "counts")}
        of = lambda kind: [i for i, k in enumerate(kinds) if k == kind]
        head = of(TEXTS)[0]
        base = rows["piece"][head].as_py()
        ids, marks, digests = (rows[c][head].as_py() for c in ("ids", "marks", "digests"))
        n = _unpacked(cols["counts"][head]).astype(np.int64)
        join = lambda arrays, kind: np.concatenate([np.zeros(0, kind), *arrays]).astype(kind)
        known = join([_unpacked_keys(cols["keys"][i]) for i in of(COUNTS)], np.uint64)
        known_held = join([_unpacked(cols["counts"][i]) for i in of(COUNTS)], np.int64)
        order = np.argsort(known)
        known, known_held = known[order], known_held[order]
        frequent = join([_unpacked_keys(cols["keys"][i]) for i in of(FREQUENT)], np.uint64)
        keys = join([*(_unpacked_keys(cols["keys"][i]) for i in of(POSTINGS)), frequent], np.uint64)
        text = join([_unpacked(cols["values"][i]) for i in (*of(POSTINGS), *of(FREQUENT))], np.int64)
        held = join([*(_unpacked(cols["counts"][i]) for i in of(POSTINGS)), known_held[np.searchsorted(known, frequent)]], np.int64)
        order = np.lexsort((keys, held, text))
        keys, text = keys[order], text[order]
        shared = np.bincount(text, minlength=len(n))
        begin = np.cumsum(shared) - shared
        place = np.arange(len(text)) - begin[text]
        # Shingles of the text alone come first in its order and take the first places of its prefix.
        indexed = np.clip(n - -(-percent * n // 100) + 1 - (n - shared), 0, shared)
        sets = [{"node": base + i, "hashes": keys[begin[i] : begin[i] + shared[i]].astype("<u8").tobytes()} for i in np.flatnonzero(indexed).tolist()]
        chosen = place < indexed[text]
        keys, text = keys[chosen], text[chosen]
        order = np.lexsort((n[text], keys))
        keys, text = keys[order], text[order]
        alike = np.append(False, (keys[1:] == keys[:-1]) & (100 * n[text[:-1]] >= percent * n[text[1:]]))[: len(keys)]
        links = np.unique(np.stack((text[alike], text[np.flatnonzero(alike) - 1]), 1), axis=0)
        first = _first_of(digests)
        again = np.flatnonzero(first != np.arange(len(n)))
        links = np.concatenate((links, np.stack((again, first[again]), 1)))
        starts = np.flatnonzero(~alike)
        low, high = n[text[starts]], n[text[np.append(starts[1:], len(text)) - 1]] if len(text) else n[:0]
        parts = [{"range": r, "keys": _packed_keys(keys[starts][at]), "nodes": _packed(base + text[starts][at]), "low": _packed(low[at]), "high": _packed(high[at])} for r, at in _by_range(keys[starts], ranges)]
        texts = [{"node": base + i, "doc_id": d, "mark": m, "n": k, "digest": x} for i, (d, m, k, x) in enumerate(zip(ids, marks, n.tolist(), digests, strict=True))]
        pairs = [{"u": base + u, "v": base + v} for u, v in links.tolist()]
        return pa.Table.from_arrays([pa.array([a], f.type) for a, f in zip((texts, pairs, sets, parts), _PIECES_ARROW, strict=True)], schema=_PIECES_ARROW)

    return prefixes


def _meet(percent: int):
    """Links between the runs of one range that have a key in common and sizes that may link: each to the one before it by size."""

    def meet(parts: pa.Table) -> pa.Table:
        column = lambda c: np.concatenate([_unpacked(b) for b in parts[c].to_pylist()]).astype(np.int64)
        keys = np.concatenate([_unpacked_keys(b) for b in parts["keys"].to_pylist()])
        nodes, low, high = column("nodes"), column("low"), column("high")
        order = np.lexsort((nodes, low, keys))
        keys, nodes, low, high = keys[order], nodes[order], low[order], high[order]
        number = np.cumsum(np.append(0, keys[1:] != keys[:-1]))
        largest = np.maximum.accumulate((number << 40) + high) - (number << 40)
        near = (keys[1:] == keys[:-1]) & (100 * largest[:-1] >= percent * low[1:])
        links = np.unique(np.stack((nodes[1:][near], nodes[:-1][near]), 1), axis=0)
        return pa.table({"u": links[:, 0], "v": links[:, 1]})

    return meet


class Forest:
    """Union-find over numbered sets that also counts trees."""

    def __init__(self, start: list[int]):
        self.up, self.links, self.trees = list(range(len(start))), [], len(start)
        first: dict[int, int] = {}
        for i, s in enumerate(start):
            self.join(first.setdefault(s, i), i, new=False)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int, new: bool = True) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.trees -= 1
            if new:
                self.links.append((i, j))


def occurrences(lists: list[array], least: int, wanted: Callable[[int], bool]) -> Iterator[tuple[int, int]]:
    """Numbers that stand in `least` or more of the sorted lists and are wanted, with how often they do (DivideSkip).

    The longest lists are set apart, fewer than `least` of them. A heap merges the others; what it finds is looked up in
    the long lists by binary search, until it can't reach `least` any more.
    """
    if len(lists) < least:
        return
    lists = sorted(lists, key=len)
    short, long = lists[: len(lists) - least + 1], lists[len(lists) - least + 1 :]
    found = [(number, len(list(run))) for number, run in groupby(heapq.merge(*short))]
    found = [(number, count) for number, count in found if wanted(number)]
    if len(found) < MANY_FOUND:
        for number, count in found:
            for rest, own in zip(range(len(long), 0, -1), long, strict=True):
                if count + rest < least:
                    break
                at = bisect_left(own, number)
                count += at < len(own) and own[at] == number
            if count >= least:
                yield number, count
        return
    numbers, counts = (np.array(x, np.int32) for x in zip(*found, strict=True))
    for rest, own in zip(range(len(long), 0, -1), long, strict=True):
        able = counts + rest >= least
        numbers, counts, own = numbers[able], counts[able], np.frombuffer(own, np.int32)
        counts = counts + (own[np.minimum(np.searchsorted(own, numbers), len(own) - 1)] == numbers)
    yield from zip(numbers[counts >= least].tolist(), counts[counts >= least].tolist(), strict=True)


def search(sets: list[np.ndarray], sizes: list[int], start: list[int], percent: int, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join, with those of equal `start`, all sets of one group that links connect.

    sets: hashes without those that no other set holds; sizes: with them. If sides are given, only sets of different sides are compared.
    """
    order = sorted(range(len(sets)), key=lambda i: (sizes[i], i))
    sizes, forest = [sizes[i] for i in order], Forest([start[i] for i in order])
    if forest.trees == 1:
        return []
    number, count = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)[1:]
    ends = np.cumsum([len(sets[i]) for i in order])[:-1]
    own = [part[count[part] > 1].tolist() for part in np.split(number, ends)]  # numbers of the hashes that two sets of the group hold

    def look(index: dict[int, array], i: int) -> None:
        n = sizes[i]
        lists = [index[h] for h in own[i] if h in index]
        apart = lambda j: 100 * sizes[j] >= percent * n and forest.root(j) != forest.root(i)
        for j, common in occurrences(lists, max(1, -(-percent * n // 100)), apart):
            if 100 * common >= percent * (n + sizes[j] - common):
                forest.join(i, j)

    def put(index: dict[int, array], i: int) -> None:
        for h in own[i]:
            index.setdefault(h, array("i")).append(i)

    indexes: dict[int, dict[int, array]] = {}
    if sides is not None:
        for i in range(len(own)):
            if forest.trees == 1:
                break
            side = sides[order[i]]
            for other, index in indexes.items():
                if other != side:
                    look(index, i)
            put(indexes.setdefault(side, {}), i)
        return [(order[i], order[j]) for i, j in forest.links]
    # First among one set of each tree: a set that joins none is a tree's first.
    leads: dict[int, array] = {}
    others = []
    for i in range(len(own)):
        look(leads, i)
        if forest.root(i) == i:
            put(leads, i)
        else:
            others.append(i)
    # Then among the others, tree by tree, while there are several trees.
    joined = set(others)
    for i in range(len(own)):
        if forest.trees == 1:
            break
        for tree, index in indexes.items():
            if forest.root(tree) != forest.root(i):
                look(index, i)
        if i in joined:
            put(indexes.setdefault(forest.root(i), {}), i)
    return [(order[i], order[j]) for i, j in forest.links]


def _search_task(percent: int, sides: bool):
    def searched(rows: pa.Table) -> pa.Table:
        node, found, n, block = (rows[c].to_pylist() for c in ("node", "found", "n", "block"))
        members: dict[int, list[int]] = {}
        for i, c in enumerate(rows["candidate"].to_pylist()):
            members.setdefault(c, []).append(i)
        links = []
        for own in members.values():
            sets = [np.frombuffer(rows["hashes"][i].as_py(), "<u8") for i in own]
            part = search(sets, [n[i] for i in own], [found[i] for i in own], percent, [block[i] for i in own] if sides else None)
            links += [(node[own[i]], node[own[j]]) for i, j in part]
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    return searched


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """(candidate, node, n, hashes) -> links (u, v) that connect the sets of each candidate group wherever links do."""
    spark = sets.sparkSession
    sizes = cut(sets.groupBy("candidate").agg(F.sum(F.octet_length("hashes") / 8).cast("long").alias("total")))
    total, most = sizes.agg(F.sum("total"), F.max("total")).first()
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total or 0) // TASK_SHINGLES)
    blocks = F.when(F.col("total") > 2 * BLOCK_SHINGLES, F.ceil(F.col("total") / BLOCK_SHINGLES)).otherwise(1).cast("int")
    sets = sets.join(sizes, "candidate").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int"))
    own = F.when(F.col("blocks") > 1, F.xxhash64("candidate", "block")).otherwise(F.pmod(F.xxhash64("candidate"), F.lit(bins)))
    columns = ["candidate", "node", "n", "hashes", "found", "block"]
    run = lambda df, sides=False: cut(df.groupBy("task").applyInArrow(_search_task(percent, sides), "u long, v long"))
    links = run(sets.withColumn("found", F.col("node")).select(*columns, own.alias("task")))
    # Groups of several blocks: one set of each tree, of ever more blocks together, then the blocks of groups that are still in several trees.
    if (most or 0) <= 2 * BLOCK_SHINGLES:
        return links
    large = sets.where("blocks > 1")

    def apart() -> DataFrame:
        state = large.join(connected_components(links).withColumnRenamed("id", "node"), "node", "left").withColumn("found", F.coalesce("component", "node"))
        several = state.groupBy("candidate").agg(F.min("found").alias("low"), F.max("found").alias("high")).where("low < high").select("candidate")
        return state.join(several, "candidate")

    together = 8
    while together // 8 * BLOCK_SHINGLES < most:
        leads = apart().where("node = found").withColumn("task", F.xxhash64("candidate", F.floor(F.col("block") / together)))
        links = cut(links.unionByName(run(leads.select(*columns, "task"), True)))
        together *= 8
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j"))))
    pairs = apart().withColumn("pair", pairs).where("pair.i < pair.j")
    return links.unionByName(run(pairs.select(*columns, F.xxhash64("candidate", "pair.i", "pair.j").alias("task")), True))


def jaccard_classes(df: DataFrame, key: str, text: str, mark: str | None, words: int, percent: int) -> DataFrame:
    """(doc_id, mark, n_shingles, tree) for every row of `df`: rows whose sets links connect have an equal tree (a long; null without shingles).

    mark: a binary column that is handed on, by which the caller may know rows that share a key apart.
    """
    marks = F.col(mark).cast("binary") if mark else F.lit(None).cast("binary")
    texts = df.select(F.col(key).cast("long").alias("doc_id"), marks.alias("mark"), F.col(text).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    rows = texts.mapInArrow(_read_pieces(ranges, words), _ROWS_SQL).groupBy("range").applyInArrow(_counted, _ROWS_SQL)
    pieces = written(rows.groupBy("piece").applyInArrow(_prefixes(ranges, percent), _PIECES))
    nodes = pieces.select(F.explode("texts").alias("t")).select("t.*")
    met = pieces.select(F.explode("parts").alias("p")).select("p.*").groupBy("range").applyInArrow(_meet(percent), "u long, v long")
    near = met.unionByName(pieces.select(F.explode("links").alias("l")).select("l.*"))
    candidates = cut(connected_components(near))
    members = nodes.join(candidates.select(F.col("id").alias("node"), F.col("component").alias("candidate")), "node")
    # Equal sets are one representative; a set that fills a third of all rows is summed up before the shuffle.
    reps = cut(members.groupBy("candidate", "digest").agg(F.min("node").alias("node"), F.first("n").alias("n")))
    several = reps.groupBy("candidate").count().where("count > 1").select("candidate")
    sets = pieces.select(F.explode("sets").alias("s")).select("s.*").join(reps.join(several, "candidate"), "node")
    links = _links(written(sets.select("candidate", "node", "n", "hashes")), percent)
    trees = reps.join(connected_components(links).withColumnRenamed("id", "node"), "node", "left").select("candidate", "digest", F.coalesce("component", "node").alias("tree"))
    placed = members.select("candidate", "digest", "node").join(trees, ["candidate", "digest"]).select("node", "tree")
    out = nodes.join(placed, "node", "left")
    tree = F.when(F.col("n") > 0, F.coalesce("tree", "node"))
    return written(out.select("doc_id", "mark", F.col("n").alias("n_shingles"), tree.alias("tree")))


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the components of links between whole texts.

    A text's set holds its distinct runs of `words` words ([^\\x20\\x09-\\x0D]+, A-Z in lower case), or all its words as one
    where they are fewer; two texts link when 100 * intersection >= percent * union. component_id is the smallest key
    reachable, itself included. Null texts and texts without words have no shingles and link with nothing. Rows that
    repeat a key count each; a null key never names a component, unless all its members have none. Keys must be whole
    numbers; other columns are not read. An empty table gives no rows.
    """
    classes = jaccard_classes(df, key, text, None, words, percent)
    smallest = classes.where("tree IS NOT NULL").groupBy("tree").agg(F.min("doc_id").alias("component"), F.count("*").alias("members")).where("members > 1")
    out = classes.join(smallest, "tree", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def first_of_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Of the rows that links of near copies connect (see jaccard_components) the one of smallest key, then of smallest hash of the text.

    Keys may repeat or be null, also on different texts: each row is judged by its own text, and a null key comes last. Of
    rows equal in key and text one stays, with the other columns of any of them. Rows without words (null or blank texts)
    are no near copies of anything and all stay. Columns and their order are those of `df`.
    """
    mark, keep_key, keep_mark, row = unused(df.columns, "mark", "keep_key", "keep_mark", "row")
    marked = df.withColumn(mark, F.unhex(F.md5(F.col(text).cast("binary"))))
    classes = jaccard_classes(marked, key, text, mark, words, percent).where("tree IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    first = classes.groupBy("tree").agg(F.min(order).alias("f"))
    rows = classes.groupBy("tree", "doc_id", "mark").agg(F.count("*").alias("repeats"))
    kept = rows.join(first, "tree").where(F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("mark") == F.col("f.mark")))
    kept = cut(kept.select(F.col("doc_id").alias(keep_key), F.col("mark").alias(keep_mark), F.col("repeats")))
    worded = F.coalesce(F.col(text).cast("string"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")

    def chosen(which: DataFrame) -> DataFrame:
        return marked.where(worded).join(which.drop("repeats"), (F.col(mark) == F.col(keep_mark)) & F.col(key).cast("long").eqNullSafe(F.col(keep_key)), "left_semi")

    once = chosen(kept.where("repeats = 1")).select(*df.columns)
    again = chosen(kept.where("repeats > 1")).groupBy(F.col(key).cast("long").alias(keep_key), mark).agg(F.first(F.struct(*df.columns)).alias(row))
    return once.unionByName(again.select(f"{row}.*")).unionByName(df.where(~worded))
