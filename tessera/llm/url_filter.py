"""URL filters: all rules at once, as bits of a wildcard Shift-And automaton over the canonical URL.

A glob is a run of literal bytes with `*` (any bytes but `/`) and `**` (any bytes) between them. Every glob takes one bit
for its start and one for each literal byte, packed side by side into 64-bit words. Reading byte c turns the state S into
((S << 1) & literal[c]) | (S & loop[c]), for all globs and a whole batch of URLs in the same few instructions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slabs, unused


@dataclass(frozen=True)
class Rule:
    """`host` and all its subdomains, where the path starts with `path`."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> list[str]:
        return [f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"]


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))
#: Globs of the method itself; they decide where no rule fits.
BLOCK_GLOBS = ("*casino*/**", "*porn*/**", "*viagra*/**", "*.xxx/**", "**/wp-login.php**", "**/cgi-bin/**", "**.exe", "**.torrent")


class Automaton:
    """Shift-And masks of several globs; `run` tells which of them match each text as a whole."""

    def __init__(self, globs: list[str]):
        parts = [[p for p in re.split(rb"(\*+)", g.encode()) if p] for g in globs]
        bits = sum(1 + sum(len(p) for p in ps if not p.startswith(b"*")) for ps in parts)
        self.words = max(1, -(-bits // 64))
        literal, loop = np.zeros((256, self.words * 64), bool), np.zeros((256, self.words * 64), bool)
        starts, self.accept, at = np.zeros(self.words * 64, bool), [], 0
        for ps in parts:
            starts[at] = True
            for p in ps:
                if p.startswith(b"*"):
                    loop[:, at] = True
                    loop[ord("/"), at] = len(p) > 1
                else:
                    for c in p:
                        at += 1
                        literal[c, at] = True
            self.accept.append(at)
            at += 1
        pack = lambda m: np.packbits(m, axis=-1, bitorder="little").view("<u8")
        self.literal, self.loop, self.start = pack(literal), pack(loop), pack(starts)

    def run(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text, a column for each glob."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        hits = np.zeros((len(texts), len(self.accept)), bool)
        sizes = [len(texts[i]) for i in order]
        lo = 0
        while lo < len(order):  # rows of like length side by side, 4 MB of padded bytes at most
            hi = min(len(order), lo + max(1, (4 << 20) // max(1, sizes[lo])))
            rows, longest = order[lo:hi], sizes[lo]
            grid = np.frombuffer(b"".join(texts[i].ljust(longest, b"\0") for i in rows), np.uint8).reshape(len(rows), longest)
            state = np.repeat(self.start[None], len(rows), axis=0)
            ends = np.searchsorted(-np.array(sizes[lo:hi]), -np.arange(longest), side="left")  # rows longer than j
            for j in range(longest):
                k = ends[j]
                s, c = state[:k], grid[:k, j]
                moved = s << np.uint64(1)
                moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
                state[:k] = (moved & self.literal[c]) | (s & self.loop[c])
            for g, bit in enumerate(self.accept):
                hits[rows, g] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
            lo = hi
        return hits


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased. Path: then up to `?`, `#` or end. Null or no `://`: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(df: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, block_globs: tuple[str, ...] = BLOCK_GLOBS) -> DataFrame:
    """Add host, path, rule, glob and verdict for each URL.

    Of the rules that fit, the longest wins (of equal ones the earlier). Where none fits, the first matching glob blocks
    and else the URL is allowed. Null, empty and malformed URLs have empty host and path, fit no rule and are allowed.
    Columns of these five names that `df` has already are replaced.
    """
    globs = [g for r in rules for g in r.globs] + list(block_globs)
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))

    @F.pandas_udf("rule string, action string, glob string")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(globs)
        for urls in batches:
            texts = [u.encode("utf-8", "surrogatepass") for u in urls]
            out = []
            for lo, hi in slabs([len(t) for t in texts], 16 << 20):
                hits = automaton.run(texts[lo:hi])
                for row in hits:
                    rule = next((rules[i] for i in ranked if row[2 * i] or row[2 * i + 1]), None)
                    glob = next((g for g, hit in zip(block_globs, row[2 * len(rules) :], strict=True) if hit), None)
                    out.append((rule and rule.name, rule and rule.action, glob))
            yield pd.DataFrame(out, columns=["rule", "action", "glob"], dtype=object)

    host, path = host_and_path(F.col(url))
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "glob", "verdict")]
    (own,) = unused([*kept, "host", "path"], "judged")
    out = df.select(*kept, host.alias("host"), path.alias("path")).withColumn(own, judged(F.concat("host", "path")))
    verdict = F.coalesce(f"{own}.action", F.when(F.col(f"{own}.glob").isNotNull(), "block").otherwise("allow"))
    return out.select(*kept, "host", "path", f"{own}.rule", f"{own}.glob", verdict.alias("verdict"))
