"""All places of many phrases in texts, found in one pass: an automaton over word numbers, run on Arrow batches."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start: int, end: int, phrase: int>>"


class Automaton:
    """Phrases as sequences of words: each state is a beginning of phrases, and falls back to its longest end that is one, too."""

    def __init__(self, phrases: Iterable[Sequence[str]]):
        self.lengths = [len(p) for p in phrases]
        self.vocabulary = sorted({w for p in phrases for w in p})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for phrase, words in enumerate(phrases):
            state = 0
            for w in words:
                if number[w] not in self.next[state]:
                    self.next[state][number[w]] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                state = self.next[state][number[w]]
            if state:
                self.ends[state].append(phrase)
        self.back = [0] * len(self.next)
        todo = deque(self.next[0].values())
        while todo:
            state = todo.popleft()
            for w, child in self.next[state].items():
                self.back[child] = self.step(self.back[state], w)
                self.ends[child] += self.ends[self.back[child]]
                todo.append(child)

    def step(self, state: int, word: int) -> int:
        while state and word not in self.next[state]:
            state = self.back[state]
        return self.next[state].get(word, 0)

    def places(self, words: pa.Array) -> pa.Array:
        """For each list of words all (start from 1, end after the last word, phrase), in order; none for a null list."""
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        numbers = pc.fill_null(pc.index_in(words.flatten(), pa.array(self.vocabulary, pa.string())), -1).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(numbers >= 0)  # an unknown word ends every phrase
        row = np.repeat(np.arange(len(sizes)), sizes)[known]
        found, state, last = [], 0, (-1, -1)
        for at, own, word in zip(known.tolist(), row.tolist(), numbers[known].tolist(), strict=True):
            state = self.step(state if last == (own, at - 1) else 0, word)
            last = own, at
            for phrase in self.ends[state]:
                found.append((own, at + 1 - self.lengths[phrase], at + 1, phrase))
        own, start, end, phrase = np.array(sorted(found), np.int64).reshape(-1, 4).T
        shift = 1 - first[own]
        columns = [pa.array((c).astype(np.int32)) for c in (start + shift, end + shift, phrase)]
        offsets = np.append(0, np.cumsum(np.bincount(own, minlength=len(sizes)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, names=["start", "end", "phrase"]))


def spans(words: Column, phrases: Sequence[str] | Sequence[Sequence[str]]) -> Column:
    """All places (start from 1, end after the last word, number of the phrase) of phrases among `words`, in order, also where they overlap.

    A phrase is its words, or a text that blanks cut into them; one without words stands nowhere. Null words hold nothing.
    The list of phrases goes to every task: it is a short list by hand, or a dictionary.
    """
    automaton = Automaton([p.split() if isinstance(p, str) else list(p) for p in phrases])

    @F.arrow_udf(SPAN)
    def found(words: pa.Array) -> pa.Array:
        return automaton.places(words)

    return found(words) if automaton.vocabulary else F.array().cast(SPAN)


def covered(found: Column) -> Column:
    """The places (from 1), each once, that spans take."""
    return F.array_distinct(F.flatten(F.transform(found, lambda s: F.sequence(s["start"], s["end"] - 1))))


def all_places(words: Column) -> Column:
    return F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))


def without(words: Column, found: Column) -> Column:
    """The words outside all spans. `words` must be a column that is there, not an expression, as it is read again for each word that stays."""
    return F.transform(F.array_except(all_places(words), covered(found)), lambda i: F.get(words, i - 1))


def mask(words: Column, found: Column) -> Column:
    """Whether each word belongs to one of the spans."""
    told = lambda places, value: F.transform(places, lambda i: F.struct(i.alias("i"), F.lit(value).alias("x")))
    every, taken = all_places(words), covered(found)
    return F.transform(F.sort_array(F.concat(told(F.array_except(every, taken), False), told(F.array_intersect(every, taken), True))), lambda p: p["x"])


def held(found: Column, phrases: list[str]) -> Column:
    """The phrases that have a span, in the order given."""
    numbers = F.array_distinct(F.transform(found, lambda s: s["phrase"]))
    return F.transform(F.sort_array(numbers), lambda n: F.element_at(F.array(*map(F.lit, phrases)).cast("array<string>"), n + 1))
