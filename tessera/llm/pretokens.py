"""The pre-tokens that the byte-level tokenizers' pattern matches, found from runs of character classes."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

LETTER, NUMBER, SPACE, OTHER = range(4)
#: Code points with the property White_Space, as inclusive ranges.
WHITE_SPACE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: What may follow an apostrophe in a pre-token.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for lo, hi in WHITE_SPACE:
        table[lo : hi + 1] = SPACE
    return table


def pretokens(text: str) -> list[str]:
    """The matches of public_tokenizers.PATTERN, in order; together they are the text."""
    if not text:
        return []
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[chars]
    starts = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1))
    ends = np.append(starts[1:], len(chars))
    begins = np.zeros(len(chars) + 1, bool)
    begins[starts] = True
    # The last white space before something else stands apart; if it is a blank, it belongs to what follows.
    inner = (kind[starts] == SPACE) & (ends < len(chars))
    begins[ends[inner] - 1] = True
    begins[ends[inner & (chars[ends - 1] == 0x20)]] = False
    # A lone apostrophe that starts a pre-token takes a contraction's letters with it.
    lone = starts[(chars[starts] == 0x27) & (ends - starts == 1) & (ends < len(chars)) & begins[starts]]
    for a in lone[kind[np.minimum(lone + 1, len(chars) - 1)] == LETTER].tolist():
        for c in CONTRACTIONS:
            if text.startswith(c, a + 1):
                begins[a + 1] = False
                begins[a + 1 + len(c)] = True
                break
    cuts = np.flatnonzero(begins[: len(chars)]).tolist()
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]
