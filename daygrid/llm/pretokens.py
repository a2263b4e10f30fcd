"""Words of byte-level BPE found on arrays: the split pattern as rules on classes of code points.

The pattern takes, from left to right, an English contraction, or an optional space with a run of letters, of numbers or
of other signs, or white space but for the last sign before a word. Said on arrays: a word begins where the class
changes, the space before a run belongs to it, and the last white space before a run stands alone unless it is such a
space. A contraction is a lone apostrophe, not after a space, before the right letters.
"""

from __future__ import annotations

import functools

import numpy as np

LETTER, NUMBER, SPACE, OTHER = range(4)
CODES = 0x110000
#: Code points with the White_Space property.
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.lru_cache(4)
def class_runs(path: str) -> tuple[tuple[int, int, int], ...]:
    """(first, end, class) of the letters, numbers and spaces, as the tokenizer itself sees them.

    Each code point is put between a letter and a digit; the side it sticks to tells its class.
    """
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    classes = np.full(CODES, OTHER, np.uint8)
    points = [c for c in range(CODES) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 1 << 16):
        part = points[at:at + (1 << 16)]
        starts = np.zeros(3 * len(part) + 1, bool)
        starts[[o[0] for _, o in split("".join(f"a{chr(c)}1" for c in part))]] = True
        part = np.asarray(part)
        classes[part[~starts[1:-1:3]]] = LETTER
        classes[part[~starts[2::3]]] = NUMBER
    classes[list(WHITE)] = SPACE
    edges = np.flatnonzero(np.diff(classes)) + 1
    firsts, ends = np.r_[0, edges], np.r_[edges, CODES]
    return tuple((int(a), int(b), int(classes[a])) for a, b in zip(firsts, ends, strict=True) if classes[a] != OTHER)


def class_table(runs) -> np.ndarray:
    classes = np.full(CODES, OTHER, np.uint8)
    for first, end, kind in runs:
        classes[first:end] = kind
    return classes


def word_starts(data: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte positions where words of the texts begin; ``rows`` holds the n + 1 byte offsets of the texts."""
    if not len(data):
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of code points
    first = data[lead]
    code = first.astype(np.int32)
    if first.max() >= 0x80:
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        for least, most, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
            which = np.flatnonzero((first >= least) & (first < most))
            if len(which):
                value = first[which].astype(np.int32) & mask
                for k in range(1, more + 1):
                    value = (value << 6) | (padded[lead[which] + k] & 0x3F)
                code[which] = value
    kind = classes[code]
    n = len(lead)
    fresh = np.zeros(n + 1, bool)  # a text begins here; the end counts as one
    fresh[np.searchsorted(lead, rows)] = True
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= fresh[:n]
    white = kind == SPACE
    # the last white sign before a word of the same text
    before = np.zeros(n, bool)
    before[:-1] = white[:-1] & ~white[1:] & ~fresh[1:n]
    glued = before & (code == 32)
    begins = change.copy()
    begins |= before  # it parts from the white space before it
    begins[1:] &= ~glued[:-1]  # and takes in the run after it
    begins[glued] = True
    begins[0] = True
    # contractions: a word that is one apostrophe, with letters right after it
    quote = np.flatnonzero((code[:-1] == 39) & begins[:-1] & (kind[1:] == LETTER) & ~fresh[1:n]) if n > 1 else np.zeros(0, np.int64)
    if len(quote):
        one = code[quote + 1]
        two = np.where((quote + 2 < n), code[np.minimum(quote + 2, n - 1)], 0)
        two = np.where(fresh[np.minimum(quote + 2, n)], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        for at, length in ((quote[short], 2), (quote[long & ~short], 3)):
            begins[at + 1] = False
            after = at + length
            after = after[after < n]
            # what is left of the letters begins anew; a space or other run there begins by itself
            left = after[(kind[after] == LETTER)]
            begins[left] = True
    return lead[begins]
