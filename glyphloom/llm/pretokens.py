"""Words of the public byte-level pattern, found for whole slices of texts at once in numpy.

The pattern takes, at each place, the first of: a contraction (an apostrophe with
s, t, re, ve, m, ll or d), letters, digits or other characters with at most one
space before them, white space up to the last before something else, white space.
So words begin where the class of characters changes, except that

* the last of several white space characters before something else stands apart,
* a space before something else belongs to it,
* an apostrophe alone between other classes, not after a space, takes its
  contraction's letters, and the rest of those letters is a word of its own.
"""

import sys
import unicodedata
from functools import lru_cache

import numpy as np

from glyphloom.llm.wordhash import BYTES, SLICE_BYTES, Words, columns_bytes, hashes_of

#: Fixed value: the pattern this module stands for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space of the Unicode standard.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_OTHER, _LETTER, _DIGIT, _WHITE = range(4)


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _DIGIT}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    table[WHITE] = _WHITE
    return table


def _starts(chars: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Which characters begin a word; ``begins`` marks those that begin a text."""
    kind = _classes()[chars]
    n = len(chars)
    start = begins.copy()
    start[1:] |= kind[1:] != kind[:-1]
    last = np.append(begins[1:], True)  # the last character of each text
    after = np.append(kind[1:], _WHITE)
    lone = np.flatnonzero((kind == _WHITE) & ~last & (after != _WHITE))  # white space right before something else
    start[lone] = True
    spaces = lone[chars[lone] == 0x20]
    start[spaces + 1] = False
    tick = np.flatnonzero((chars == 0x27) & ~last & (after == _LETTER) & start)
    if len(tick):
        one = chars[tick + 1]
        more = tick + 2 < n
        two = np.where(more, chars[np.minimum(tick + 2, n - 1)], 0) * (more & ~begins[np.minimum(tick + 2, n - 1)])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        some = short | long
        tick, length = tick[some], np.where(short[some], 2, 3)
        start[tick + 1] = False
        rest = tick + length
        rest = rest[rest < n]
        start[rest] |= kind[rest] == _LETTER
    return start


def sliced_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slice_bytes: int = SLICE_BYTES) -> np.ndarray:
    """Hashes of ascending words, of some slices' bytes at a time."""
    if len(data) <= 4 * slice_bytes:
        return hashes_of(data, starts, ends, BYTES)
    hashes, at = [], 0
    while at < len(starts):
        to = max(int(np.searchsorted(ends, starts[at] + slice_bytes, "right")), at + 1)
        origin = starts[at]
        hashes.append(hashes_of(data[origin:ends[to - 1]], starts[at:to] - origin, ends[at:to] - origin, BYTES))
        at = to
    return np.concatenate([*hashes, np.zeros(0, np.uint64)])


def pretokens(column, slice_bytes: int = SLICE_BYTES):
    """Slices of texts as ``Words`` without gaps: a word ends where the next begins."""
    offsets, data = columns_bytes(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + slice_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        part = data[offsets[lo]:offsets[hi]]
        limits = offsets[lo:hi + 1] - offsets[lo]
        if not len(part):
            none = np.zeros(0, np.int64)
            yield Words((lo, hi), np.zeros(hi - lo + 1, np.int64), none.view(np.uint64), none, none, part)
            lo = hi
            continue
        leads = np.flatnonzero((part & 0xC0) != 0x80)
        chars = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)
        begins = np.zeros(len(chars), bool)
        full = limits[:-1][limits[:-1] < limits[1:]]
        begins[np.searchsorted(leads, full)] = True
        starts = leads[_starts(chars, begins)]
        ends = np.append(starts[1:], len(part))
        yield Words((lo, hi), np.searchsorted(starts, limits), sliced_hashes(part, starts, ends, slice_bytes), starts, ends, part)
        lo = hi


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places ``starts[i] .. starts[i] + lengths[i] - 1`` of all i, one after the other."""
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(len(shift)) + shift


class HashIndex:
    """Place of each of a set of distinct hashes, by open addressing."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.mask = np.uint64((1 << max(4, int(2 * len(hashes)).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, np.int32)
        left, step = np.arange(len(hashes), dtype=np.int32), 0
        while len(left):
            slot = (hashes[left] + np.uint64(step)) & self.mask
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            left = left[self.slots[slot] != left]
            step += 1

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places, -1 for hashes that aren't in the set."""
        out = np.full(len(wanted), -1, np.int32)
        left, step = np.arange(len(wanted)), 0
        while len(left) and len(self.hashes):
            found = self.slots[(wanted[left] + np.uint64(step)) & self.mask]
            hit = (found >= 0) & (self.hashes[found] == wanted[left])
            out[left[hit]] = found[hit]
            left = left[(found >= 0) & ~hit]
            step += 1
        return out
