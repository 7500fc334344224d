"""Words of whole texts as 64-bit hashes, computed a slice of texts at a time in numpy.

A word is a maximal run of bytes other than space, tab, newline, vertical tab,
form feed and carriage return. Its hash is a polynomial over a fixed random
table of byte values, so that one prefix sum serves all words of a slice; the
result is mixed, hence its low bits are as good as its high ones.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 17
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Blanks and all ASCII characters but letters and digits.
PUNCTUATED = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, 256, dtype=np.uint64)
_LOWER = BYTES.copy()
_LOWER[ord("A"):ord("Z") + 1] = BYTES[ord("a"):ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_bytes, _words = _Powers(_BASE), _Powers(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Words:
    """Words of the texts ``rows[0]:rows[1]`` of a column; text i owns ``bounds[i]:bounds[i + 1]``."""

    rows: tuple[int, int]
    bounds: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    def text(self, lo: int, hi: int) -> bytes:
        return self.data[lo:hi].tobytes()

    def owner(self) -> np.ndarray:
        """Text of each word, counted from the slice's first text."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def columns_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return offsets, data


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    up, down = _bytes.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def _split(data: np.ndarray, breaks: np.ndarray, blanks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = ~blanks[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    breaks = breaks[(breaks > 0) & (breaks < len(data))]
    first[breaks] = solid[breaks]
    last[breaks - 1] = solid[breaks - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_slices(column, lower: bool = False, blanks: np.ndarray = BLANKS,
                slice_bytes: int = SLICE_BYTES) -> Iterator[Words]:
    """Slices of about ``slice_bytes`` (one text at least); null texts are empty.

    A text longer than a slice is hashed in pieces cut at blanks, so that
    memory per byte stays small whatever its length.
    """
    offsets, data = columns_bytes(column)
    table = _LOWER if lower else BYTES
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + slice_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        base, part = offsets[lo], data[offsets[lo]:offsets[hi]]
        limits = offsets[lo:hi + 1] - base
        starts, ends = _split(part, limits[:-1], blanks)
        if len(part) <= 2 * slice_bytes:
            hashes = hashes_of(part, starts, ends, table)
        else:
            pieces, at = [], 0
            while at < len(starts):
                to = max(int(np.searchsorted(ends, starts[at] + slice_bytes, "right")), at + 1)
                origin = starts[at]
                pieces.append(hashes_of(part[origin:ends[to - 1]], starts[at:to] - origin, ends[at:to] - origin, table))
                at = to
            hashes = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
        yield Words((lo, hi), np.searchsorted(starts, limits), hashes, starts, ends, part)
        lo = hi


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each position on; the last ``width - 1`` positions have none."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _words.upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:len(hashes)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[:n])


def run_positions(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a run of ``width`` words fits inside its text, and the text of each."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    shift = np.repeat(bounds[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(len(owner)) + shift, owner


def starts_of(owner: np.ndarray, texts: int) -> np.ndarray:
    """Bounds of each text in an ascending ``owner`` array."""
    return np.searchsorted(owner, np.arange(texts + 1))
