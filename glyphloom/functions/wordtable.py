"""A look-up table of short strings with numbers, held in flat arrays and probed a batch at a time.

Keys are ordered by a 64-bit hash and found by binary search; bytes are compared
before a key counts as found, so a colliding hash is a miss and never a wrong answer.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

LONGEST = 64    # bytes of a key of a table of words; a vocabulary's tokens may be longer


def flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every string in the bytes they lie in, and these bytes."""
    array = strings.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(1, np.uint8)
    # of a slice, its own bytes only: tables are shipped to tasks
    return offsets[:-1] - offsets[0], np.diff(offsets), data[int(offsets[0]):max(int(offsets[-1]), int(offsets[0]) + 1)]


def _hashes(starts, lengths, data, salt) -> np.ndarray:
    """Hash of each string and its salt; takes as many steps as the longest has bytes."""
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = starts[order], lengths[order]
    h = salt[order].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + sizes.astype(np.uint64)
    for k in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -k, "left"))     # strings longer than k bytes
        h[:live] = (h[:live] ^ data[starts[:live] + k]) * np.uint64(0xD6E8FEB86659FD93)
        h[:live] ^= h[:live] >> np.uint64(32)
    out = np.empty_like(h)
    out[order] = h
    return out


def buckets_of(strings: pa.Array, buckets: int) -> np.ndarray:
    """A bucket for each string, by its beginning and its length."""
    starts, lengths, data = flat(strings)
    return (_hashes(starts, np.minimum(lengths, LONGEST), data, lengths) % np.uint64(buckets)).astype(np.int64)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of ranges laid end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


@dataclass
class WordTable:
    """Rows of numbers by string and salt; equal hashes keep their first key."""

    hashes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    salts: np.ndarray
    data: np.ndarray
    first: np.ndarray       # first number of each row
    size: np.ndarray        # how many there are
    numbers: np.ndarray

    @classmethod
    def of(cls, keys: pa.Array, salts: np.ndarray, rows: pa.ListArray) -> "WordTable":
        starts, lengths, data = flat(keys)
        sizes = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        hashes = _hashes(starts, lengths, data, salts)
        hashes, kept = np.unique(hashes, return_index=True)
        numbers = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        return cls(hashes, starts[kept], lengths[kept], salts[kept], data,
                   (np.cumsum(sizes) - sizes)[kept], sizes[kept].astype(np.int64), numbers)

    def find(self, keys: pa.Array, salts: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        starts, lengths, data = flat(keys)
        out = np.full(len(starts), -1)
        short = np.flatnonzero(lengths <= (self.lengths.max() if len(self.lengths) else 0))
        if not len(self.hashes) or not len(short):
            return out
        starts, lengths, salts = starts[short], lengths[short], salts[short]
        h = _hashes(starts, lengths, data, salts)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        same = (self.hashes[at] == h) & (self.lengths[at] == lengths) & (self.salts[at] == salts)
        hit = np.flatnonzero(same)
        sizes = lengths[hit]
        mine, theirs = data[gather(starts[hit], sizes)], self.data[gather(self.starts[at[hit]], sizes)]
        wrong = np.repeat(np.arange(len(hit)), sizes)[mine != theirs]
        same[hit[wrong]] = False
        out[short[same]] = at[same]
        return out
