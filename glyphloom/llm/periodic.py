"""Periodic runs of words: maximal repetitions, found through suffix-tree LCE.

A run is a stretch of words with smallest period p, at least two periods and
``least`` words long, that can't be extended on either side with the same period.
Every run has a Lyndon root, and a Lyndon root that counts is the longest Lyndon
word from its start, under the order of the alphabet or under its reverse. So
two candidates a position are all: the longest Lyndon word at i ends before the next
smaller suffix. Both are read off Ukkonen's suffix tree of the words. The longest
common extension of two positions is the depth of their leaves' lowest common
ancestor: the least depth that the Euler tour meets between them, from a sparse
table in constant time. Candidates are extended right by the tree of the words and
left by the tree of their reversal.

A run's words all lie in windows of ``least // 2`` words that occur twice in their
text. Words outside such windows can't be part of any run, so trees are built for the
stretches in between only; most texts have none. Every text is one row's work;
nothing is shuffled. Memory is proportional to the longest stretch (n log n numbers).

Defined results: a null or empty text has no words and no runs; rows that share an
id, or texts, are each handled by themselves; other columns stay as they are, and those
that bear the name of a new one are replaced.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from glyphloom.llm.frames import appended

LEAST = 12
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])


class SuffixTree:
    """Ukkonen's tree of a sequence of symbols above 0, closed by the least symbol 0."""

    def __init__(self, symbols: list[int]):
        self.text = text = [*symbols, 0]
        self.base = base = max(text) + 1
        n = len(text)
        begin, end, link, suffix, edges = [0], [0], [0], [-1], {}
        node = at = length = waiting = 0
        for i, c in enumerate(text):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    at = i
                key = node * base + text[at]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(begin)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    first = begin[child]
                    size = min(end[child], i + 1) - first
                    if length >= size:
                        at += size
                        length -= size
                        node = child
                        continue
                    if text[first + length] == c:
                        if unlinked:
                            link[unlinked] = node
                        length += 1
                        break
                    edges[key] = fork = len(begin)
                    begin.append(first)
                    end.append(first + length)
                    link.append(0)
                    suffix.append(-1)
                    begin[child] = first + length
                    edges[fork * base + text[first + length]] = child
                    edges[fork * base + c] = len(begin)
                    if unlinked:
                        link[unlinked] = fork
                    unlinked = fork
                begin.append(i)
                end.append(n)
                link.append(0)
                suffix.append(i - waiting + 1)
                waiting -= 1
                if not node and length:
                    length -= 1
                    at = i - waiting + 1
                else:
                    node = link[node]
        keys = np.sort(np.fromiter(edges.keys(), np.int64, len(edges)))
        self.children = [edges[k] for k in keys.tolist()]
        self.bounds = np.searchsorted(keys, np.arange(len(begin) + 1) * base).tolist()
        self.begin, self.end, self.suffix = begin, end, suffix

    def leaves(self, reverse: bool = False) -> np.ndarray:
        """Suffixes in order; by ``reverse``, symbols but the closing one are compared the other way round."""
        out, stack = [], [0]
        children, bounds, suffix, begin, text = self.children, self.bounds, self.suffix, self.begin, self.text
        while stack:
            v = stack.pop()
            below = children[bounds[v]:bounds[v + 1]]
            if not below:
                out.append(suffix[v])
            elif not reverse:
                stack.extend(below[::-1])
            elif text[begin[below[0]]]:
                stack.extend(below)
            else:
                stack.extend(below[1:])
                stack.append(below[0])
        return np.array(out)

    def tour(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Depths along the Euler tour, suffixes in order, and their places in the tour."""
        depths, order, places = [], [], []
        children, bounds, suffix, begin, end = self.children, self.bounds, self.suffix, self.begin, self.end
        depth, stack, n = [0] * len(begin), [0], len(self.text)
        while stack:
            v = stack.pop()
            if v < 0:
                depths.append(depth[~v])
                continue
            lo, hi = bounds[v], bounds[v + 1]
            if lo == hi:
                order.append(suffix[v])
                places.append(len(depths))
                depths.append(n - suffix[v])
                continue
            depths.append(depth[v])
            for child in reversed(children[lo:hi]):
                depth[child] = depth[v] + end[child] - begin[child]
                stack.append(~v)
                stack.append(child)
        return np.array(depths, np.int32), np.array(order), np.array(places)


class Extensions:
    """Longest common extensions of positions, by lowest common ancestors in a suffix tree."""

    def __init__(self, tree: SuffixTree):
        depths, self.order, places = tree.tour()
        self.rank = np.empty(len(self.order), np.int64)
        self.rank[self.order] = np.arange(len(self.order))
        row = np.minimum.reduceat(depths, places)  # least depth from each leaf to the next one
        self.table = [row[:-1]]
        while 2 << len(self.table) - 1 <= len(row) - 1:
            last, step = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[:-step], last[step:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of positions ``a`` and ``b``, which differ pairwise."""
        a, b = self.rank[a], self.rank[b]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(hi - lo)[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.table[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(k))])
        return out


def _next_smaller(rank: list[int]) -> list[int]:
    """Next position with a smaller rank, for each position but the last, which has the least rank of all."""
    out, stack = [0] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out[:-1]


def repetitions(symbols: list[int], least: int = LEAST) -> np.ndarray:
    """Runs of a sequence of symbols above 0: rows (start, length, period), by start and period."""
    n = len(symbols)
    if n < max(least, 2):
        return np.zeros((0, 3), np.int64)
    tree = SuffixTree(symbols)
    right, left = Extensions(tree), Extensions(SuffixTree(symbols[::-1]))
    found = []
    for order in (right.order, tree.leaves(reverse=True)):
        rank = np.empty(n + 1, np.int64)
        rank[order] = np.arange(n + 1)
        a = np.arange(n)
        b = np.array(_next_smaller(rank.tolist()))
        after, before = right.of(a, b), left.of(n - a, n - b)
        whole = after + before >= b - a
        found.append(np.stack([a - before, after + before + b - a, b - a], 1)[whole])
    rows = np.unique(np.concatenate(found)[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]
    return rows[rows[:, 1] >= least]


def _repeated(codes: np.ndarray, width: int) -> np.ndarray:
    """Words that lie in a window of ``width`` words whose hash occurs twice (equal windows have equal hashes)."""
    n = len(codes) - width + 1
    if n < 2:
        return np.zeros(len(codes), bool)
    windows = np.zeros(n, np.uint64)
    for k in range(width):
        windows = (windows ^ codes[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        windows ^= windows >> np.uint64(29)
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    edges = np.zeros(len(codes) + 1, np.int64)
    twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    edges[twice] += 1
    edges[twice + width] -= 1
    return np.cumsum(edges[:-1]) > 0


def runs(words: list, least: int = LEAST) -> np.ndarray:
    """Runs of a list of words; words are numbered exactly, not hashed."""
    if len(words) < max(least, 2):
        return np.zeros((0, 3), np.int64)
    numbers: dict = {}
    codes = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.uint64)
    kept = np.concatenate([[False], _repeated(codes, max(least // 2, 1)), [False]])
    borders = np.flatnonzero(kept[1:] != kept[:-1])
    out = []
    for lo, hi in zip(borders[::2].tolist(), borders[1::2].tolist()):
        own, symbols = np.unique(codes[lo:hi], return_inverse=True)
        part = repetitions((symbols + 1).tolist(), least)
        part[:, 0] += lo
        out.append(part)
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """Words that no run repeats: of each run its first period stays, joined by spaces."""
    if not len(found):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    gone = np.cumsum(edges[:-1]) > 0
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def with_runs(docs: DataFrame, column: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (by start, then period) and ``collapsed``, the text without repeated periods."""
    fields = [StructField("n_words", LongType()), StructField("runs", ArrayType(_RUN)), StructField("collapsed", StringType())]

    def compute(texts: pa.Array) -> list[pa.Array]:
        counts, ends, rows, out = [], [0], [], []
        for text in texts.cast(pa.binary()):
            words = WORD.findall(text.as_py() or b"")
            found = runs(words, least)
            counts.append(len(words))
            ends.append(ends[-1] + len(found))
            rows.append(found)
            out.append(collapsed(words, found))
        flat = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
        parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], ["start", "length", "period"])
        return [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts),
                pa.array(out, pa.binary()).cast(pa.string())]

    return appended(docs, column, fields, compute)
