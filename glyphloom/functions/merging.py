"""Byte-pair merges of one symbol sequence: a heap of ranked pairs over a linked list.

A sequence of n symbols takes O(n log n) whatever its length, so a word of a
megabyte is no worse per symbol than a short one.
"""

from array import array
from heapq import heapify, heappop, heappush


class Merges:
    """Ranked merges ``(left, right, product)``; a lower rank goes first.

    With ``once`` a merge is over when its rank has passed, as in training, where a
    pair that comes up again needs a merge of its own; without it a pair always has
    its least rank, as in encoding.
    """

    def __init__(self, ranked: list[tuple[int, int, int]], once: bool = False):
        self.once = once
        # flat arrays and one number a pair: a task holds the merges of all its groups
        self.left, self.right, self.product = (array("q", column) for column in (zip(*ranked) if ranked else ((), (), ())))
        self.first: dict[int, int] = {}             # least rank of a pair
        self.later: dict[int, list[int]] = {}       # its other ranks, with ``once``
        for rank, (left, right) in enumerate(zip(self.left, self.right)):
            if self.first.setdefault(left << 32 | right, rank) != rank and once:
                self.later.setdefault(left << 32 | right, []).append(rank)

    def _next(self, left: int, right: int, now: int) -> int:
        """The next rank of a pair after ``now``, -1 if there is none."""
        rank = self.first.get(left << 32 | right, -1)
        if rank > now or rank < 0 or not self.once:
            return rank
        return next((r for r in self.later.get(left << 32 | right, ()) if r > now), -1)

    def applied(self, symbols: list[int]) -> list[int]:
        heap = [(r, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := self._next(*pair, -1)) >= 0]
        if not heap:
            return symbols
        heapify(heap)
        n = len(symbols)
        out = [*symbols, -1]     # -1 ends the list and marks symbols that are gone
        after, before = list(range(1, n + 2)), list(range(-1, n))
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if out[i] != self.left[rank] or out[j] != self.right[rank]:
                continue
            k = after[j]
            out[i], out[j] = self.product[rank], -1
            after[i] = k
            before[k] = i
            for at in ((before[i], i) if before[i] >= 0 else (i,)):
                r = self._next(out[at], out[after[at]], rank)
                if r >= 0:
                    heappush(heap, (r, at))
        return [s for s in out if s >= 0]
