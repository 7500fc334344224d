"""Exact top-k inner products by Fagin's threshold algorithm.

Each shard keeps one list of its rows per dimension, sorted by that component. A
query goes down all lists together, from the top where its component is positive
and from the bottom where it is negative; rows met for the first time are scored
in full. No unseen row can beat the sum of the query's components times the
values at the current depth, so the descent ends once the k-th best score is
above that bound. Depth doubles from step to step. Ties go to the smaller id,
hence a score equal to the bound doesn't end the descent.

Defined results: vectors that are null, empty or hold null or non-finite parts
take no part; zero vectors do; a table with one usable row, or none, has no
result; a query with fewer than k candidates gets all of them.
"""

import numpy as np
from pyspark.sql import DataFrame

from glyphloom.llm.shards import nearest, usable

FIRST_DEPTH = 16


def _scores(rows: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; in floating point where that can't round."""
    return (rows @ query).astype(np.int64) if exact else rows.astype(np.int64) @ query.astype(np.int64)


def _descend(rows, lists, query, k, own, exact):
    """Places and scores of the k best rows for one query, and how many rows were scored."""
    n = len(rows)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    scored = np.zeros(n, bool)
    if own is not None:
        scored[own] = True
    place, value = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, depth = 0, min(FIRST_DEPTH, n)
    while True:
        met = np.zeros(n, bool)
        met[lists[n - depth:n - at, up].ravel()] = True
        met[lists[at:depth, down].ravel()] = True
        if depth == n or not (len(up) or len(down)):
            met[:] = True
        new = np.flatnonzero(met & ~scored)
        scored[new] = True
        place = np.concatenate([place, new])
        value = np.concatenate([value, _scores(rows[new], query, exact)])
        best = np.lexsort((place, -value))[:k]
        place, value = place[best], value[best]
        if scored.all():
            break
        bound = (query[up] * rows[lists[n - depth, up], up]).sum() + (query[down] * rows[lists[depth - 1, down], down]).sum()
        if len(value) == k and value[-1] > bound:
            break
        at, depth = depth, min(2 * depth, n)
    return place, value


def sorted_lists(ids, rows):
    """A shard's ids, its quantized rows and their places in order of each dimension."""
    rows = np.floor(256 * rows)
    return ids, rows, np.argsort(rows, axis=0, kind="stable").astype(np.int32)


def threshold_search(index, query_ids, queries, k):
    """The k best rows of a shard for each query; ids ascend."""
    ids, rows, lists = index
    queries = np.floor(256 * queries)
    exact = np.abs(rows).max() * np.abs(queries).max() * rows.shape[1] < 2**53
    out = []
    for i, query in enumerate(queries):
        own = np.searchsorted(ids, query_ids[i])
        own = own if own < len(ids) and ids[own] == query_ids[i] else None
        place, value = _descend(rows, lists, query, k, own, exact)
        out.append((np.full(len(place), i), place, value))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out))


def top_products(embeddings: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id",
                 vector: str = "embedding", **bounds) -> DataFrame:
    """(query_id, rank, vec_id, score long) of the quantized vectors floor(256 x)."""
    return nearest(usable(embeddings, key, vector), every, k, sorted_lists, threshold_search, "long", **bounds)
