"""Approximate nearest neighbours with a vantage-point tree per shard.

Nearness is the inner product. A shard's rows get one more component so that all
have the shard's largest norm; then the nearest in Euclidean distance is the one
of the largest inner product, and the triangle inequality holds. A node splits
its rows at the median distance from a vantage point. A query first visits the
side it lies on, then the other one only if ``distance to the border <= factor *
distance of its k-th best``. Factor 1 is exact search, smaller ones prune more.
Queries of a block go down the tree together.

Defined results: vectors that are null, empty, zero or hold null or non-finite
parts take no part; ties go to the smaller id; equal rows that can't be split
stay in one leaf; a query with fewer than k candidates gets all of them.
"""

import numpy as np
from pyspark.sql import DataFrame

from glyphloom.llm.shards import nearest, usable

FACTOR = 0.2
LEAF = 256


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in one order whatever the batch."""
    return (rows * query).sum(axis=-1)


def build(points: np.ndarray, at: np.ndarray, rng, leaf: int):
    """(vantage point, border, inner, outer), or the places of a leaf."""
    if len(at) <= leaf:
        return at
    vantage = points[rng.choice(at)]
    distance = np.sqrt(((points[at] - vantage) ** 2).sum(axis=1))
    border = np.median(distance)
    inner = distance < border
    if not inner.any():
        return at
    return vantage, border, build(points, at[inner], rng, leaf), build(points, at[~inner], rng, leaf)


class _Search:
    def __init__(self, rows, ids, largest, queries, query_ids, k, factor):
        self.rows, self.ids, self.queries, self.query_ids = rows, ids, queries, query_ids
        self.k, self.factor, self.largest = k, factor, largest
        self.lengths = (queries ** 2).sum(axis=1)
        self.value = np.full((len(queries), k), -np.inf)
        self.place = np.full((len(queries), k), len(rows))

    def reach(self, active):
        """Distance of the k-th best."""
        return np.sqrt(np.maximum(self.largest + self.lengths[active] - 2 * self.value[active, -1], 0))

    def visit(self, node, active):
        if not len(active):
            return
        if not isinstance(node, tuple):
            value = np.einsum("qd,ld->ql", self.queries[active], self.rows[node])
            value[self.ids[node] == self.query_ids[active, None]] = -np.inf
            value = np.concatenate([self.value[active], value], axis=1)
            place = np.concatenate([self.place[active], np.broadcast_to(node, (len(active), len(node)))], axis=1)
            place[value == -np.inf] = len(self.rows)
            best = np.lexsort((place, -value), axis=-1)[:, :self.k]
            self.value[active] = np.take_along_axis(value, best, 1)
            self.place[active] = np.take_along_axis(place, best, 1)
            return
        vantage, border, inner, outer = node
        # the query's own extra component is 0
        distance = np.sqrt(((self.queries[active] - vantage[:-1]) ** 2).sum(axis=1) + vantage[-1] ** 2)
        inside = distance < border
        self.visit(inner, active[inside])
        self.visit(outer, active[~inside])
        far = np.abs(distance - border) <= self.factor * self.reach(active)
        self.visit(outer, active[inside & far])
        self.visit(inner, active[~inside & far])


def planted(leaf: int):
    """The tree of a shard, with its rows, their ids and their largest norm."""
    def prepare(ids, rows):
        norms = (rows ** 2).sum(axis=1)
        points = np.column_stack([rows, np.sqrt(np.maximum(norms.max() - norms, 0))])
        return ids, rows, norms.max(), build(points, np.arange(len(rows)), np.random.default_rng(len(rows)), leaf)

    return prepare


def tree_search(factor: float):
    def kernel(index, query_ids, queries, k):
        ids, rows, largest, tree = index
        search = _Search(rows, ids, largest, queries, query_ids, k, factor)
        search.visit(tree, np.arange(len(queries)))
        at, rank = np.nonzero(search.place < len(rows))
        place = search.place[at, rank]
        return at, place, products(rows[place], queries[at])

    return kernel


def nearest_neighbours(embeddings: DataFrame, k: int = 20, every: int = 20, factor: float = FACTOR, leaf: int = LEAF,
                       key: str = "vec_id", vector: str = "embedding", **bounds) -> DataFrame:
    """(query_id, rank, vec_id, score double): the k nearest found of every row whose id ``every`` divides."""
    return nearest(usable(embeddings, key, vector, zero=False), every, k, planted(leaf), tree_search(factor), "double",
                   **bounds)
