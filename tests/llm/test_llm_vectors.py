"""Top-k and nearest neighbours against brute force."""

import numpy as np
import pytest

from glyphloom.llm import topk, vptree
from glyphloom.llm.queries import QUERIES


def rows_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def brute(ids, vectors, every, k, score):
    out = {}
    for q in ids[ids % every == 0]:
        values = score(vectors, vectors[ids == q][0])
        best = [i for i in np.lexsort((ids, -values)) if ids[i] != q][:k]
        if best:
            out[q] = [(ids[i], values[i]) for i in best]
    return out


def integer(v, q):
    return np.floor(256 * v).astype(np.int64) @ np.floor(256 * q).astype(np.int64)


def inner(v, q):
    return (v * q).sum(axis=1)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(400, 6)), 1)  # rounding makes ties
    v[50:90] = v[7]
    rows = [(i, [float(x) for x in r], "t") for i, r in enumerate(v)]
    rows += [(1000, None, "t"), (1010, [float("nan")] * 6, "t"), (1020, [None] + [1.0] * 5, "t"), (None, [1.0] * 6, "t"),
             (1030, [float("inf")] * 6, "t"), (1040, [], "t"), (0, rows[0][1], "t")]
    return np.arange(400), v, spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)


def test_threshold_algorithm_is_exact(spark, table):
    ids, v, df = table
    want = brute(ids, v, 5, 7, integer)
    assert rows_of(topk.top_products(df, k=7, every=5)) == want
    assert rows_of(topk.top_products(df, k=7, every=5, shard_rows=60, query_rows=20)) == want


def test_threshold_algorithm_stops_early():
    rng = np.random.default_rng(1)
    rows = np.floor(np.abs(rng.normal(size=(4000, 2))) * 100)
    seen = []
    plain = topk._scores
    topk._scores = lambda r, q, e: seen.append(len(r)) or plain(r, q, e)
    try:
        place, value = topk._descend(rows, np.argsort(rows, axis=0, kind="stable"), np.array([3.0, 1.0]), 5, None, True)
    finally:
        topk._scores = plain
    assert sum(seen) < 1000 and list(value) == sorted((rows @ [3, 1]).astype(int))[:-6:-1]



def test_factor_one_is_exact(spark, table):
    ids, v, df = table
    keep = np.abs(v).sum(axis=1) > 0
    got = rows_of(vptree.nearest_neighbours(df, k=6, every=4, factor=1.0, leaf=8, shard_rows=150))
    want = brute(ids[keep], v[keep], 4, 6, inner)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]])


def test_zero_vectors_and_few_candidates(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (20, [1.0, 0.0]), (21, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert rows_of(vptree.nearest_neighbours(df)) == {20: [(21, 0.5)]}
    assert vptree.nearest_neighbours(df.limit(0)).count() == 0
    assert topk.top_products(df.limit(0)).count() == 0
    assert topk.top_products(df.where("vec_id = 0")).count() == 0


def test_queries(spark, sf):
    data = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in data]), np.array([r.embedding for r in data], float)
    assert rows_of(QUERIES["op2_topk"](spark, sf)) == brute(ids, v, 50, 5, integer)
    got, want = rows_of(QUERIES["op4_vptree"](spark, sf)), brute(ids, v, 20, 20, inner)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9 and all(len(got[q]) == 20 for q in want)
