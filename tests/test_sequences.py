import random

import pytest
from pyspark.sql import functions as F

from glyphloom.operators import packing as pk
from glyphloom.operators import ranking as rk
from glyphloom.sources import corpus as co


def stream(spark, docs):
    return spark.createDataFrame([("l", "c", i, x) for i, x in docs.items()],
                                 "label string, config string, doc_id bigint, ids array<int>")


def expected_chunks(docs, ctx):
    flat = [x for i in sorted(docs) for x in docs[i]]
    return [flat[i:i + ctx] for i in range(0, len(flat) - ctx, ctx)]


@pytest.mark.parametrize("n, chunks", [(3, 0), (4, 0), (8, 1), (9, 2)])
def test_chunk_counts(spark, n, chunks):
    docs = {1: list(range(n - 2)), 2: [90, 91]}
    got = pk.pack(stream(spark, docs), 4).orderBy("chunk_id").collect()
    assert [r.ids for r in got] == expected_chunks(docs, 4) and len(got) == chunks


def test_pack_with_one_huge_document(spark):
    rng = random.Random(4)
    docs = {i: [rng.randint(0, 9) for _ in range(rng.choice([0, 1, 3, 50]))] for i in range(200)}
    docs[77] = [rng.randint(0, 9) for _ in range(4000)]
    got = {r.chunk_id: r.ids for r in pk.pack(stream(spark, docs), 16).collect()}
    expected = expected_chunks(docs, 16)
    assert got == dict(enumerate(expected))
    pairs = pk.next_token_pairs(pk.pack(stream(spark, docs), 16)).count()
    assert pairs == len(expected) * 15


def test_separator(spark):
    row = pk.with_separator(stream(spark, {1: [5, 6]}), F.lit(3)).first()
    assert row.ids == [5, 6, 3]


def test_batches_repeat_and_drop_the_short_one(spark):
    docs = {i: [i] * 10 for i in range(60)}
    chunks = pk.pack(stream(spark, docs), 8)
    runs = [sorted((r.batch_id, r.chunk_id) for r in pk.batches(chunks, 7, 42).collect()) for _ in range(2)]
    assert runs[0] == runs[1]
    sizes = {}
    for b, _ in runs[0]:
        sizes[b] = sizes.get(b, 0) + 1
    n = chunks.count()
    assert set(sizes) == set(range(n // 7)) and set(sizes.values()) == {7}
    kept = pk.batches(chunks, 7, 42, drop_last=False)
    assert kept.count() == n and kept.agg(F.max("batch_id")).first()[0] == (n - 1) // 7
    other = sorted((r.batch_id, r.chunk_id) for r in pk.batches(chunks, 7, 43).collect())
    assert other != runs[0]


def test_batches_of_the_query_are_told_by_sizes(spark, sf, monkeypatch):
    """Its chunks' ids must not be dealt to ranges and written again."""
    from glyphloom.plans import queries
    seen, real = [], queries.pk.batches
    monkeypatch.setattr(queries.pk, "batches", lambda chunks, *a, **k: seen.append(chunks.schema["ids"].dataType.simpleString()) or real(chunks, *a, **k))
    rows = queries.QUERIES["shuffle_batches"](spark, sf).collect()
    assert seen == ["int"] and rows and all(r.chunks == queries.BATCH and r.ids <= queries.BATCH * queries.CONTEXT for r in rows)


def test_prefix_sums_with_clustered_ids_and_a_hot_group(spark):
    rng = random.Random(9)
    ids = sorted({rng.choice([rng.randint(0, 500), 10**15 + rng.randint(0, 500)]) for _ in range(900)})
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.randint(0, 5)) for i in ids]
    df = spark.createDataFrame(rows, "g string, doc_id bigint, v int")
    got = {r.doc_id: (r.start, r.total) for r in rk.with_prefix(
        df, F.col("v"), "start", "doc_id", ("g",), "total", buckets=5).collect()}
    at, totals = {}, {}
    for g, _, v in rows:
        totals[g] = totals.get(g, 0) + v
    for g, i, v in rows:
        assert got[i] == (at.get(g, 0), totals[g])
        at[g] = at.get(g, 0) + v
    ranked = rk.with_position(df)
    assert [r.position for r in ranked.orderBy("doc_id").collect()] == list(range(len(rows)))


def test_positional_splits(spark):
    df = spark.range(0, 300, 3).withColumnRenamed("id", "doc_id")
    rows = {r.doc_id: r.split for r in rk.positional_split(df).collect()}
    assert [rows[i] for i in sorted(rows)] == ["train"] * 90 + ["validation"] * 10
    fixed = {r.doc_id: r.split for r in rk.positional_split_at(df, 60, 20).collect()}
    assert [fixed[i] for i in sorted(fixed)] == ["train"] * 60 + ["validation"] * 20


def test_heads(spark):
    rows = [("a" if i % 3 else "b", i, " " if i % 4 == 0 else "x") for i in range(100)]
    df = spark.createDataFrame(rows, "label string, doc_id bigint, text string")
    head = co.nonblank(rk.first_n(df, 10))
    assert sorted(r.doc_id for r in head.collect()) == [i for i in range(10) if i % 4]
    tail = rk.first_n(co.nonblank(df), 10)
    assert sorted(r.doc_id for r in tail.collect()) == [i for i in range(100) if i % 4][:10]
    each = rk.first_n_per_group(df, 5, "label", salts=4)
    got = sorted((r.label, r.doc_id) for r in each.collect())
    assert got == sorted([("a", i) for i in range(100) if i % 3][:5] + [("b", i) for i in range(0, 15, 3)])


def test_training_lines(spark):
    df = spark.createDataFrame([("l", 1, "a\n\nb"), ("l", 2, "c\n"), ("l", 3, "")],
                               "label string, doc_id bigint, text string")
    rows = co.training_lines(df).collect()
    lines = {i: [r.text for r in rows if r.doc_id == i] for i in (1, 2, 3)}
    assert lines == {1: ["a\n", "\n", "b\n"], 2: ["c\n", "\n"], 3: ["\n"]}


def test_unigram_perplexity(spark):
    import math
    train = spark.createDataFrame([("l", "a", 3), ("l", "b", 1)], "label string, piece string, n bigint")
    valid = spark.createDataFrame([("l", "a", 2), ("l", "z", 1)], "label string, piece string, n bigint")
    ratios = spark.createDataFrame([("l", 2.0)], "label string, char_ratio double")
    row = pk.unigram_perplexity(train, valid, ratios).first()
    loss = -(2 * math.log(4 / 7) + math.log(1 / 7)) / 3
    assert row.loss == pytest.approx(loss)
    assert row.ppl_token == pytest.approx(math.exp(loss)) and row.ppl_char == pytest.approx(math.exp(loss / 2))


def test_positions_with_null_groups_null_keys_and_ties(spark):
    rows = [(g, k, v) for g in (None, "a", "b") for k in (None, 1, 1, 2) for v in ("x", "y")]
    df = spark.createDataFrame(rows, "g string, k bigint, v string")
    got = sorted((str(r.g), r.position, r.k, r.v, r.n) for r in rk.with_position(df, order=("k", "v"), group=("g",), total="n").collect())
    keys = sorted(((r[1] is not None, r[1] or 0), r[2], r[1]) for r in rows if r[0] == "a")
    want = sorted((g, i, k, v, 8) for g in ("None", "a", "b") for i, (_, v, k) in enumerate(keys))
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want]
    assert rk.with_position(df.limit(0), order="k", group=("g",)).collect() == []
