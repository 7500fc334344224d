"""Toxicity: held-out accuracy, odd inputs, and what a model without lessons says."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.llm import frames, toxicity
from glyphloom.llm.queries import QUERIES

SMALL = toxicity.Settings(rows=400, shards=2, epochs=8, l1=2.0)


@pytest.fixture(scope="module")
def labelled(spark):
    words = ["lamp", "river", "stone", "cloud", "table", "green", "paper", "night"]
    rows = []
    for i in range(400):
        text = " ".join(words[(i * k + k) % 8] for k in range(1, 30))
        rows.append((i, text + (" vile, HORRID" if i % 4 == 0 else ""), float(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, label double")


def test_learns_what_marks_a_label(spark, labelled):
    model = toxicity.fit(labelled.where("doc_id % 5 <> 0"), SMALL)
    out = toxicity.scored(labelled.where("doc_id % 5 = 0"), model).collect()
    assert len(out) == 80 and all(r.predicted == r.label for r in out)
    assert len(model.weights) < 200  # L1 leaves few


def test_odd_texts_and_clashing_columns(spark, labelled):
    model = toxicity.fit(labelled, SMALL)
    df = spark.createDataFrame([(None, None, "x"), (1, "", "y"), (1, "", "y"), (2, "vile horrid " * 50_000, "z"), (3, "  \n", "w")],
                               "doc_id long, text string, score string")
    out = toxicity.scored(df, model)
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == 5 and len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert [r.predicted for r in rows if r.doc_id == 2] == [1]


def test_states_are_packed_without_loss():
    rng = np.random.default_rng(1)
    for size, kinds in ((0, 1), (1, 1), (5000, 7), (100_000, 100_000)):
        at = np.sort(rng.choice(1 << 22, size, replace=False))
        z, n = (rng.standard_normal(kinds).astype(np.float32)[rng.integers(0, kinds, size)] for _ in range(2))
        got = toxicity._unpacked(toxicity._packed(at, z, n))
        assert all(np.array_equal(x, y) for x, y in zip(got, (at, z, n)))


def test_nothing_to_learn_from(spark, labelled):
    model = toxicity.fit(labelled.limit(0), SMALL)
    out = toxicity.scored(labelled.limit(3), model).collect()
    assert all(r.score < 1e-9 and r.predicted == 0 for r in out)
    assert toxicity.scored(labelled.limit(0), model).count() == 0


def test_sample_is_bounded_and_skips_nulls(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 40, 1, i % 2) for i in range(80)] + [(None, 1, 1), (41, 1, None)],
                                   "doc_id long, quality int, toxic int")
    assert toxicity.labelled_sample(docs, labels, "toxic", 10).count() == 10
    everything = toxicity.labelled_sample(docs, labels, "toxic", 1000)
    assert everything.count() == 40 and everything.where("doc_id = 41").count() == 0
    assert toxicity.labelled_sample(docs, labels, "toxic", 1000, F.col("_id") < 5).count() == 5


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = QUERIES["op1_toxicity"](spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_held_out_errors_at_production_settings(spark, sf):
    """Labelled rows of sf0.1: held-out toxic texts are found, and hardly any clean one is taken for toxic."""
    at = sf.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{at}/labels.parquet").where("toxic is not null")
    docs = spark.read.parquet(f"{at}/documents.parquet").join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").cache()
    learnable = F.crc32(F.col("_id").cast("string").cast("binary")) % 5 != 0
    model = toxicity.fit(toxicity.labelled_sample(docs, labels, "toxic", toxicity.Settings.rows, learnable))
    out = toxicity.scored(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
                          .select("doc_id", "text", "toxic"), model).collect()
    toxic, clean = ([r.predicted for r in out if r.toxic == label] for label in (1, 0))
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.005 * len(clean)


def test_places_of_a_shard_take_two_bytes_each():
    rows = [np.array(r, np.int32) for r in ([], [0], [65_534, 131_069, 200_000], [3, 65_538, 4_000_000], [], [65_535])]
    steps, far = toxicity._steps(rows)
    kept = toxicity._Rows(np.array([len(r) for r in rows], np.int32), steps, far)
    assert steps.itemsize == 2 and len(kept) == len(rows) and far.tolist() == [65_535, 68_931, 65_535, 3_934_462, 65_535]
    assert all(kept[i].tolist() == r.tolist() for i, r in enumerate(rows))


def test_coordinates_of_a_shard_are_told_by_flags_and_kept_as_steps(spark, labelled):
    rows = [np.array(r, np.int32) for r in ([], [5, 70_000], [0, 5, 4_194_303])]
    found = toxicity._included(rows, 22)
    steps, beyond = toxicity._steps([found])
    assert found.tolist() == [0, 5, 70_000, 4_194_303] and steps.itemsize == 2
    assert toxicity._Rows(np.array([len(found)]), steps, beyond)[0].tolist() == found.tolist()
    assert toxicity._blob(found).to_pylist() == [found.tobytes()] and toxicity._blob(found[:0]).to_pylist() == [b""]


def test_workers_give_memory_back():
    """What a group needed does not stay with its worker for all stages after."""
    import os
    import pyarrow as pa

    def resident():
        return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

    def group(table):
        kept = [bytes(60_000) for _ in range(4000)]
        last = bytes(100)  # keeps the heap from shrinking at its end
        del kept
        return table.append_column("held", pa.array([last]))

    before = resident()
    assert frames.slimmed(group)(pa.table({"x": [1]})).num_rows == 1
    assert list(frames.lean(lambda batches: (b + 1 for b in batches))([1, 2])) == [2, 3]
    assert resident() - before < 60
