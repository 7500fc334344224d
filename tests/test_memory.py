"""What tasks hold must not grow with a partition or be held more than once."""

import pickle
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from glyphloom.functions.memory import together
from glyphloom.functions.wordtable import WordTable
from glyphloom.operators import bpe, encode
from glyphloom.plans.queries import QUERIES


def test_a_learner_holds_few_bytes_a_symbol_to_its_end():
    """149 bytes a symbol when each pair had arrays of its own."""
    rng = np.random.default_rng(1)
    values, rows = rng.integers(97, 123, 400_000).astype(np.int32), np.repeat(np.arange(50_000, dtype=np.int32), 8)
    tracemalloc.start()
    merges = bpe.learnt(values, rows, np.ones(50_000, np.int64), bpe._Names([]), set(), None, 3_000, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(merges) == 3_000 and peak < 100 * len(values)


def test_pairs_and_their_places_over_several_steps(monkeypatch):
    monkeypatch.setattr(bpe, "_STEP", 7)
    rng = random.Random(5)
    for _ in range(200):
        words = [[rng.randint(97, 99) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 12))]
        weights = [rng.randint(1, 5) for _ in words]
        want: dict[int, list[tuple[int, int]]] = {}
        at = 0
        for word, w in zip(words, weights):
            for k, (a, b) in enumerate(zip(word, word[1:])):
                want.setdefault(a << bpe._BITS | b, []).append((at + k, w))
            at += len(word)
        chain = bpe._Chain(np.array(sum(words, []), np.int64), np.repeat(np.arange(len(words)), [len(x) for x in words]),
                           np.array(weights))
        for wanted in (None, np.array(sorted(want)[::2], np.int64)):
            keys, sums, places = chain.pairs(wanted)
            found = {k: (n, p.tolist()) for k, n, p in zip(keys, sums, places)}
            assert found == {k: (sum(w for _, w in v), [i for i, _ in v]) for k, v in want.items()
                             if wanted is None or k in wanted}


def test_a_table_of_a_slice_holds_its_own_strings_only():
    """The tables of all groups are cut from one column, and each is shipped to tasks."""
    whole = pa.array([f"word {i}" for i in range(100_000)])
    rows = pa.array([[i] for i in range(10)], pa.list_(pa.int32()))
    table = WordTable.of(whole.slice(500, 10), np.zeros(10, np.int64), rows)
    assert len(pickle.dumps(table)) < 10_000
    assert table.find(pa.array(["word 503", "word 0", "word 509"]), np.zeros(3, np.int64)).tolist()[1] == -1
    at = table.find(pa.array(["word 503", "word 509"]), np.zeros(2, np.int64))
    assert table.numbers[table.first[at]].tolist() == [3, 9]


def test_a_speller_remembers_a_bounded_number_of_words(monkeypatch):
    monkeypatch.setattr(encode, "SEEN", 50)
    speller = encode._Speller({"a": 0, "b": 1, "ab": 2}, [("a", "b")])
    words = [f"ab{i}" for i in range(1_000)] * 2
    assert all(speller.spelled(w) == ([2], len(w) - 2) for w in words)
    assert len(speller.seen) <= 50


def test_batches_come_in_parts_and_together(monkeypatch):
    monkeypatch.setattr(encode, "ITEMS", 10)
    lists = [[1] * n if n is not None else None for n in (3, 25, None, 0, 4, 9, 1, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), pa.array(range(8))], names=["ids", "row"])
    parts = list(encode._limited([batch, batch.slice(0, 0)], "ids"))
    assert [r for x in parts for r in x.column("row").to_pylist()] == list(range(8))
    assert [x for part in parts for x in part.column("ids").to_pylist()] == lists and len(parts) > 2
    again = list(together(parts, rows=5))
    assert sum(x.num_rows for x in again) == 8 and again[0].num_rows >= 5


def test_token_lookup_sends_few_documents_at_a_time(spark, sf):
    """Ten thousand documents with all their tokens were one batch."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        rows = QUERIES["token_lookup"](spark, sf)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
        assert rows.filter("not same").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
