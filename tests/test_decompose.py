"""Decomposition tables of one small text, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from glyphloom.functions import opcodes as oc
from glyphloom.operators import decompose as dec

CAPITAL, TWICE, THRICE = "\uE100\uE000", "\uE201\uE000\uE002\uE003", "\uE200\uE000\uE003"


@pytest.fixture(scope="module")
def units(spark):
    text = "Abcabcabc xyxyxy AAA   b"
    df = spark.createDataFrame([("l", 1, text)], "label string, doc_id bigint, text string")
    return dec.dictionary(df, ("split_factored",)).cache()


def test_encoded_units(units):
    rows = {(r.piece, r.run): (r.encoded, r.n) for r in dec.encode_units(units).collect()}
    assert rows == {
        ("Abcabcabc", 1): (CAPITAL + "abcabcabc", 1), (" ", 1): (" ", 2), (" ", 3): (THRICE + " ", 1),
        ("xyxyxy", 1): (TWICE + "xy", 1), ("AAA", 1): (THRICE + CAPITAL + "a", 1), ("b", 1): ("b", 1)}


def test_words(units):
    assert {r.word: r.n for r in dec.word_counts(units).collect()} == {
        CAPITAL: 2, THRICE: 2, TWICE: 1, "abcabcabc": 1, " ": 3, "xy": 1, "a": 1, "b": 1}
    apart, fused = (oc.words(F.col("ops"), F.col("base"), flag) for flag in (True, False))
    row = units.agg(F.sum(F.size(apart) * F.col("n")), F.sum(F.size(fused) * F.col("n"))).first()
    assert tuple(row) == (12, 7)


def test_operator_tables(units):
    freq = {r.op: (r.n, r.pieces) for r in dec.op_frequency(units).collect()}
    assert freq == {"CAPITALIZE": (2, 2), "REPEAT": (2, 2), "MULTIREPEAT": (1, 1)}
    multi = dec.op_occurrences(units).filter("op = 'MULTIREPEAT'").collect()
    assert [(r.params, r.n) for r in multi] == [([0, 2, 3], 1)]
    bases = {r.base: (r.surface_forms, r.n) for r in dec.surface_collapse(units).collect()}
    assert bases[" "] == (1, 3) and bases["a"] == (1, 1) and bases["abcabcabc"] == (1, 1)


def test_limits(spark, units):
    row = dec.limits(units).first()
    assert (row.units, row.max_param, row.long_units, row.raw_units, row.capitals_left) == (7, 3, 0, 0, 0)
    letters = "".join(chr(0x4E00 + i) for i in range(256))
    texts = [(letters + "A",), ("x\uE105y",), ("b" * 255 + "\n",)]
    df = spark.createDataFrame(texts, "text string").select(
        F.lit("l").alias("label"), F.lit(1).alias("doc_id"), "text")
    row = dec.limits(dec.dictionary(df, ("split_factored",))).first()
    assert row.max_param == 255 and row.long_units == 1 and row.capitals_left == 1 and row.raw_units == 1


def test_character_runs(spark):
    df = spark.createDataFrame([("l", "aaab", 2), ("l", "bbbbaaa", 1), ("l", "aabb", 5)],
                               "label string, piece string, n bigint")
    assert {(r.ch, r.run): r.n for r in dec.char_runs(df).collect()} == {("a", 3): 3, ("b", 4): 1}
