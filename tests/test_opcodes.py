import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from glyphloom.functions import opcodes as oc
from glyphloom.functions import patterns as p

E = chr


def encode(spark, texts, capitalize=True, repeat=True, serialize=True):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, piece string")
    df = oc.with_opcodes(df, capitalize, repeat, serialize)
    df = df.withColumn("encoded", oc.encoded(F.col("ops"), F.col("base")))
    return sorted(oc.with_decoded(df, "encoded").collect(), key=lambda r: r.i)


GOLDEN = [
    ("Hello", "\uE100\uE000", "hello"),
    ("Héllo", "\uE102\uE001\uE100\uE000", "hello"),
    ("######", "\uE200\uE000\uE006", "#"),
    ("    ", "\uE200\uE000\uE004", " "),
    ("abcabcabc", "\uE201\uE000\uE003\uE003", "abc"),
]


def test_worked_encodings(spark):
    rows = encode(spark, [g[0] for g in GOLDEN])
    for row, (text, prefix, base) in zip(rows, GOLDEN):
        assert (row.encoded, row.base) == (prefix + base, base)
        assert row.decoded == text


@pytest.mark.parametrize("encoded, text", [
    ("\uE200\uE000\uE004\uE200\uE000\uE003\n", "\n" * 6),
    ("\uE200\uE000\uE008\uE200\uE000\uE003\n", "\n" * 10),
    ("\uE100\uE000,", ","),
    ("\uE100\uE000\uE100\uE002 ", " "),
    ("\uE201\uE000\uE003\uE003\uE100\uE000abc", "AbcAbcAbc"),
])
def test_worked_decodings(spark, encoded, text):
    df = spark.createDataFrame([(encoded,)], "e string")
    assert oc.with_decoded(df, "e").first().decoded == text


def test_mixed_case_repeats_stay(spark):
    same, mixed = encode(spark, ["AbcAbcAbc", "Abcabcabc"])
    assert [o.op for o in same.ops] == [p.MULTIREPEAT, p.CAPITALIZE] and same.base == "abc"
    assert [o.op for o in mixed.ops] == [p.CAPITALIZE] and mixed.base == "abcabcabc"


def test_limits(spark):
    letters = "".join(chr(0x4E00 + i) for i in range(255))
    rows = encode(spark, ["#" * 255, "#" * 256, letters + "A", letters + "cA", "ß", "İ", "ǅ",
                          "ab\uE100c", "q\u0323"])
    assert [o.params for o in rows[0].ops] == [[0, 255]]
    assert not rows[1].ops and rows[1].base == "#" * 256
    assert [o.op for o in rows[2].ops] == [p.CAPITALIZE]
    assert not rows[3].ops and rows[3].base.endswith("A")
    assert not rows[4].ops and not rows[6].ops
    assert rows[7].raw and rows[7].base == "ab\uE100c" and not rows[7].ops
    assert not rows[8].ops
    assert all(max(o.params) <= 255 for r in rows for o in r.ops)


def test_every_mark(spark):
    texts = [unicodedata.normalize("NFC", "o" + m) for m in p.MARK_OPS]
    for row, (name, code) in zip(encode(spark, texts), p.MARK_OPS.values()):
        assert (row.base, [(o.op, o.params) for o in row.ops]) == ("o", [(code, [0])]), name


def test_mark_table_covers_unicode():
    table = oc._mark_table()
    for cp in range(0xC0, sys.maxunicode + 1):
        full = unicodedata.normalize("NFD", chr(cp))
        expected = len(full) > 1 and all(m in p.MARK_OPS for m in full[1:])
        assert (cp in table) == expected, hex(cp)


def test_nfc_inert_characters():
    for low, high in ((0, 0x2FF), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF)):
        for cp in range(low, high + 1):
            c = chr(cp)
            assert unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c)


@pytest.mark.parametrize("flags", [(True, True, True), (False, True, False), (True, False, True),
                                   (True, False, False), (False, False, True)])
def test_round_trip_of_random_pieces(spark, flags):
    rng = random.Random(7)
    alphabet = "aabbAB ÉéñǺạậế\u0323\u0301\u0303ßİΣςǅ가#\n" + chr(0x1F600)
    texts = []
    for _ in range(1500):
        unit = "".join(rng.choices(alphabet, k=rng.randint(0, 6)))
        text = "".join(rng.choice([unit, rng.choice(alphabet)]) * rng.choice([1, 1, 2, 3, 5, 90, 260])
                       for _ in range(rng.randint(1, 4)))
        texts.append(unicodedata.normalize("NFC", text))
    for row in encode(spark, texts, *flags):
        assert row.decoded == row.piece, ascii(row.piece)


def test_megabyte_pieces(spark):
    texts = ["x" * 1_000_000, "ab" * 500_000, "".join(random.Random(3).choices("abcdefgh", k=200_000))]
    for row in encode(spark, texts):
        assert row.decoded == row.piece


def test_words_apart_and_fused(spark):
    df = oc.with_opcodes(spark.createDataFrame([("Héllo",)], "piece string"), True, True, True)
    row = df.select(oc.words(F.col("ops"), F.col("base"), True).alias("a"),
                    oc.words(F.col("ops"), F.col("base"), False).alias("f")).first()
    assert row.a == ["\uE102\uE001", "\uE100\uE000", "hello"]
    assert row.f == ["\uE102\uE001\uE100\uE000hello"]


def test_short_exits_of_the_opcode_step_search_no_complement(spark):
    """A search for a character outside a class starts the regex engine afresh at every character."""
    df = oc.with_opcodes(spark.createDataFrame([("aÉ",)], "piece string"), True, True, True)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert r"[^\x00-\x7F]" not in plan and r"[^\x00-\x40" not in plan and df.first().base == "ae"
