"""Kernels over Arrow arrays against the plain definitions."""

import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphloom.functions import patterns as p
from glyphloom.functions import repeats
from glyphloom.functions import text as t
from glyphloom.functions import wordtable
from glyphloom.functions.wordtable import WordTable


def test_nfc_of_every_code_point_and_of_random_sequences():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(1)
    marks = [c for c in points if unicodedata.combining(c)]
    starters = [c for c in points[:0x3000] if unicodedata.normalize("NFD", c) != c] + list("aeiouAEnc각")
    mixed = ["".join(rng.choice(rng.choice((marks, starters, points))) for _ in range(rng.randint(0, 8))) for _ in range(30_000)]
    for texts in (points, mixed, [f"{a}{b}" for a, b in zip(points[::7], points[3::7])]):
        assert t.nfc_array(pa.array(texts)).to_pylist() == [unicodedata.normalize("NFC", x) for x in texts]


def test_nfc_of_odd_arrays():
    every_border = "".join(t._BORDERS) + "é"
    for texts in ([], [None], ["", None, "é\n", "\n"], [every_border, None, "é"]):
        want = [None if x is None else unicodedata.normalize("NFC", x) for x in texts]
        assert t.nfc_array(pa.array(texts, pa.string())).to_pylist() == want


def test_nfc_columns(spark):
    rows = [(1, "café", ["é", None, ""]), (2, "café", []), (3, None, None), (4, "가", ["Å"])]
    df = spark.createDataFrame(rows, "id int, s string, a array<string>")
    got = {r.id: (r.s, r.a) for r in df.select("id", t.nfc(F.col("s")).alias("s"), t.nfc_each(F.col("a")).alias("a")).collect()}
    assert got == {1: ("café", ["é", None, ""]), 2: ("café", []), 3: (None, None), 4: ("가", ["Å"])}


def test_text_that_may_compose(spark):
    rows = ["", "a\nb", "é\n", "e\u0301", "\u0301", "a\u2019b\u20ac", "\u2126", "a" * 5000 + "\u0300", "\U0001F600", None, "\n\u1100\u1161"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, s string")
    inert = re.compile(f"[{p.NFC_INERT}]*")
    got = {r.i: r.c for r in df.select("i", t.may_compose(F.col("s")).alias("c")).collect()}
    assert got == {i: None if x is None else not inert.fullmatch(x) for i, x in enumerate(rows)}


@pytest.mark.parametrize("weak", [False, True])
def test_word_table(monkeypatch, weak):
    """Also where all hashes collide: a key is a miss then, or itself."""
    if weak:
        hashes = wordtable._hashes
        monkeypatch.setattr(wordtable, "_hashes", lambda *a: hashes(*a) % np.uint64(3))
    rng = random.Random(2)
    words = ["".join(rng.choices("abé", k=rng.randint(0, 20))) for _ in range(400)] + ["x" * 64, "x" * 65]
    keys = list(dict.fromkeys((w, rng.randint(1, 2)) for w in words))
    rows = [[i] * rng.randint(0, 3) for i in range(len(keys))]
    table = WordTable.of(pa.array([k for k, _ in keys]), np.array([r for _, r in keys]), pa.array(rows, pa.list_(pa.int32())))
    asked = keys + [(w + "a", 1) for w, _ in keys] + [(w, 3) for w, _ in keys]
    found = table.find(pa.array([w for w, _ in asked]), np.array([r for _, r in asked]))
    known = {k: r for k, r in zip(keys, rows)}
    for key, at in zip(asked, found.tolist()):
        if at >= 0:
            assert table.numbers[table.first[at]:table.first[at] + table.size[at]].tolist() == known[key]
        else:
            assert weak or key not in known or len(key[0]) > 64
    assert table.find(pa.array([], pa.string()), np.zeros(0, int)).tolist() == []


SEGMENT = re.compile(r"(?s)(.)\1{2,}|(.{2,255}?)\2{2,}|.")


def folded_by_regex(text):
    """The definition: segments by a pattern with back references, then the limits."""
    out, ops, at = "", [], 0
    spans = list(SEGMENT.finditer(text))
    for m in spans[:p.PARAM_MAX + 1]:
        unit = m.group(1) or m.group(2) or m.group(0)
        n, size = len(m.group(0)) // len(unit), len(unit)
        fits = at <= p.PARAM_MAX if size == 1 else at + size <= p.PARAM_MAX
        if 3 <= n <= p.PARAM_MAX and fits:
            ops.append({"op": p.REPEAT if size == 1 else p.MULTIREPEAT, "params": [at, n] if size == 1 else [at, at + size, n]})
            out, at = out + unit, at + size
        else:
            out, at = out + m.group(0), at + len(m.group(0))
    return out + "".join(m.group(0) for m in spans[p.PARAM_MAX + 1:]), ops


def test_repeats_equal_the_pattern():
    rng = random.Random(3)
    texts = [None, "", "aa", "aaa", "ababab", "abab", "aaaabaaaab" * 3, "x" * 300 + "yyy", "ab" * 300, "z" * 254 + "kkk", "z" * 256 + "kkk"]
    texts += ["".join(rng.choices("abc"[:rng.randint(1, 3)], k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(x * rng.randint(1, 5) for x in ("".join(rng.choices("abé😀", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 30))))
              for _ in range(500)]
    unit = "".join(chr(200 + i) for i in range(255))
    texts += [unit * 3, (unit + "!") * 3, "ab" + unit * 4, "".join(rng.choices("ab", k=600)), "q".join(["mmm"] * 200)]
    got = repeats.parts(pa.array(texts, pa.string())).to_pylist()
    for text, mine in zip(texts, got):
        if text is None:
            assert mine is None
            continue
        want, ops = folded_by_regex(text)
        assert ((text, []) if mine is None else (mine["text"], mine["ops"])) == (want, ops), text
