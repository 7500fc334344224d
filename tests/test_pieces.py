import itertools
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from glyphloom.functions import pieces as pc
from glyphloom.functions import text as t
from glyphloom.operators import decompose as dec
from glyphloom.operators import pieces as pcs
from glyphloom.operators.configs import CATALOGUE

#: What a text is put together from; each class is a feature that pre-tokenizers treat in their own way.
FEATURES = {
    "line ends": ["\n", "\n\n\n", "\r", "\r\n"], "tabs": ["\t", "\t\t"], "spaces": [" ", "   ", "\u00A0"],
    "words": ["oak", "Elm", "BIRCH"], "identifiers": ["x_1", "__y", "a_b_c"], "numbers": ["7", "2048"],
    "symbols": [".", ",,", "<=", "\"\"\"", "!?!"], "contractions": ["he's", "WE'LL"],
    "composed": ["é", "Ñu", "ç"], "decomposed": ["e\u0301", "o\u0308\u0323"], "wide": ["語", "😀"],
}


def generated(seed: int, size: int) -> list[str]:
    """Seeded texts: one of each feature, one of each pair of features, then random ones."""
    rng = random.Random(seed)
    pick = lambda kind: rng.choice(FEATURES[kind])
    texts = ["", *map(pick, FEATURES), *(pick(a) + pick(b) for a, b in itertools.product(FEATURES, repeat=2))]
    return texts + ["".join(pick(rng.choice(list(FEATURES))) for _ in range(rng.randint(3, 25))) for _ in range(size)]


TEXTS = generated(11, 60)


def cut(spark, name, texts=TEXTS):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    rows = df.select("i", pc.PRE_TOKENIZERS[name](F.col("text")).alias("p")).collect()
    return [r.p for r in sorted(rows, key=lambda r: r.i)]


@pytest.mark.parametrize("name", ["split", "llama", "metaspace", "metaspace_split"])
def test_pieces_join_to_the_text(spark, name):
    for text, pieces in zip(TEXTS, cut(spark, name)):
        joined = "".join(pieces)
        assert (joined.replace("▁", " ") if "metaspace" in name else joined) == text


def test_split_isolates(spark):
    texts = ["x_1,, oak.", "7\t\toak", "<=\n\n\nx", ".  7", "Elm\u00A0oak 7"]
    assert cut(spark, "split", texts) == [
        ["x_1", ",,", " ", "oak", "."], ["7", "\t\t", "oak"], ["<=", "\n\n\n", "x"], [".", " ", " ", "7"], ["Elm\u00A0oak", " ", "7"]]


def test_llama_look_ahead(spark):
    assert cut(spark, "llama", [".  oak", "he's WE'LL   7"]) == [
        [".", " ", " oak"], ["he", "'s", " WE", "'LL", "  ", " ", "7"]]


def test_metaspace_and_whitespace(spark):
    assert cut(spark, "metaspace", ["a  b c"]) == [["a", "▁", "▁b", "▁c"]]
    assert cut(spark, "whitespace", ["a  b== c_1"]) == [["a", "b", "==", "c_1"]]


def test_long_words_do_not_overflow(spark):
    long = "x" * 1_000_000
    for name in pc.PRE_TOKENIZERS:
        assert "".join(cut(spark, name, [long])[0]) == long


def test_against_the_public_library(spark):
    from tokenizers import Regex, pre_tokenizers
    patterns = {
        "split": r"\n+|\t+|[ ]| |[^\p{L}\p{N}\s _]+",
        "llama": r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*"
                 r"|\s*[\r\n]+|\s+(?!\S)|\s+"}
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choices("ab1_ é\n\t\r.'!sT\u00A0", k=rng.randint(0, 60))) for _ in range(400)]
    for name, pattern in patterns.items():
        tok = pre_tokenizers.Split(Regex(pattern), "isolated")
        for text, mine in zip(texts, cut(spark, name, texts)):
            assert mine == [x for x, _ in tok.pre_tokenize_str(text)], ascii(text)


def test_runs_and_offsets(spark):
    rng = random.Random(2)
    arrays = [[], ["a"], [" "] * 3, [" "] * 255, [" "] * 256, ["x" * 300] * 4] + [
        [rng.choice(["a", "bb", " "]) for _ in range(rng.randint(1, 900))] for _ in range(30)]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, p array<string>")
    rows = sorted(df.select("i", pc.collapse_piece_runs(F.col("p")).alias("r"),
                            pc.piece_offsets(F.col("p")).alias("o")).collect(), key=lambda r: r.i)
    for pieces, row in zip(arrays, rows):
        expected = []
        for piece, group in itertools.groupby(pieces):
            n = len(list(group))
            expected += [(piece, n)] if 3 <= n <= 255 and len(piece) <= 255 else [(piece, 1)] * n
        assert [(u.piece, u.run) for u in row.r] == expected
        at = 0
        for piece, span in zip(pieces, row.o, strict=True):
            assert (span.start, span.end, span.piece) == (at, at + len(piece), piece)
            at += len(piece)


def test_scalar_functions(spark):
    words = ["Café", "hmmmm", "book", "!!", "\uE100\uE000Hello", "ÀÉÎ", "x\uF8FFy"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    rows = sorted(df.select("i", t.concept_key(F.col("w")).alias("k"), t.strip_pua(F.col("w")).alias("s"),
                            t.strip_pua_wide(F.col("w")).alias("v")).collect(), key=lambda r: r.i)
    assert [r.k for r in rows] == ["cafe", "hm", "book", "", "hello", "aei", "xy"]
    assert rows[6].s == "x\uF8FFy" and rows[6].v == "xy"


def test_blank_and_normal_form(spark):
    texts = [None, "", " \n", "\u00A0 ", "x", "e\u0301", "\u212B", "가"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    rows = sorted(df.select("i", t.is_nonblank(F.col("x")).alias("ok"), t.nfc(F.col("x")).alias("c"),
                            t.nfd(F.col("x")).alias("d")).collect(), key=lambda r: r.i)
    assert [r.ok for r in rows] == [False, False, False, False, True, True, True, True]
    for x, row in zip(texts, rows):
        if x is not None:
            assert row.c == unicodedata.normalize("NFC", x) and row.d == unicodedata.normalize("NFD", x)


def test_dictionary_is_lossless_for_every_configuration(spark):
    texts = [unicodedata.normalize("NFC", x) for x in TEXTS if x] + ["a" + " " * 12 + "B" * 7 + "!!!! 1111"]
    df = spark.createDataFrame([(i, "l", x) for i, x in enumerate(texts)], "doc_id int, label string, text string")
    dic = dec.decode_units(dec.dictionary(df, CATALOGUE))
    totals = {r.config: (r.chars, r.bad) for r in dic.groupBy("config").agg(
        F.sum(F.length("piece") * F.col("run") * F.col("n")).alias("chars"),
        F.count_if(~F.col("lossless")).alias("bad")).collect()}
    assert len(totals) == 12
    kept = sum(len(x) for x in texts)
    solid = sum(len(re.sub(r"\s", "", x.replace(" ", "▁"))) for x in texts)
    for config, (chars, bad) in totals.items():
        assert bad == 0, config
        assert chars == (solid if "whitespace" in config else kept), config


def test_diagnostics(spark):
    df = spark.createDataFrame([("l", 1, "a == b\n"), ("l", 2, "ab")], "label string, doc_id int, text string")
    rows = {r.pre_tokenizer: r for r in pcs.split_diagnostics(df, ["split", "whitespace"]).collect()}
    assert (rows["split"].pct_line_ends_kept, rows["whitespace"].pct_line_ends_kept) == (100, 0)
    assert (rows["split"].docs_with_symbol_runs, rows["split"].pct_symbol_runs_kept) == (1, 100)
    assert (rows["split"].pct_spaces_kept, rows["whitespace"].pct_spaces_kept) == (100, 0)


def test_shares_of_pieces_equal_counts_by_share(spark):
    """One shuffle of packed rows; it were two of single rows."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["x" * 5_000, "é" * 70, "\n", "  "]
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), i, rng.random() < 0.3,
             rng.choice([None, "", *[" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(20)]])) for i in range(500)]
    docs = spark.createDataFrame(rows, "label string, seed bigint, doc_id bigint, held boolean, text string")
    names, by = ("split", "llama", "metaspace"), ("label", "seed")
    found = pcs.piece_shares(docs, names, "held", by)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "HashAggregate" not in plan
    counts = pcs.piece_counts(docs, names, (*by, "held"))
    want = counts.groupBy(*by, "pre_tokenizer", "piece").agg(
        F.sum(F.when(F.col("held"), 0).otherwise(F.col("n"))).alias("n_train"), F.sum(F.when(F.col("held"), F.col("n")).otherwise(0)).alias("n_valid"))
    assert found.columns == want.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    assert pcs.piece_shares(docs.limit(0), names, "held", by).count() == 0
