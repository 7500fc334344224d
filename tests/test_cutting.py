"""Cutting of whole batches against the regex columns."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphloom.functions import cutting as cu
from glyphloom.functions import opcodes as oc
from glyphloom.functions import pieces as pc
from glyphloom.operators import decompose as dec
from glyphloom.operators import packing as pk
from glyphloom.operators import pieces as pcs
from glyphloom.operators.configs import CATALOGUE
from glyphloom.plans import bindings as b
from glyphloom.sources.corpus import training_lines

SYMBOLS = ["a", "B", "s", "'", "t", "l", "re", "ve", "LL", "ſ", " ", "  ", "\n", "\r", "\t", " ", " ", "7", "_", "!",
           "é", "é", "語", "\U0001f600", "▁", "\x00", "²", "ͅ", ""]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return [None, "", " ", "!\n\n \n x", "a" * 300, " " * 256 + "a"] + [
        "".join(rng.choices(SYMBOLS, k=rng.randint(0, 14))) for _ in range(4000)]


@pytest.fixture(scope="module")
def corpus(spark, texts):
    return spark.createDataFrame([("ab"[i % 2], i, x) for i, x in enumerate(texts)], "label string, doc_id long, text string")


@pytest.mark.parametrize("name", list(pc.PRE_TOKENIZERS))
def test_pieces_and_runs_equal_the_columns(spark, corpus, name):
    cut = pc.PRE_TOKENIZERS[name](F.col("text"))
    rows = corpus.select("text", cut.alias("pieces"), pc.collapse_piece_runs(cut).alias("units")).toArrow().combine_chunks()
    part = rows.to_batches()[0]
    mine = cu.Texts(part.column("text"), cu.kinds(spark).value).cut(name)
    valid = part.column("text").is_valid()
    assert cu.listed(mine.pieces, mine.rows, valid).to_pylist() == part.column("pieces").to_pylist()
    assert cu.listed(*cu.units(mine, True), valid).to_pylist() == part.column("units").to_pylist()


def test_sums_and_sizes_equal_the_pieces(corpus):
    names = tuple(pc.PRE_TOKENIZERS)
    arrays = pcs.piece_arrays(corpus, names)
    key = ["label", "pre_tokenizer"]
    spans = arrays.select(*key, F.inline(pc.piece_offsets(F.col("pieces"))))
    want = spans.groupBy(*key, "piece").agg(F.count("*"), F.sum("start"), F.sum("end"), F.max("end").cast("bigint"))
    whole = [n for n in names if "whitespace" not in n]      # others leave text out, which offsets of the column don't count
    lossless = F.col("pre_tokenizer").isin(whole)
    assert sorted(map(tuple, pcs.piece_spans(corpus, whole).collect())) == sorted(map(tuple, want.filter(lossless).collect()))
    assert sorted(map(tuple, pcs.piece_counts(corpus, names).collect())) == sorted(
        tuple(r)[:4] for r in want.collect())
    totals = spans.groupBy(*key).agg(F.sum(F.length("piece")), F.count("*"))
    assert sorted(map(tuple, pcs.piece_totals(corpus, names).collect())) == sorted(map(tuple, totals.collect()))
    size = F.size("pieces")
    sizes = arrays.select("label", "doc_id", "pre_tokenizer", F.length("text"), size, F.length(F.array_join("pieces", "")).cast("bigint"),
                          F.when(size > 0, F.get("pieces", F.lit(0))), F.get("pieces", size - 1))
    assert sorted(map(repr, map(tuple, pcs.piece_sizes(corpus, names).collect()))) == sorted(map(repr, map(tuple, sizes.collect())))


def test_lines_equal_documents_cut_into_lines(corpus):
    names = ("split", "split_factored", "llama", "llama_factored")
    docs = corpus.filter(F.col("text").isNotNull())
    want = dec.word_counts(dec.dictionary(training_lines(docs), names))
    got = dec.word_counts(dec.dictionary(docs.withColumn("text", F.concat("text", F.lit("\n"))), names, lines=True))
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())


def test_words_of_units_equal_the_columns(spark, corpus):
    """Capitals, marks, repeats, runs, private-use text and places past the last parameter."""
    more = ["ÀÉÎx", "İSSS", "aaaBBB", "AbAbAb", "ǅƵ", "Ⓐ", "\ue100\ue000Hello", "x" * 255 + "ÉÉ", "É" * 300, "ạ̈̈e\u0323\u0301", "ΣΑΣ", "Å" * 3]
    docs = corpus.select("label", "text").unionByName(spark.createDataFrame([("a", x) for x in more], "label string, text string"))
    counts = pcs.counted_units(pcs.normalized(docs), CATALOGUE).persist()
    columns = ["label", "config", "piece", "run", "n"]
    words = oc.words(F.col("ops"), F.col("base"), F.col("split_operators"))
    want = dec.factor(counts, CATALOGUE).select(*columns, words.alias("words"))
    got = dec.spelled(counts, CATALOGUE).select(*columns, "words")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    counts.unpersist()


def test_a_slice_holds_whole_rows(monkeypatch):
    monkeypatch.setattr(cu, "SLICE", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["abc", None, "x" * 40, "", "yz", "y" * 9])], ["text"])
    parts = list(cu.slices(batch))
    assert len(parts) > 2 and [x for part in parts for x in part.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert list(cu.slices(batch.slice(0, 0))) == []
    assert cu.Texts(pa.array([], pa.string()), (np.zeros(0x110000, np.uint8), {})).count == 0


def test_losses_in_one_pass(corpus):
    docs = corpus.withColumn("text", F.coalesce("text", F.lit("")))
    counts, ratios = b.split_counts(docs, ["split"]), pk.char_ratio(b.doc_sizes(docs, ["split"]), ("label",))
    parts = [counts.filter(F.col(c) > 0).select("label", "piece", F.col(c).alias("n")) for c in ("n_train", "n_valid")]
    want = {r.label: r for r in pk.unigram_perplexity(*parts, ratios).collect()}
    got = {r.label: r for r in pk.unigram_losses(counts, ratios).collect()}
    for label, row in got.items():
        if label in want:
            assert all(abs(row[c] - want[label][c]) < 1e-9 * abs(want[label][c]) for c in ("tokens", "loss", "ppl_token", "ppl_char"))
        else:
            assert row.tokens == 0 and row.loss is None
