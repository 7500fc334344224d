"""Personal data, passages, near copies and BPE against brute force."""

import base64
import collections
import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from glyphloom.llm import bpe_fold, minmax, pii, pretokens, substrings
from glyphloom.llm.components import components
from glyphloom.llm.queries import QUERIES, VOCABULARY, public_codec
from glyphloom.session import work_dir

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "lorem ipsum 7 " * 30_000
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a row without id a row without id"), (5, LONG), (6, "one two"), (6, "one two")]


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def odd(spark, extra="spans"):
    return spark.createDataFrame([(*r, "mine") for r in ODD], f"doc_id long, text string, `{extra}` string")


# --- personal data --------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if passes(k, m.group())]


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("a.@1+9 -()5.b0é%") for _ in range(rng.randint(0, 30)))
        text = text.replace("a", "12").replace("b", ".") if rng.random() < 0.3 else text
        assert [s for s in pii.spans(text) if s[0] in pii.BASE] == brute_spans(text), text


def test_anchors_add_spans():
    found = pii.spans("iban: DE89 3704 0044 0532 0130 00 or account no 1234-5678, ftp://joe:pw@host.org/x; accounts 12")
    assert [k for k, _, _ in found] == ["email", "login", "account", "account"]
    assert pii.redact("mail a@b.cd now", pii.spans("mail a@b.cd now")) == "mail [EMAIL] now"
    assert pii.redact(None, []) is None


def test_pii_query_and_odd_rows(spark, sf):
    want = {i: brute_spans(t) for i, t in documents(spark, sf)}
    for r in QUERIES["op3_pii"](spark, sf).collect():
        base = pii.joined(want[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want[r.doc_id]) for k in pii.BASE]
    out = pii.detected(odd(spark))
    assert out.columns.count("spans") == 1 and {r.spans for r in out.collect()} == {""}
    assert pii.redacted(odd(spark)).collect() == odd(spark).collect()
    assert pii.detected(odd(spark).limit(0)).count() == 0


# --- repeated passages ----------------------------------------------------------

def brute_kept(rows, width=20):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = np.zeros(len(words), bool)
        for k in range(len(words) - width + 1):
            window = tuple(words[k:k + width])
            if window in seen:
                gone[k:k + width] = True
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    return out


def kept(df):
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", "n_words", "n_removed", digest).collect()}


@pytest.mark.parametrize("vocabulary,shard", [(3, 4096), (60, 4096), (60, 4)])
def test_passages_equal_brute_force(spark, vocabulary, shard):
    rng = random.Random(vocabulary)
    pool = [[str(rng.randint(0, vocabulary)) for _ in range(60)] for _ in range(8)]
    rows = []
    for i in range(150):
        words = ["z"] * rng.choice([0, 0, 0, 70])
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, 30)
            words += rng.choice(pool)[at:at + rng.randint(5, 35)] if rng.random() < 0.5 else [
                str(rng.randint(0, vocabulary)) for _ in range(rng.randint(0, 30))]
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert kept(substrings.deduplicated(df, substrings.Settings(shard=shard))) == brute_kept(rows)


def test_automaton_matches_substrings():
    rng = random.Random(9)
    for _ in range(200):
        automaton, texts = substrings.Automaton(), []
        for _ in range(4):
            words = [rng.randint(0, 2) for _ in range(rng.randint(0, 12))]
            known = {tuple(t[a:a + 3]) for t in texts for a in range(len(t) - 2)}
            assert automaton.ends(words, 3) == [e for e in range(2, len(words)) if tuple(words[e - 2:e + 1]) in known]
            automaton.add(words)
            texts.append(words)


def test_reference_shards(spark):
    docs = spark.createDataFrame([(1, "x " * 3 + " ".join(map(str, range(40)))), (2, "no match"), (None, "n")],
                                 "doc_id long, text string")
    reference = spark.createDataFrame([(" ".join(map(str, range(5, 35))),), (None,)], "text string")
    for words in (200_000, 4):
        found = substrings.matched(docs, reference, shard_words=words).collect()
        starts = {s for r in found for s in range(r.start, r.start + r.n)}
        assert {r.doc_id for r in found} == {1} and starts == set(range(8, 19))


def test_passages_of_odd_rows(spark):
    out = substrings.deduplicated(odd(spark, "n_words"))
    rows = out.collect()
    assert out.columns.count("n_words") == 1 and len(rows) == len(ODD)
    assert {r.doc_id: r.n_removed for r in rows}[5] == 90_000 - 3
    assert substrings.deduplicated(odd(spark).limit(0)).count() == 0


def test_passage_query(spark, sf):
    out = QUERIES["op6_substrings"](spark, sf)
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == brute_kept(documents(spark, sf))


# --- near copies ----------------------------------------------------------------

def brute_components(rows, hundredths):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    above = {i: i for i in sets}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    holders = collections.defaultdict(list)
    for i in sorted(sets):
        common = collections.Counter(j for x in sets[i] for j in holders[x])
        for j, both in common.items():
            if 100 * both >= hundredths * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                above[max(a, b)] = min(a, b)
        for x in sets[i]:
            holders[x].append(i)
    return {i: (len(sets[i]), top(i)) for i in sets}


def near(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("block", [2048, 8])
def test_near_copies_equal_brute_force(spark, block):
    rng = random.Random(7)
    rows = []
    for g in range(12):
        base = [f"W{rng.randint(0, 3000)}" for _ in range(rng.randint(4, 120))]
        for _ in range(rng.choice([1, 2, 25])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"w{rng.randint(0, 3000)}"
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    s = minmax.Settings(block=block)
    assert near(minmax.near_duplicates(df, s)) == brute_components(rows, 85)


def test_near_copies_of_odd_rows(spark):
    rows = minmax.near_duplicates(odd(spark)).collect()
    assert len(rows) == len(ODD)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows} >= {
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (6, 1, 6, True), (None, 4, None, True)}
    assert minmax.near_duplicates(odd(spark).limit(0)).count() == 0
    assert minmax.kept(odd(spark)).count() == len(ODD)


def test_near_copy_query(spark, sf):
    out = QUERIES["op8_minmax_dedup"](spark, sf)
    assert near(out) == brute_components(documents(spark, sf), 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(70, 71), (71, 71), (None, 1)], "a long, b long")
    got = dict(components(path).collect())
    assert got == {**{i: 0 for i in range(61)}, 70: 70, 71: 70}


# --- BPE ------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def coded(rows, library):
    out = {}
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        out[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                  hashlib.sha256((text or "").encode()).hexdigest())
    return out


def test_bpe_equals_the_library(spark, sf, library):
    rng = random.Random(3)
    bits = ["th", "e", "in", " ", "é", "=", "1", "\n", "日", "ß", "tion", "aa", "　", "\x1c", "🙂", "'s"]
    texts = [None, "", " ", "a" * 3000, "ab" * 500, "日本語" * 300, "<|endoftext|>", "  \n\n \t x"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 50))) for _ in range(400)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    codec = public_codec()
    for budget in (1 << 20, 900, 0):
        out = bpe_fold.digests(codec.decoded(codec.encoded(df, budget=budget)))
        assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()} == coded(rows, library)
    query = QUERIES["op5_bpe"](spark, sf).collect()
    assert {r[0]: tuple(r)[1:] for r in query} == coded(documents(spark, sf), library)


def test_bpe_of_odd_rows(spark):
    codec = public_codec()
    out = codec.decoded(codec.encoded(odd(spark, "ids")))
    rows = out.collect()
    assert out.columns.count("ids") == 1 and len(rows) == len(ODD)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in rows)
    assert codec.encoded(odd(spark).limit(0)).count() == 0


def test_bpe_leaves_nothing_written(spark):
    """Neither texts nor ids are written or shuffled on their way; only counts of words are, and they go."""
    shared = os.path.dirname(work_dir(spark, "any")).removeprefix("file:")
    before = os.listdir(shared)
    df = spark.createDataFrame([(i, f"the same words and one{i}xq") for i in range(50)], "doc_id long, text string")
    encoded = public_codec().encoded(df, budget=1500, keep=False, decode="decoded")
    assert os.listdir(shared) == before and "Exchange" not in encoded._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: bytes(r.decoded).decode() for r in encoded.collect()} == {r.doc_id: r.text for r in df.collect()}


def test_bpe_counts_words_a_slice_at_a_time(monkeypatch):
    sizes = []
    hashes_of = pretokens.hashes_of
    monkeypatch.setattr(pretokens, "hashes_of", lambda data, *rest: sizes.append(len(data)) or hashes_of(data, *rest))
    texts = [f"word{i % 7} other{i}" * 20 for i in range(20_000)]
    batches = bpe_fold._counted(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))
    counts = collections.Counter()
    for b in batches:
        counts.update(dict(zip(b["word"].to_pylist(), b["n"].to_pylist())))
    assert max(sizes) <= 4 * pretokens.SLICE_BYTES < sum(map(len, texts))
    assert counts[b"word"] == 400_000 and sum(len(w) * n for w, n in counts.items()) == sum(map(len, texts))


# --- rows that share an id, and names that clash ------------------------------------

WORDS = [f"w{i}" for i in range(60)]


def test_repeated_rows_keep_a_passage(spark):
    """Neither of two equal rows starts earlier; a copy under a larger id goes."""
    varied = WORDS[:30] + ["other"] + WORDS[31:]
    rows = [(1, " ".join(WORDS)), (1, " ".join(WORDS)), (2, " ".join(varied)), (3, " ".join(WORDS))]
    got = sorted((r.doc_id, r.n_removed) for r in substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0), (1, 0), (2, 59), (3, 60)]


def test_passages_among_clashing_names(spark):
    names = ["spans", "_spans", "_may", "_bit", "_both", "_id", "a.b", "n_words", "_0", "_total"]
    rows = [(*["x"] * len(names), 1, " ".join(WORDS)), (*["y"] * len(names), 2, " ".join(WORDS))]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names) + ", doc_id int, text string")
    out = substrings.deduplicated(df)
    assert out.columns == [n for n in names if n != "n_words"] + ["doc_id", "n_words", "n_removed", "text"]
    got = sorted((r["doc_id"], r["a.b"], r["_may"], r["_0"], r["n_words"], r["n_removed"]) for r in out.collect())
    assert got == [(1, "x", "x", "x", 60, 0), (2, "y", "y", "y", 60, 60)]


def test_kept_judges_rows_by_their_own_texts(spark):
    r, q = " ".join(WORDS), "another text that is linked with nothing at all here"
    rows = [(3, r, "p"), (6, q, "p"), (6, r, "p"), (3, r, "p"), (None, r, "p"), (None, None, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `component_id` string").withColumn("a.b", F.lit(1)).withColumn("key", F.lit(2))
    out = minmax.kept(df)
    assert out.columns == df.columns
    assert sorted(map(str, ((x.doc_id, x.text) for x in out.collect()))) == sorted(
        map(str, [(3, r), (3, r), (6, q), (None, r), (None, None)]))
