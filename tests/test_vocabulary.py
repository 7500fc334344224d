import collections
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.functions.merging import Merges
from glyphloom.operators import bpe, encode
from glyphloom.operators import decompose as dec
from glyphloom.operators import pieces as pcs
from glyphloom.plans.vocabulary_profile import profile
from glyphloom.session import work_dir
from glyphloom.sources import corpus, results

tokenizers = pytest.importorskip("tokenizers")
SPECIALS = ["[UNK]", "[PAD]", "[CLS]", "[SEP]", "[MASK]"]
SPLIT = r"\n+|\t+|[ ]| |[^\p{L}\p{N}\s _]+"


def library_tokenizer(words: dict[str, int], size: int):
    """The public trainer on a bag of words."""
    from tokenizers import models, pre_tokenizers, trainers
    tok = tokenizers.Tokenizer(models.BPE())
    tok.pre_tokenizer = pre_tokenizers.Split("\x00", "removed")
    tok.train_from_iterator(
        [w for w, n in words.items() for _ in range(n)],
        trainers.BpeTrainer(vocab_size=size, special_tokens=SPECIALS, show_progress=False))
    return tok


def train(spark, groups: dict[str, dict[str, int]], size, **options):
    rows = [(g, "c", w, n) for g, words in groups.items() for w, n in words.items()]
    df = spark.createDataFrame(rows, "label string, config string, word string, n bigint")
    v = bpe.train(df, size, **options)
    merges = {}
    for r in v.merges.orderBy("rank").collect():
        merges.setdefault(r.label, []).append((r.left, r.right))
    return v, merges


def bags(seed, groups=24):
    """Small bags of words that tie often, hold self-pairs and spell strings in two ways."""
    rng = random.Random(seed)
    out = {}
    for g in range(groups):
        letters = rng.choice(["ab", "abc", "abcde"])
        out[f"g{g:02d}"] = {"".join(rng.choices(letters, k=rng.randint(1, 9))): rng.randint(1, 6)
                            for _ in range(rng.randint(2, 25))}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_merges_equal_the_public_trainer(spark, seed):
    groups = bags(seed)
    v, merges = train(spark, groups, 40)
    vocab = {}
    for r in v.vocab.collect():
        vocab.setdefault(r.label, {})[r.token] = r.id
    for label, words in groups.items():
        tok = library_tokenizer(words, 40)
        expected = [tuple(m) for m in json.loads(tok.to_str())["model"]["merges"]]
        # The public trainer keeps stale counts when a merge spells an older symbol again.
        strings = [a + b for a, b in expected]
        clean = next((i for i, s in enumerate(strings) if s in strings[:i]), len(strings))
        assert merges.get(label, [])[:clean] == expected[:clean], label
        if clean == len(strings):
            assert vocab[label] == tok.get_vocab(), label


@pytest.mark.parametrize("active, symbols", [(1, 8), (2, 40), (5, 60), (12, 10_000)])
def test_bounds_of_a_phase_change_phases_only(spark, active, symbols):
    groups = bags(3)
    one, wide = train(spark, groups, 30)
    many, narrow = train(spark, groups, 30, active=active, symbols=symbols)
    assert wide == narrow and one.phases == 1 < many.phases


def recounted(words, size):
    """Merges by counting all pairs before each of them."""
    symbols, ids, out = [(list(map(ord, w)), n) for w, n in words.items()], {}, []
    names = {}
    while len(ids) < size:
        counts = collections.Counter()
        for s, n in symbols:
            for pair in zip(s, s[1:]):
                counts[pair] += n
        if not counts:
            break
        n, (a, b) = min(((-n, pair) for pair, n in counts.items()))
        token = names.get(a, chr(a) if a < bpe.FIRST_MERGE else "") + names.get(b, chr(b) if b < bpe.FIRST_MERGE else "")
        made = ids.setdefault(token, bpe.FIRST_MERGE + len(ids))
        names[made] = token
        out.append((a, b, -n))
        merged = []
        for s, w in symbols:
            t, i = [], 0
            while i < len(s):
                hit = i + 1 < len(s) and (s[i], s[i + 1]) == (a, b)
                t.append(made if hit else s[i])
                i += 1 + hit
            merged.append((t, w))
        symbols = merged
    return out


def in_phases(words, size, active):
    """The trainer's own phases on one group, without Spark."""
    state = collections.Counter({tuple(map(ord, w)): n for w, n in words.items()})
    names, out = bpe._Names([]), []
    while len(names.symbols) < size:
        counts = collections.Counter()
        for s, n in state.items():
            for pair in zip(s, s[1:]):
                counts[pair] += n
        ranked = sorted((-n, a << 21 | b) for (a, b), n in counts.items())
        kept = {r[1] for r in ranked[:active]}
        last = ranked[active] if active < len(ranked) else None
        cut = collections.Counter()
        for s, n in state.items():
            stretch = list(s[:1])
            for a, b in zip(s, s[1:]):
                if (a << 21 | b) not in kept:
                    cut[tuple(stretch)] += n
                    stretch = []
                stretch.append(b)
            cut[tuple(stretch)] += n
        merges = bpe.learnt(np.array([x for s in cut for x in s], np.int64), np.repeat(np.arange(len(cut)), [len(s) for s in cut]),
                            np.array(list(cut.values())), bpe._Names(list(names.symbols)), kept, last, size - len(names.symbols), 1)
        if not merges:
            break
        out += merges
        ranked_merges = bpe.Merges([(a, b, names.merged(a, b)[0]) for a, b, _ in merges], once=True)
        state = sum((collections.Counter({tuple(ranked_merges.applied(list(s))): n}) for s, n in state.items()), collections.Counter())
    return out


def test_phases_learn_the_merges_of_recounting():
    """Words whose tokens are spelled in many ways, cut at most places."""
    rng = random.Random(8)
    for _ in range(400):
        letters = rng.choice(["ab", "abc", "abcd"])
        words = {"".join(rng.choices(letters, k=rng.randint(1, 14))): rng.randint(1, 9) for _ in range(rng.randint(1, 30))}
        size = rng.choice([5, 20, 60])
        want = recounted(words, size)
        for active in (1, 2, 3, 6, 100):
            assert in_phases(words, size, active) == want, (words, size, active)


def test_replayed_merges_equal_those_of_a_heap():
    rng = random.Random(18)
    for _ in range(300):
        words = [[rng.randint(97, 99) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(1, 20))]
        known, merges = [97, 98, 99], []
        for made in range(200, 200 + rng.randint(1, 12)):
            merges.append((rng.choice(known), rng.choice(known), made))
            known.append(made)
        merges += rng.sample(merges, len(merges) // 3)      # pairs that come up again
        left, at = bpe.replayed(np.array([x for w in words for x in w], np.int64), np.repeat(np.arange(len(words)), list(map(len, words))), merges)
        heap = Merges(merges, once=True)
        assert [left[at == i].tolist() for i in range(len(words))] == [heap.applied(w) for w in words]


def test_a_symbol_takes_few_bytes():
    """Eight million symbols of a group must fit in a task."""
    import tracemalloc
    values = np.random.default_rng(1).integers(97, 123, 400_000)
    rows = np.repeat(np.arange(50_000), 8)
    tracemalloc.start()
    merges = bpe.learnt(values, rows, np.ones(50_000, np.int64), bpe._Names([]), set(), None, 300, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(merges) == 300 and peak < 90 * len(values)


def test_plain_units_are_those_of_the_folded_stream(spark):
    from glyphloom.operators.configs import CATALOGUE
    docs = spark.createDataFrame([("a", 1, "aa  !!   x x x x\n\n\n\n"), ("a", 2, " " * 300 + "ab" * 4), ("b", 3, ""), ("b", 4, "a\ta\t\t\ta     b")],
                                 "label string, doc_id long, text string")
    for names in (tuple(CATALOGUE), ("split", "split_factored"), ("llama",), ("split_factored",)):
        want = pcs.unit_counts(pcs.unit_arrays(docs, names))
        assert sorted(pcs.counted_units(docs, names).select(want.columns).collect()) == sorted(want.collect())
    assert pcs.streams_of(("split", "split_factored")) == ["split", "split+runs"]


def test_merges_of_a_long_word():
    """A megabyte word, by lowest rank first, as the public encoder has it."""
    from tokenizers import models
    rng = random.Random(9)
    pairs = [("a", "b"), ("b", "a"), ("ab", "a"), ("aba", "b"), ("a", "a"), ("aa", "ab")]
    vocab = {s: i for i, s in enumerate(dict.fromkeys(["a", "b", *(x + y for x, y in pairs)]))}
    merges = Merges([(vocab[x], vocab[y], vocab[x + y]) for x, y in pairs])
    model = tokenizers.Tokenizer(models.BPE(vocab=vocab, merges=pairs))
    for size in (0, 1, 2, 50, 3000, 1_000_000):
        word = "".join(rng.choices("ab", k=size))
        assert merges.applied([vocab[c] for c in word]) == model.encode(word).ids


def test_corpus_vocabulary_equals_the_public_trainer(spark, docs, tmp_path):
    from tokenizers import Regex, models, normalizers, pre_tokenizers, trainers
    size = 300
    lines = corpus.training_lines(docs.withColumn("label", F.lit("all")))
    words = dec.word_counts(dec.dictionary(lines, ["split"]))
    v = bpe.train(words, size)
    tok = tokenizers.Tokenizer(models.BPE())
    tok.normalizer = normalizers.NFC()
    tok.pre_tokenizer = pre_tokenizers.Split(Regex(SPLIT), "isolated")
    file = tmp_path / "corpus.txt"
    texts = {r.doc_id: r.text for r in docs.collect()}
    file.write_text("".join(x + "\n" for x in texts.values()), encoding="utf-8")
    tok.train([str(file)], trainers.BpeTrainer(vocab_size=size, special_tokens=SPECIALS, show_progress=False))
    assert {r.token: r.id for r in v.vocab.collect()} == tok.get_vocab()
    assert [(r.left, r.right) for r in v.merges.orderBy("rank").collect()] == [
        tuple(m) for m in json.loads(tok.to_str())["model"]["merges"]]

    # Encoding: every document gets the ids of the public encoder.
    one = pcs.normalized(docs.withColumn("label", F.lit("all")))
    units = pcs.unit_arrays(one, ["split"])
    coded = encode.encode_dictionary(dec.factor(pcs.unit_counts(units), ["split"]), v.merges, v.vocab)
    mine = {r.doc_id: list(r.ids) for r in encode.encode_corpus(units, coded, ["split"]).collect()}
    assert mine == {k: tok.encode(x).ids for k, x in texts.items()}

    # Units that no table holds come by shuffle: the same ids.
    for budget in (0, 2000):
        few = encode.encode_corpus(units, coded, ["split"], budget).collect()
        assert {r.doc_id: list(r.ids) for r in few} == mine


def test_thousands_of_merges_equal_the_public_trainer(spark):
    """Until the public trainer's counts go stale, 2,000 merges and more."""
    docs = corpus.documents(spark, "/root/testdata/sf0.01").withColumn("label", F.lit("all"))
    words = dec.word_counts(dec.dictionary(docs, ["split"]))
    v = bpe.train(words, 3000, active=400, symbols=60_000)
    tok = library_tokenizer({r.word: r.n for r in words.collect()}, 3000)
    expected = [tuple(m) for m in json.loads(tok.to_str())["model"]["merges"]]
    strings = [a + b for a, b in expected]
    seen, clean = set(), len(strings)
    for i, x in enumerate(strings):
        if x in seen:
            clean = i
            break
        seen.add(x)
    got = [(r.left, r.right) for r in v.merges.orderBy("rank").collect()]
    assert v.phases > 1 and len(got) >= 2000
    assert got[:clean] == expected[:clean] and clean > 500


def test_exhausted_corpus_has_one_token_per_word(spark):
    words = {"hello": 3, "help": 2, "held": 1, "a": 9}
    v, _ = train(spark, {"g": words}, 1000)
    tokens = {r.token for r in v.vocab.collect()}
    assert set(words) <= tokens and len(tokens) < 1000


def test_profile_round_trip_and_saved_tables(spark):
    texts = ["Hello   world!!! Café", "hello WORLD\n\n\n\tàb", "aaa bbb AAA 1111 hello   "] * 3
    rows = [("l", i, x) for i, x in enumerate(texts)]
    train_df = spark.createDataFrame(rows, "label string, doc_id bigint, text string")
    odd = [("l", 100, "hello Ж world"), ("l", 101, "Hello hello"), ("l", 102, "a" + " " * 9 + "b" * 7)]
    valid = train_df.union(spark.createDataFrame(odd, train_df.schema))
    configs = ("split", "split_factored", "split_factored_repeat", "metaspace_factored", "llama_factored")
    prof = profile(train_df, valid, 200, configs)
    found = {(r.config, r.outcome): r.docs for r in prof.roundtrip().collect()}
    assert found[("split", "oov")] == 1 and found[("split", "lossless")] == 11
    assert not any(outcome in ("failure", "long") for _, outcome in found)
    assert found[("split_factored", "opcode_oov")] == 1  # REPEAT(0,9) was never seen
    metrics = {r.config: r for r in prof.metrics().collect()}
    assert metrics["split"].inflation is None
    assert metrics["split_factored"].baseline == "split" and metrics["split_factored"].inflation is not None
    assert metrics["split"].chars == sum(len(x) for x in texts) + sum(len(x) for _, _, x in odd)

    path = work_dir(spark, "vocab-test")
    v = prof.vocabulary
    results.write_vocabulary(v.merges, v.vocab, path)
    merges, vocab = results.read_vocabulary(spark, path)
    assert vocab.select(*v.vocab.columns).exceptAll(v.vocab).isEmpty()
    assert merges.select(*v.merges.columns).exceptAll(v.merges).isEmpty()
    words = v.vocab.select("label", "config").distinct().withColumn("word", F.lit("hello"))
    again = encode.encode_words(words, merges, vocab).exceptAll(encode.encode_words(words, v.merges, v.vocab))
    assert again.isEmpty()


def test_private_use_text(spark):
    """Plain configurations give private-use text back; with operators it is reported, not hidden."""
    odd = "abc \uE100\uE000 x abc"
    rows = [("l", i, "abc x y z abc xyz") for i in range(3)] + [("l", 9, odd)]
    df = spark.createDataFrame(rows, "label string, doc_id bigint, text string")
    prof = profile(df, df, 60, ("split", "split_factored"))
    decoded = encode.decode_ids(prof.encoded(), prof.vocabulary.vocab)
    got = {r.config: r.decoded for r in decoded.filter("doc_id = 9").collect()}
    assert got["split"] == odd
    found = {(r.config, r.outcome): r.docs for r in prof.roundtrip().collect()}
    assert found[("split", "lossless")] == 4 and found[("split_factored", "lossless")] == 3
    audit = dec.decode_units(dec.dictionary(df, ("split", "split_factored")))
    lost = {(r.config, r.piece) for r in audit.filter(~F.col("lossless")).collect()}
    assert {c for c, _ in lost} == {"split_factored"}


def test_normal_form_is_its_own_class(spark):
    rows = [("l", 1, "caf\u00e9 caf\u00e9"), ("l", 2, "cafe\u0301 cafe\u0301")]
    df = spark.createDataFrame(rows, "label string, doc_id bigint, text string")
    found = {(r.config, r.outcome): r.docs for r in profile(df, df, 40, ("split",)).roundtrip().collect()}
    assert found == {("split", "lossless"): 1, ("split", "normalized"): 1}
