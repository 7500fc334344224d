"""Languages by context trees, Merkle witnesses and periodic runs against brute force."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.llm import merkle, periodic, ppm
from glyphloom.llm.queries import QUERIES

# --- languages -------------------------------------------------------------------


def brute_probability(texts, order, context, byte):
    """P(byte | context) by the definition: direct share, or escape times the renormalised shorter context."""
    after = {}
    for text in texts:
        padded = bytes(order) + text
        for i in range(order, len(padded)):
            for k in range(order + 1):
                after.setdefault(padded[i - k:i], []).append(padded[i])

    def p(ctx, b):
        if ctx is None:
            return 1 / 256
        shorter = ctx[1:] if ctx else None
        seen = after.get(ctx)
        if not seen:
            return p(shorter, b)
        total, kinds = len(seen), set(seen)
        if b in kinds:
            return seen.count(b) / (total + len(kinds))
        left = 1 - sum(p(shorter, x) for x in kinds)
        return len(kinds) / (total + len(kinds)) * p(shorter, b) / left

    return p(context, byte)


def model_from(texts_of, order):
    grams, counts, names = [], [], sorted(texts_of)
    for i, name in enumerate(names):
        data = np.frombuffer(b"".join(texts_of[name]), np.uint8)
        offsets = np.cumsum([0] + [len(t) for t in texts_of[name]])
        g, n = np.unique(ppm._grams(data, offsets, order), return_counts=True)
        grams.append(g)
        column = np.zeros((len(g), len(names)))
        column[:, i] = n
        counts.append(column)
    keys, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    table = np.zeros((len(keys), len(names)))
    np.add.at(table, inverse, np.concatenate(counts))
    return ppm.model_of(names, keys, table, 1 << 23)


def test_probabilities_equal_the_definition_and_add_up():
    rng = random.Random(3)
    texts_of = {"a": [bytes(rng.choices(b"abc ", k=rng.randint(0, 30))) for _ in range(6)],
                "b": [bytes(rng.choices(b"bcde", k=rng.randint(0, 30))) for _ in range(6)]}
    model = model_from(texts_of, 3)
    assert model.order == 3
    for context in [b"\0\0\0", b"abc", b"\0\0a", b"zzz", b"zbc", b"dea", b"c a"]:
        grams = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        p = np.exp2(-model.bits(grams))
        assert np.allclose(p.sum(0), 1, atol=1e-5)
        for i, name in enumerate("ab"):
            want = [brute_probability(texts_of[name], 3, context, b) for b in range(256)]
            assert np.allclose(p[:, i], want, rtol=1e-4), (context, name)


def test_code_lengths_of_whole_texts_in_blocks(monkeypatch):
    rng = random.Random(4)
    texts_of = {"a": [bytes(rng.choices(b"abc ", k=40)) for _ in range(4)], "b": [bytes(rng.choices(b"bcde", k=40)) for _ in range(4)]}
    model = model_from(texts_of, 2)
    texts = [bytes(rng.choices(b"abcde ", k=rng.randint(0, 25))) for _ in range(30)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    want = np.zeros((30, 2))
    for t, text in enumerate(texts):
        padded = bytes(2) + text
        for i in range(len(text)):
            for k, name in enumerate("ab"):
                want[t, k] -= math.log2(brute_probability(texts_of[name], 2, padded[i:i + 2], text[i]))
    for block in (7, 1 << 16):
        monkeypatch.setattr(ppm, "BLOCK", block)
        assert np.allclose(model.code_lengths(data, offsets), want, rtol=1e-4)


def test_deepest_levels_go_if_the_trees_are_too_large():
    rng = random.Random(5)
    texts = {"a": [bytes(rng.choices(range(97, 110), k=500)) for _ in range(20)]}
    whole = model_from(texts, 4)
    grams = whole.seen[4]
    small = ppm.model_of(["a"], grams, np.ones((len(grams), 1)), 2000)
    assert whole.order == 4 and 0 < small.order < 4


def test_odd_texts(spark):
    english = "the cat sat on the mat and the dog ran off "
    rows = [(i, english * 3, "en") for i in range(20)] + [(100 + i, "le chat dort et la souris danse ce soir ", "fr") for i in range(20)]
    docs = spark.createDataFrame(rows + [(None, "x y z", "en"), (300, None, "en"), (301, "no language", None)], "doc_id long, text string, lang string")
    model = ppm.fit(ppm.sample(docs, "lang", 5, F.lit(True)))
    assert model.languages == ["en", "fr"]
    odd = [(1, None, "x"), (2, "", "x"), (3, "12 ... 34", "x"), (None, "the dog sat", "x"), (5, "le chat danse ", "x"),
           (5, "le chat danse ", "x"), (6, "the mat " * 50_000, "x")]
    df = spark.createDataFrame(odd, "doc_id long, text string, `lang_pred` string").withColumn("a.b", F.lit(1)).withColumn("_known", F.lit(2))
    got = [(r.doc_id, r.lang_pred) for r in ppm.identified(df, model).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [
        (1, "und"), (2, "und"), (3, "und"), (None, "en"), (5, "fr"), (5, "fr"), (6, "en")]))
    assert all(0 <= r.score <= 1 for r in ppm.identified(df, model).collect())
    assert ppm.identified(df.limit(0), model).collect() == []
    nothing = ppm.fit(ppm.sample(docs.limit(0), "lang", 5, F.lit(True)))
    assert nothing is None and {r.lang_pred for r in ppm.identified(df, nothing).collect()} == {"und"}


def test_sample_is_bounded_for_every_label(spark):
    rows = [(i, f"text {i}", "big" if i % 10 else "small") for i in range(3000)] + [(7, "copy", "big")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = ppm.sample(docs, "lang", 100, F.col("doc_id") != 3).collect()
    assert sum(r.label == "big" for r in got) == 100 and sum(r.label == "small" for r in got) == 100


def test_held_out_accuracy(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op11_ppm"](spark, sf).collect()]
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


# --- Merkle manifests ---------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(leaves):
    """Root, and each leaf's siblings."""
    paths, owners, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(level) > 1:
        for i, members in enumerate(owners):
            other = level[i ^ 1] if i ^ 1 < len(level) else None
            for m in members:
                paths[m].append((other, None if other is None else i % 2 == 1))
        owners = [sum(owners[i:i + 2], []) for i in range(0, len(level), 2)]
        level = [h("".join(level[i:i + 2])) for i in range(0, len(level), 2)]
    return (level[0] if level else None), paths


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 11, 16, 33])
def test_frontier(n):
    leaves = [h(str(i)) for i in range(n)]
    front = merkle.Frontier(n)
    for leaf in leaves:
        front.append(leaf)
    root, paths = brute_tree(leaves)
    assert front.closed() == root
    assert [[w[i] for w in front.witness] for i in range(n)] == [[s for s, _ in p] for p in paths]


def test_partial_witnesses_are_extended_by_later_siblings():
    front = merkle.Frontier(4)
    for i in range(3):
        front.append(h(str(i)))
    assert front.witness[0][:2].tolist() == [h("1"), h("0")] and len(front.open) == 2
    front.append(h("3"))
    assert front.witness[1][0] == h(h("2") + h("3")) and len(front.open) == 1


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest_equals_brute_force(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.randrange(60) if rng.random() < 0.95 else None, rng.choice(["a", "a", "a", "bb", None]),
             rng.choice([None, "", "same", "text€ " * rng.randint(1, 500)])) for _ in range(140)] + [(1, "lone", "x")] + [(9, "a", "twin")] * 3
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("_digest", F.lit("mine")).withColumn("a.b", F.lit(0))
    leaf = merkle.leaf(F.col("doc_id"), F.col("lang"), F.col("text"))
    out = merkle.manifest(df, "doc_id", "lang", leaf, bits=bits)
    got = sorted(((r.doc_id, r.lang, r.leaf, r.subroot, r.root, [(s.sibling, s.before) for s in r.path], r.folded) for r in
                  out.withColumn("folded", merkle.folded(F.col("leaf"), F.col("path"))).collect()), key=str)

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], h("".join(map(field, r)))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {g: brute_tree([x for _, x in groups[g]]) for g in order}
    root, above = brute_tree([trees[g][0] for g in order])
    want = sorted(((k, g, x, trees[g][0], root, trees[g][1][i] + above[order.index(g)], root)
                   for g in order for i, (k, x) in enumerate(groups[g])), key=str)
    assert got == want
    assert merkle.manifest(df.limit(0), "doc_id", "lang", leaf, bits=bits).collect() == []


def test_tampered_rows_fail(spark, sf):
    rows = QUERIES["op12_merkle"](spark, sf).collect()
    assert {r.verified for r in rows} == {True, False} and len({r.root for r in rows}) == 1
    assert all(r.verified == (r.folded_root == r.root) for r in rows)


# --- periodic runs --------------------------------------------------------------------


def brute_runs(w, least):
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, 2 * p):
                out.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(6)
    for _ in range(1500):
        w = [rng.randint(0, rng.choice([0, 1, 2, 4])) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5 and w:
            a, p = rng.randrange(len(w)), rng.randint(1, 9)
            w = [w[i] if i < a else w[a + (i - a) % p] if a + (i - a) % p < len(w) else 0 for i in range(len(w))]
        least = rng.choice([2, 3, 4, 7, 12])
        assert list(map(tuple, periodic.runs(w, least).tolist())) == brute_runs(w, least), (w, least)


def test_runs_of_all_short_sequences():
    for n in range(9):
        for w in itertools.product((1, 2), repeat=n):
            assert list(map(tuple, periodic.repetitions(list(w), 2).tolist())) == brute_runs(w, 2)


def test_extensions_equal_brute_force():
    rng = random.Random(7)
    w = [rng.randint(1, 2) for _ in range(80)]
    pairs = [(a, b) for a in range(80) for b in range(80) if a != b]
    got = periodic.Extensions(periodic.SuffixTree(w)).of(*map(np.array, zip(*pairs)))
    for (a, b), n in zip(pairs, got):
        m = 0
        while max(a, b) + m < 80 and w[a + m] == w[b + m]:
            m += 1
        assert n == m


def test_collapsed_texts(spark):
    phrase = "one two three four"
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, f"start {' '.join([phrase] * 5)} end"), (5, "ha " * 200_000), (5, "ha " * 200_000),
            (6, "no repetition at all in this text of more than twelve different words so nothing goes")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("old")).withColumn("a.b", F.lit(1))
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.with_runs(df).collect())
    assert got == sorted([("1", 0, [], ""), ("2", 0, [], ""), ("3", 0, [], ""), ("None", 22, [(1, 20, 4)], f"start {phrase} end"),
                          ("5", 200_000, [(0, 200_000, 1)], "ha"), ("5", 200_000, [(0, 200_000, 1)], "ha"), ("6", 16, [], rows[6][1])])
    assert periodic.with_runs(df.limit(0)).collect() == []
