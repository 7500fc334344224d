"""Registered queries that SQL can't express, whole, against plain Python and the public BPE library."""

import collections
import hashlib
import itertools
import json
import unicodedata

import pytest
import regex

from glyphloom.functions import patterns as p
from glyphloom.operators import decompose as dec
from glyphloom.operators.configs import CATALOGUE, REPORT_CONFIGS
from glyphloom.plans import bindings as b
from glyphloom.plans.queries import QUERIES, TARGET_SIZE
from glyphloom.sources.corpus import nonblank, training_lines

tokenizers = pytest.importorskip("tokenizers")
SEGMENT = regex.compile(r"(?s)(.)\1{2,}|(.{2,255}?)\2{2,}|.")
SPLIT = regex.compile(r"\n+|\t+|[ ]|[^\p{L}\p{N}\s _]+|(?:(?![\n\t ])[\p{L}\p{N}_\s])+")
LLAMA = regex.compile(r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+")
PUA = regex.compile("[\uE000-\uF8FF]")
MARKS = {mark: code for mark, (_, code) in p.MARK_OPS.items()}


@pytest.fixture(scope="module")
def texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "doc_id", "text").collect()
    return [(r.lang, r.doc_id, unicodedata.normalize("NFC", r.text), r.text) for r in rows]


def units(text, pattern, runs):
    for piece, group in itertools.groupby(pattern.findall(text)):
        n = len(list(group))
        if runs and 3 <= n <= 255 and len(piece) <= 255:
            yield piece, n
        else:
            yield from [(piece, 1)] * n


def repeated(piece):
    out, ops, at, spans = "", [], 0, list(SEGMENT.finditer(piece))
    for m in spans[:256]:
        unit = m.group(1) or m.group(2) or m.group(0)
        n, size = len(m.group(0)) // len(unit), len(unit)
        if 3 <= n <= 255 and (at <= 255 if size == 1 else at + size <= 255):
            ops.append((p.REPEAT, at, n) if size == 1 else (p.MULTIREPEAT, at, at + size, n))
            out, at = out + unit, at + size
        else:
            out, at = out + m.group(0), at + len(m.group(0))
    return out + "".join(m.group(0) for m in spans[256:]), ops


def factored(piece, run, config):
    """(operators, base, raw) of a unit."""
    size = len(piece)
    outer = [] if run == 1 or not config.repeat else [(p.REPEAT, 0, run) if size == 1 else (p.MULTIREPEAT, 0, size, run)]
    if PUA.search(piece):
        return outer, piece, True
    text, inner = repeated(piece) if config.repeat else (piece, [])
    marks, capitals, base = [], [], []
    for i, ch in enumerate(text):
        full = unicodedata.normalize("NFD", ch)
        if config.serialize and i <= 255 and len(full) > 1 and all(m in MARKS for m in full[1:]):
            marks += [(MARKS[m], i) for m in full[1:]]
            ch = full[0]
        low = ch.lower()
        if config.capitalize and i <= 255 and low != ch and len(low) == 1 and low.upper() == ch:
            capitals.append((p.CAPITALIZE, i))
            ch = low
        base.append(ch)
    return outer + inner + marks + capitals, "".join(base), False


def rendered(op):
    return chr(op[0]) + "".join(chr(p.PARAM_BASE + x) for x in op[1:])


@pytest.fixture(scope="module")
def dictionary(texts):
    """(label, piece, run) with counts, of all documents, and how each is factored."""
    config = CATALOGUE["split_factored"]
    counts = collections.Counter((label, *u) for label, _, text, _ in texts for u in units(text, SPLIT, True))
    return [(key, n, *factored(key[1], key[2], config)) for key, n in counts.items()]


def grouped(rows):
    out = collections.Counter()
    for key, n in rows:
        out[key] += n
    return dict(out)


def test_encode_pieces(spark, sf, dictionary):
    want = grouped(((key[0], "".join(map(rendered, ops)) + base), n) for key, n, ops, base, _ in dictionary)
    assert {(r.label, r.encoded): r.n for r in QUERIES["encode_pieces"](spark, sf).collect()} == want


def test_multi_repeat_ops(spark, sf, dictionary):
    want = grouped(((key[0], ",".join(map(str, op[1:]))), n) for key, n, ops, _, _ in dictionary for op in ops if op[0] == p.MULTIREPEAT)
    assert {(r.label, r.params): r.n for r in QUERIES["multi_repeat_ops"](spark, sf).collect()} == want


def test_op_limits(spark, sf, dictionary):
    want = {}
    for label in {key[0] for key, *_ in dictionary}:
        rows = [(key, n, ops, base, raw) for key, n, ops, base, raw in dictionary if key[0] == label]
        params = [x for _, _, ops, _, _ in rows for op in ops for x in op[1:]]
        left = [n for _, n, _, base, _ in rows
                if any(c != c.lower() and len(c.lower()) == 1 and c.lower().upper() == c for c in base)]
        want[label] = (sum(r[1] for r in rows), max(params, default=None), sum(n for key, n, *_ in rows if len(key[1]) > 256),
                       sum(r[1] for r in rows if r[4]), sum(left))
    got = {r.label: (r.units, r.max_param, r.long_units, r.raw_units, r.capitals_left) for r in QUERIES["op_limits"](spark, sf).collect()}
    assert got == want


def test_split_operator_forms(spark, sf, dictionary):
    want = {}
    for label in {key[0] for key, *_ in dictionary}:
        rows = [(n, ops, base) for key, n, ops, base, _ in dictionary if key[0] == label]
        want[label] = (sum(n * (len(ops) + 1) for n, ops, _ in rows), sum(n for n, *_ in rows), len({base for *_, base in rows}),
                       len({"".join(map(rendered, ops)) + base for _, ops, base in rows}))
    got = {r.label: (r.words_apart, r.words_fused, r.bases, r.fused_forms) for r in QUERIES["split_operator_forms"](spark, sf).collect()}
    assert got == want


# --- learned vocabularies -----------------------------------------------------------


@pytest.fixture(scope="module")
def learned(spark, sf):
    merges, tokens = collections.defaultdict(list), collections.defaultdict(list)
    for r in QUERIES["bpe_merges"](spark, sf).orderBy("rank").collect():
        merges[r.label, r.config].append((r.left, r.right, r.token))
    for r in QUERIES["vocab_table"](spark, sf).orderBy("id").collect():
        tokens[r.label, r.config].append(r.token)
        assert r.id == len(tokens[r.label, r.config]) - 1
    return merges, tokens


def test_merges_equal_the_public_trainer(spark, sf, learned):
    """All groups; up to the place where the public trainer's counts go stale, as a merge spells an older token again."""
    from tokenizers import models, pre_tokenizers, trainers
    train = training_lines(nonblank(b.train(b.documents(spark, sf))))
    words = collections.defaultdict(dict)
    for r in dec.word_counts(dec.dictionary(train, REPORT_CONFIGS)).collect():
        words[r.label, r.config][r.word] = r.n
    merges, tokens = learned
    assert set(words) == set(merges)
    for group, bag in words.items():
        tok = tokenizers.Tokenizer(models.BPE())
        tok.pre_tokenizer = pre_tokenizers.Split("\x00", "removed")
        tok.train_from_iterator((w for w, n in bag.items() for _ in range(n)), trainers.BpeTrainer(
            vocab_size=TARGET_SIZE, special_tokens=list(p.SPECIAL_TOKENS), show_progress=False))
        expected = [tuple(m) for m in json.loads(tok.to_str())["model"]["merges"]]
        seen, clean = set(), 0
        for left, right in expected:
            if left + right in seen:
                break
            seen.add(left + right)
            clean += 1
        assert [m[:2] for m in merges[group][:clean]] == expected[:clean] and clean > 50, group
        alphabet = sorted({c for w in bag for c in w})
        assert tokens[group] == [*p.SPECIAL_TOKENS, *alphabet, *dict.fromkeys(m[2] for m in merges[group])], group
        assert len(tokens[group]) <= TARGET_SIZE


def words_of(text, config):
    pattern = LLAMA if config.pre_tokenizer == "llama" else SPLIT
    for piece, run in units(text, pattern, config.repeat):
        if config.factored:
            ops, base, _ = factored(piece, run, config)
            yield from [*map(rendered, ops), base]
        else:
            yield piece


def test_corpus_ids_texts_and_outcomes(spark, sf, texts, learned):
    """Every validation document under every configuration, by the public encoder and the definitions."""
    from tokenizers import models
    merges, tokens = learned
    ids, known = {}, {}
    for group, names in tokens.items():
        model = models.BPE(vocab={s: i for i, s in enumerate(names)}, merges=list(dict.fromkeys(m[:2] for m in merges[group])))
        known[group] = {s for s in names if len(s) == 1}
        ids[group] = tokenizers.Tokenizer(model)
    want, looked, outcomes, whole = {}, {}, collections.Counter(), {}
    for label, doc, text, raw in texts:
        if doc % 10 != 9:
            continue
        for config in REPORT_CONFIGS:
            group, words = (label, config), list(words_of(text, CATALOGUE[config]))
            spelled = [i for w in words for i in ids[group].encode(w).ids]
            want[label, config, doc] = (len(spelled), hashlib.md5(",".join(map(str, spelled)).encode()).hexdigest())
            names = "\x1f".join(tokens[group][i] for i in spelled)
            looked[label, config, doc] = (len(spelled), hashlib.md5(names.encode()).hexdigest(), True)
            if all(c in known[group] for w in words for c in w):
                outcomes[label, config, "lossless" if raw == text else "normalized"] += 1
                whole[label, config, doc] = text
            else:
                outcomes[label, config, "other"] += 1
    got = {(r.label, r.config, r.doc_id): (r.tokens, r.content) for r in QUERIES["encode_corpus"](spark, sf).collect()}
    assert got == want
    assert {(r.label, r.config, r.doc_id): (r.tokens, r.content, r.same) for r in QUERIES["token_lookup"](spark, sf).collect()} == looked
    for name in ("decode_corpus", "decode_factored"):
        for r in QUERIES[name](spark, sf).collect():
            key = (r.label, r.config, r.doc_id)
            assert key not in whole or r.text == whole[key], key
    found = collections.Counter()
    for r in QUERIES["roundtrip_classes"](spark, sf).collect():
        found[r.label, r.config, r.outcome if r.outcome in ("lossless", "normalized") else "other"] += r.docs
    assert found == outcomes
