"""WARC round trips, mixing, language-model scores and the pipeline."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphloom.llm import mixing, pitman_yor, warc
from glyphloom.llm.queries import QUERIES
from glyphloom.session import work_dir

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- WARC -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>é" + "x" * 1200
    rows = [(1, "http://a/ü\r\nX: y", big), (5, "http://b", big), (3, None, big), (2, "u", "small"), (4, "u", "small"),
            (6, "", None), (None, "n", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"), (7, "z", "y" * 300_000), (7, "z", "y" * 300_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_warc_round_trip(spark, pages):
    path = work_dir(spark, "warc-test")
    got = warc.archived(pages, path).collect()
    assert len(got) == 9
    html = {(r.page_id, r.url): (r.html or "").encode() for r in pages.collect()}
    for r in got:
        own = html[r.page_id, r.url]
        assert (r.payload_bytes, r.payload_digest) == (len(own), hashlib.sha1(own).hexdigest())
        assert bytes(r.payload) == own if r.record_type == "response" else r.payload is None
    assert {(r.page_id, r.record_type, r.refers_to) for r in got if r.record_type == "revisit"} == {
        (1, "revisit", 5), (3, "revisit", 5)}
    read = spark.read.format("warc").load(path)
    assert {r.page_id for r in read.where("record_type = 'revisit' and payload_bytes > 10").collect()} == {1, 3}
    assert read.where("page_id is null").count() == 1


def test_predicates_leave_payloads_alone(monkeypatch):
    data = b"".join(warc.member(warc.record(i, "u", "response", 5000, "d", None, bytes([65 + i]) * 5000)) for i in range(4))
    rows = list(warc.records(memoryview(data), lambda r: r["page_id"] == 2))
    assert [r["page_id"] for r in rows] == [2] and rows[0]["payload"] == b"C" * 5000
    assert [r["payload"] for r in warc.records(memoryview(data), payload=False)] == [None] * 4
    import gzip
    assert gzip.decompress(data).count(b"WARC/1.1") == 4


def test_empty_archive(spark, pages):
    assert warc.archived(pages.limit(0)).count() == 0


def test_warc_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    own = {r.page_id: (r.html or "").encode() for r in rows}
    last = {}
    for i, body in own.items():
        last[body] = max(i, last.get(body, i))
    for r in QUERIES["op9_warc"](spark, sf).collect():
        body = own.pop(r.page_id)
        refers = last[body] if len(body) >= 1000 and last[body] != r.page_id else None
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(body), hashlib.sha1(body).hexdigest(), refers)
        assert r.record_type == ("response" if refers is None else "revisit")
    assert not own


# --- mixing ---------------------------------------------------------------------

def expected(rows, domains):
    shares = np.zeros(domains)
    for r in rows:
        shares += r.rate * r.n_tokens * np.array(r.posterior)
    return shares / shares.sum()


def test_mixing_meets_targets(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    targets = {"en": 0.25, "fr": 0.25, "de": 0.4, "es": 0.1}
    rows = mixing.mixed(docs, labels, targets=targets).collect()
    names = sorted(targets)
    assert np.allclose(expected(rows, 4), [targets[n] for n in names], atol=1e-4)
    assert min(r.rate for r in rows) >= 0 and len(rows) == docs.count()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert np.mean([truth[r.doc_id] == r.domain for r in rows]) > 0.95
    again = mixing.remixed(docs, labels, targets)
    assert again.columns == docs.columns
    assert {r.doc_id for r in again.select("doc_id").collect()} >= {r.doc_id for r in rows if r.rate >= 1}


def test_mixing_projects_to_zero(spark):
    rows = spark.createDataFrame([(i, 10, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(40)],
                                 "doc_id long, n_tokens long, posterior array<double>")
    out = mixing.fitted_rates(rows, ["a", "b"], {"a": 1.0}, mixing.Settings(), keep=False).collect()
    assert {(r.doc_id % 2, round(r.rate, 6)) for r in out} == {(1, 1.0), (0, 0.0)}


def test_mixing_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", 5.0), (2, "", "en", 5.0), (None, "a b", "fr", 5.0), (3, "c d " * 90_000, "fr", 5.0),
                                  (3, "c d", None, 5.0)], "doc_id long, text string, lang string, rate double")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (3, 0), (None, 1)], "doc_id long, quality int")
    out = mixing.mixed(docs, labels)
    assert out.columns.count("rate") == 1 and out.count() == 5
    none = mixing.mixed(docs, labels.limit(0)).collect()
    assert {r.domain for r in none} == {"all"} and len({r.rate for r in none}) == 1
    assert mixing.mixed(docs.limit(0), labels).count() == 0


def test_mixing_query(spark, sf):
    rows = QUERIES["op10_mixing"](spark, sf).collect()
    have = np.sum([r.n_tokens * np.array(r.posterior) for r in rows], axis=0)
    want = (have / have.sum()) ** 0.7
    assert np.allclose(expected(rows, len(have)), want / want.sum(), atol=1e-4)
    assert min(r.rate for r in rows) >= 1 - 1e-9


# --- language model -------------------------------------------------------------

def counted(rows):
    tokens = {i: WORD.findall((t or "").translate(LOWER)) + [None] for i, t in rows}
    train = {i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1}
    return tokens, train, collections.Counter(w for i in train for w in tokens[i])


def test_pitman_yor_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    tokens, train, c = counted(rows)
    n, v = sum(c.values()), len(c)
    out = QUERIES["op7_pitman_yor"](spark, sf).collect()
    assert len(out) == len(rows)
    for r in out:
        own = tokens[r.doc_id]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c[w] > 0 for w in own), n)
        assert r.held_out == (r.doc_id not in train) and math.isclose(r.base_score, base, rel_tol=1e-7)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_predictions_sum_to_one(spark):
    """Over all known words and one unknown, after any known context."""
    words = ["a", "b", "c", "d"]
    train = [(i, True, " ".join(words[(i * k) % 4] for k in range(1, 9))) for i in range(20)]
    probes = [(100 + i, False, w) for i, w in enumerate([*words, "unknown"])]
    # one-word texts: P(word | start) P(end | word); the ends are divided out by texts that only differ in their start
    s = pitman_yor.Settings(contexts=64, samples=1)
    df = spark.createDataFrame(train + probes + [(200, False, "")], "doc_id long, train boolean, text string")
    rows = {r.doc_id: r for r in pitman_yor.scored(df, s).collect()}
    assert all(r.score < 0 for r in rows.values()) and rows[104].n_known == 1
    total = sum(10 ** rows[100 + i].score for i in range(5)) + 10 ** rows[200].score
    assert 0 < total <= 1 + 1e-9


def test_seating_follows_the_chinese_restaurant():
    """Mean tables of the sampler against seating customers one at a time without a parent's pull."""
    rng = np.random.default_rng(5)
    d, theta = 0.5, 1.0
    exact = np.zeros(13)
    s = np.exp(pitman_yor.stirling(d))[12]
    weights = [s[t] * np.prod([theta + d * i for i in range(t)]) for t in range(1, 13)]
    exact[1:] = np.array(weights) / sum(weights)
    tables = np.ones(20_000)
    for k in range(1, 12):
        tables += rng.random(20_000) < (theta + d * tables) / (theta + k)
    assert abs(tables.mean() - (exact * np.arange(13)).sum()) < 0.05
    drawn = pitman_yor.seat(np.full(20_000, 12), np.full(20_000, 0.7), d, rng)
    p = np.array([s[t] * 0.7 ** t for t in range(13)])
    assert abs(drawn.mean() - (p * np.arange(13)).sum() / p.sum()) < 0.05
    many = pitman_yor.seat(np.array([0, 1, 2, 65, 5000]), np.full(5, 3.0), d, rng)
    assert many[0] == 0 and many[1] == 1 and 1 <= many[2] <= 2 and (many <= [0, 1, 2, 65, 5000]).all()


def test_probabilities_of_each_context_sum_to_one(spark):
    """Over all words, the end and one unknown, in several buckets, for frequent and rarer contexts alike."""
    words = [f"w{i}" for i in range(12)]
    train = [(i, True, " ".join(words[(i * k * k + k) % (4 + i % 9)] for k in range(1, 40))) for i in range(60)]
    train.append((60, True, " ".join(words)))
    probes = [(1000 + i, False, f"{a} {b}") for i, (a, b) in enumerate((a, b) for a in words for b in [*words, "unknown"])]
    df = spark.createDataFrame(train + probes, "doc_id long, train boolean, text string")
    s = pitman_yor.Settings(contexts=4, bucket_events=150, samples=2)
    pairs, sent, buckets, _ = pitman_yor.predicted(df, s)
    total, seen, rare = collections.Counter(), collections.Counter(), set()
    for r in pairs.collect():
        b = pitman_yor._Pairs.unpacked(r.part)
        for context, p in zip(b.contexts[b.context].tolist(), b.p.tolist()):
            total[context] += 10 ** p
            seen[context] += 1
        rare |= set(b.contexts[b.hot_context < 0].tolist())
    whole = [c for c in total if seen[c] == 14]
    assert buckets > 3 and len(whole) == 12 and len(sent.value) <= 4 and rare & set(whole)
    assert all(abs(total[c] - 1) < 1e-5 for c in whole)


def test_sweeps_move_repeated_pairs_only():
    """A pair seen once has one table whatever is drawn; it counts, but doesn't travel."""
    part = [np.array([1, 2, 3], np.uint64), np.array([2, 2, 1]), np.array([5, 6, 7], np.uint64), np.array([0, 1, 1, 2, 0]),
            np.array([1, 3, 0, 2, 1])]
    b = pitman_yor._Pairs([part], np.array([6], np.uint64))
    drawn = pitman_yor._Seated.unpacked(pitman_yor._Seated(b).packed())
    assert drawn.count.tolist() == [3, 2] and drawn.tables.tolist() == [1, 1] and drawn.cuts.tolist() == [0, 2]
    assert drawn.t_word().tolist() == [2, 1] and drawn.rare.tolist() == [7]


def test_frequent_words_travel_as_places():
    """Coded hashes come back whole and in order; frequent ones take two bytes at most."""
    rng = np.random.default_rng(3)
    frequent = np.sort(rng.integers(1, 1 << 63, 60_000).astype(np.uint64))
    hashes = np.unique(np.concatenate((rng.choice(frequent, 5000), rng.integers(1, 1 << 63, 700).astype(np.uint64))))
    for some in (hashes, hashes[:0], frequent[:1], frequent[-1:]):
        steps, others = coded = pitman_yor._coded(some, pitman_yor._places(some, frequent))
        assert steps.itemsize <= 2 and len(others) <= 700
        assert np.array_equal(pitman_yor._hashes(coded, frequent), some)


def test_scores_do_not_read_texts_again(spark):
    """Documents' pairs lie in the buckets with their documents: what is left to do in the end is adding up sums."""
    df = spark.createDataFrame([(i, i % 3 > 0, f"w{i % 7} w{i % 5} " * (i + 1)) for i in range(40)], "doc_id long, train boolean, text string")
    out = pitman_yor.scored(df, pitman_yor.Settings(contexts=4, bucket_events=300))
    assert "text" not in out._jdf.queryExecution().toString()
    assert sorted((r.doc_id, r.n_tokens) for r in out.collect()) == [(i, 2 * i + 3) for i in range(40)]


def test_every_context_has_its_own_restaurant(spark):
    """More contexts than are broadcast, each with one successor that nothing else has."""
    train = [(i, True, " ".join(f"a{i + k} b{i + k}" for k in range(0, 1200, 60))) for i in range(60) for _ in range(9)]
    probes = [(5000, False, " ".join(f"a{k} b{k}" for k in range(0, 600, 7))), (5001, False, " ".join(f"a{k} b{k + 1}" for k in range(0, 600, 7)))]
    df = spark.createDataFrame(train + probes, "doc_id long, train boolean, text string")
    rows = {r.doc_id: r.score for r in pitman_yor.scored(df, pitman_yor.Settings(contexts=16)).collect()}
    # the documents differ in P(b | a): near 1 where a was followed by b alone, small where never; the same in a shared restaurant
    assert rows[5000] - rows[5001] > 86 * 3


def test_scores_of_odd_rows(spark):
    df = spark.createDataFrame([(1, True, None), (2, False, ""), (None, True, "x y"), (3, True, "w " * 200_000), (3, True, "w")],
                               "doc_id long, train boolean, text string")
    rows = pitman_yor.scored(df).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 2, 3, 200_001]
    assert all(math.isfinite(r.score) for r in rows)
    assert pitman_yor.scored(df.limit(0)).count() == 0
    nothing = pitman_yor.scored(df.where("not train")).collect()
    assert [r.train_tokens for r in nothing] == [0]


# --- pipeline -------------------------------------------------------------------

def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minmax_dedup", "pii", "mixing", "bpe"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        path = work_dir(spark, name)
        after.write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns
        ids, had = ({r.doc_id for r in x.select("doc_id").collect()} for x in (after, before))
        assert ids <= had and (ids == had if name in ("pii", "mixing") else True)
        before = after
    assert before.where("text rlike '[a-z]@[a-z]+[.]com'").count() == 0


def test_pipeline_query(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert "ids" not in out.columns and out.where("n_tokens = 0").count() == 0
    assert out.count() >= 100


def test_archive_grows_by_appends(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 200) for i in range(1, 5)], "page_id long, url string, html string")
    path = work_dir(spark, "warc-append")
    warc.archived(pages.where("page_id <= 2"), path)
    both = warc.archived(pages.where("page_id = 3"), path)
    assert sorted(r.page_id for r in both.collect()) == [1, 2, 3]
    assert sorted(r.page_id for r in warc.archived(pages.where("page_id = 4"), path).collect()) == [1, 2, 3, 4]


def test_verified_records_are_measured_not_quoted(spark):
    """Lengths and digests come from the payloads that are in the archive; the predicate reaches the reader."""
    pages = spark.createDataFrame([(1, "u", "a" * 2000), (2, "u", "a" * 2000), (3, "u", None), (4, "u", "short")],
                                  "page_id long, url string, html string")
    archive = warc.archived(pages)
    rows = {r.page_id: (r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.verified(archive).collect()}
    digest = lambda x: hashlib.sha1(x.encode()).hexdigest()
    assert rows == {1: ("revisit", 2000, digest("a" * 2000), 2), 2: ("response", 2000, digest("a" * 2000), None),
                    3: ("response", 0, digest(""), None), 4: ("response", 5, digest("short"), None)}
    plan = archive.where("record_type = 'response'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan


def test_warc_query_returns_revisits_once(spark, tmp_path):
    """Two predicates on one opened archive shared the last one's reader, so revisits came twice."""
    body = "<p>é" + "x" * 1200
    rows = [(1, "a", body), (2, None, body), (3, "c", body), (4, "d", "s"), (5, "e", "s"), (6, "f", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    sha1 = lambda x: hashlib.sha1((x or "").encode()).hexdigest()
    want = [(i, len((x or "").encode()), sha1(x), "revisit" if i < 3 else "response", 3 if i < 3 else None) for i, _, x in rows]
    assert sorted(tuple(r) for r in QUERIES["op9_warc"](spark, str(tmp_path)).collect()) == want
    archive = warc.archived(spark.read.parquet(f"{tmp_path}/pages.parquet"))
    assert archive.where("record_type = 'revisit'").count() == 2
    assert sorted(r.page_id for r in warc.verified(archive).collect()) == [1, 2, 3, 4, 5, 6]


def test_stages_keep_columns_of_any_name(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    for name in ("domain", "rate", "score", "predicted", "n_tokens", "posterior", "a.b", "_key", "component_id"):
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} "), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[c] == f"{c} {r.doc_id}" for c in ("domain", "rate", "score", "a.b", "_key", "component_id")), name
