"""Mixing to target weights with soft domain membership.

A classifier learnt on the labelled table says how likely each document belongs
to each domain; a document then counts towards every domain by that share.
Distributed projected-gradient least squares fits a nonnegative rate for each
document so that the expected tokens of the domains match their targets.

* Classifier: multinomial over hashed words (A-Z lowered), fitted on a bounded
  sample of labelled documents. Its mean log-likelihood a word is scaled by a
  temperature that is chosen on sampled documents not used for the counts, so
  posteriors stay soft.
* Rates start at 1. Each step is one aggregation to as many sums as domains; a
  document's next rate is its last one less the posterior-weighted gradient of
  the domains, projected to 0 and above. Rates are replayed from the short history
  of gradients, so no state is kept between steps and a lost executor loses none.

Defined results: a null or empty text has no tokens, the prior as posterior and a
rate like any other; labelled rows with a null id or domain don't teach; a
repeated label row counts once; without labelled rows there is one domain,
``all``, and every rate comes out the same; domains are those of the sample.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField

from glyphloom.llm.frames import appended, guarded
from glyphloom.llm.wordhash import PUNCTUATED, word_slices
from glyphloom.session import remove, work_dir, written, written_at

BITS = 16


@dataclass(frozen=True)
class Settings:
    """``rows`` bounds the labelled sample; targets are shares to the power ``tilt`` if none are given."""

    rows: int = 10_000
    tilt: float = 0.7
    steps: int = 30
    close: float = 1e-6


@dataclass
class Classifier:
    """Log-likelihoods of hashed words by domain (one row each), log priors and temperature."""

    domains: list
    words: np.ndarray
    priors: np.ndarray
    scale: float = 1.0


def sampled(docs: DataFrame, labels: DataFrame, domain: Column, rows: int) -> DataFrame:
    """(doc_id, text, domain) of at most ``rows`` labelled documents, those of the smallest id hashes.

    ``domain`` may use columns of both tables. The picked ids are few by the
    bound, so they are broadcast and the documents aren't shuffled.
    """
    picked = (labels.where("doc_id is not null").dropDuplicates(["doc_id"])
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    names = {c: f"_{c}" if c in docs.columns and c != "doc_id" else c for c in picked.columns}
    picked = picked.select(*(F.col(a).alias(b) for a, b in names.items()))
    both = docs.join(F.broadcast(picked), "doc_id")
    return both.select("doc_id", "text", domain.cast("string").alias("domain")).where("domain is not null")


def _counted(group: pa.Table) -> pa.Table:
    counts = np.zeros(1 << BITS)
    for words in word_slices(group["text"], lower=True, blanks=PUNCTUATED):
        counts += np.bincount((words.hashes >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    return pa.table({"domain": group["domain"].slice(0, 1), "n": pa.array([group.num_rows], pa.int64()),
                     "counts": pa.array([counts.astype(np.float32).tobytes()], pa.binary())})


def _means(column, classifier: Classifier) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and their mean log-likelihood under each domain."""
    sizes, sums = np.zeros(len(column)), np.zeros((len(column), len(classifier.domains)))
    for words in word_slices(column, lower=True, blanks=PUNCTUATED):
        at, owner = (words.hashes >> np.uint64(64 - BITS)).astype(np.int64), words.owner()
        lo, hi = words.rows
        sizes[lo:hi] = np.diff(words.bounds)
        for d, table in enumerate(classifier.words):
            sums[lo:hi, d] = np.bincount(owner, table[at], minlength=hi - lo)
    return sizes, sums / np.maximum(sizes, 1)[:, None]


def _posteriors(means: np.ndarray, priors: np.ndarray, scale: float) -> np.ndarray:
    logits = priors + scale * means
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    return p / p.sum(axis=1, keepdims=True)


def fit(sample: DataFrame) -> Classifier:
    """Classifier of a bounded table (doc_id, text, domain)."""
    path = work_dir(sample.sparkSession, "domains")
    sample = written_at(sample.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))), path)
    taught = sample.where("half = 0").drop("half")
    rows = (taught.groupBy("domain").applyInArrow(_counted, "domain string, n long, counts binary")
            .orderBy("domain").collect())
    if not rows:
        return Classifier(["all"], np.zeros((1, 1 << BITS)), np.zeros(1))
    counts = np.stack([np.frombuffer(r.counts, np.float32) for r in rows]).astype(float)
    background = (counts.sum(axis=0) + 1) / (counts.sum() + (1 << BITS))
    words = np.log((counts + 100 * background) / (counts.sum(axis=1, keepdims=True) + 100))
    priors = np.log(np.array([r.n for r in rows]) / sum(r.n for r in rows))
    classifier = Classifier([r.domain for r in rows], words, priors)
    sent = sample.sparkSession.sparkContext.broadcast(classifier)

    def means(column):
        return [pa.array(list(_means(column, sent.value)[1]), pa.list_(pa.float64()))]

    held = appended(sample.where("half = 1").select("domain", "text"), "text",
                    [StructField("means", ArrayType(DoubleType()))], means).select("domain", "means").collect()
    held = [(classifier.domains.index(r.domain), r.means) for r in held if r.domain in classifier.domains]
    if held:
        truth, values = np.array([h[0] for h in held]), np.array([h[1] for h in held])
        scales = 2.0 ** np.arange(-2, 11)
        fits = [np.log(_posteriors(values, priors, s)[np.arange(len(truth)), truth] + 1e-12).mean() for s in scales]
        classifier.scale = float(scales[int(np.argmax(fits))])
    remove(sample.sparkSession, path)
    return classifier


def member_shares(docs: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``domain`` (the likeliest) and ``posterior`` (by domain, in order)."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def compute(column):
        c = sent.value
        sizes, means = _means(column, c)
        p = _posteriors(means, c.priors, np.where(sizes > 0, c.scale, 0)[:, None])
        names = [c.domains[i] for i in p.argmax(axis=1)]
        return [pa.array(sizes.astype(np.int64)), pa.array(names, pa.string()), pa.array(list(p), pa.list_(pa.float64()))]

    fields = [StructField("n_tokens", LongType()), StructField("domain", StringType()),
              StructField("posterior", ArrayType(DoubleType()))]
    return appended(docs, text, fields, compute)


def _summed(shares: DataFrame, values) -> np.ndarray:
    """Sum over all rows of ``values(tokens, posteriors)``, a vector of fixed length."""
    def run(batches):
        total = None
        for batch in batches:
            p = batch.column(1)
            if len(p):
                part = values(batch.column(0).to_numpy(), p.flatten().to_numpy().reshape(len(p), -1))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], names=["at", "x"])

    rows = (shares.select(F.col("n_tokens").cast("double"), "posterior").mapInArrow(run, "at long, x double")
            .groupBy("at").agg(F.sum("x").alias("x")).collect())
    out = np.zeros(len(rows))
    for r in rows:
        out[r["at"]] = r.x
    return out


def _replayed(p: np.ndarray, moves: list[np.ndarray]) -> np.ndarray:
    rate = np.ones(len(p))
    for move in moves:
        rate = np.maximum(rate - p @ move, 0)
    return rate


def fitted_rates(shares: DataFrame, domains: list, targets: dict | None, s: Settings,
                 keep: bool = True) -> DataFrame:
    """``shares`` (n_tokens, posterior) with ``rate``.

    ``targets`` gives weights by domain. The mix is the same at any scale; with
    ``keep`` the scale is such that a pure member of the domain that is fullest for
    its weight has rate 1, so no document goes (unless a rate is fitted to 0). The gradient is taken in the metric of the domains'
    overlaps (a square matrix of as many rows as domains, one aggregation), in
    which a step without projection solves the least squares.
    """
    have = _summed(shares, lambda n, p: n @ p)
    moves: list[np.ndarray] = []
    if have.sum():
        weights = np.array([targets.get(d, 0.0) for d in domains]) if targets else (have / have.sum()) ** s.tilt
        weights = weights / weights.sum()
        wanted = weights * np.max(have[weights > 0] / weights[weights > 0])
        overlap = _summed(shares, lambda n, p: ((p * n[:, None]).T @ p).ravel()).reshape(len(domains), -1)
        overlap += np.eye(len(domains)) * 1e-9 * overlap.trace()
        while len(moves) < s.steps and np.abs(have - wanted).max() > s.close * wanted.sum():
            moves.append(np.linalg.solve(overlap, have - wanted))
            have = _summed(shares, lambda n, p: (n * _replayed(p, moves)) @ p)

    least = _replayed(np.eye(len(domains)), moves).min() if keep else 1.0
    least = least if least > 0 else 1.0

    def compute(column):
        p = column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, len(domains)))
        return [pa.array(_replayed(p, moves) / least)]

    return appended(shares, "posterior", [StructField("rate", DoubleType())], compute).select(
        *(c for c in shares.columns if c != "rate"), "rate")


def mixed(docs: DataFrame, labels: DataFrame, domain: Column | None = None, targets: dict | None = None,
          keep_text: bool = False, s: Settings = Settings()) -> DataFrame:
    """``docs`` with ``n_tokens``, ``domain``, ``posterior`` and ``rate``; its text goes unless it is kept.

    The domain of a labelled document is by default its language.
    """
    domain = F.col("lang") if domain is None else domain
    classifier = fit(sampled(docs, labels, domain, s.rows))
    shares = member_shares(docs, classifier)
    shares = written(shares if keep_text else shares.drop("text"), "shares")
    return fitted_rates(shares, classifier.domains, targets, s)


def remixed(docs: DataFrame, labels: DataFrame, targets: dict | None = None, s: Settings = Settings()) -> DataFrame:
    """``docs``, each row as many times as its rate says: the whole part, and one more by the hash of its id.

    The expected tokens of the domains are then in the targets' proportions.
    """
    chance = (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) + 0.5) / (1 << 20)
    copies = F.floor(F.col("rate") + chance + 1e-9).cast("int")

    def copied(inner: DataFrame) -> DataFrame:
        rated = mixed(inner, labels, targets=targets, keep_text=True, s=s)
        return rated.withColumn("_copies", copies).where("_copies > 0").withColumn(
            "_copy", F.explode(F.sequence(F.lit(1), "_copies")))

    return guarded(docs, ["doc_id", "text", "lang"], copied)
