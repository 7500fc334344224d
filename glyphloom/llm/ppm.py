"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to ``order`` bytes long, learnt from a
bounded sample of its documents. In a context, a byte that followed it c times gets
c / (T + D), T being the context's count and D the number of different bytes after it;
the escape D / (T + D) is left to all other bytes and is shared out by the context
shorter by one byte, from which the bytes already seen are excluded. At the end
stands the uniform distribution over the 256 bytes. Every context's probabilities
thus add up to one, and -log2 of their product is an exact code length. Statistics are
frozen: a text's own bytes change nothing while it is scored.

The language with the shortest code wins. The score is its share of probability
when the code lengths a byte are those of ``evidence`` bytes (or of the text, if it is
shorter), because bytes of a text are far from independent.

Counting is a Spark job: tasks pack contexts with their next byte into integers
and count them before the shuffle. The model, looked up by every scan task, holds
at most ``cells`` probabilities; if trees are larger, their deepest level is left out
as often as it takes, so its size doesn't grow with the corpus. Texts are scored
whole, in one pass without a shuffle, a block of bytes at a time.

Defined results: a null text, and one without a letter, is ``und`` with a score of 0;
so is every text if nothing could be learnt. Rows with a null language, or null id,
don't train. Equal code lengths go to the language that comes first bytewise.
Repeated rows train as often as they are there, within the sample's bound. Other columns stay as
they are; those that bear the name of a new one are replaced.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from glyphloom.llm.frames import appended, quoted, small_batches
from glyphloom.llm.wordhash import columns_bytes
from glyphloom.session import written

BLOCK = 1 << 16


@dataclass(frozen=True)
class Settings:
    """``rows`` bounds the sample of each language, ``cells`` the probabilities of all languages' trees."""

    order: int = 4
    rows: int = 2000
    cells: int = 1 << 23
    evidence: int = 64


def sample(docs: DataFrame, label: str, rows: int, usable: Column) -> DataFrame:
    """(label, text) of at most ``rows`` documents of each label, those of the smallest hashes.

    Counts of labels choose a threshold of the hash under which about ``rows`` remain; only
    ids below it are ranked, so a label that has a third of all rows is cut where it lies.
    """
    key = F.xxhash64("doc_id", "text")
    usable = usable & quoted(label).isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    rated = docs.where(usable).select(quoted(label).alias("label"), "text", key.alias("_key"))
    # Written, so that its size is known before the texts meet it: a row per label.
    counts = written(docs.where(usable).groupBy(quoted(label).alias("_of")).agg(F.count("*").alias("_n")), "labels")
    share = F.least(F.lit(1.0), F.lit(1.2 * rows + 100) / F.col("_n"))
    below = rated.join(counts, F.col("label") == F.col("_of")).where(
        F.col("_key") <= (share * 2.0 ** 64 - 2.0 ** 63))
    first = Window.partitionBy("label").orderBy("_key")
    return (below.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= rows)
            .select("label", "text"))


def _grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte, itself in the low bits and the ``order`` bytes before it above; those before a text's start are 0."""
    grams = data.astype(np.uint64)
    depth = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order + 1):
        before = np.zeros(len(data), np.uint64)
        before[k:] = data[:-k] if k < len(data) else 0
        before[depth < k] = 0
        grams |= before << np.uint64(8 * k)
    return grams


def _counted(order: int):
    """Counts of each label's grams, batch by batch."""

    def run(batches):
        for batch in batches:
            labels = batch.column("label").dictionary_encode()
            for code, label in enumerate(labels.dictionary.to_pylist()):
                texts = batch.column("text").filter(pa.compute.equal(labels.indices, code))
                offsets, data = columns_bytes(texts)
                data = data[offsets[0]:offsets[-1]]
                grams, counts = np.unique(_grams(data, offsets - offsets[0], order), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts)],
                    names=["label", "gram", "n"])

    return run


@dataclass
class Model:
    """Languages, and for each context length the grams with every language's log2 probabilities.

    ``seen[k]`` are ascending grams of a context of k bytes and the byte after it, ``logs[k]``
    their probabilities (a row per gram, NaN where a language hasn't seen it). ``contexts[k]``
    and ``escapes[k]`` are the same for contexts of k bytes: what an unseen byte's
    probability under the shorter context is multiplied by, 0 for an unseen context.
    """

    languages: list[str]
    seen: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    @property
    def order(self) -> int:
        return len(self.seen) - 1

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text (rows) under each language (columns), the bytes before a text being zeros."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        grams = None
        for lo in range(0, len(data), BLOCK):
            hi, start = min(lo + BLOCK, len(data)), max(lo - self.order, 0)
            part = np.clip(offsets, start, hi) - start
            grams = _grams(data[start:hi], part, self.order)[lo - start:]
            first = int(np.searchsorted(offsets, lo, "right")) - 1
            last = int(np.searchsorted(offsets, hi, "left"))
            owner = np.repeat(np.arange(first, last), np.diff(np.clip(offsets[first:last + 1], lo, hi)))
            distinct, inverse = np.unique(grams, return_inverse=True)
            bits = self.bits(distinct)
            for k in range(len(self.languages)):
                out[:, k] += np.bincount(owner, bits[inverse, k], len(out))
        return out

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """-log2 of each gram's last byte after its context, for each language."""
        total = np.zeros((len(grams), len(self.languages)))
        open_ = np.ones(total.shape, bool)
        for k in range(self.order, -1, -1):
            known = grams & np.uint64((1 << 8 * (k + 1)) - 1)
            logs = _rows(self.seen[k], self.logs[k], known, np.nan)
            here = open_ & ~np.isnan(logs)
            total[here] -= logs[here]
            open_ &= ~here
            escapes = _rows(self.contexts[k], self.escapes[k], known >> np.uint64(8), 0.0)
            total[open_] -= escapes[open_]
        return total + 8 * open_


def _rows(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), otherwise)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], otherwise)


def _level(grams: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of a context of k bytes, out of longer ones, and their counts per language."""
    short, inverse = np.unique(grams & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
    out = np.zeros((len(short), counts.shape[1]))
    np.add.at(out, inverse, counts)
    return short, out


def model_of(languages: list[str], grams: np.ndarray, counts: np.ndarray, cells: int) -> Model:
    """Frozen trees from the counts (a column per language) of the longest grams."""
    order, levels, size = 0, [], 0
    while True:
        level = _level(grams, counts, order)
        size += 2 * level[1].size
        if levels and (size > cells or len(levels) == 8):
            break
        levels.append(level)
        order += 1
        if len(level[0]) == len(grams) and np.array_equal(level[0], grams):
            break
    model = Model(languages, [], [], [], [])
    for k, (keys, n) in enumerate(levels):
        contexts, inverse = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, kinds = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
        np.add.at(total, inverse, n)
        np.add.at(kinds, inverse, n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = n / (total + kinds)[inverse]
            escape = kinds / (total + kinds)
        # what the shorter context gives to the bytes seen here is excluded from what it shares out
        below = np.zeros_like(total)
        if k:
            at = np.searchsorted(model.seen[k - 1], keys & np.uint64((1 << 8 * k) - 1))
            shorter = np.where(n > 0, np.exp2(np.nan_to_num(model.logs[k - 1][at].astype(float), nan=-np.inf)), 0.0)
        else:
            shorter = np.where(n > 0, 1 / 256, 0.0)
        np.add.at(below, inverse, shorter)
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(kinds > 0, np.log2(escape) - np.log2(1 - below), 0.0)
            logs = np.where(n > 0, np.log2(p), np.nan)
        model.seen.append(keys)
        model.logs.append(logs.astype(np.float32))
        model.contexts.append(contexts)
        model.escapes.append(left.astype(np.float32))
    return model


def fit(rows: DataFrame, s: Settings = Settings()) -> Model | None:
    """Model of the sampled (label, text) rows; None if there are none.

    Grams that are to reach the driver are counted first: the longest contexts whose
    grams fit in ``cells`` are taken, so the driver never holds more than the model.
    """
    small_batches(rows.sparkSession)
    held = written(rows.select("label", "text"), "language-sample")
    grams = written(held.mapInArrow(_counted(s.order), "label string, gram long, n long")
                    .groupBy("label", "gram").agg(F.sum("n").alias("n")), "grams")
    languages = sorted((r.label for r in grams.select("label").distinct().collect()), key=str.encode)
    if not languages:
        return None
    for order in range(s.order, -1, -1):
        short = F.col("gram").bitwiseAND((1 << 8 * (order + 1)) - 1)
        level = grams.groupBy(short.alias("gram"), "label").agg(F.sum("n").alias("n"))
        if order == 0 or level.select("gram").distinct().count() * len(languages) * 2 <= s.cells:
            break
    table = level.toArrow()
    keys, inverse = np.unique(table.column("gram").to_numpy().astype(np.uint64), return_inverse=True)
    place = {name: i for i, name in enumerate(languages)}
    counts = np.zeros((len(keys), len(languages)))
    counts[inverse, [place[x] for x in table.column("label").to_pylist()]] = table.column("n").to_numpy()
    return model_of(languages, keys, counts, s.cells)


def identified(docs: DataFrame, model: Model | None, column: str = "text", s: Settings = Settings()) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``bits``, the best code length a byte."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    lettered = docs.withColumn("_letters", F.coalesce(quoted(column).rlike("\\p{L}"), F.lit(False)))
    lettered = lettered.withColumn("_scored", F.when(F.col("_letters"), quoted(column)))
    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits", DoubleType())]

    def compute(texts: pa.Array) -> list[pa.Array]:
        model = held.value
        offsets, data = columns_bytes(texts)
        known = ~texts.is_null().to_numpy(zero_copy_only=False)
        if model is None or not len(texts):
            return [pa.array(["und"] * len(texts), pa.string()), pa.array(np.zeros(len(texts))),
                    pa.array([None] * len(texts), pa.float64())]
        sizes = np.diff(offsets)
        lengths = model.code_lengths(data[offsets[0]:offsets[-1]], offsets - offsets[0])
        best = lengths.argmin(1)
        least = lengths.min(1)
        damped = (lengths - least[:, None]) * (np.minimum(sizes, s.evidence) / np.maximum(sizes, 1))[:, None]
        score = np.where(known, 1 / np.exp2(-damped).sum(1), 0.0)
        names = [model.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())]
        return [pa.array(names, pa.string()), pa.array(score), pa.array(least / np.maximum(sizes, 1), mask=~known)]

    return appended(lettered, "_scored", fields, compute).drop("_letters", "_scored")
