"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are maximal runs of letters, digits and non-ASCII bytes, A-Z lowered.
A text's features are the distinct hashes of its words, of its word pairs and
of its pairs with one word left out; each present feature has the value 1.

Training keeps, per coordinate, the sums ``z`` and ``n`` of follow-the-
regularized-leader. A bounded sample of labelled rows is dealt to a fixed number
of shards; every shard starts from the common state and goes through its rows one by
one, some times over, then each coordinate's changes are averaged over the shards
that touched it, and so on from there. No coordinate of the sample is left out, only L1 makes weights
sparse. Only the states of the bounded sample's coordinates meet on the driver. L1
leaves few weights other than zero; they are broadcast and every text of the corpus
is scored in one pass without a shuffle.

Defined results: a null or empty text has no features and gets the score of the
bias; rows with a null label or null id don't train; a repeated label row counts
once, with its largest label; without labelled rows, or with one label only, the
score is that of the bias learnt so far (0 if nothing could be learnt); very long texts are
hashed whole, in slices.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from glyphloom.llm.frames import appended, passing_shuffles, records_a_batch, slim, slimmed
from glyphloom.llm.wordhash import PUNCTUATED, mix, runs, word_slices
from glyphloom.session import remove, work_dir, written_at


@dataclass(frozen=True)
class Settings:
    """``rows`` bounds the labelled sample and so what reaches the driver.

    Shards go through their rows ``epochs`` times, and between that exchange their
    changes ``exchanges`` times: an exchange moves every coordinate of the sample.
    """

    rows: int = 20_000
    shards: int = 6
    epochs: int = 10
    exchanges: int = 5
    bits: int = 22
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0


@dataclass
class Model:
    """Weights other than zero, and the bias."""

    bits: int
    coordinates: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -35.0


def _features(words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, coordinate) of every n-gram and skip-gram occurrence of a slice."""
    h, owner = words.hashes, words.owner()
    shift = np.uint64(64 - bits)
    texts, coordinates = [owner], [h >> shift]
    if len(h) > 1:
        same = owner[1:] == owner[:-1]
        texts.append(owner[:-1][same])
        coordinates.append(runs(h, 2)[same] >> shift)
    if len(h) > 2:
        same = owner[2:] == owner[:-2]
        skips = mix(h[:-2] * np.uint64(0xA24BAED4963EE407) + h[2:] * np.uint64(0x9FB21C651E98DF25))
        texts.append(owner[:-2][same])
        coordinates.append(skips[same] >> shift)
    return np.concatenate(texts), np.concatenate(coordinates).astype(np.int64)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def features(column, bits: int) -> list[bytes]:
    """Distinct coordinates of each text as 32-bit integers."""
    out = []
    for words in word_slices(column, lower=True, blanks=PUNCTUATED):
        n = words.rows[1] - words.rows[0]
        texts, coordinates = _features(words, bits)
        keys = _distinct((texts.astype(np.int64) << bits) | coordinates)
        bounds = np.searchsorted(keys, np.arange(n + 1, dtype=np.int64) << bits)
        keys = (keys & ((1 << bits) - 1)).astype(np.int32)
        out.extend(keys[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:]))
    return out


class _State:
    """z and n of some coordinates, the last one being the bias, which isn't shrunk."""

    def __init__(self, s: Settings, z: np.ndarray, n: np.ndarray):
        self.s, self.z, self.n = s, z, n

    def weights(self, at: np.ndarray) -> np.ndarray:
        s, z = self.s, self.z[at]
        bias = at == len(self.z) - 1
        shrunk = np.where(bias, z, np.sign(z) * np.maximum(np.abs(z) - s.l1, 0))
        return -shrunk / ((s.beta + np.sqrt(self.n[at])) / s.alpha + np.where(bias, 0, s.l2))

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g


def _lookup(keys: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values of ``at`` in a map of ascending keys, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(at))
    place = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
    return np.where(keys[place] == at, values[place], 0.0)


def _packed(at: np.ndarray, z: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending coordinates with their z and n, losslessly in some three bytes each.

    Coordinates of the same texts have the same z and n, so these are few different
    pairs; and most coordinates are less than 255 above the one before.
    """
    pairs = z.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | n.astype(np.float32).view(np.uint32)
    kinds, codes = np.unique(pairs, return_inverse=True)
    codes = codes.astype(np.uint16 if len(kinds) <= 1 << 16 else np.uint32)
    gaps = np.diff(at, prepend=0)
    far = gaps[gaps >= 255].astype(np.int32)
    head = np.array([len(at), len(kinds), codes.itemsize, len(far)], np.int32)
    return b"".join(x.tobytes() for x in (head, kinds, codes, far, np.minimum(gaps, 255).astype(np.uint8)))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size, kinds, width, far = np.frombuffer(blob, np.int32, 4)
    pairs = np.frombuffer(blob, np.uint64, kinds, 16)
    at = 16 + 8 * kinds
    codes = np.frombuffer(blob, np.uint16 if width == 2 else np.uint32, size, at)
    at += width * size
    gaps = np.frombuffer(blob, np.uint8, size, at + 4 * far).astype(np.int32)
    gaps[gaps == 255] = np.frombuffer(blob, np.int32, far, at)
    z, n = ((pairs >> np.uint64(s)).astype(np.uint32).view(np.float32)[codes] for s in (32, 0))
    return np.cumsum(gaps, dtype=np.int32), z, n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int,
                    usable: Column | None = None) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents, those of the smallest id hashes.

    The sampled ids are few by that bound, so they are broadcast and the
    documents aren't shuffled.
    """
    picked = (labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("label"))
              .where(F.col("_id").isNotNull() & F.col("label").isNotNull() & (F.lit(True) if usable is None else usable))
              .groupBy("_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("_id"), "_id").limit(rows))
    return (docs.select("doc_id", "text")
            .join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label"))


#: Changes are averaged in so many ranges of coordinates (and that of the bias), so that only averages reach the driver.
_RANGE_BITS = 4
#: Fixed value: the step that stands for a farther one.
_FAR = (1 << 16) - 1
_PACKED = "shard int, labels binary, lengths binary, features binary, far binary, coordinates binary, beyond binary"


class _Rows:
    """Ascending places of each text of a shard, kept as steps of two bytes; steps too far for that are kept apart."""

    def __init__(self, lengths: np.ndarray, steps: np.ndarray, far: np.ndarray):
        self.steps, self.far, self.bounds = steps, far, np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        self.at = np.flatnonzero(steps == _FAR)
        self.of = np.searchsorted(self.at, self.bounds)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        lo, hi = self.bounds[i:i + 2]
        steps = self.steps[lo:hi].astype(np.int64)
        some = slice(self.of[i], self.of[i + 1])
        steps[self.at[some] - lo] = self.far[some]
        return np.cumsum(steps)


def _steps(rows) -> tuple[np.ndarray, np.ndarray]:
    """Steps of texts with ascending places, and those that are too far for two bytes."""
    steps, far = [], []
    for places in rows:
        gaps = np.diff(places, prepend=0)
        far.append(gaps[gaps >= _FAR].astype(np.int32))
        steps.append(np.minimum(gaps, _FAR).astype(np.uint16))
    return np.concatenate(steps), np.concatenate(far)


def _blob(values: np.ndarray) -> pa.Array:
    """One binary value of the bytes of an array, which aren't copied."""
    ends = pa.py_buffer(np.array([0, values.nbytes], np.int32))
    return pa.Array.from_buffers(pa.binary(), 1, [None, ends, pa.py_buffer(np.ascontiguousarray(values))])


def _included(rows: list[np.ndarray], bits: int) -> np.ndarray:
    """Ascending coordinates of all texts of a shard, told by a flag each: they aren't sorted together."""
    present = np.zeros(1 << bits, bool)
    for r in rows:
        present[r] = True
    return np.flatnonzero(present).astype(np.int32)


def _packer(s: Settings):
    """One row of a shard: the coordinates it includes, and each text's places among them."""

    def pack(group: pa.Table) -> pa.Table:
        order = np.argsort(group["doc_id"].to_numpy(), kind="stable")
        labels, shard = group["label"].to_numpy()[order].astype(np.float64), group["shard"][0].as_py()
        rows = [np.frombuffer(x, np.int32) for x in features(group["text"], s.bits)]
        rows = [rows[i] for i in order]
        found = _included(rows, s.bits)
        lengths = np.array([len(r) for r in rows], np.int32)
        # a text at a time: places of all at once take several times the memory
        inside, far = _steps(np.searchsorted(found, r) for r in rows)
        arrays = [pa.array([shard], pa.int32()), *map(_blob, (labels, lengths, inside, far, *_steps([found])))]
        return pa.table(arrays, names=["shard", "labels", "lengths", "features", "far", "coordinates", "beyond"])

    return slimmed(pack)


def _looked_up(state: dict[int, bytes], at: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """z and n of ascending coordinates, a range at a time."""
    out = np.zeros((2, len(at)), np.float32)
    cuts = np.searchsorted(at, np.arange((1 << _RANGE_BITS) + 2, dtype=np.int32) << (s.bits - _RANGE_BITS))
    for i, blob in state.items():
        lo, hi = cuts[i], cuts[i + 1]
        keys, *values = _unpacked(blob)
        for row, x in zip(out, values):
            row[lo:hi] = _lookup(keys, x, at[lo:hi])
    return out[0], out[1]


def _epochs(common, epochs: range, s: Settings):
    """From the common state through each shard's rows, as often as there are ``epochs``, to the changes of its coordinates."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                shard = batch.column("shard")[k].as_py()
                labels, lengths, steps, far, *coordinates = (
                    np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in (
                        ("labels", np.float64), ("lengths", np.int32), ("features", np.uint16),
                        ("far", np.int32), ("coordinates", np.uint16), ("beyond", np.int32)))
                at = np.append(_Rows(np.array([len(coordinates[0])]), *coordinates)[0].astype(np.int32), np.int32(1 << s.bits))
                rows = _Rows(lengths, steps, far)
                z, n = _looked_up(common.value, at, s)
                own = _State(s, z.astype(float), n.astype(float))
                for epoch in epochs:
                    for i in np.random.default_rng([epoch, shard]).permutation(len(rows)):
                        own.learn(np.append(rows[i], len(at) - 1), labels[i])
                del rows, steps, far
                cuts = np.searchsorted(at, np.arange((1 << _RANGE_BITS) + 2, dtype=np.int32) << (s.bits - _RANGE_BITS))
                for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
                    some = lo + np.flatnonzero(own.n[lo:hi] != n[lo:hi])  # a range at a time, like all that is as long as the state
                    blob = _packed(at[some].astype(np.int64), own.z[some] - z[some], own.n[some] - n[some])
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([shard], pa.int32()),
                                                      pa.array([blob], pa.binary())], names=["range", "shard", "state"])
                del own, z, n, at, coordinates
                slim()

    return run


def _averaged(group: pa.Table) -> pa.Table:
    """Changes of a range of coordinates, averaged over the shards that touched each."""
    parts = [_unpacked(r["state"]) for r in sorted(group.to_pylist(), key=lambda r: r["shard"])]
    a, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    touched = np.maximum(np.bincount(place, minlength=len(a)), 1)
    z, n = (np.bincount(place, np.concatenate([p[k] for p in parts]), len(a)) / touched for k in (1, 2))
    return pa.table({"range": group["range"][:1].cast(pa.int32()), "state": pa.array([_packed(a.astype(np.int64), z, n)], pa.binary())})


def _moved(state: bytes, change: bytes) -> bytes:
    """The state of a range after its changes."""
    (a, *old), (b, *new) = _unpacked(state), _unpacked(change)
    every = np.union1d(a, b)
    out = np.zeros((2, len(every)), np.float32)
    for row, x, dx in zip(out, old, new):
        row[np.searchsorted(every, a)] = x
        row[np.searchsorted(every, b)] += dx
    return _packed(every.astype(np.int64), *out)


def fit(sample: DataFrame, settings: Settings = Settings()) -> Model:
    """Model of a bounded table (doc_id, text, label), learnt shard by shard and averaged at each exchange."""
    s, spark = settings, sample.sparkSession
    dealt = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(s.shards)).cast("int")
    state: dict[int, bytes] = {}    # of each range, packed
    steps = np.linspace(0, s.epochs, s.exchanges + 1).round().astype(int).tolist()
    path = work_dir(spark, "labelled")
    with passing_shuffles(spark):
        rows = written_at(sample.withColumn("shard", dealt).select("shard", "doc_id", "text", "label")
                       .groupBy("shard").applyInArrow(_packer(s), _PACKED), path, "uncompressed")
        for some in map(range, steps, steps[1:]):
            common = spark.sparkContext.broadcast(state)
            changes = rows.mapInArrow(_epochs(common, some, s), "range int, shard int, state binary")
            with records_a_batch(spark, 1):
                parts = changes.groupBy("range").applyInArrow(slimmed(_averaged), "range int, state binary").toArrow()
            common.destroy()
            for i, change in zip(parts["range"].to_pylist(), parts["state"]):
                state[i] = _moved(state[i], change.as_py()) if i in state else change.as_py()
            del parts, common
            slim()  # the driver's memory counts as well
    remove(spark, path)
    last = 1 << _RANGE_BITS     # the range that holds the bias alone
    if last not in state:
        return Model(s.bits)
    coordinates, weights = [], []
    for i in sorted(state):
        at, z, n = _unpacked(state[i])
        # weights() takes the last coordinate for the bias, so other ranges get one more
        w = _State(s, z, n).weights(np.arange(len(z))) if i == last else _State(
            s, np.append(z, 0), np.append(n, 0)).weights(np.arange(len(z)))
        kept = np.flatnonzero(w)
        coordinates.append(at[kept].astype(np.int64))
        weights.append(w[kept])
        bias = float(w[-1])
    del state, at, z, n
    slim()
    return Model(s.bits, np.concatenate(coordinates[:-1] or [np.zeros(0, np.int64)]),
                 np.concatenate(weights[:-1] or [np.zeros(0)]), bias)


def _logits(column, model: Model, dense: np.ndarray) -> np.ndarray:
    out = np.full(len(column), model.bias)
    for words in word_slices(column, lower=True, blanks=PUNCTUATED):
        texts, coordinates = _features(words, model.bits)
        telling = np.flatnonzero(dense[coordinates])
        keys = _distinct((texts[telling].astype(np.int64) << model.bits) | coordinates[telling])
        n = words.rows[1] - words.rows[0]
        out[words.rows[0]:words.rows[1]] += np.bincount(
            keys >> model.bits, dense[keys & ((1 << model.bits) - 1)], minlength=n)
    return out


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from a score of 0.5 on)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compute(column):
        m = sent.value
        dense = np.zeros(1 << m.bits, np.float32)
        dense[m.coordinates] = m.weights
        p = 1 / (1 + np.exp(-np.clip(_logits(column, m, dense), -35, 35)))
        return [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

    return appended(docs, text, [StructField("score", DoubleType()), StructField("predicted", IntegerType())], compute)
