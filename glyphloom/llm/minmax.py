"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct shingles of five words (A-Z lowered); with
fewer words, the whole sequence is the one shingle; without words the set is
empty and links with nothing. Two documents are linked if their sets' similarity
(intersection by union) reaches the threshold.

1. One pass over the texts makes a sketch of each: the size of its set, a 128-bit
   sum that stands for the set, and a signature that keeps both the minimum and
   the maximum of every permutation, so ``permutations`` evaluations give twice
   as many values.
2. Documents of equal sets form a class; only one of each goes on.
3. Signatures are cut into bands. In each bucket of equal bands every member is
   paired with one leader: the member whose bands are the most common overall,
   which in a group of edited copies is the original or one close to it. That is
   one pair a member, not all pairs of a bucket.
4. Pairs are confirmed on full sets; confirmed ones are joined into components.
5. Documents of buckets that still hold several components are gathered in
   clusters and compared in blocks of bounded size, on full sets and only across
   components; a block gives one link for each two components that it joins.

So no pair that shares a bucket is lost. At the threshold, four rows a band and
twenty bands miss a pair with probability (1 - 0.85^4)^20 = 4e-7. The bitmap that
tells which sets are needed has a fixed size; if it fills up, more sets travel,
none is lost.

Defined results: null text and blank text have an empty set, are their own
component and are kept; a row with a null id is its own class of null id and is
kept; rows of a repeated id have the same component if their texts are linked.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField

from glyphloom.llm.components import components
from glyphloom.llm.frames import appended, guarded, lean, slimmed
from glyphloom.llm.wordhash import mix, run_positions, runs, starts_of, word_slices
from glyphloom.session import written

_SLOTS = 1 << 24


@dataclass(frozen=True)
class Settings:
    """Similarity in hundredths; ``block`` and ``block_shingles`` bound the documents of a chunk and their sets."""

    hundredths: int = 85
    width: int = 5
    permutations: int = 40
    rows: int = 4
    block: int = 2048
    block_shingles: int = 1_000_000


def shingle_sets(column, width: int = 5):
    """Ascending distinct shingle hashes of each text."""
    for words in word_slices(column, lower=True):
        at, owner = run_positions(words.bounds, width)
        hashes, bounds = runs(words.hashes, width), starts_of(owner, len(words.bounds) - 1)
        hashes = hashes[at] if len(at) else np.zeros(0, np.uint64)
        for i, n in enumerate(np.diff(words.bounds)):
            if n >= width:
                own = np.sort(hashes[bounds[i]:bounds[i + 1]])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif n:
                yield runs(words.hashes[words.bounds[i]:words.bounds[i + 1]], int(n))
            else:
                yield hashes[:0]


def _signatures(sets: list[np.ndarray], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Minima and maxima of each set (0 for an empty one), and the set's two sums."""
    sizes = np.array([len(x) for x in sets])
    full = np.flatnonzero(sizes)
    values = np.zeros((len(sets), 2 * s.permutations), np.uint64)
    sums = np.zeros((len(sets), 2), np.uint64)
    if len(full):
        x = np.concatenate([sets[i] for i in full])
        starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        sums[full, 0] = np.add.reduceat(mix(x + np.uint64(0x51ED270B)), starts)
        sums[full, 1] = np.add.reduceat(mix(x ^ np.uint64(0xB5297A4D3F84D5B5)), starts)
        rng = np.random.Generator(np.random.PCG64(s.permutations))
        y = np.empty_like(x)
        for p, (a, b) in enumerate(rng.integers(0, 2**64, (s.permutations, 2), dtype=np.uint64)):
            np.multiply(x, a | np.uint64(1), out=y)
            y ^= b
            values[full, 2 * p] = np.minimum.reduceat(y, starts)
            values[full, 2 * p + 1] = np.maximum.reduceat(y, starts)
    return mix(values), sums


def sketches(docs: DataFrame, text: str = "text", s: Settings = Settings()) -> DataFrame:
    """``docs`` with ``n_shingles``, ``set_a``, ``set_b`` and ``bands`` (null for an empty set)."""
    bands = 2 * s.permutations // s.rows

    def compute(column):
        n, a, b, keys = [], [], [], []
        sets, size = [], 0
        todo = shingle_sets(column, s.width)
        while True:
            x = next(todo, None)
            if x is not None:
                sets.append(x)
                size += len(x)
            if sets and (x is None or size > 1 << 15):
                values, sums = _signatures(sets, s)
                n.extend(map(len, sets))
                a.append(sums[:, 0].view(np.int64))
                b.append(sums[:, 1].view(np.int64))
                rows = values[:, :bands * s.rows].reshape(len(sets), bands, s.rows)
                odd = np.arange(1, 2 * s.rows, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                seed = np.arange(bands, dtype=np.uint64)
                keys.append(mix((rows * odd).sum(axis=2) + mix(seed + np.uint64(1))).view(np.int64))
                sets, size = [], 0
            if x is None:
                break
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        flat = join([k.reshape(-1) for k in keys], np.int64)
        empty = np.append(np.array(n, np.int64) == 0, False)
        offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands, mask=empty)
        return [pa.array(n, pa.int64()), pa.array(join(a, np.int64)), pa.array(join(b, np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(flat))]

    fields = [StructField("n_shingles", LongType()), StructField("set_a", LongType()),
              StructField("set_b", LongType()), StructField("bands", ArrayType(LongType()))]
    return appended(docs, text, fields, compute)


def _slot(column: str):
    return F.xxhash64(column).bitwiseAND(F.lit(_SLOTS - 1))


def _sets_of(docs: DataFrame, ids: DataFrame, s: Settings) -> DataFrame:
    """(id, shingles) of the documents of ``ids`` and, rarely, of others; at least one row an id.

    ``ids`` goes out as a bitmap of 2 MB.
    """
    words = (ids.select(_slot("id").alias("slot")).groupBy((F.col("slot") / 64).cast("long").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).collect())
    bitmap = np.zeros(_SLOTS // 64, np.int64)
    for r in words:
        bitmap[r.word] = r.bits
    sent = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())
    width = s.width

    def run(batches):
        bits = np.unpackbits(np.frombuffer(sent.value, np.uint8), bitorder="little")
        for batch in batches:
            wanted = pa.array(bits[batch.column(1).to_numpy()].astype(bool))
            batch = batch.filter(wanted)
            sets = [x.view(np.int64) for x in shingle_sets(batch.column(2), width)]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "shingles"])

    return (docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), _slot("doc_id").alias("slot"), "text")
            .mapInArrow(lean(run), "id long, shingles array<long>"))


def confirmed(pairs: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) of document ids whose full sets reach the threshold."""
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = written(_sets_of(docs, ids, s), "sets")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    whole = pairs.join(right, "b").join(left, "a").withColumn("both", both)
    return (whole.where(100 * F.col("both") >= s.hundredths * (F.size("x") + F.size("y") - F.col("both")))
            .select("a", "b"))


def _close(a: str, b: str, s: Settings):
    return 100 * F.least(a, b) >= s.hundredths * F.greatest(a, b)


def _leader_pairs(members: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """One pair a member and bucket, the member and its leader, and the rows of ``members`` (key, id, n) in such buckets."""
    counts = written(members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "buckets")
    shared = written(members.join(counts, "key"), "shared")
    fame = written(shared.groupBy("id").agg(F.sum("m").alias("fame")), "fame")
    famed = shared.join(fame, "id")
    leaders = written(famed.groupBy("key").agg(
        F.max(F.struct("fame", (-F.col("id")).alias("low"), "n")).alias("top")), "leaders")
    pairs = (shared.join(leaders, "key")
             .select("id", "n", (-F.col("top.low")).alias("lead"), F.col("top.n").alias("lead_n"))
             .where(F.col("id") != F.col("lead")).where(_close("n", "lead_n", s)))
    return pairs.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct(), shared


def _comparer(s: Settings):
    """Links between the components of one block: one for each pair of components that it joins.

    Shingles that two documents of the block share become the bits of a row, so
    the sizes of all intersections with a document are a few vector operations.
    """
    def compare(group: pa.Table) -> pa.Table:
        ids, comp = group["id"].to_numpy(), group["component"].to_numpy()
        sets = group["shingles"].combine_chunks()
        size = sets.value_lengths().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(ids)), size)
        _, column, times = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = times > 1
        at = np.flatnonzero(shared[column])
        column, owner = (np.cumsum(shared) - 1)[column[at]], owner[at]
        rows = np.zeros((len(ids), (int(shared.sum()) + 63) // 64 * 8), np.uint8)
        np.bitwise_or.at(rows, (owner, column >> 3), (1 << (column & 7)).astype(np.uint8))
        rows = rows.view(np.uint64)
        _, comp, members = np.unique(comp, return_inverse=True, return_counts=True)
        joined = np.arange(len(members))
        links = []
        for i in np.flatnonzero(comp != members.argmax()):
            other = np.flatnonzero((joined[comp] != joined[comp[i]])
                                   & (100 * np.minimum(size, size[i]) >= s.hundredths * np.maximum(size, size[i])))
            both = np.bitwise_count(rows[other] & rows[i]).sum(axis=1, dtype=np.int64)
            for j in other[100 * both >= s.hundredths * (size[other] + size[i] - both)]:
                if joined[comp[i]] != joined[comp[j]]:
                    joined[joined == joined[comp[j]]] = joined[comp[i]]
                    links.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return compare


def _rest_links(shared: DataFrame, labels: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Links between components that still share a bucket.

    Documents that are linked through such buckets form a cluster; a cluster is
    dealt to chunks of bounded size, and every two chunks meet in one block.
    """
    members = written(shared.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "members")
    mixed = written(members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"),
                                               F.min("id").alias("least")).where("x <> y"), "mixed")
    rest = written(members.join(mixed.select("key", "least"), "key"), "rest")
    clusters = written(components(rest.where("id <> least").select("id", "least").distinct())
                       .withColumnRenamed("component", "cluster"), "clusters")
    rest = rest.groupBy("id").agg(F.first("n").alias("n"), F.first("component").alias("component")).join(clusters, "id")
    rest = written(rest, "rest")
    chunks = F.greatest(F.ceil(F.count("*") / s.block), F.ceil(F.sum("n") / s.block_shingles)).cast("int")
    sizes = written(rest.groupBy("cluster").agg(chunks.alias("chunks")), "sizes")
    sets = written(_sets_of(docs, rest.select("id"), s), "sets").dropDuplicates(["id"])
    dealt = rest.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id",
                          "component").join(sets, "id")
    return blocks.groupBy("cluster", "i", "j").applyInArrow(slimmed(_comparer(s)), "a long, b long")


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    return _labelled(docs, s).drop("key")


def _text_key() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def _labelled(docs: DataFrame, s: Settings) -> DataFrame:
    """``near_duplicates`` with a key of the text: rows may share an id and differ in their texts."""
    docs = docs.select("doc_id", "text")
    keyed = docs.withColumn("key", _text_key())
    sketch = written(sketches(keyed, "text", s).drop("text"), "sketches")
    classes = written(sketch.where("bands is not null and doc_id is not null").groupBy("set_a", "set_b")
                      .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"),
                           F.first("bands").alias("bands")), "classes")
    members = classes.select(F.explode("bands").alias("key"), "id", "n")
    pairs, shared = _leader_pairs(members, s)
    links = written(confirmed(pairs, docs, s), "links")
    labels = written(components(links), "labels")
    more = written(_rest_links(shared, labels, docs, s), "links")
    labels = components(links.unionByName(more))
    named = (classes.select("set_a", "set_b", "id").join(labels, "id", "left")
             .select("set_a", "set_b", F.coalesce("component", "id").alias("component_id")))
    found = (sketch.select("doc_id", "n_shingles", "set_a", "set_b", "key")
             .withColumn("set_a", F.when(F.col("n_shingles") > 0, F.col("set_a")))
             .join(written(named, "named"), ["set_a", "set_b"], "left"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "key")


def kept(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with one document of each component: its smallest id (every row with a null id stays).

    Rows that share an id are judged by their own texts.
    """
    gone = written(_labelled(docs, s).where("not kept").select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "gone")
    return guarded(docs, ["doc_id", "text"], lambda d: d.join(
        gone, (F.col("doc_id") == F.col("_id")) & (_text_key() == F.col("_key")), "left_anti"))
