"""Exact removal of repeated word passages with suffix automata.

A window is ``width`` consecutive words of a document. A window whose words also
start earlier (in a document of smaller id, or earlier in the same one) is
repeated, and every word it covers goes. Suffix automata find the repeats: a text
is streamed through the automaton of what came before, and where the matching
statistic reaches ``width`` a repeated window ends.

``matched`` is the plain form for a bounded reference: automata of reference
shards are broadcast one after the other and all documents stream through them.

``repeated`` takes the corpus as its own reference. Its automata would be as large
as the corpus and every document would have to stream through each of them, so
shards are cut by content instead, such that equal windows lie in one shard:

1. A window's anchor is the smallest hash of its 5-word grams. Neighbouring
   windows that share one anchor form a segment. Windows are equal only if their
   anchors are, so segments whose anchor occurs once are done with.
2. Segments of equal words are grouped; all occurrences but the first are
   repeated throughout.
3. First occurrences that share an anchor with different segments make a shard:
   they stream, in order, through the suffix automaton of those before them.
   An anchor with very many segments is taken apart into windows, which are
   grouped by their words like segments in step 2.

Anchors and positions that matter go out as bitmaps of fixed size; a full bitmap
lets more segments travel and loses none. Words are compared by 64-bit hashes,
segments by two of them.

Defined results: null and blank texts have no words; a row with a null id is left
whole and is no reference; rows that share an id and a start are one position,
neither is earlier; texts of fewer than ``width`` words are left whole.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from glyphloom.llm.frames import appended, quoted, small_batches
from glyphloom.llm.wordhash import mix, run_positions, runs, word_slices
from glyphloom.session import written

GRAM = 5
_ANCHOR_BITS = 26
_HOT_BITS = 20


@dataclass(frozen=True)
class Settings:
    """``shard`` bounds the segments that one automaton takes in."""

    width: int = 20
    shard: int = 2048


class Automaton:
    """Suffix automaton of several word sequences, grown one sequence at a time."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c, q: int) -> int:
        """A copy of state q for the shorter strings that end as p's do."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, words: list) -> None:
        last = 0
        for c in words:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
                continue
            new = self._state(self.length[last] + 1, {}, 0)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p != -1:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            last = new

    def ends(self, words: list, width: int) -> list[int]:
        """Positions at which a match of at least ``width`` words ends."""
        state = size = 0
        out = []
        for i, c in enumerate(words):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            to = self.next[state].get(c)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            if size >= width:
                out.append(i)
        return out


def _stretches(starts: list[int]) -> list[tuple[int, int]]:
    """(first, count) of runs of consecutive numbers."""
    out = []
    for s in starts:
        if out and out[-1][0] + out[-1][1] == s:
            out[-1][1] += 1
        else:
            out.append([s, 1])
    return [tuple(x) for x in out]


# --- segments -----------------------------------------------------------------

def _segments(words, width: int):
    """Segments of a slice: text, first window (word place in the slice), windows, anchor, identity."""
    at, owner = run_positions(words.bounds, width)
    none = np.zeros(0, np.int64)
    if not len(at):
        return owner, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64)
    grams, whole = runs(words.hashes, GRAM), runs(words.hashes, width)
    span = width - GRAM + 1
    low, have = grams, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    low = low[at]
    fresh = np.ones(len(at), bool)
    same = owner[1:] == owner[:-1]
    # the anchor moves if its value changes or if the word it stood on has been left behind
    fresh[1:] = ~same | (low[1:] != low[:-1]) | (grams[at[:-1]] == low[:-1])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(at)))
    head, tail = whole[at[first]], whole[at[first + count - 1]]
    identity = mix(head + mix(tail ^ (count.astype(np.uint64) << np.uint64(32))))
    return owner[first], at[first], count, low[first], identity, whole


def _position(identity: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bit of a segment's occurrence."""
    x = mix(docs.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + starts.astype(np.uint64))
    return (mix(identity ^ x) & np.uint64((1 << _ANCHOR_BITS) - 1)).astype(np.int32)


def _bitmap(bits: DataFrame, size: int) -> bytes:
    """Bitmap of 2**size bits with those of column ``bit`` set."""
    words = (bits.groupBy(F.shiftright("bit", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow())
    out = np.zeros(1 << (size - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.tobytes()


def _set_bits(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _anchor_bit(anchor: np.ndarray, size: int) -> np.ndarray:
    return (anchor & np.uint64((1 << size) - 1)).astype(np.int64)


def _slices(batch, width):
    """(ids, words, text, first, count, anchor, identity, window hashes, start in its text) by slice."""
    ids = batch.column(0).to_numpy()
    for words in word_slices(batch.column(1)):
        owner, first, count, anchor, identity, whole = _segments(words, width)
        yield ids[words.rows[0]:words.rows[1]][owner], words, first, count, anchor, identity, whole, first - words.bounds[owner]


def _anchor_counter(width):
    def run(batches):
        for batch in batches:
            found = [s[4] for s in _slices(batch, width)]
            anchor, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    return run


def _occurrences(sent, width):
    def run(batches):
        bitmap = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            for ids, _, first, count, anchor, identity, _, start in _slices(batch, width):
                on = np.flatnonzero(_set_bits(bitmap, _anchor_bit(anchor, _ANCHOR_BITS)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[on].view(np.int64)), pa.array(identity[on].view(np.int64)), pa.array(ids[on]),
                     pa.array(start[on].astype(np.int32)), pa.array(count[on].astype(np.int16)),
                     pa.array(_position(identity[on], ids[on], start[on]))],
                    names=["anchor", "identity", "doc_id", "start", "n", "bit"])

    return run


def _first_ones(sent, hot, width, of_hot):
    """Segments of the marked positions: with their words, or those of hot anchors as windows."""
    def run(batches):
        bitmap, hot_bits = np.frombuffer(sent.value, np.uint8), np.frombuffer(hot.value, np.uint8)
        for batch in batches:
            for ids, words, first, count, anchor, identity, whole, start in _slices(batch, width):
                on = _set_bits(bitmap, _position(identity, ids, start))
                on = np.flatnonzero(on & (_set_bits(hot_bits, _anchor_bit(anchor, _HOT_BITS)) == of_hot))
                if of_hot:
                    rep = np.repeat(on, count[on])
                    shift = np.arange(len(rep)) - np.repeat(np.cumsum(count[on]) - count[on], count[on])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[rep].view(np.int64)), pa.array(whole[first[rep] + shift].view(np.int64)),
                         pa.array(ids[rep]), pa.array((start[rep] + shift).astype(np.int32))],
                        names=["anchor", "identity", "doc_id", "start"])
                else:
                    texts = [words.hashes[a:a + c + width - 1].tobytes() for a, c in zip(first[on], count[on])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[on].view(np.int64)), pa.array(ids[on]), pa.array(start[on].astype(np.int32)),
                         pa.array(texts, pa.binary())], names=["anchor", "doc_id", "start", "words"])

    return run


def _streamed(width):
    """Rows sorted by anchor and position, through one automaton an anchor."""
    def run(batches):
        # Rows of one place (repeated rows) are all matched before any of them is added: none of them is earlier.
        anchor = automaton = place = None
        waiting = set()
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)))
            docs, starts, counts = [], [], []
            for own, doc, start, text in rows:
                words = np.frombuffer(text, np.uint64).tolist()
                if place != (own, doc, start):
                    if own != anchor:
                        anchor, automaton = own, Automaton()
                    else:
                        for held in sorted(waiting):
                            automaton.add(np.frombuffer(held, np.uint64).tolist())
                    place, waiting = (own, doc, start), set()
                for first, n in _stretches([start + e - width + 1 for e in automaton.ends(words, width)]):
                    docs.append(doc)
                    starts.append(first)
                    counts.append(n)
                waiting.add(text)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int32()),
                                              pa.array(counts, pa.int32())], names=["doc_id", "start", "n"])

    return run


def _later(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """Occurrences that aren't the first of their group."""
    both = rows.join(firsts.select("anchor", "identity", F.col("first.doc_id").alias("d"), F.col("first.start").alias("s")),
                     ["anchor", "identity"])
    return both.where("doc_id <> d or start <> s")


def repeated(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, start, n): stretches of n repeated windows from word ``start`` of a document on."""
    spark, width = docs.sparkSession, s.width
    small_batches(spark)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = (texts.mapInArrow(_anchor_counter(width), "anchor long, n long")
              .groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"))
    mask = F.lit((1 << _ANCHOR_BITS) - 1)
    sent = spark.sparkContext.broadcast(_bitmap(counts.select(F.col("anchor").bitwiseAND(mask).alias("bit")), _ANCHOR_BITS))
    found = written(texts.mapInArrow(
        _occurrences(sent, width), "anchor long, identity long, doc_id long, start int, n smallint, bit int"), "segments")
    firsts = written(found.groupBy("anchor", "identity").agg(
        F.min(F.struct("doc_id", "start", "bit")).alias("first"), F.count("*").alias("times")), "firsts")
    whole = _later(found.drop("bit"), firsts.where("times > 1")).select("doc_id", "start", F.col("n").cast("int").alias("n"))

    shared = written(firsts.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "anchors")
    hot_ones = shared.where(F.col("kinds") > s.shard)
    some_hot = hot_ones.count() > 0
    bits = firsts.join(shared, "anchor", "left_semi").select(F.col("first.bit").cast("long").alias("bit"))
    marked = spark.sparkContext.broadcast(_bitmap(bits, _ANCHOR_BITS))
    hot = spark.sparkContext.broadcast(_bitmap(
        hot_ones.select(F.col("anchor").bitwiseAND(F.lit((1 << _HOT_BITS) - 1)).alias("bit")), _HOT_BITS))
    shards = texts.mapInArrow(_first_ones(marked, hot, width, False), "anchor long, doc_id long, start int, words binary")
    edges = (shards.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start")
             .mapInArrow(_streamed(width), "doc_id long, start int, n int"))
    stretches = whole.unionByName(edges)
    if some_hot:
        windows = written(texts.mapInArrow(_first_ones(marked, hot, width, True),
                                           "anchor long, identity long, doc_id long, start int"), "windows")
        lowest = written(windows.groupBy("anchor", "identity").agg(
            F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("times")).where("times > 1"), "windows")
        stretches = stretches.unionByName(_later(windows, lowest).select("doc_id", "start", F.lit(1).alias("n")))
    return stretches


def matched(docs: DataFrame, reference: DataFrame, s: Settings = Settings(), shard_words: int = 200_000) -> DataFrame:
    """(doc_id, start, n) of windows that also occur in ``reference`` (text), by broadcast automata.

    The reference is cut into shards of about ``shard_words`` words, cuts
    overlapping by a window, and each shard is broadcast and streamed by itself;
    meant for references of bounded size.
    """
    width, out = s.width, None
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards, size = [[]], 0
    for row in reference.select("text").toLocalIterator():
        for words in word_slices(pa.array([row.text], pa.string())):
            hashes = words.hashes
            for lo in range(0, max(len(hashes) - width + 1, 0), shard_words):
                part = hashes[lo:lo + shard_words + width - 1]
                if size and size + len(part) > shard_words:
                    shards.append([])
                    size = 0
                shards[-1].append(part)
                size += len(part)
    for shard in shards:
        sent = texts.sparkSession.sparkContext.broadcast(shard)
        found = texts.mapInArrow(_through(sent, width), "doc_id long, start int, n int")
        out = found if out is None else out.unionByName(found)
    return out


def _through(sent, width):
    def run(batches):
        automaton = Automaton()
        for part in sent.value:
            automaton.add(part.tolist())
        for batch in batches:
            docs, starts, counts = [], [], []
            for words in word_slices(batch.column(1)):
                for i, doc in enumerate(batch.column(0).to_pylist()[words.rows[0]:words.rows[1]]):
                    own = words.hashes[words.bounds[i]:words.bounds[i + 1]].tolist()
                    for first, n in _stretches([e - width + 1 for e in automaton.ends(own, width)]):
                        docs.append(doc)
                        starts.append(first)
                        counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int32()),
                                              pa.array(counts, pa.int32())], names=["doc_id", "start", "n"])

    return run


# --- removal ------------------------------------------------------------------

def _kept(words, i: int, spans, width: int) -> tuple[int, int, bytes]:
    """(words, removed words, the others joined by one space) of text i of a slice."""
    lo, hi = words.bounds[i], words.bounds[i + 1]
    gone = np.zeros(hi - lo + 1, np.int32)
    for start, n in spans:
        gone[start] += 1
        gone[start + n + width - 1] -= 1
    stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0) + lo
    text = b" ".join(words.text(words.starts[j], words.ends[j]) for j in stay)
    return int(hi - lo), int(hi - lo - len(stay)), text


def removed(docs: DataFrame, stretches: DataFrame, width: int = 20) -> DataFrame:
    """``docs`` (doc_id, text, ...) with its text reduced to the kept words, ``n_words`` and ``n_removed``.

    Only documents that may have stretches are shuffled to meet them.
    """
    spans = written(stretches.groupBy(F.col("doc_id").alias("_id")).agg(
        F.sort_array(F.collect_set(F.struct("start", "n"))).alias("_spans")), "spans")
    bit = F.xxhash64(quoted("doc_id").cast("long")).bitwiseAND(F.lit((1 << 24) - 1))
    sent = docs.sparkSession.sparkContext.broadcast(
        _bitmap(spans.select(F.xxhash64("_id").bitwiseAND(F.lit((1 << 24) - 1)).alias("bit")), 24))

    def with_spans(batches):
        bitmap = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(_set_bits(bitmap, batch.column(batch.num_columns - 1).to_numpy()))],
                names=[*batch.schema.names[:-1], "_may"])

    # All columns travel under numbers; whatever their names are, they clash with nothing here.
    place = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    doc, text = place["doc_id"], place["text"]
    base = docs.select(*(quoted(c).alias(n) for c, n in place.items()), F.coalesce(bit, F.lit(0)).alias("_bit"))
    schema = StructType([*base.schema.fields[:-1], StructField("_may", BooleanType())])
    flagged = base.mapInArrow(with_spans, schema)
    empty = F.lit(None).cast("array<struct<start:int,n:int>>")
    plain = flagged.where("not _may").drop("_may").withColumn("_spans", empty)
    met = flagged.where("_may").drop("_may").join(spans, F.col(doc).cast("long") == F.col("_id"), "left").drop("_id")
    both = plain.unionByName(met).withColumn("_both", F.struct(F.col(text).alias("text"), F.col("_spans").alias("spans")))

    def compute(column):
        total, gone, texts = [], [], []
        lists = column.field("spans").to_pylist()
        for words in word_slices(column.field("text")):
            for i in range(words.rows[1] - words.rows[0]):
                spans = [(x["start"], x["n"]) for x in lists[words.rows[0] + i] or ()]
                n, less, kept = _kept(words, i, spans, width)
                total.append(n)
                gone.append(less)
                texts.append(kept.decode())
        return [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())]

    new = {"n_words": "_total", "n_removed": "_gone", "text": "_kept"}
    fields = [StructField("_total", LongType()), StructField("_gone", LongType()), StructField("_kept", StringType())]
    done = appended(both.drop(text, "_spans"), "_both", fields, compute)
    return done.select(*(F.col(n).alias(c) for c, n in place.items() if c not in new), *(F.col(n).alias(c) for c, n in new.items()))


def deduplicated(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` without the words that repeated windows cover; see ``removed``."""
    return removed(docs, repeated(docs, s), s.width)


