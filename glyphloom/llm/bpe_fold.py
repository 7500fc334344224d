"""Byte-level BPE encoding and decoding by a ranked vocabulary.

The merges are folded by Spark's higher-order functions: a distinct word is an
array of token ids, one a byte to begin with; each step of ``aggregate`` looks up
all new neighbouring pairs in a literal map (pairs by their left token, laid into one
array such that none overlap, the id being the rank) and merges the pair of the lowest rank wherever it occurs,
leftmost first. All its occurrences merge in one step only if no pair that comes
up on the way has a lower rank; else only the leftmost does, so the result is that
of merging one at a time.

1. Words of all texts are counted, each once a block of texts. Those frequent enough
   to fit in a budget of bytes are folded once each and broadcast.
2. A pass over the texts replaces broadcast words by ids, bytes being compared. Other
   words leave gaps and are folded in the row; so texts and ids are never shuffled
   or written.
3. Decoding concatenates the binary pieces of the ids.

Defined results: a null text is an empty one, without tokens; special tokens are
ordinary text; lone surrogates can't occur in Spark strings; a word of any
length takes as many steps as distinct ranks merge in it, each linear in it.
"""

import base64
import json
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from glyphloom.llm.frames import appended, lean, passing_shuffles, quoted, small_batches
from glyphloom.llm.pretokens import PATTERN, HashIndex, pretokens, sliced_hashes, spread
from glyphloom.session import remove, work_dir, written_at

HOT_BYTES = 64 << 20      # of broadcast words, their ids and their index
HOT_LETTERS = 4096        # bytes; longer words are never broadcast
_ENTRY = 36               # bytes of a broadcast word beside its letters and ids
SHORT = 64
_NONE = 1 << 30
_COUNTED = 1 << 20        # words of slices that are held before their counts are added up
_FILLED = 64              # rows whose ids are spread out at once
_TEXT, _RARE = "_text", "_rare"
_NUMBERS = ArrayType(IntegerType())
_BEGUN = [StructField("bytes", _NUMBERS), StructField("ranks", _NUMBERS)]


def rank_table(path: str) -> list[bytes]:
    """Pieces by rank, of a file of base64 pieces and ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    pieces = [b""] * (max(int(r) for _, r in pairs) + 1)
    for piece, rank in pairs:
        pieces[int(rank)] = base64.b64decode(piece)
    return pieces


def pair_map(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every way to cut a piece into two: the pair (a, b) lies at place ``shift[a] + b``, whose owner is a."""
    rank = {p: i for i, p in enumerate(pieces) if p}
    follow = {}
    for piece, i in rank.items():
        for cut in range(1, len(piece)):
            a, b = rank.get(piece[:cut]), rank.get(piece[cut:])
            if a is not None and b is not None:
                follow.setdefault(a, []).append((b, i))
    most, block = sum(map(len, follow.values())), 4096
    owner = np.full(most + len(pieces) + block, -1, np.int32)
    ids, shift, lone = np.zeros(len(owner), np.int32), np.zeros(len(pieces) + 1, np.int32), []
    for a, pairs in sorted(follow.items(), key=lambda f: -len(f[1])):
        b = np.array([x for x, _ in pairs])
        if len(b) == 1:
            lone.append((a, *pairs[0]))
            continue
        at = 0
        while True:
            if at + len(pieces) + block > len(owner):
                owner, ids = (np.append(x, np.full(len(x), none, np.int32)) for x, none in ((owner, -1), (ids, 0)))
            taken = np.zeros(block, bool)
            for x in b:
                taken |= owner[x + at:x + at + block] >= 0
            if not taken.all():
                break
            at += block
        at += int(np.argmin(taken))
        owner[b + at], ids[b + at], shift[a] = a, [i for _, i in pairs], at
    owner, ids = (np.append(x, np.full(len(lone), none, np.int32)) for x, none in ((owner, -1), (ids, 0)))
    free, k = np.flatnonzero(owner < 0), 0
    for a, b, i in sorted(lone, key=lambda one: one[1]):
        while free[k] < b:
            k += 1
        owner[free[k]], ids[free[k]], shift[a] = a, i, free[k] - b
        k += 1
    end = int(np.flatnonzero(owner >= 0).max(initial=-1)) + 1
    return shift, owner[:end], ids[:end]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _literal(pieces: list[bytes]) -> Column:
    parts = dict(zip(("shift", "owner", "ids"), (x.tolist() for x in pair_map(pieces))))
    return F.from_json(F.lit(json.dumps(parts, separators=(",", ":"))), ", ".join(f"{name} array<int>" for name in parts))


def _merged(t: Column, a: Column, b: Column) -> Column:
    """Id of the pair, or a number above all ids; the number of pieces stands for a token beyond the word's ends."""
    place = F.get(t["shift"], a) + b
    return F.when(F.get(t["owner"], place) == a, F.get(t["ids"], place)).otherwise(F.lit(_NONE))


def _places(count: Column) -> Column:
    return F.sequence(F.lit(0), count - 1)


def _step(t: Column, p: Column) -> Column:
    """(pieces, more) after the merges of the lowest rank."""
    ranks = F.transform(_places(F.size(p) - 1), lambda i: _merged(t, F.get(p, i), F.get(p, i + 1)))
    stop = F.struct(p.alias("p"), F.lit(False).alias("more"))

    def merge(r):
        def with_lowest(low):
            marks = F.array_join(F.transform(r, lambda x: F.when(x == low, "1").otherwise("0")), "")
            # of overlapping pairs the left one merges: of a run of marks, every other
            chosen = F.split(F.regexp_replace(marks, "11", "10"), "")

            def apply(c):
                rest = F.transform(_places(F.size(p)), lambda i: F.when(F.get(c, i) == "1", low).when(
                    (i > 0) & (F.get(c, i - 1) == "1"), F.lit(-1)).otherwise(F.get(p, i)))
                return F.struct(F.filter(rest, lambda x: x >= 0).alias("p"), F.lit(True).alias("more"))

            def safe(c):
                def odd(i):
                    before = F.when((i > 1) & (F.get(c, i - 2) == "1"), low).otherwise(F.get(p, i - 1))
                    left = (i > 0) & (_merged(t, before, low) < low)
                    right = (i + 2 < F.size(p)) & (_merged(t, low, F.get(p, i + 2)) < low)
                    return (F.get(c, i) == "1") & (left | right)

                once = F.transform(r, lambda x, i: F.when(i == F.array_position(r, low) - 1, "1").otherwise("0"))
                several = F.size(F.filter(c, lambda x: x == "1")) > 1
                return F.when(several & F.exists(_places(F.size(r)), odd), once).otherwise(c)

            return F.when(low == _NONE, stop).otherwise(_let(chosen, lambda c: _let(safe(c), apply)))

        return _let(F.array_min(r), with_lowest)

    return F.when(F.size(p) < 2, stop).otherwise(_let(ranks, merge))


def _single(t: Column, p: Column, r: Column) -> Column:
    """(pieces, ranks of neighbouring pairs) after the leftmost merge of the lowest rank, both with an end on each side."""
    rest = F.lit(1 << 30)

    def merge(low):
        def at(pos):
            pieces = F.concat(F.slice(p, F.lit(1), pos - 1), F.array(low), F.slice(p, pos + 2, rest))
            new = F.array(_merged(t, F.get(p, pos - 2), low), _merged(t, low, F.get(p, pos + 1)))
            ranks = F.concat(F.slice(r, F.lit(1), pos - 2), new, F.slice(r, pos + 2, rest))
            return F.struct(pieces.alias("p"), ranks.alias("r"))

        return F.when(low == _NONE, F.struct(p.alias("p"), F.array().cast("array<int>").alias("r"))).otherwise(
            _let(F.array_position(r, low).cast("int"), at))

    return _let(F.array_min(r), merge)


def folded(t: Column, ids: Column, ranks: Column) -> Column:
    """Ids of a word given as the ids of its bytes (never empty) and the ranks of their neighbouring pairs.

    Short words take one merge a step, which is cheapest for them; long ones take
    all merges of a rank a step, which keeps their number of steps small.
    """
    outside, none = F.array(F.size(t["shift"]) - 1), F.array(F.lit(_NONE))
    begun = F.struct(F.concat(outside, ids, outside).alias("p"), F.concat(none, ranks, none).alias("r"))
    short = F.aggregate(_places(F.size(ids)), begun, lambda s, _: F.when(F.size(s["r"]) > 0, _single(
        t, s["p"], s["r"])).otherwise(s), lambda s: F.slice(s["p"], F.lit(2), F.size(s["p"]) - 2))
    start = F.struct(ids.alias("p"), F.lit(True).alias("more"))
    long = F.aggregate(_places(F.size(ids)), start, lambda s, _: F.when(s["more"], _step(t, s["p"])).otherwise(s),
                       lambda s: s["p"])
    return F.when(F.size(ids) <= SHORT, short).otherwise(long)


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of binary values, and the bytes they lie in."""
    own = words.cast(pa.large_binary())
    offsets = np.frombuffer(own.buffers()[1], np.int64)[own.offset:own.offset + len(own) + 1] if len(own) else np.zeros(1, np.int64)
    raw = own.buffers()[2]
    return offsets, np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(1, np.uint8)


def _cut(words, at: np.ndarray) -> pa.Array:
    """Words of a slice as binary values."""
    size = words.ends[at] - words.starts[at]
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    letters = words.data[spread(words.starts[at], size)]
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes())])


def _added(held: list) -> pa.RecordBatch:
    _, at, own = np.unique(np.concatenate([h for h, _, _ in held]), return_index=True, return_inverse=True)
    n = np.bincount(own, np.concatenate([n for _, _, n in held]), len(at)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.concat_arrays([w for _, w, _ in held]).take(pa.array(at)), pa.array(n)], names=["word", "n"])


def _counted(batches):
    """(word, n) of short words; a slice at a time, so that memory stays small whatever a batch holds."""
    held, size = [], 0
    for batch in batches:
        for words in pretokens(batch.column(0)):
            hashes, at, n = np.unique(words.hashes, return_index=True, return_counts=True)
            short = words.ends[at] - words.starts[at] <= HOT_LETTERS
            held.append((hashes[short], _cut(words, at[short]), n[short]))
            size += len(at) + held[-1][1].nbytes // 64
            if size > _COUNTED:
                yield _added(held)
                held, size = [], 0
    if held:
        yield _added(held)


class _Known:
    """Index of the broadcast words, their letters, and all their ids with a gap behind them."""

    def __init__(self, words: pa.Table, narrow: np.dtype):
        own = words["word"].combine_chunks() if len(words) else pa.array([], pa.binary())
        offsets, data = _bytes(own)
        self.index = HashIndex(sliced_hashes(data, offsets[:-1], offsets[1:]))
        self.at, self.data = np.append(offsets, offsets[-1]).astype(np.int32), data
        ids = words["ids"].combine_chunks() if len(words) else pa.array([], pa.list_(pa.int32()))
        self.gap = np.iinfo(narrow).max
        self.flat = np.append(ids.flatten().to_numpy().astype(narrow), narrow.type(self.gap))
        self.starts = np.concatenate(([0], np.cumsum(np.append(ids.value_lengths().to_numpy(), 1)))).astype(np.int32)
        self.none = len(own)

    def places(self, words) -> np.ndarray:
        """Place of each word of a slice, bytes being compared."""
        place = self.index.find(words.hashes)
        size = words.ends - words.starts
        place[(place < 0) | (self.at[place + 1] - self.at[place] != size)] = self.none
        hit = np.flatnonzero(place != self.none)
        differ = words.data[spread(words.starts[hit], size[hit])] != self.data[spread(self.at[place[hit]], size[hit])]
        place[np.repeat(hit, size[hit])[differ]] = self.none
        return place

    def ids(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, and their bounds."""
        lengths = self.starts[place + 1] - self.starts[place]
        return self.flat[spread(self.starts[place], lengths)], np.concatenate(([0], np.cumsum(lengths)))


def _flat(rows: list, kind: np.dtype = np.dtype("<u4")) -> tuple[np.ndarray, np.ndarray]:
    """All ids of binary values, and the bounds of each one's; a null has none."""
    rows = [x or b"" for x in rows]
    bounds = np.concatenate(([0], np.cumsum([len(x) // kind.itemsize for x in rows]))).astype(np.int64)
    return np.frombuffer(b"".join(rows), kind), bounds


class Codec:
    """Encoder and decoder of one vocabulary; ``path`` names a rank file, ``pattern`` what splits text."""

    def __init__(self, path: str, pattern: str = PATTERN):
        if pattern != PATTERN:
            raise ValueError("texts can be split by the public byte-level pattern only")
        self.pieces = rank_table(path)
        self.narrow = np.dtype("<u2" if len(self.pieces) < 1 << 16 else "<u4")    # its largest number marks a gap
        of_byte = {p: i for i, p in enumerate(self.pieces) if len(p) == 1}
        self.of_byte = np.array([of_byte[bytes([b])] for b in range(256)], np.int32)
        self.of_pair = np.full(1 << 16, _NONE, np.int32)    # what two bytes merge to
        for i, piece in enumerate(self.pieces):
            if len(piece) == 2:
                self.of_pair[piece[0] << 8 | piece[1]] = i

    @cached_property
    def pairs(self) -> Column:
        return _literal(self.pieces)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "pairs"}    # tasks can't hold columns

    def _start(self, words: pa.Array) -> list[pa.Array]:
        """The ids of each word's bytes, and the ranks of neighbouring bytes."""
        starts, data = _bytes(words)
        offsets = (starts - starts[0]).astype(np.int32)
        data = data[starts[0]:starts[-1]].astype(np.int32)
        pairs = self.of_pair[data[:-1] << 8 | data[1:]] if len(data) else data
        inside = np.ones(len(pairs), bool)
        inside[offsets[1:-1] - 1] = False       # words are never empty
        fewer = offsets - np.arange(len(offsets), dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.of_byte[data])),
                pa.ListArray.from_arrays(pa.array(fewer), pa.array(pairs[inside]))]

    def counts(self, docs: DataFrame, text: str) -> DataFrame:
        """(word, n) of words short enough to be broadcast; a block of texts counts its words before they move."""
        small_batches(docs.sparkSession)
        partial = docs.select(quoted(text).alias("text")).mapInArrow(lean(_counted), "word binary, n long")
        return partial.groupBy("word").agg(F.sum("n").alias("n"))

    def folds(self, words: DataFrame) -> DataFrame:
        """(word, ids) of distinct words, each folded once."""
        begun = appended(words.select("word"), "word", _BEGUN, self._start)
        return begun.select("word", _let(self.pairs, lambda t: folded(t, F.col("bytes"), F.col("ranks"))).alias("ids"))

    def hot_words(self, docs: DataFrame, text: str, budget: int) -> pa.Table:
        """(word, ids) of the words that occur so often that all of them fit in ``budget`` bytes, folded.

        Sizes are added up by powers of two of the count; a word has at most as many ids as bytes.
        """
        spark = docs.sparkSession
        path = work_dir(spark, "words")
        with passing_shuffles(spark):
            counts = written_at(self.counts(docs, text), path)
        power, size = F.floor(F.log2("n")).cast("int"), F.sum((1 + self.narrow.itemsize) * F.octet_length("word") + _ENTRY)
        least, load = None, 0
        for step in sorted(counts.groupBy(power.alias("power")).agg(size.alias("size")).collect(), key=lambda r: -r.power):
            load += step["size"]
            if load > budget:
                break
            least = 2 ** step["power"]
        hot = counts.where(F.col("n") >= least) if least is not None else counts.limit(0)
        folded_words = self.folds(hot).toArrow()
        remove(spark, path)
        return folded_words

    def encoded(self, docs: DataFrame, text: str = "text", budget: int = HOT_BYTES, keep: bool = True,
                decode: str | None = None) -> DataFrame:
        """``docs`` with ``ids``: the tokens of each text as little-endian 32-bit integers; the text goes unless it is kept.

        With ``decode``, a column of that name has the bytes that ``decoded`` makes of them.
        """
        narrow, start, back = self.narrow, self._start, self._decoder() if decode else None
        sent = docs.sparkSession.sparkContext.broadcast(_Known(self.hot_words(docs, text, budget), narrow))

        def look_up(column):
            known = sent.value
            ids, rare, counts = [], [], []
            for words in pretokens(column):
                place = known.places(words)
                flat, bounds = known.ids(place)
                bounds = bounds[words.bounds]
                ids.extend(flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:]))
                missing = np.flatnonzero(place == known.none)
                counts.append(np.diff(np.searchsorted(missing, words.bounds)))
                rare.append(_cut(words, missing))
            outer = np.concatenate([[0], *counts]).cumsum().astype(np.int32)
            begun = pa.StructArray.from_arrays(start(pa.concat_arrays([*rare, pa.array([], pa.binary())])), ["bytes", "ranks"])
            return [pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(outer), begun)]

        source = docs.withColumn(_TEXT, quoted(text)) if keep else docs.select(
            *(quoted(c) for c in docs.columns if c != text), quoted(text).alias(_TEXT))
        looked = appended(source, _TEXT, [StructField("ids", BinaryType()), StructField(_RARE, ArrayType(StructType(_BEGUN)))],
                          look_up).drop(_TEXT)
        met = _let(self.pairs, lambda t: F.transform(_RARE, lambda w: folded(t, w["bytes"], w["ranks"])))
        gapped = looked.withColumn(_TEXT, F.struct("ids", met.alias("rare"))).drop(_RARE)
        gap = np.iinfo(narrow).max

        def fill(column):
            packed, rows, out, texts = column.field("ids"), column.field("rare"), [], []
            for at in range(0, len(packed), _FILLED):
                flat, bounds = _flat(packed.slice(at, _FILLED).to_pylist(), narrow)
                words = rows.slice(at, _FILLED).flatten()
                gaps = np.flatnonzero(flat == gap)
                own = words.value_lengths().to_numpy()
                sizes = np.ones(len(flat), np.int64)
                sizes[gaps] = own
                ends = np.cumsum(sizes)
                ids = np.repeat(flat.astype("<u4"), sizes)
                ids[spread((ends - sizes)[gaps], own)] = words.flatten().to_numpy()
                bounds = np.concatenate(([0], ends))[bounds]
                blobs = [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                out.extend(blobs)
                if back:
                    texts.extend(back(blobs))
            return [pa.array(out, pa.binary()), *([pa.array(texts, pa.binary())] if back else [])]

        fields = [StructField("ids", BinaryType()), *([StructField(decode, BinaryType())] if decode else [])]
        return appended(gapped, _TEXT, fields, fill).drop(_TEXT)

    def _decoder(self):
        """Function from ids, as binary values, to the bytes of their tokens."""
        pieces = self.pieces
        sizes = np.array([len(p) for p in pieces])
        starts, letters = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(pieces), np.uint8)

        def decode(rows):
            flat, bounds = _flat(rows)
            own = sizes[flat]
            text = letters[spread(starts[flat], own)]
            bounds = np.concatenate(([0], np.cumsum(own)))[bounds]
            return [text[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]

        return decode

    def decoded(self, encoded: DataFrame, ids: str = "ids", out: str = "decoded") -> DataFrame:
        """``encoded`` with the bytes of each row's tokens; an unknown id raises."""
        back = self._decoder()

        def compute(column):
            return [pa.array([x for at in range(0, len(column), _FILLED)
                              for x in back(column.slice(at, _FILLED).to_pylist())], pa.binary())]

        return appended(encoded, ids, [StructField(out, BinaryType())], compute)


def digests(encoded: DataFrame) -> DataFrame:
    """``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of rows with ``ids`` and ``decoded``."""
    return (encoded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
            .withColumn("ids_sha256", F.sha2("ids", 256)).withColumn("decoded_sha256", F.sha2("decoded", 256)))
