"""Language-model scores of a hierarchical Pitman-Yor model of word pairs.

Every context, that is every word of the corpus, has a restaurant of its own whose
customers are the words that follow it; a customer sits at a table of its word or
opens one, and each table sends a customer to the one parent restaurant that all
contexts share. The parent backs off to the uniform distribution over the known
words and one unknown.

Seating is sampled by Gibbs: given all other tables, the number of tables of a
word in a restaurant has a known distribution (generalized Stirling numbers times
powers of the weight of a new table), which is drawn from directly; large counts
seat their customers in order, a sixteenth of them at a time. A sweep draws all
pairs anew, given the tables of contexts and of words after the sweep before it (a
pair's own tables but the first are taken off). The first sweep starts from one
table a pair; predictive probabilities are averaged over the sweeps after ``burn``,
each with the sums of its own seating, so that those of a context sum to 1.

1. Words that are frequent somewhere are found from counts of blocks of documents.
   They only say how pairs are dealt and which sums are broadcast, not the results.
2. A pass turns texts into pairs (word, context) with the documents of each, by block,
   and deals them to buckets: by word, or by word and context for frequent words, so that
   no word makes a bucket of its own. A bucket becomes four rows of pairs and four of their
   documents in a written table; frequent words travel as places among themselves.
3. A pair seen once always has one table; so a sweep reads and writes pairs seen at
   least twice, with the tables of their words and contexts. Sums of at most
   ``contexts`` frequent words are added up in arrays and broadcast. A rarer word lies in
   one row; sums of rarer contexts that lie in several buckets meet by context and return. Seatings
   after ``burn`` are kept, and all pairs meet them and their sums once, in the end.
4. In the end each bucket adds up the probabilities of its documents' pairs, some of the
   buckets at a time, and documents add up what buckets say. Texts are not read again.

The number of buckets follows the number of tokens, so a bucket stays bounded.
Results are log10 probabilities.

Defined results: a null or empty text is one end token; a null id counts as
training data; with no training data everything is unknown and the model is
uniform over one symbol; repeated rows count as often as they occur.
"""

import pickle
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.llm.frames import passing_shuffles, slim, slimmed, small_batches
from glyphloom.llm.wordhash import mix, word_slices
from glyphloom.session import remove, work_dir, written, written_at

END = np.uint64(0x5BF0_3635_DCD6_F1A9)
_DOC_BITS, _TIMES_BITS = 12, 4
BLOCK_DOCS = 1 << _DOC_BITS
BLOCK_BYTES = 10 << 20
SUBS = 4
SMALL = 64
PART_PAIRS = 200_000
#: Documents are scored by so many shares of the buckets, one after the other: a share is all that is shuffled at once.
SHARES = 4


@dataclass(frozen=True)
class Settings:
    """``contexts`` bounds the words whose sums are broadcast."""

    contexts: int = 65_536
    burn: int = 8
    samples: int = 3
    strength: float = 1.0
    bucket_events: int = 2_000_000


# --- events -------------------------------------------------------------------

def _gathered(batches, most: int):
    """Tables of at most BLOCK_DOCS rows and, but for a longer text, ``most`` bytes of text."""
    held, docs, size = [], 0, 0
    for batch in batches:
        texts = batch.column(2).cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        at = 0
        while at < batch.num_rows:
            room = int(np.searchsorted(ends, ends[at] + most - size, "right")) - 1 - at
            n = min(room, BLOCK_DOCS - docs, batch.num_rows - at)
            if n <= 0 and held:
                yield pa.Table.from_batches(held)
                held, docs, size = [], 0, 0
                continue
            n = max(n, 1)
            held.append(batch.slice(at, n))
            docs, size, at = docs + n, size + int(ends[at + n] - ends[at]), at + n
    if held:
        yield pa.Table.from_batches(held)


def _tokens(part: pa.Table):
    hashes, owners, counts = [], [], []
    for words in word_slices(part.column(2), lower=True):
        bounds, n = words.bounds, len(words.bounds) - 1
        out = np.full(len(words.hashes) + n, END)
        out[np.arange(len(words.hashes)) + words.owner()] = words.hashes
        hashes.append(out)
        counts.append(np.diff(bounds))
        owners.append(np.repeat(np.arange(words.rows[0], words.rows[1], dtype=np.int32), np.diff(bounds) + 1))
    return (part.column(0), part.column(1).to_numpy().astype(bool), np.concatenate(counts),
            np.concatenate(hashes), np.concatenate(owners))


def _blocks(batches, most: int = BLOCK_BYTES):
    """(ids, training flags, words per document, hashes with an end after each document, document of each)."""
    return map(_tokens, _gathered(batches, most))  # no frame keeps a block's arrays while another works on them


def _frequent(docs: DataFrame, most: int) -> np.ndarray:
    """Ascending hashes of at most ``most`` words that repeat most in their blocks, the end among them."""
    def run(batches):
        for _, train, _, hashes, owner in _blocks(batches):
            word, n = np.unique(hashes[train[owner]], return_counts=True)
            word, n = word[n > 1], n[n > 1]
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    counts = written(docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
                     .where("n > 7"), "frequent")
    steps = (counts.groupBy(F.least("n", F.lit(1_000_000)).alias("n")).agg(F.count("*").alias("m"))
             .orderBy(F.desc("n")).toLocalIterator())
    total, least = 1, 1_000_001
    for step in steps:
        total += step.m
        if total > most:
            break
        least = step.n
    words = counts.where(F.col("n") >= least).select("word").toArrow()["word"].to_numpy().view(np.uint64)
    return np.union1d(words, np.array([END]))


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct hashes and the number of each: as numpy's unique, in half its memory."""
    order = np.argsort(hashes)
    hashes = hashes[order]
    new = np.append(True, hashes[1:] != hashes[:-1])[:len(hashes)]
    distinct, number = hashes[new], np.empty(len(order), np.int32)
    del hashes
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return distinct, number


def _coded(hashes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes as steps from place to place of frequent ones, and the others as they are."""
    return _narrow(np.diff(place[place >= 0], prepend=0)), hashes[place < 0]


def _hashes(coded: tuple[np.ndarray, np.ndarray], frequent: np.ndarray) -> np.ndarray:
    steps, others = coded
    return np.sort(np.concatenate((frequent[np.cumsum(steps, dtype=np.int64)], others)), kind="stable")


def _planes(values: np.ndarray) -> bytes:
    """32-bit integers by the place of their bytes, which are alike."""
    return values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _packed(sent, buckets: int):
    """Pairs of each block and row of a bucket with their documents, compressed.

    A part is (words, pairs of each, contexts, context of each pair, events of each pair,
    document and times of each event, number of documents, of which the first ones train,
    how many these are; ids and lengths in one part a block). Words and contexts are coded.
    """
    def run(batches):
        frequent = sent.value
        task, number = TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=1)
        numbers = buckets * SUBS
        for ids, train, counts, hashes, owner in _blocks(batches):
            docs, trained = len(train), int(train.sum())
            first_train = np.argsort(~train, kind="stable")
            ids, counts = ids.take(pa.array(first_train)), counts[first_train]
            rank = np.empty(docs, np.int64)
            rank[first_train] = np.arange(docs)
            word, token = _numbered(hashes)
            del hashes  # a block's arrays are large beside what comes of them
            start = np.searchsorted(word, END)  # a document begins after an end
            bits, extra = max(len(word) - 1, 1).bit_length(), max(docs - 1, 1).bit_length()
            place = _places(word, frequent)
            key = token.astype(np.int64)
            key <<= bits
            key[0] |= start
            key[1:] |= token[:-1]
            del token
            key <<= extra
            key |= rank[owner]
            del owner
            key.sort()
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            times = np.diff(np.append(first, len(key))).astype(np.int32)
            key = key[first]
            doc = (key & ((1 << extra) - 1)).astype(np.int32)
            key >>= extra
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key = key[first]
            own, context = (key >> bits).astype(np.int32), (key & ((1 << bits) - 1)).astype(np.int32)
            del key
            w = word[own]
            dealt = np.where(place[own] >= 0, mix(w ^ (word[context] * END)), w)
            row = ((dealt >> np.uint64(40)) % np.uint64(buckets) * np.uint64(SUBS)).astype(np.int32)
            row += ((dealt >> np.uint64(20)) & np.uint64(SUBS - 1)).astype(np.int32)
            del w, dealt
            most = 1 << _TIMES_BITS
            pieces = (times + most - 1) // most
            left = np.full(int(pieces.sum()), most, np.int32)
            left[np.cumsum(pieces) - 1] = times - (pieces - 1) * most
            event = ((np.repeat(doc, pieces) << _TIMES_BITS) | (left - 1)).astype(np.uint16)
            del left, times, doc
            size = np.add.reduceat(pieces, first)
            del pieces, first
            event = event[np.argsort(np.repeat(row, size), kind="stable")]
            bounds = np.append(0, np.cumsum(np.bincount(row, size, numbers))).astype(np.int64)
            order = np.argsort(row, kind="stable")
            cuts = np.searchsorted(row[order], np.arange(numbers + 1))
            block, out = (task << 32) | number, []
            home = int(mix(np.array([block], np.uint64))[0] % np.uint64(numbers))
            number += 1
            sent_rows = [b for b in range(numbers) if cuts[b] < cuts[b + 1] or b == home]
            for b in sent_rows:
                at = order[cuts[b]:cuts[b + 1]]
                mine = own[at]
                begin = np.flatnonzero(np.append(True, mine[1:] != mine[:-1])) if len(mine) else np.zeros(0, np.int64)
                runs = np.diff(np.append(begin, len(mine))).astype(np.uint32)
                contexts, which = np.unique(context[at], return_inverse=True)
                words = mine[begin]
                which = which.astype(np.uint16 if len(contexts) <= 1 << 16 else np.uint32)
                head = (ids.to_pylist(), counts.astype(np.int32)) if b == home else None
                part = [_coded(word[words], place[words]), _narrow(runs), _coded(word[contexts], place[contexts]), which,
                        _narrow(size[at]), event[bounds[b]:bounds[b + 1]], docs, trained, head]
                out.append(pack.compress(pickle.dumps(part)))
            sent_rows = np.array(sent_rows, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sent_rows // SUBS), pa.array(sent_rows % SUBS), pa.array(np.full(len(sent_rows), block)),
                 pa.array(out, pa.binary())], names=["bucket", "sub", "block", "part"])
            del own, context, row, event, order, out, word, place
            slim()

    return run


_PACKED = "bucket int, sub int, block long, part binary"


def _unpacked(blob):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _by_sub(group: pa.Table) -> dict[int, list]:
    """(block, blob) of each row of a bucket, by block."""
    out = {}
    for sub, block, blob in sorted(zip(*(group[n].to_pylist() for n in ("sub", "block", "part"))), key=lambda r: r[:2]):
        out.setdefault(sub, []).append((block, blob))
    return out


def _state(fields: dict) -> bytes:
    """Fields of pairs in order of word and context: words as runs, contexts by the place of their bytes, which are alike."""
    own = {"word": _narrow(np.bincount(fields["word"])), "context": _planes(fields["context"])}
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(fields | own))


def _stated(blob: bytes) -> dict:
    fields = _unpacked(blob)
    return fields | {"word": np.repeat(np.arange(len(fields["word"]), dtype=np.int32), fields["word"]),
                     "context": _from_planes(fields["context"])}


def _counts(part: list) -> np.ndarray:
    """Times that each pair of a part occurs in training documents."""
    size, event, _, trained = part[4:8]
    times = np.where(event >> _TIMES_BITS < trained, (event & ((1 << _TIMES_BITS) - 1)) + 1, 0)
    return np.bincount(np.repeat(np.arange(len(size)), size), times, len(size))


class _Events:
    """Documents of the pairs of a row, block by block: (block, place of each pair in the row, events of each, events,
    documents); ``heads`` has ids and lengths of blocks whose home is this row."""

    def __init__(self, blocks: list[int], parts: list, places: list[np.ndarray]):
        self.blocks, self.docs = np.array(blocks), np.array([p[6] for p in parts], np.int32)
        self.pairs, self.length = (np.array([len(p[i]) for p in parts], np.int32) for i in (4, 5))
        self.steps = np.concatenate([np.diff(x, prepend=0) for x in places])
        self.size, self.event = (np.concatenate([p[i] for p in parts]) for i in (4, 5))
        self.heads = {block: p[8] for block, p in zip(blocks, parts) if p[8]}

    def packed(self) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(self.__dict__ | {"steps": _planes(self.steps)}))

    @classmethod
    def unpacked(cls, blob: bytes) -> "_Events":
        e = cls.__new__(cls)
        e.__dict__.update(_unpacked(blob))
        e.steps = _from_planes(e.steps)
        return e

    def __iter__(self):
        pairs, events = (np.append(0, np.cumsum(x, dtype=np.int64)) for x in (self.pairs, self.length))
        for i, (block, docs) in enumerate(zip(self.blocks.tolist(), self.docs.tolist())):
            mine, own = slice(pairs[i], pairs[i + 1]), slice(events[i], events[i + 1])
            yield block, np.cumsum(self.steps[mine], dtype=np.int64), self.size[mine], self.event[own], docs


class _Pairs:
    """Distinct pairs of a row, in order of word and context, with counts, tables and summed predictions."""

    def __init__(self, parts: list, frequent: np.ndarray):
        self.words, self.contexts = (np.unique(np.concatenate([p[i] for p in parts])) for i in (0, 2))
        key = np.concatenate([self.keys(p) for p in parts])
        key, index = np.unique(key, return_inverse=True)
        self.word, self.context = (key >> 32).astype(np.int32), (key & 0xFFFF_FFFF).astype(np.int32)
        self.count = np.bincount(index, np.concatenate([p[4] for p in parts]), len(key)).astype(np.int64)
        self.tables = np.minimum(self.count, 1)
        self.p = np.zeros(len(key))
        self.hot_word, self.hot_context = _places(self.words, frequent), _places(self.contexts, frequent)

    def keys(self, part) -> np.ndarray:
        """Word and context of each pair of a part, as places in this row."""
        word, context = np.searchsorted(self.words, part[0]), np.searchsorted(self.contexts, part[2])
        return (np.repeat(word, part[1]) << 32) | context[part[3]]

    def packed(self) -> bytes:
        return _state(self.__dict__ | {"count": _narrow(self.count), "tables": _narrow(self.tables)})

    @classmethod
    def unpacked(cls, blob: bytes) -> "_Pairs":
        b = cls.__new__(cls)
        b.__dict__.update(_stated(blob))
        b.count, b.tables = b.count.astype(np.int64), b.tables.astype(np.int64)
        return b

    def unseated(self) -> bytes:
        """Pairs as they are before anything is drawn: what frequent words, counts and places say for themselves is left out."""
        return _state({"word": self.word, "context": self.context, "count": _narrow(self.count),
                       "words": _coded(self.words, self.hot_word), "contexts": _coded(self.contexts, self.hot_context)})

    @classmethod
    def seatable(cls, blob: bytes, frequent: np.ndarray) -> "_Pairs":
        b = cls.__new__(cls)
        b.__dict__.update(_stated(blob))
        b.words, b.contexts = _hashes(b.words, frequent), _hashes(b.contexts, frequent)
        b.hot_word, b.hot_context = _places(b.words, frequent), _places(b.contexts, frequent)
        b.count = b.count.astype(np.int64)
        b.tables, b.p = np.minimum(b.count, 1), np.zeros(len(b.count))
        return b

    def parts(self):
        """Stretches of pairs of whole words: (pairs, words) as slices."""
        ends = np.searchsorted(self.word, np.arange(len(self.words)), "right")
        at = word = 0
        while word < len(ends):
            to = max(int(np.searchsorted(ends, at + PART_PAIRS, "right")), word + 1)
            yield slice(at, int(ends[to - 1])), slice(word, to)
            at, word = int(ends[to - 1]), to


def _places(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Place of each hash among the frequent ones, or -1."""
    place = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    return np.where(frequent[place] == hashes, place, -1)


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


# --- seating ------------------------------------------------------------------

def stirling(d: float) -> np.ndarray:
    """Logarithms of generalized Stirling numbers: seatings of c customers at t tables, both up to SMALL."""
    s = np.zeros((SMALL + 1, SMALL + 1))
    s[1, 1] = 1
    t = np.arange(SMALL + 1)
    for c in range(1, SMALL):
        s[c + 1] = (c - d * t) * s[c]
        s[c + 1, 1:] += s[c, :-1]
    with np.errstate(divide="ignore"):
        return np.log(np.maximum(s, 0))


def seat(count: np.ndarray, fresh: np.ndarray, d: float, rng) -> np.ndarray:
    """Tables of each (word, restaurant): a draw given its customers and the weight of a new table."""
    tables = np.minimum(count, 1).astype(np.int64)
    logs, weight = stirling(d), np.log(np.maximum(fresh, 1e-300))
    order = np.argsort(count, kind="stable")
    cuts = np.searchsorted(count[order], np.arange(2, SMALL + 2))
    for c in range(2, SMALL + 1):
        for lo in range(cuts[c - 2], cuts[c - 1], 1 << 16):
            at = order[lo:min(lo + (1 << 16), cuts[c - 1])]
            p = logs[c, 1:c + 1] + np.outer(weight[at], np.arange(1, c + 1))
            p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
            tables[at] = 1 + (p < rng.random(len(at))[:, None] * p[:, -1:]).sum(axis=1)
    big = order[cuts[-1]:]
    done, total = np.ones(len(big), np.int64), count[big]
    while len(big) and (done < total).any():
        some = np.minimum(np.maximum(done // 16, 1), total - done)
        w = fresh[big]
        p = w / (done - d * tables[big] + w)
        tables[big] += rng.binomial(some, np.clip(p, 0, 1))
        done += some
    return tables


_SEATS = "kind int, bucket int, sub int, key long, c double, t double, part binary"
#: Kinds of rows of the table of seats: sums that no sweep changes and others, by frequent word and in all; customers and
#: tables by rarer context; pairs; tables of drawn pairs by rarer context, of contexts of several buckets and of one alone.
FIXED, DRAWN, RARE, PAIRS, SHARED, ALONE, SEATED, EVENTS = range(8)
#: Sums by frequent word are added up in so many ranges.
RANGES = 16


class _Seated:
    """Pairs of a row that are seen at least twice, with their tables.

    ``base`` has the tables of other pairs by rarer context, ``alone`` says which of these have drawn pairs in this bucket
    alone, ``kept`` has the tables of these pairs in each seating that counts.
    """

    def __init__(self, b: _Pairs):
        at = np.flatnonzero(b.count > 1)
        words, word = np.unique(b.word[at], return_inverse=True)
        contexts, context = np.unique(b.context[at], return_inverse=True)
        self.count, self.tables, self.base, self.alone, self.kept = b.count[at], b.tables[at], None, None, []
        self.word, self.context = word.astype(np.int32), context.astype(np.int32)
        self.hot_word, self.hot_context = b.hot_word[words], b.hot_context[contexts]
        self.rare = b.contexts[contexts[self.hot_context < 0]]
        self.words, self.once = words, np.bincount(b.word, b.count == 1, len(b.words)).astype(np.int64)[words]
        self.cuts = np.searchsorted(at, [0, *(pairs.stop for pairs, _ in b.parts())])

    def packed(self) -> bytes:
        narrow = {k: _narrow(getattr(self, k)) for k in ("count", "tables", "once")}
        return _state(self.__dict__ | narrow)

    @classmethod
    def unpacked(cls, blob: bytes) -> "_Seated":
        b = cls.__new__(cls)
        b.__dict__.update(_stated(blob))
        b.count, b.tables, b.once = (x.astype(np.int64) for x in (b.count, b.tables, b.once))
        return b

    def t_word(self) -> np.ndarray:
        """Tables of each word in this row, pairs seen once included."""
        return self.once + np.bincount(self.word, self.tables, len(self.once))


class _Frequent:
    """Customers and tables of frequent contexts, those of frequent words, and totals."""

    def __init__(self, size: int):
        self.sums = [*(np.zeros(size) for _ in range(4)), np.zeros(7)]

    def add(self, b, context: tuple, word: tuple) -> None:
        for place, pair, own in ((b.hot_context, self.sums[:2], context), (b.hot_word, self.sums[2:4], word)):
            at = place >= 0
            for total, values in zip(pair, own):
                total[place[at]] += values[at]

    def packed(self) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(pickle.dumps([_narrow(x.astype(np.int64)) for x in self.sums]))


def _added(batches):
    """Sums of the buckets that a task reads, by kind and range."""
    sums = {}
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("part")):
            own = _unpacked(blob.as_py())
            before = sums.setdefault(kind, [np.zeros(len(x)) for x in own])
            for total, values in zip(before, own):
                total += values
    rows = [(kind, i, pickle.dumps([np.array_split(x, RANGES)[i] for x in total])) for kind, total in sums.items() for i in range(RANGES)]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                      pa.array([r[2] for r in rows], pa.binary())], names=["kind", "range", "part"])


def _added_up(group: pa.Table) -> pa.Table:
    """Sums of a kind and range from those of all tasks."""
    total = None
    for blob in group["part"]:
        own = pickle.loads(blob.as_py())
        total = own if total is None else [a + b for a, b in zip(total, own)]
    return pa.table({"kind": group["kind"][:1], "range": group["range"][:1], "part": pa.array([pickle.dumps(total)], pa.binary())})


def _by_key(kind: int, parts: list) -> tuple:
    key, index = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    c, t = (np.bincount(index, np.concatenate([p[i] for p in parts]), len(key)) for i in (1, 2))
    return np.full(len(key), kind), key, c, t


def _seats(bucket: int, sums: list, blobs: list) -> pa.Table:
    """Rows of (kind, key, c, t), then of (kind, sub, blob)."""
    kind, key, c, t = (np.concatenate(x) for x in zip(*sums))
    n, zero = len(blobs), np.zeros(len(blobs))
    return pa.table({"kind": pa.array(np.append(kind, [k for k, _, _ in blobs]).astype(np.int32)),
                     "bucket": pa.array(np.full(len(kind) + n, bucket, np.int32)),
                     "sub": pa.array(np.append(np.zeros(len(kind)), [sub for _, sub, _ in blobs]).astype(np.int32)),
                     "key": pa.array(np.append(key, zero.astype(np.int64)).astype(np.int64)),
                     "c": pa.array(np.append(c, zero).astype(float)), "t": pa.array(np.append(t, zero).astype(float)),
                     "part": pa.array([None] * len(kind) + [blob for _, _, blob in blobs], pa.binary())})


def _drawn(rows: dict[int, _Seated], size: int, kept: bool = True) -> tuple[list, list]:
    """Tables of drawn pairs by rarer context, and as blobs by frequent context and word and in all, and the pairs.

    Those by contexts that lie in this bucket alone are only told where the seating is kept, for other pairs of theirs.
    """
    sums, parts, blobs = _Frequent(size), {SHARED: [], ALONE: []}, []
    for sub, b in rows.items():
        t_context, t_word = np.bincount(b.context, b.tables, len(b.hot_context)), np.bincount(b.word, b.tables, len(b.once))
        sums.add(b, (np.zeros(len(t_context)), t_context), (np.zeros(len(t_word)), t_word))
        own = b.t_word()[b.hot_word < 0]
        sums.sums[4][4:] += (own == 1).sum(), (own == 2).sum(), own.sum()
        t, alone = t_context[b.hot_context < 0], np.zeros(len(b.rare), bool) if b.alone is None else b.alone
        for kind, at in ((SHARED, ~alone), (ALONE, alone)):
            parts[kind].append((b.rare[at].view(np.int64), np.zeros(at.sum()), t[at]))
        blobs.append((SEATED, sub, b.packed()))
    blobs.append((DRAWN, 0, sums.packed()))
    return [_by_key(kind, parts[kind]) for kind in ([SHARED, ALONE] if kept else [SHARED])], blobs


def _alone(rows: dict[int, _Seated]) -> dict[int, np.ndarray]:
    """Tables of contexts that lie in this bucket alone, for each of its rows."""
    t = [np.bincount(b.context, b.tables, len(b.hot_context))[b.hot_context < 0][b.alone] for b in rows.values()]
    _, index = np.unique(np.concatenate([b.rare[b.alone] for b in rows.values()]), return_inverse=True)
    total = np.bincount(index, np.concatenate(t))[index]
    return dict(zip(rows, np.split(total, np.cumsum([len(x) for x in t])[:-1])))


def _first(sent):
    """Pairs of a bucket from those of all blocks, one table each, their documents, and what is known for good: customers,
    and tables of pairs seen once, by frequent context, frequent word, in all, and by rarer context."""
    def run(group: pa.Table) -> pa.Table:
        sums, rare, blobs, seated = _Frequent(len(sent.value)), [], [], {}
        for sub, blocks in _by_sub(group).items():
            parts = [_unpacked(blob) for _, blob in blocks]
            coded = [[_hashes(p[0], sent.value), p[1], _hashes(p[2], sent.value), p[3], _counts(p)] for p in parts]
            b = _Pairs(coded, sent.value)
            keys = (b.word.astype(np.int64) << 32) | b.context
            events = _Events([block for block, _ in blocks], parts, [np.searchsorted(keys, b.keys(p)) for p in coded])
            del parts, coded, keys
            blobs.append((EVENTS, sub, events.packed()))
            del events
            seated[sub] = drawn = _Seated(b)
            once = b.count == 1
            c_context, t_context = (np.bincount(b.context, v, len(b.contexts)) for v in (b.count, once))
            c_word, t_word = (np.bincount(b.word, v, len(b.words)) for v in (b.count, once))
            sums.add(b, (c_context, t_context), (c_word, t_word))
            at, own = b.hot_context < 0, (b.hot_word < 0) & (c_word > 0)
            rare.append((b.contexts[at].view(np.int64), c_context[at], t_context[at]))
            alone = own.copy()
            alone[drawn.words] = False
            sums.sums[4] += (own.sum(), once.sum(), (b.count == 2).sum(), c_context.sum(),
                             (t_word[alone] == 1).sum(), (t_word[alone] == 2).sum(), t_word[alone].sum())
            blobs.append((PAIRS, sub, b.unseated()))
        more, drawn = _drawn(seated, len(sent.value))
        return _seats(group["bucket"][0].as_py(), [_by_key(RARE, rare), *more], [*blobs, (FIXED, 0, sums.packed()), *drawn])

    return run


def _discount(ones, twos) -> float:
    return float(np.clip(ones / max(ones + 2 * twos, 1), 0.05, 0.95))


@dataclass
class _Sums:
    """What all tasks know: sums by frequent context and frequent word, sizes and discounts."""

    frequent: np.ndarray
    c_context: np.ndarray
    t_context: np.ndarray
    c_word: np.ndarray
    t_word: np.ndarray
    tokens: float
    words: float
    tables: float
    discount: float
    parent_discount: float


def _collected(seats: DataFrame, frequent: np.ndarray, fixed: list | None = None) -> tuple[_Sums, list]:
    """Sums of a seating, and those of them that no sweep changes; the first table has both, others get the latter."""
    rows = (seats.where(F.col("kind").isin(FIXED, DRAWN)).select("kind", "part")
            .mapInArrow(_added, "kind int, range int, part binary").groupBy("kind", "range")
            .applyInArrow(_added_up, "kind int, range int, part binary").toArrow().to_pylist())

    def dense(own):
        parts = [pickle.loads(r["part"]) for r in sorted(rows, key=lambda r: r["range"]) if r["kind"] == own]
        return [np.concatenate(x) for x in zip(*parts)] or _Frequent(len(frequent)).sums

    fixed = fixed or dense(FIXED)
    c_context, t_context, c_word, t_word, totals = (a + b for a, b in zip(fixed, dense(DRAWN)))
    ones, twos = totals[4] + (t_word == 1).sum(), totals[5] + (t_word == 2).sum()
    return _Sums(frequent, c_context, t_context, c_word, t_word, totals[3], totals[0] + (c_word > 0).sum(),
                 totals[6] + t_word.sum(), _discount(totals[1], totals[2]), _discount(ones, twos)), fixed


def _parent(t_word: np.ndarray, m: _Sums, s: Settings) -> np.ndarray:
    """Probability of a word in the parent restaurant, from its tables below; 0 tables for unknown words."""
    d, all_ = m.parent_discount, s.strength + m.tables
    return (np.maximum(t_word - d, 0) + (s.strength + d * m.words) / (m.words + 1)) / all_


def _found(rare: pa.Table, wanted: np.ndarray) -> np.ndarray:
    """Rows of the wanted contexts, all of which are there."""
    key = rare["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    return order[np.searchsorted(key[order], wanted)]


def _spliced(hot: np.ndarray, place: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Values of frequent contexts by place, of others in their order."""
    values = hot[place]
    values[place < 0] = rare
    return values


def _predict(b: _Pairs, m: _Sums, sums, s: Settings) -> None:
    """Add the probabilities of a seating, by the sums of that seating."""
    c_context, t_context, _, t_word = sums
    parent = _parent(t_word, m, s)
    for pairs, _ in b.parts():
        context = b.context[pairs]
        new = (s.strength + m.discount * t_context[context]) * parent[b.word[pairs]]
        b.p[pairs] += (b.count[pairs] - m.discount * b.tables[pairs] + new) / (s.strength + c_context[context])


def _sweep(sent, sweep: int, s: Settings):
    """Draw the tables of a bucket anew, given all sums of the seating before."""
    def run(group: pa.Table, rare: pa.Table) -> pa.Table:
        m, bucket = sent.value, group["bucket"][0].as_py()
        rows = {sub: _Seated.unpacked(blob) for sub, blob in sorted(zip(group["sub"].to_pylist(), group["part"].to_pylist()))}
        for b in rows.values():
            if b.base is None:
                at = _found(rare, b.rare)
                b.base, b.alone = rare["base"].to_numpy()[at], rare["buckets"].to_numpy()[at] == 1
        own = _alone(rows)
        for sub, b in rows.items():
            t_rare = np.zeros(len(b.rare))
            t_rare[b.alone] = own[sub]
            t_rare[~b.alone] = rare["t"].to_numpy()[_found(rare, b.rare[~b.alone])]
            t_context = _spliced(m.t_context, b.hot_context, b.base + t_rare)
            t_word = np.where(b.hot_word >= 0, m.t_word[b.hot_word], b.t_word())
            rng = np.random.default_rng([bucket, sub, sweep])
            for pairs in map(slice, b.cuts[:-1], b.cuts[1:]):
                other = np.maximum(b.tables[pairs] - 1, 0)
                fresh = s.strength + m.discount * (t_context[b.context[pairs]] - other)
                b.tables[pairs] = seat(b.count[pairs], fresh * _parent(t_word[b.word[pairs]] - other, m, s), m.discount, rng)
            if sweep >= s.burn:
                b.kept.append(_narrow(b.tables))
        return _seats(bucket, *_drawn(rows, len(m.frequent), sweep >= s.burn))

    return run


def _with_probabilities(group: pa.Table, rare: pa.Table, models: list[_Sums], s: Settings):
    """(sub, pairs, documents' events) of each row of a bucket: pairs with score, words with base score and whether they are known."""
    blobs = {}
    for sub, kind, blob in zip(*(group[n] for n in ("sub", "kind", "part"))):
        blobs.setdefault(sub.as_py(), {})[kind.as_py()] = blob
    key = rare["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    key = key[order]
    for sub, own in sorted(blobs.items()):
        b, kept = _Pairs.seatable(own[PAIRS].as_py(), models[0].frequent), _Seated.unpacked(own[SEATED].as_py()).kept
        at, drawn = order[np.searchsorted(key, b.contexts[b.hot_context < 0])], np.flatnonzero(b.count > 1)
        c, t = (rare[n].to_numpy()[at] for n in ("c", "base"))
        c_context = _spliced(models[0].c_context, b.hot_context, c)
        c_word = np.where(b.hot_word >= 0, models[0].c_word[b.hot_word], np.bincount(b.word, b.count, len(b.words)))
        for i, m in enumerate(models):
            b.tables[drawn] = kept[i]
            t_context = _spliced(m.t_context, b.hot_context, t + rare[f"t{i}"].to_numpy()[at])
            t_word = np.where(b.hot_word >= 0, m.t_word[b.hot_word], np.bincount(b.word, b.tables, len(b.words)))
            _predict(b, m, (c_context, t_context, c_word, t_word), s)
        b.p = np.log10(b.p / s.samples)
        b.base = np.log10((c_word + 0.5) / (models[0].tokens + 0.5 * (models[0].words + 1)))
        b.known = c_word > 0
        yield sub, b, own.get(EVENTS)


def _predicted(sent, s: Settings):
    """The bucket's pairs with their probabilities."""
    def run(group: pa.Table, rare: pa.Table) -> pa.Table:
        out = [(sub, b.packed()) for sub, b, _ in _with_probabilities(group, rare, sent.value, s)]
        return pa.table({"bucket": pa.array([group["bucket"][0].as_py()] * len(out), pa.int32()),
                         "sub": pa.array([sub for sub, _ in out], pa.int32()), "part": pa.array([b for _, b in out], pa.binary())})

    return run


def _scores(sent, s: Settings):
    """Sums by document of a block in one bucket: score, base score, known tokens; of its documents with pairs there."""
    def run(group: pa.Table, rare: pa.Table) -> pa.Table:
        sums, heads = {}, {}
        for _, b, blob in _with_probabilities(group, rare, sent.value, s):
            events = _Events.unpacked(blob.as_py())
            heads.update(events.heads)
            for block, place, size, event, docs in events:
                before = sums.setdefault(block, [np.zeros(docs), np.zeros(docs), np.zeros(docs), np.zeros(docs, bool)])
                at = np.repeat(place, size)
                doc, times = event >> _TIMES_BITS, (event & ((1 << _TIMES_BITS) - 1)).astype(np.int64) + 1
                before[3][doc] = True
                for total, values in zip(before, (b.p[at], b.base[b.word[at]], b.known[b.word[at]])):
                    total += np.bincount(doc, values * times, docs)
        out = []
        for block, (score, base, known, met) in sums.items():
            at = np.flatnonzero(met).astype(np.uint16)
            out.append(pickle.dumps((at, score[at], base[at], _narrow(known[at].astype(np.int64)), heads.get(block))))
        return pa.table({"block": pa.array(list(sums), pa.int64()), "sums": pa.array(out, pa.binary())})

    return run


def _documents(group: pa.Table) -> pa.Table:
    parts = [pickle.loads(x) for x in group["sums"].to_pylist()]
    ids, counts = next(p[4] for p in parts if p[4])
    score, base, known = totals = np.zeros((3, len(ids)))
    for at, *sums, _ in parts:
        for total, values in zip(totals, sums):
            total[at] += values
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(counts.astype(np.int64) + 1),
                     "n_known": pa.array(known.astype(np.int64)), "base_score": pa.array(base), "score": pa.array(score)})


@dataclass
class _Learnt:
    """Rows of buckets (kind, bucket, sub, part), sums of rarer contexts, the broadcast sums of each seating that
    counts, the broadcast frequent words, the number of buckets and that of training tokens."""

    rows: DataFrame
    rare: DataFrame
    models: object
    frequent: object
    buckets: int
    tokens: int
    paths: list[str]

    def by_bucket(self, kinds: list[int], share: Column):
        """Groups of the rows and of the sums of each bucket of a share."""
        rows, rare = self.rows.where(F.col("kind").isin(kinds) & share), self.rare.where(share)
        return rows.groupBy("bucket").cogroup(rare.groupBy("bucket"))


def _learnt(docs: DataFrame, s: Settings) -> _Learnt:
    spark = docs.sparkSession
    frequent = _frequent(docs, s.contexts)
    sent = spark.sparkContext.broadcast(frequent)
    letters = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, ceil(letters / 6 / s.bucket_events))  # a word has about six bytes, its blank included

    both = Window.partitionBy("key")

    def rare_of(seats):
        """Tables of rarer contexts with pairs that are drawn: of these, and in the first table those of other pairs."""
        t = {kind: F.sum(F.when(F.col("kind") == kind, F.col("t"))).over(both) for kind in (RARE, SHARED)}
        buckets = F.count(F.when(F.col("kind") == SHARED, 1)).over(both).alias("buckets")
        return (seats.where(F.col("kind").isin(RARE, SHARED))
                .select("kind", "bucket", "key", t[RARE].alias("base"), t[SHARED].alias("t"), buckets)
                .where(F.col("kind") == SHARED).drop("kind").groupBy("bucket"))

    def all_rare(first, kept):
        """Customers and tables of all rarer contexts, the latter for each seating."""
        rows = first.where(F.col("kind") == RARE).withColumn("of", F.lit(-1))
        for i, seats in enumerate(kept):
            rows = rows.unionByName(seats.where(F.col("kind").isin(SHARED, ALONE)).withColumn("of", F.lit(i)))
        total = {n: F.coalesce(F.sum(F.when(F.col("of") == i, F.col(c))).over(both), F.lit(0.0)).alias(n)
                 for n, i, c in (("c", -1, "c"), ("base", -1, "t"), *((f"t{i}", i, "t") for i in range(len(kept))))}
        return rows.select("of", "bucket", "key", *total.values()).where("of = -1").drop("of")

    def blobs_of(seats, *kinds):
        return seats.where(F.col("kind").isin(*kinds)).select("kind", "bucket", "sub", "part")

    start = path = work_dir(spark, "seats")
    paths, kept, models = [start], [], []
    with passing_shuffles(spark):
        first = seats = written_at(docs.mapInArrow(_packed(sent, buckets), _PACKED)
                                   .groupBy("bucket").applyInArrow(slimmed(_first(sent)), _SEATS), path, "uncompressed")
        sums, fixed = _collected(first, frequent)
        for sweep in range(s.burn + s.samples):
            model = spark.sparkContext.broadcast(sums)
            old, path = path, work_dir(spark, "seats")
            seats = written_at(blobs_of(seats, SEATED).groupBy("bucket").cogroup(rare_of(seats))
                               .applyInArrow(slimmed(_sweep(model, sweep, s)), _SEATS), path, "uncompressed")
            model.unpersist()
            if old not in paths:
                remove(spark, old)
            sums, _ = _collected(seats, frequent, fixed)
            if sweep >= s.burn:
                paths.append(path)
                kept.append(seats)
                models.append(sums)
        rare = work_dir(spark, "rare")
        sums_of_rare = written_at(all_rare(first, kept), rare)
        for old in paths[1:-1]:
            remove(spark, old)
    return _Learnt(blobs_of(first, PAIRS, EVENTS).unionByName(blobs_of(seats, SEATED)), sums_of_rare,
                   spark.sparkContext.broadcast(models), sent, buckets, int(sums.tokens), [start, path, rare])


def predicted(docs: DataFrame, s: Settings = Settings()):
    """Pairs (bucket, sub, part) of ``docs`` (doc_id, train, text) with their probabilities, the broadcast
    frequent words, the number of buckets and that of training tokens."""
    m = _learnt(docs, s)
    pairs = m.by_bucket([PAIRS, SEATED], F.lit(True)).applyInArrow(_predicted(m.models, s), "bucket int, sub int, part binary")
    return pairs, m.frequent, m.buckets, m.tokens


def scored(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of ``docs`` (doc_id, train, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    m = _learnt(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "train", "text"), s)
    scores = []
    with passing_shuffles(spark):
        for i in range(min(SHARES, m.buckets)):
            share = m.by_bucket([PAIRS, EVENTS, SEATED], F.col("bucket") % SHARES == i)
            scores.append(written(share.applyInArrow(slimmed(_scores(m.models, s)), "block long, sums binary"), "scores"))
    for path in m.paths:
        remove(spark, path)
    return (reduce(DataFrame.unionByName, scores).groupBy("block").applyInArrow(
        _documents, "doc_id long, n_tokens long, n_known long, base_score double, score double")
        .withColumn("train_tokens", F.lit(m.tokens).cast("long")))
