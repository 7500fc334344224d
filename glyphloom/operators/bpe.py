"""Byte-pair vocabulary induction in few phases of DataFrame jobs.

The state is a table of distinct words per group (a group is one label and one
configuration), each word an array of symbols. Pairs rank by (count desc, left id,
right id), ids being code points and then merges in order of birth; the best pair
is merged until the vocabulary is full or no pair is left.

**A phase.** Spark counts all pairs of a group and takes the ``active`` best of
them. Words are cut wherever two neighbours are not an active pair, and equal
stretches are added up. One task per group then trains on its table of stretches
alone: pair counts by signed deltas, an index from pairs to positions, a heap. Its merges
are those of training on all words, for as long as they rank before the best inactive
pair:

* Two tokens A and B can meet only where the last symbol of A met the first of B
  at the start of the phase, so that junction pair is at least as frequent.
  If it is inactive, (A, B) ranks after it and is not due in this phase. If it is active,
  no occurrence was cut: all of them are inside stretches, and the count is exact.
* A token that merges spell in several ways has several junctions. With at most
  m junctions a pair and inactive pairs of count h at most, no more than m * h occurrences of it
  were cut. The phase ends where that could matter: at a pair with a cut junction, or
  when such a pair, or m * h, reaches the best count.

The best pair of all is always active and exact, so every phase learns something. If no
pair is inactive, one phase is all there is.

**Bounds.** A table of stretches holds at most ``symbols`` symbols; if it is larger,
fewer pairs are active and the same table is cut again. Active pairs are few by their number. So neither the
driver nor a task holds anything that grows with the corpus, and both numbers change
the number of phases only, never a merge.
"""

import gc
import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphloom.functions import patterns as p
from glyphloom.functions import text as t
from glyphloom.functions.memory import lean, slim, together
from glyphloom.functions.merging import Merges  # noqa: F401
from glyphloom.session import remove, small_table, small_tables, spread, work_dir, written, written_at

FIRST_MERGE = 0x110000      # symbols below are code points
_BITS = 21                  # a symbol fits in 21 bits, a group in the 21 above two of them
_MASK = (1 << _BITS) - 1
_PAIR = (1 << 2 * _BITS) - 1
STATE = "gid int, symbols array<int>, n bigint"
_STEP = 1 << 20             # symbols whose pairs a task looks at at once
_ROWS = 65_536              # words that a task counts or cuts at once
MAX_ACTIVE = 4_000_000      # active pairs of all groups, which every task looks up


@dataclass
class Vocabulary:
    """Learned merges and vocabularies, one per group, as bounded DataFrames."""

    merges: DataFrame    # (*by, rank, left, right, token, n)
    vocab: DataFrame     # (*by, token, id, kind, merge_rank)
    phases: int


# --- task side ---------------------------------------------------------------

def _flat(batch):
    """Symbols of a batch laid end to end, with the row each belongs to."""
    col = batch.column("symbols")
    lengths = np.diff(col.offsets.to_numpy())
    return (col.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
            np.repeat(np.arange(len(lengths)), lengths))


def _pair_keys(values, rows, gids):
    inside = rows[:-1] == rows[1:]
    key = (gids[rows[:-1]] << (2 * _BITS)) | (values[:-1] << _BITS) | values[1:]
    return key, inside


def _counted(batches):
    """Pairs of each batch with their counts."""
    for batch in together(batches, _ROWS):
        gids = batch.column("gid").to_numpy().astype(np.int64)
        values, rows = _flat(batch)
        key, inside = _pair_keys(values, rows, gids)
        found, where = np.unique(key[inside], return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, where, batch.column("n").to_numpy()[rows[:-1][inside]])
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total)], ["pair", "n"])


def _cutter(active):
    """Stretches of two symbols or more in which every neighbouring pair is active."""
    def cut(batches):
        for batch in together(batches, _ROWS):
            gids = batch.column("gid").to_numpy().astype(np.int64)
            values, rows = _flat(batch)
            if len(values) < 2 or not len(active.value):
                continue
            key, inside = _pair_keys(values, rows, gids)
            at = np.minimum(np.searchsorted(active.value, key), len(active.value) - 1)
            tied = inside & (active.value[at] == key)
            first = np.flatnonzero(np.concatenate(([True], ~tied)))
            size = np.diff(np.append(first, len(values)))
            long_ = size > 1
            kept = np.repeat(long_, size)
            offsets = np.concatenate(([0], np.cumsum(size[long_]))).astype(np.int32)
            row = rows[first[long_]]
            yield pa.RecordBatch.from_arrays([
                pa.array(gids[row].astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[kept].astype(np.int32))),
                pa.array(batch.column("n").to_numpy()[row])], ["gid", "symbols", "n"])
    return cut


def _rewriter(merges):
    """Words after the merges of a phase, group by group; single symbols have no pair left and go."""
    def rewrite(batches):
        for batch in together(batches, 1 << 19):
            gids, weights = batch.column("gid").to_numpy(), batch.column("n").to_numpy()
            values, rows = _flat(batch)
            for gid in np.unique(gids).tolist():
                mine = gids[rows] == gid
                left, at = replayed(values[mine], rows[mine], merges.value[gid])
                sizes = np.bincount(at, minlength=len(gids))
                kept = np.flatnonzero(sizes > 1)
                offsets = np.concatenate(([0], np.cumsum(sizes[kept]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(kept), gid, np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(left[sizes[at] > 1].astype(np.int32))),
                    pa.array(weights[kept])], ["gid", "symbols", "n"])
    return rewrite


class _Names:
    """Symbols of a group: code points, then learned strings in order of birth."""

    def __init__(self, symbols: list[str]):
        self.symbols = symbols
        self.ids = {s: FIRST_MERGE + i for i, s in enumerate(symbols)}

    def text(self, symbol: int) -> str:
        return chr(symbol) if symbol < FIRST_MERGE else self.symbols[symbol - FIRST_MERGE]

    def merged(self, left: int, right: int) -> tuple[int, bool]:
        """Symbol of two symbols put together, and whether it is a new one."""
        token = self.text(left) + self.text(right)
        new = token not in self.ids
        if new:
            self.ids[token] = FIRST_MERGE + len(self.symbols)
            self.symbols.append(token)
        return self.ids[token], new


class _Junctions:
    """Which symbols of the phase's start can begin or end a symbol, and what was cut there."""

    def __init__(self, active: set, most: int):
        self.active, self.most = active, most   # the best inactive pair's count, 0 if there is none
        self.firsts: dict[int, set] = {}
        self.lasts: dict[int, set] = {}
        self.ways = 1
        self.shadow: list = []                  # heap of pairs that may have been cut

    def _of(self, table: dict, symbol: int) -> set:
        return table.get(symbol) or {symbol}

    def born(self, left: int, right: int, symbol: int, new: bool, counts: dict) -> None:
        for table, part in ((self.firsts, left), (self.lasts, right)):
            own = set() if new else self._of(table, symbol)
            table[symbol] = own | self._of(table, part)
        sizes = [max(map(len, table.values())) for table in (self.firsts, self.lasts)] if not new else None
        if sizes:
            self.ways = max(self.ways, sizes[0] * sizes[1])
            for pair, n in counts.items():
                if symbol in (pair >> _BITS, pair & _MASK):
                    self.changed(pair, n)
        else:
            self.ways = max(self.ways, len(self.firsts[symbol]) * len(self.lasts[symbol]))

    def cut(self, pair: int) -> bool:
        return any((a << _BITS | b) not in self.active for a in self._of(self.lasts, pair >> _BITS)
                   for b in self._of(self.firsts, pair & _MASK))

    def changed(self, pair: int, n: int) -> None:
        if self.ways > 1 and n > 0 and self.cut(pair):
            heapq.heappush(self.shadow, (-n, pair))

    def doubtful(self, pair: int, n: int, counts: dict) -> bool:
        """Whether cut occurrences could make another pair come first."""
        if self.ways == 1:
            return False
        hidden = self.ways * self.most
        while self.shadow and counts.get(self.shadow[0][1]) != -self.shadow[0][0]:
            heapq.heappop(self.shadow)
        return n <= hidden or self.cut(pair) or bool(self.shadow and hidden - self.shadow[0][0] >= n)


class _Chain:
    """Symbols of stretches laid end to end, linked to their neighbours, in arrays of a few bytes a symbol.

    Neighbours of a stretch's ends are its borders: the place after the last one stands for all of them.
    """

    def __init__(self, values: np.ndarray, rows: np.ndarray, weights: np.ndarray):
        n = self.end = len(values)
        self.rows, self.weights = rows.astype(np.int32, copy=False), weights
        self.symbols = np.empty(n + 1, np.int32)
        self.symbols[:-1], self.symbols[-1] = values, -1
        heads = np.flatnonzero(rows[1:] != rows[:-1]) + 1       # first places of stretches but the first one
        self.after = np.arange(1, n + 2, dtype=np.int32)
        self.before = np.arange(-1, n, dtype=np.int32)
        self.after[heads - 1] = self.before[heads] = n
        self.after[-1] = self.before[0] = self.before[-1] = n

    def _keyed(self):
        """Some places that begin a pair, and their pairs, step by step from left to right."""
        for at in range(0, self.end, _STEP):
            places = np.flatnonzero(self.after[at:min(at + _STEP, self.end)] != self.end) + at
            yield places.astype(np.int32), self.symbols[places].astype(np.int64) << _BITS | self.symbols[places + 1]

    def pairs(self, wanted: np.ndarray | None = None):
        """Pairs (of ``wanted`` ones), how often each occurs, and its places in order.

        Places are dealt to their pairs step by step, so that no array but theirs is as long as the symbols.
        """
        kinds, sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, keys in self._keyed():
            found, n = np.unique(keys if wanted is None else keys[np.isin(keys, wanted)], return_counts=True)
            both, where = np.unique(np.concatenate((kinds, found)), return_inverse=True)
            more = np.zeros(len(both), np.int64)
            more[where[:len(kinds)]] = sizes
            more[where[len(kinds):]] += n
            kinds, sizes = both, more
        ends = np.cumsum(sizes)
        free, sums = ends - sizes, np.zeros(len(kinds), np.int64)
        places = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for starts, keys in self._keyed() if len(kinds) else ():
            code = np.minimum(np.searchsorted(kinds, keys), len(kinds) - 1)
            if wanted is not None:
                kept = kinds[code] == keys
                code, starts = code[kept], starts[kept]
            code = code.astype(np.uint16 if len(kinds) < 1 << 16 else np.int64)
            order = np.argsort(code, kind="stable")
            code, starts = code[order], starts[order]
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
            if not len(first):
                continue
            mine, n = code[first], np.diff(np.append(first, len(code)))
            places[np.repeat(free[mine] - first, n) + np.arange(len(code))] = starts
            free[mine] += n
            sums[mine] += np.add.reduceat(self.weights[self.rows[starts]], first)
        return kinds.tolist(), sums.tolist(), np.split(places, ends[:-1]) if len(ends) else []

    def merge(self, left: int, right: int, made: int, places: list):
        """Put all occurrences of a pair together, from left to right.

        Yields ``(old pair, new pair, count, places of the new one)`` for their neighbours,
        first of all the merged pair itself with no new one.
        """
        at = np.concatenate(places) if len(places) > 1 else places[0]
        if (at[1:] <= at[:-1]).any():       # places noted at different times
            at = np.unique(at)
        symbols, after = self.symbols, self.after
        at = at[(symbols[at] == left) & (symbols[after[at]] == right)]     # others were merged into neighbours since
        if left == right and len(at) > 1:       # of overlapping ones every second
            first = np.concatenate(([True], after[at[:-1]] != at[1:]))
            run = np.flatnonzero(first)
            at = at[(np.arange(len(at)) - run[np.cumsum(first) - 1]) % 2 == 0]
        if not len(at):
            return
        gone = after[at]
        w, h, k = self.weights[self.rows[at]], self.before[at], after[gone]
        tied = np.append(k[:-1] == at[1:], False)           # the next occurrence follows at once
        lone = np.concatenate(([True], ~tied[:-1])) & (h != self.end)
        free = ~tied & (k != self.end)
        beside = [(symbols[h[lone]], h[lone], w[lone], True), (symbols[k[free]], at[free], w[free], False)]
        symbols[at], symbols[gone] = made, -2
        after[at] = k
        self.before[k] = at
        yield left << _BITS | right, None, int(w.sum()), None
        if tied.any():
            yield right << _BITS | left, made << _BITS | made, int(w[tied].sum()), at[tied]
        for others, where, weight, ahead in beside:
            if not len(others):
                continue
            order = np.argsort(others, kind="stable")
            others, where = others[order], where[order]
            first = np.flatnonzero(np.concatenate(([True], others[1:] != others[:-1])))
            sums = np.add.reduceat(weight[order], first).tolist()
            bounds = [*first.tolist(), len(others)]
            for x, n, a, b in zip(others[first].tolist(), sums, bounds, bounds[1:]):
                yield (x << _BITS | left, x << _BITS | made, n, where[a:b]) if ahead else (
                    right << _BITS | x, made << _BITS | x, n, where[a:b])


def learnt(values: np.ndarray, rows: np.ndarray, weights: np.ndarray, names: _Names, active: set,
           last: tuple | None, room: int, floor: int) -> list[tuple[int, int, int]]:
    """Merges ``(left, right, n)`` in order, from the stretches of one group.

    ``values`` are the stretches' symbols laid end to end, ``rows`` says which stretch each
    is in and ``weights`` how often that occurs. ``last`` is the rank (-n, pair) of the best
    inactive pair; ``room`` bounds new symbols. A pair is an integer, its left symbol in the high bits.
    """
    return _learnt(_Chain(values, rows, weights), names, active, last, room, floor)


def _learnt(chain: _Chain, names: _Names, active: set, last: tuple | None, room: int, floor: int) -> list[tuple[int, int, int]]:
    found, sums, split = chain.pairs()
    counts: dict[int, int] = dict(zip(found, sums))
    # most pairs occur once or twice: bytes and one number take a third of what arrays and tuples would
    places: dict[int, bytes] = {k: part.tobytes() for k, part in zip(found, split)}
    del found, sums, split
    heap = [pair - (n << 2 * _BITS) for pair, n in counts.items()]      # order of (-n, pair)
    heapq.heapify(heap)
    worst = last and last[1] + (last[0] << 2 * _BITS)
    junctions = _Junctions(active, -last[0]) if last else None
    out = []
    while heap and room > 0:
        rank = heap[0]
        pair, n = rank & _PAIR, -(rank >> 2 * _BITS)
        if counts.get(pair) != n:
            heapq.heappop(heap)     # an entry from before the count changed
            continue
        if n < floor or (last and rank >= worst) or (junctions and junctions.doubtful(pair, n, counts)):
            break
        left, right = pair >> _BITS, pair & _MASK
        made, new = names.merged(left, right)
        out.append((left, right, n))
        room -= new
        changed: dict[int, int] = {}
        for old, fresh, w, where in chain.merge(left, right, made, [np.frombuffer(places.pop(pair), np.int32)]):
            changed[old] = changed.get(old, 0) - w
            if fresh is not None:
                changed[fresh] = changed.get(fresh, 0) + w
                places[fresh] = places.get(fresh, b"") + where.astype(np.int32, copy=False).tobytes()
        for other, delta in changed.items():
            if not delta:
                continue
            total = counts.get(other, 0) + delta
            if total > 0:
                counts[other] = total
                heapq.heappush(heap, other - (total << 2 * _BITS))
            else:
                counts.pop(other, None)
                places.pop(other, None)
        if junctions:
            junctions.born(left, right, made, new, counts)
            for other in changed:
                junctions.changed(other, counts.get(other, 0))
    return out


def replayed(values: np.ndarray, rows: np.ndarray, merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their rows after the merges ``(left, right, made)``, each over when its turn has passed."""
    chain = _Chain(values, rows, np.ones(int(rows[-1]) + 1 if len(rows) else 0, np.int64))
    keys = [left << _BITS | right for left, right, _ in merges]
    due = set(keys)
    found, _, split = chain.pairs(np.array(sorted(due), np.int64))
    places: dict[int, list] = {k: [part] for k, part in zip(found, split)}
    for key, (left, right, made) in zip(keys, merges):
        at = places.pop(key, None)
        if at is not None:
            for _, fresh, _, where in chain.merge(left, right, made, at):
                if fresh in due:
                    places.setdefault(fresh, []).append(where)
    alive = chain.symbols[:-1] >= 0
    return chain.symbols[:-1][alive], rows[alive]


def _learner(groups, active, floor: int):
    """One group's stretches to its merges of this phase."""
    def laid(batches) -> tuple[int, _Chain]:
        """The group and its stretches; a batch goes as soon as it is laid down."""
        gid, parts, sizes, weights = None, [], [], []
        for batch in batches:
            if batch.num_rows:
                gid = batch.column("gid")[0].as_py()
                column = batch.column("symbols")
                parts.append(column.flatten().to_numpy(zero_copy_only=False).astype(np.int32))
                sizes.append(np.diff(column.offsets.to_numpy()))
                weights.append(batch.column("n").to_numpy().copy())
        sizes = np.concatenate(sizes)
        return gid, _Chain(np.concatenate(parts), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.concatenate(weights))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, chain = laid(batches)
        symbols, room, last = groups.value[gid]
        lo, hi = np.searchsorted(active.value, [gid << (2 * _BITS), (gid + 1) << (2 * _BITS)])
        pairs = {k & _PAIR for k in active.value[lo:hi].tolist()} if last else set()
        merges = _learnt(chain, _Names(list(symbols)), pairs, last, room, floor)
        del chain
        gc.collect()
        slim()
        columns = list(zip(*merges)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array([gid] * len(merges), pa.int32()), pa.array(range(len(merges)), pa.int64()),
                                          *(pa.array(c, pa.int64()) for c in columns)], names=["gid", "seq", "a", "b", "n"])
    return learn


# --- training ----------------------------------------------------------------

class _Group:
    """Merge list of one group. Holds at most ``target_size`` strings."""

    def __init__(self, alphabet: list[str], target_size: int):
        self.alphabet = sorted(alphabet)
        self.names = _Names([])
        self.size = target_size - len(p.SPECIAL_TOKENS) - len(self.alphabet)
        self.merges: list[tuple] = []            # (left, right, token, n)
        self.done = self.room <= 0

    @property
    def room(self) -> int:
        return self.size - len(self.names.symbols)

    def take(self, merges: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Record a phase's merges; returns them with what they make."""
        out = []
        for left, right, n in merges:
            made, _ = self.names.merged(left, right)
            self.merges.append((self.names.text(left), self.names.text(right), self.names.text(made), n))
            out.append((left, right, made))
        return out


def _ranked(state: DataFrame, active: int) -> dict[int, list[tuple]]:
    """The best ``active`` + 1 pairs of each group, by rank."""
    counts = state.mapInArrow(lean(_counted), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("gid").orderBy(F.desc("n"), "pair")
    best = (counts.withColumn("gid", F.shiftright("pair", 2 * _BITS)).withColumn("rank", F.row_number().over(top))
            .filter(F.col("rank") <= active + 1).select("pair", "n").toArrow())
    keys, totals = best.column("pair").to_numpy(), best.column("n").to_numpy()
    order = np.lexsort((keys, -totals, keys >> (2 * _BITS)))
    out: dict[int, list[tuple]] = {}
    for key, n in zip(keys[order].tolist(), totals[order].tolist()):
        out.setdefault(key >> (2 * _BITS), []).append((-n, key))
    return out


def _stretches(state: DataFrame, ranked: dict[int, list[tuple]], active: int, symbols: int):
    """Written table of stretches, active pairs (sorted keys), and each group's best inactive rank."""
    spark = state.sparkSession
    share = {gid: min(active, len(pairs)) for gid, pairs in ranked.items()}
    source, path = state, None
    while True:
        keys = np.array(sorted(k for gid, m in share.items() for _, k in ranked[gid][:m]), np.int64)
        held = spark.sparkContext.broadcast(keys)
        cut = source.mapInArrow(lean(_cutter(held)), STATE).groupBy("gid", "symbols").agg(F.sum("n").alias("n"))
        old, path = path, work_dir(spark, "stretches")
        source = written_at(cut, path)
        if old:
            remove(spark, old)
        sizes = {r.gid: r.size for r in source.groupBy("gid").agg(F.sum(F.size("symbols")).alias("size")).collect()}
        large = [g for g, size in sizes.items() if size > symbols and share[g] > 1]
        if not large:
            lasts = {g: ranked[g][m] if m < len(ranked[g]) else None for g, m in share.items()}
            lasts = {g: r and (r[0], r[1] & _PAIR) for g, r in lasts.items()}
            return source, path, held, lasts
        for g in large:
            share[g] = max(1, min(share[g] // 2, share[g] * symbols // sizes[g]))


def train(words: DataFrame, target_size: int, by=("label", "config"), min_pair_count: int = 1,
          active: int = 50_000, symbols: int = 1 << 23) -> Vocabulary:
    """Learn one vocabulary per group from ``(*by, word, n)``.

    ``active`` and ``symbols`` bound a phase's pairs and stretches of a group; they
    change the number of phases, not results.
    """
    spark = words.sparkSession
    words = written(words.select(*by, "word", "n"), "words")
    letters = (words.select(*by, F.explode(t.chars(F.col("word"))).alias("ch"))
               .distinct().groupBy(*by).agg(F.collect_list("ch").alias("alphabet")).collect())
    letters.sort(key=lambda r: tuple(str(r[k]) for k in by))
    names = [tuple(r[k] for k in by) for r in letters]
    groups = [_Group(r["alphabet"], target_size) for r in letters]
    if not groups:
        return _tables(spark, words, by, names, groups, 0)
    active = max(1, min(active, MAX_ACTIVE // len(groups)))

    numbers = F.broadcast(small_table(  # one row per group
        spark, [(*name, i) for i, name in enumerate(names)], f"{_ddl(words, by)}, gid int"))
    path = work_dir(spark, "state")
    state = written_at(spread(words, "word").filter(F.length("word") > 1).join(numbers, list(by)).select(
        "gid", F.transform(F.split("word", ""), F.ascii).alias("symbols"), "n"), path)
    phases, found, merges, taken = 0, None, [], {}
    while not all(g.done for g in groups):
        open_ = [i for i, g in enumerate(groups) if not g.done]
        state = state.filter(F.col("gid").isin(open_))
        ranked = _ranked(state, active)
        stretches, cut_path, held, lasts = _stretches(state, ranked, active, symbols)
        known = spark.sparkContext.broadcast({i: (groups[i].names.symbols, groups[i].room, lasts.get(i)) for i in open_})
        # small in bytes, long to work on: as many tasks as groups, not as few as their bytes would fill
        found = stretches.repartition(4 * len(open_), "gid").groupBy("gid").applyInArrow(_learner(known, held, min_pair_count),
                                                      "gid int, seq bigint, a bigint, b bigint, n bigint").toArrow()
        remove(spark, cut_path)
        phases += 1
        found, taken = found.sort_by([("gid", "ascending"), ("seq", "ascending")]), {}
        for i in open_:     # one group at a time: those of all groups together are large as Python objects
            mine = found.filter(pc.equal(found.column("gid"), i))
            merges = groups[i].take(list(zip(*(mine.column(c).to_pylist() for c in "abn"))))
            # without an inactive pair a phase ends only where training does
            groups[i].done = not merges or groups[i].room <= 0 or lasts.get(i) is None
            if not groups[i].done:
                taken[i] = merges
        if not all(g.done for g in groups):
            applied = spark.sparkContext.broadcast(taken)
            old, path = path, work_dir(spark, "state")
            left = state.filter(F.col("gid").isin([i for i in open_ if not groups[i].done]))
            state = written_at(left.mapInArrow(lean(_rewriter(applied)), STATE), path)
            remove(spark, old)
    remove(spark, path)
    out = _tables(spark, words, by, names, groups, phases)
    del groups, found, merges, taken
    slim()      # the driver's memory counts as well
    return out


def _ddl(df: DataFrame, by) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in by)


def _tables(spark: SparkSession, words: DataFrame, by, names, groups, phases) -> Vocabulary:
    keys = _ddl(words, by)
    merges = ([(*name, k, *m) for k, m in enumerate(g.merges)] for name, g in zip(names, groups))

    def entries(name, g) -> list[tuple]:
        ranks = {}
        for k, (_, _, token, _) in enumerate(g.merges):
            ranks.setdefault(token, k)
        found = itertools.chain(
            ((s, "special", None) for s in p.SPECIAL_TOKENS),
            ((c, "alphabet", None) for c in g.alphabet),
            ((s, "merge", ranks[s]) for s in g.names.symbols))
        return [(*name, token, i, kind, rank) for i, (token, kind, rank) in enumerate(found)]

    vocab = (entries(name, g) for name, g in zip(names, groups))
    return Vocabulary(
        small_tables(spark, merges, f"{keys}, rank bigint, left string, right string, "
                                      "token string, n bigint"),
        small_tables(spark, vocab, f"{keys}, token string, id bigint, kind string, merge_rank bigint"),
        phases)
