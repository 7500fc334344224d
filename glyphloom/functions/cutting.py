"""Pre-tokenizers over whole batches of text: the pieces of ``pieces.PRE_TOKENIZERS``, cut in arrays.

A batch's code points are laid end to end and looked up in a table of character
classes. Every pattern is a partition of the text whose borders are told by the
classes of a character's neighbours, so borders come from comparing arrays with
themselves a place on. The classes are asked of Spark's own regex engine, once a
session, so both ways of cutting agree on every character.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glyphloom.functions import patterns as p
from glyphloom.session import small_table

GATHERED = 16 << 20         # bytes of text whose rows are put in order of their groups before they are cut
SLICE = 2 << 20             # bytes of text cut at a time; a longer text is cut by itself
_LETTER, _NUMBER, _SPACE, _WORD = 1, 2, 4, 8
_CLASSES = {_LETTER: r"(?U)\p{L}", _NUMBER: r"(?U)\p{N}", _SPACE: r"(?U)\s", _WORD: r"(?U)\w"}
_TAILS = "stredvlm"         # letters of contractions
_MARK = ord(p.METASPACE)
Kinds = tuple[np.ndarray, dict]      # classes of all code points, and those that count as each letter of a contraction
_KINDS: dict[str, Broadcast] = {}


def kinds(spark: SparkSession) -> Broadcast:
    """The character classes of the session's regex engine; 1.1 million code points, asked for once."""
    key = spark.sparkContext.applicationId
    if key not in _KINDS:
        points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
        tails = {x: f"(?U)(?i:{x})" for x in _TAILS}
        found = _asked(spark, ["".join(map(chr, points[i:i + 8192])) for i in range(0, len(points), 8192)],
                       {**_CLASSES, "tails": "|".join(tails.values())})
        table = np.zeros(0x110000, np.uint8)
        for bit in _CLASSES:
            table[found[bit]] |= bit
        tails = _asked(spark, ["".join(map(chr, found["tails"].tolist()))], tails)
        _KINDS[key] = spark.sparkContext.broadcast((table, tails))
    return _KINDS[key]


def _asked(spark: SparkSession, texts: list[str], patterns: dict) -> dict:
    """The code points of ``texts`` that match each pattern."""
    found = small_table(spark, [(x,) for x in texts], "s string").select(*[
        F.array_join(F.regexp_extract_all("s", F.lit(pattern), F.lit(0)), "").alias(str(name))
        for name, pattern in patterns.items()]).toArrow()
    return {name: np.frombuffer("".join(found.column(str(name)).to_pylist()).encode("utf-32-le"), np.uint32)
            for name in patterns}


def _changes(codes: np.ndarray) -> np.ndarray:
    out = np.ones(len(codes), bool)
    np.not_equal(codes[1:], codes[:-1], out=out[1:])
    return out


def _after(flags: np.ndarray, fill: bool = False) -> np.ndarray:
    """Each place's flag of the place before."""
    out = np.full(len(flags), fill, bool)
    out[1:] = flags[:-1]
    return out


def _places(n: int) -> type:
    """Type of places in ``n`` characters and in their bytes; half the size wherever that does."""
    return np.int32 if n < 1 << 28 else np.int64


def _split(points, first, of):
    code = np.where(of & (_LETTER | _NUMBER | _SPACE) | (points == 95), 4, 3).astype(np.uint8)
    code[points == 10], code[points == 9], code[points == 32] = 0, 1, 2
    return first | _changes(code) | (code == 2)


def _words(points, first, of):
    """Borders, and whether what begins there is kept."""
    code = np.where(of & _WORD, 1, np.where(of & _SPACE, 0, 2)).astype(np.uint8)
    return first | _changes(code), code != 0


def _llama(points, first, of, tails):
    letter, number, space = ((of & bit) > 0 for bit in (_LETTER, _NUMBER, _SPACE))
    other = ~(letter | number | space)
    ends = (points == 10) | (points == 13)
    code = letter + 2 * number.astype(np.uint8) + 3 * space.astype(np.uint8)
    head = first | _changes(code)                   # first of its class
    cut = head | number
    last = np.ones(len(points), bool)               # last of its class
    last[:-1] = head[1:]
    inner = _after(~last)                           # the place before belongs to the same run of a class
    if len(points):
        stops = np.flatnonzero(ends & space)            # line ends; few, so what concerns them is told for them alone
        if len(stops):
            heads = np.flatnonzero(head)
            run = np.searchsorted(heads, stops, "right") - 1
            start = heads[run]
            new = np.concatenate(([True], run[1:] != run[:-1]))
            rank = np.arange(len(stops)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            # line ends right after other characters belong to them
            led = (stops - start == rank) & ~first[start] & other[start - 1]
            leading = np.zeros(len(points), bool)
            leading[stops[led]] = True
            cut &= ~leading
            # what is left of a run of white space is cut after its last line end, and before its last character
            for some in (led, ~led & np.append(new[1:], True)):
                spot = stops[some] + 1
                spot = spot[spot < len(points)]
                cut[spot[space[spot] & inner[spot] & ~leading[spot]]] = True
        text_end = np.ones(len(points), bool)
        text_end[:-1] = first[1:]
        plain = space & ~ends & last & ~text_end
        cut |= plain & inner                                                    # the last one stands before a word
        blank = points == 32
        joined = ~first & other & head & _after(blank & last)
        cut &= ~joined
        alone = other & head & last & ~joined
        glued = letter & head & ~first & (_after(plain) | _after(alone))
        cut &= ~glued
        quotes = np.flatnonzero(alone[:-1] & (points[:-1] == 39) & letter[1:] & ~first[1:])
        if len(quotes):
            def at(k, tail):
                spot = np.minimum(quotes + k, len(points) - 1)
                within = quotes + k < len(points)
                for step in range(1, k + 1):
                    within = within & ~first[np.minimum(quotes + step, len(points) - 1)]
                return within & np.isin(points[spot], tails[tail])
            one = at(1, "s") | at(1, "t") | at(1, "m") | at(1, "d")
            two = (at(1, "r") & at(2, "e")) | (at(1, "v") & at(2, "e")) | (at(1, "l") & at(2, "l"))
            for which, size in ((one, 1), (two & ~one, 2)):
                spot = quotes[which] + size + 1
                spot = spot[spot < len(points)]
                cut[spot] = True
    return cut


def _borders(name: str, points: np.ndarray, first: np.ndarray, known: Kinds):
    """Where pieces begin, and, where some text is left out, whether what begins there is kept."""
    table, tails = known
    of = table[points]
    if name == "split":
        return _split(points, first, of), None
    if name == "llama":
        return _llama(points, first, of, tails), None
    if name == "whitespace":
        return _words(points, first, of)
    opens = first | (points == _MARK)
    if name == "metaspace":
        return opens, None
    if name == "metaspace_split":
        return opens | _split(points, first, of), None
    if name == "metaspace_whitespace":
        cut, kept = _words(points, first, of)
        return opens | cut, kept
    raise KeyError(name)


@dataclass
class Cut:
    """Pieces of some texts: strings end to end, the text and the line each is in, and lengths in characters."""

    spelled: Callable[[], pa.Array]
    rows: np.ndarray        # number of the text
    lines: np.ndarray       # number of the stretch that pieces don't cross: a text, or a line of it
    lengths: np.ndarray
    starts: np.ndarray      # place of the first character in the text

    @cached_property
    def pieces(self) -> pa.Array:
        """The strings; who only counts or measures pieces never has them made."""
        return self.spelled()


class Texts:
    """Code points of some texts laid end to end."""

    def __init__(self, column: pa.Array, known: Kinds, lines: bool = False):
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = raw[int(offsets[0]):int(offsets[-1])].to_pybytes() if raw is not None and len(column) else b""
        self.known, self.count = known, len(column)
        self.points = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        self.ends = np.cumsum(self._widths(self.points), dtype=_places(len(self.points)))
        heads = np.searchsorted(self.ends, offsets - offsets[0], "right") if len(column) else np.zeros(1, np.int64)
        self.heads = heads                                       # place of each text's first character
        self.rows = np.repeat(np.arange(len(column), dtype=np.int32), np.diff(heads)) if len(column) else np.zeros(0, np.int64)
        self.first = np.zeros(len(self.points), bool)
        self.first[heads[:-1][heads[:-1] < len(self.points)]] = True
        if lines:
            self.first |= _after(self.points == 10)
        self.lines = np.cumsum(self.first, dtype=self.ends.dtype)

    @staticmethod
    def _widths(points: np.ndarray) -> np.ndarray:
        return 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)

    def cut(self, name: str) -> Cut:
        points, ends = self.points, self.ends
        if name.startswith("metaspace"):
            points = np.where(points == 32, np.uint32(_MARK), points)
            ends = np.cumsum(self._widths(points), dtype=ends.dtype)
        cut, kept = _borders(name, points, self.first, self.known)
        at = np.flatnonzero(cut)
        sizes = np.diff(np.append(at, len(points)))
        some = None if kept is None else np.flatnonzero(kept[at])

        def spelled() -> pa.Array:
            stop = ends[at + sizes - 1] if len(at) else np.zeros(0, np.int64)
            offsets = np.concatenate(([0], stop)).astype(np.int64)
            data = points.astype("<u4", copy=False).tobytes().decode("utf-32-le").encode()
            pieces = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            return pieces if some is None else pieces.take(pa.array(some))

        mine, lengths = (at, sizes) if some is None else (at[some], sizes[some])
        rows = self.rows[mine]
        return Cut(spelled, rows, self.lines[mine], lengths, mine - self.heads[rows])


def gathered(batches, column: str = "text"):
    """Batches put together until they hold some ``GATHERED`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= GATHERED:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def slices(batch: pa.RecordBatch, column: str = "text"):
    """A batch in parts of some ``SLICE`` bytes of text."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // SLICE
    heads = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [batch.num_rows])) if batch.num_rows else [0, 0]
    for a, b in zip(heads[:-1], heads[1:]):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def units(cut: Cut, runs: bool) -> tuple[pa.Array, np.ndarray]:
    """Array of ``(piece, run)``, and the text each is in."""
    if runs:
        _, _, at, run = folded(cut)
    else:
        at, run = np.arange(len(cut.rows)), np.ones(len(cut.rows), np.int64)
    pieces = cut.pieces.take(pa.array(at)) if runs else cut.pieces
    return pa.StructArray.from_arrays([pieces.cast(pa.string()), pa.array(run.astype(np.int32))], ["piece", "run"]), cut.rows[at]


def listed(values: pa.Array, rows: np.ndarray, valid: pa.Array) -> pa.ListArray:
    """``values`` as one list a row; null where the row is not valid."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(valid))))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pc.invert(valid))


def folded(cut: Cut):
    """Codes of the distinct pieces, and units: the place of each one's first piece, and its run.

    3 to 255 equal neighbours are one unit, as in ``pieces.collapse_piece_runs``.
    """
    codes = cut.pieces.dictionary_encode()
    code = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    head = _changes(code) | _changes(cut.lines) | _changes(cut.rows)
    at = np.flatnonzero(head)
    runs = np.diff(np.append(at, len(code)))
    one = (runs >= 3) & (runs <= p.PARAM_MAX) & (cut.lengths[at] <= p.PARAM_MAX)
    start = np.ones(len(code), bool)
    start[np.repeat(one, runs)] = False
    start[at] = True
    units = np.flatnonzero(start)
    run = np.ones(len(code), np.int64)
    run[at[one]] = runs[one]
    return codes.dictionary, code, units, run[units]
