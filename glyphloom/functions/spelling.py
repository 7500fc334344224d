"""The words of distinct units, a batch at a time: what ``opcodes.with_opcodes`` and ``opcodes.words`` give.

Only units with capitals, characters beyond ASCII, runs or repeats have operators; the
others are their own word and stay where they are.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glyphloom.functions import patterns as p
from glyphloom.functions import repeats
from glyphloom.session import small_table

_CAPITALS: dict[str, Broadcast] = {}


def capitals(spark: SparkSession) -> Broadcast:
    """Capital letters that can be lowered and raised again, by Spark's own functions, with their lower case; and the marks' table."""
    from glyphloom.functions import opcodes as oc   # its functions of columns can't travel to tasks, as this module does
    key = spark.sparkContext.applicationId
    if key not in _CAPITALS:
        points = [i for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
        texts = small_table(spark, [("".join(map(chr, points[i:i + 8192])),) for i in range(0, len(points), 8192)], "s string")
        letters = texts.select(F.explode(F.split("s", "")).alias("c")).filter(oc.is_capital(F.col("c")))
        _CAPITALS[key] = spark.sparkContext.broadcast((
            {r.c: r.low for r in letters.select("c", F.lower("c").alias("low")).collect()}, oc._mark_table()))
    return _CAPITALS[key]


def _rendered(code: int, params) -> str:
    return chr(code) + "".join(chr(p.PARAM_BASE + x) for x in params)


def _body(text: str, capitalize: bool, serialize: bool, lower: dict, table: dict) -> list[str]:
    """Operators of marks and of capitals, then the base."""
    reach = p.PARAM_MAX + 1
    if serialize and not text.isascii():
        text = text[:reach].translate(table) + text[reach:]
        clusters = re.findall(p.CLUSTER, text)
    else:
        clusters = list(text)
    marks, shifts, base = [], [], clusters[reach:]
    for i in range(min(len(clusters), reach) - 1, -1, -1):
        c = clusters[i]
        if len(c) > 1:
            marks[:0] = [_rendered(p.MARK_OPS[m][1], (i,)) for m in c[1:]]
            c = c[0]
        if capitalize and c in lower:
            shifts.append(_rendered(p.CAPITALIZE, (i,)))
            c = lower[c]
        clusters[i] = c
    return [*marks, *shifts[::-1], "".join(clusters[:reach] + base)]


def words(pieces: pa.Array, runs: np.ndarray, config, lower: dict, table: dict) -> pa.ListArray:
    """The words of every unit under one configuration."""
    if not config.factored:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(pieces) + 1, dtype=np.int32)), pieces)
    sizes = pc.utf8_length(pieces)
    wide = pc.greater(pc.binary_length(pieces), sizes)
    raw = pc.and_(wide, pc.match_substring_regex(pieces, r"[\x{E000}-\x{F8FF}]"))
    rich = pc.and_(pc.invert(raw), pc.or_(wide, pc.match_substring_regex(pieces, "[A-Z]"))) if (
        config.capitalize or config.serialize) else pa.array(np.zeros(len(pieces), bool))
    folds: list = [None] * len(pieces)
    if config.repeat:
        some = np.flatnonzero(pc.and_(pc.invert(raw), pc.greater_equal(sizes, 3)).to_numpy(zero_copy_only=False))
        for row, found in repeats.segments(pieces.take(pa.array(some))).items():
            folds[some[row]] = found
    touched = rich.to_numpy(zero_copy_only=False) | np.array([x is not None for x in folds], bool)
    if config.repeat:
        touched |= runs > 1
    at = np.flatnonzero(touched)
    made, counts = [], np.ones(len(pieces), np.int64)
    full = rich.to_numpy(zero_copy_only=False)
    for row, piece in zip(at.tolist(), pieces.take(pa.array(at)).to_pylist()):
        own, text = [], piece
        if config.repeat and runs[row] > 1:
            n = int(runs[row])
            own.append(_rendered(p.REPEAT, (0, n)) if len(piece) == 1 else _rendered(p.MULTIREPEAT, (0, len(piece), n)))
        if folds[row] is not None:
            text, ops = repeats.folded(piece, folds[row])
            own += [_rendered(o["op"], o["params"]) for o in ops]
        own += _body(text, config.capitalize, config.serialize, lower, table) if full[row] else [text]
        if not config.split_operators:
            own = ["".join(own)]
        counts[row] = len(own)
        made += own
    # a unit's words are its own made ones, or the unit itself
    ends = np.cumsum(counts)
    source = np.repeat(np.arange(len(pieces)), counts)
    source[np.repeat(touched, counts)] = len(pieces) + np.arange(len(made))
    values = pa.concat_arrays([pieces, pa.array(made, pa.string())]).take(pa.array(source))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), values)
