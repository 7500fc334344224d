"""Reversible orthographic operators on single pieces.

An encoded piece is ``[operator][parameter...]... base``. Operators are undone
right to left: case first, then marks, then repetition. Positions are character
positions in the piece as it stands when the operator is undone.

Choices the format leaves open, made here so that every piece survives a round
trip: positions ascend inside each operator kind; several marks on one character
are written in their canonical order; a character is lowered only if upper-casing
the result gives it back; a character whose canonical form holds a mark outside
the supported set is left alone; text that already holds private-use characters
is passed through as ``raw``.
"""

import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from glyphloom.functions import patterns as p
from glyphloom.functions import repeats
from glyphloom.functions import text as t

OPS_TYPE = "array<struct<op:int,params:array<int>>>"
_PARTS = StructType([StructField("text", StringType()), StructField("ops", ArrayType(StructType([
    StructField("op", IntegerType()), StructField("params", ArrayType(IntegerType()))])))])


def _no_ops() -> Column:
    return F.array().cast(OPS_TYPE)


def _op(code, *params: Column) -> Column:
    code = code if isinstance(code, Column) else F.lit(code)
    return F.struct(code.cast("int").alias("op"),
                    F.array(*[x.cast("int") for x in params]).alias("params"))


@lru_cache(1)
def _mark_table() -> dict[int, str]:
    """Composed character -> base and supported marks, derived from Unicode data once a process."""
    table = {}
    for cp in range(0xC0, 0x2200):  # no such character lies above
        full = unicodedata.normalize("NFD", chr(cp))
        if len(full) > 1 and all(m in p.MARK_OPS for m in full[1:]):
            table[cp] = full
    return table


@F.pandas_udf(StringType())
def _split_marks(s: pd.Series) -> pd.Series:
    # Positions past PARAM_MAX cannot be addressed, so the tail stays composed.
    reach, table = p.PARAM_MAX + 1, _mark_table()
    return s.map(lambda x: x[:reach].translate(table) + x[reach:], na_action="ignore")


def _beyond_ascii(text: Column) -> Column:
    return F.octet_length(text) > F.length(text)


def has_pua(text: Column) -> Column:
    return _beyond_ascii(text) & F.regexp_like(text, F.lit(f"[{p.PUA_WIDE}]"))


@F.arrow_udf(_PARTS)
def _repeat_parts(pieces: pa.Array) -> pa.Array:
    return repeats.parts(pieces)


def is_capital(ch: Column) -> Column:
    """Upper-case, and lowering it can be undone."""
    low = F.lower(ch)
    return (ch != low) & (F.length(low) == 1) & (F.upper(low) == ch)


def _mark_code(mark: Column) -> Column:
    code = F.lit(None).cast("int")
    for char, (_, op) in p.MARK_OPS.items():
        code = F.when(mark == char, F.lit(op)).otherwise(code)
    return code


def _base_and_ops(clusters: Column, capitalize: Column) -> Column:
    """``(base, ops)`` from one entry per character, marks trailing their character."""
    def letter(c: Column, i: Column) -> Column:
        return F.when(i <= p.PARAM_MAX, F.substring(c, 1, 1)).otherwise(c)

    def lowers(c: Column, i: Column) -> Column:
        return capitalize & (i <= p.PARAM_MAX) & is_capital(letter(c, i))

    marks = F.flatten(F.transform(clusters, lambda c, i: F.when(
        (F.length(c) > 1) & (i <= p.PARAM_MAX),
        F.transform(F.split(F.substring(c, F.lit(2), F.length(c)), ""),
                    lambda m: _op(_mark_code(m), i)),
    ).otherwise(_no_ops())))
    capitals = F.filter(F.transform(clusters, lambda c, i: F.when(lowers(c, i), i)),
                        lambda i: i.isNotNull())
    base = F.transform(clusters, lambda c, i: F.when(
        lowers(c, i), F.lower(letter(c, i))).otherwise(letter(c, i)))
    ops = F.concat(marks, F.transform(capitals, lambda i: _op(p.CAPITALIZE, i)))
    return F.struct(F.array_join(base, "").alias("base"), ops.cast(OPS_TYPE).alias("ops"))


def render_op(op: Column) -> Column:
    """Private-use rendering of one operator with its parameters."""
    numbers = F.lit([chr(p.PARAM_BASE + i) for i in range(p.PARAM_MAX + 1)])
    name = F.lit(None).cast("string")
    for code in p.OP_NAMES:
        name = F.when(op["op"] == code, F.lit(chr(code))).otherwise(name)
    return F.concat(name, F.array_join(F.transform(op["params"], lambda x: F.get(numbers, x)), ""))


def op_name(code: Column) -> Column:
    name = F.lit(None).cast("string")
    for value, label in p.OP_NAMES.items():
        name = F.when(code == value, F.lit(label)).otherwise(name)
    return name


def run_op(piece: Column, run: Column) -> Column:
    """Operators that expand a piece to ``run`` neighbouring copies of itself."""
    size = F.length(piece)
    one = F.when(size == 1, _op(p.REPEAT, F.lit(0), run)).otherwise(
        _op(p.MULTIREPEAT, F.lit(0), size, run))
    return F.when(run > 1, F.array(one)).otherwise(_no_ops())


def _flag(value: bool | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def with_opcodes(df: DataFrame, capitalize: bool | Column, repeat: bool | Column,
                 serialize: bool | Column, piece: str = "piece",
                 run: str | None = None) -> DataFrame:
    """Add ``base``, ``ops`` and ``raw`` to a table of (distinct) NFC pieces.

    The flags may be columns, so that all configurations pass through one plan.
    """
    capitalize, repeat, serialize = _flag(capitalize), _flag(repeat), _flag(serialize)
    text = F.col(piece)
    whole = F.struct(text.alias("text"), _no_ops().alias("ops"))
    df = t.materialize(df, raw=has_pua(text))
    # Three equal characters, or three copies of two: nothing shorter can fold.
    df = df.withColumn("_rep", _repeat_parts(F.when(repeat & ~F.col("raw") & (F.length(text) >= 3), text)))
    df = df.withColumn("_rep", F.coalesce("_rep", whole))
    folded = F.col("_rep.text")
    touched = serialize & ~F.col("raw") & _beyond_ascii(folded)
    df = df.withColumn("_split", _split_marks(F.when(touched, folded)))
    df = t.materialize(df, _marked=F.coalesce("_split", folded))
    # Lower-case ASCII has nothing to factor; most pieces take the short exit.
    rich = ~F.col("raw") & (capitalize | serialize) & (
        _beyond_ascii(folded) | F.regexp_like(folded, F.lit("[A-Z]")))
    clusters = F.when(
        serialize, F.regexp_extract_all(F.col("_marked"), F.lit(p.CLUSTER), F.lit(0))
    ).otherwise(t.chars(folded))
    df = t.materialize(df, _body=F.when(
        rich, t.let(clusters, lambda cs: _base_and_ops(cs, capitalize))
    ).otherwise(F.struct(folded.alias("base"), _no_ops().alias("ops"))))
    outer = F.when(repeat, run_op(text, F.col(run))).otherwise(_no_ops()) if run else _no_ops()
    return df.withColumns({
        "base": F.col("_body.base"),
        "ops": F.concat(outer, F.col("_rep.ops"), F.col("_body.ops")),
    }).drop("_rep", "_split", "_marked", "_body")


def op_strings(ops: Column) -> Column:
    return F.transform(ops, render_op)


def encoded(ops: Column, base: Column) -> Column:
    return F.concat(F.array_join(op_strings(ops), ""), base)


def words(ops: Column, base: Column, split_operators: bool | Column = True) -> Column:
    """Pieces the vocabulary sees: operators apart from the base, or fused to it."""
    return F.when(_flag(split_operators), F.concat(op_strings(ops), F.array(base))).otherwise(
        F.array(encoded(ops, base)))


# --- decoding ----------------------------------------------------------------

def _parse(unit: Column) -> Column:
    """``(ops, base)`` of one encoded piece; operators are the leading ones only."""
    tokens = F.regexp_extract_all(unit, F.lit(r"\G" + p.OP_TOKEN), F.lit(0))
    return t.let(tokens, lambda ts: F.struct(
        F.transform(ts, lambda x: F.struct(
            F.ascii(x).alias("op"),
            F.transform(F.slice(F.split(x, ""), 2, 3),
                        lambda c: F.ascii(c) - p.PARAM_BASE).alias("params"))).alias("ops"),
        F.substring(unit, F.length(F.array_join(ts, "")) + 1, F.length(unit)).alias("base")))


def _splice(s: Column, start: Column, end: Column, middle: Column) -> Column:
    return F.concat(F.substring(s, F.lit(1), start), middle, F.substring(s, end + 1, F.length(s)))


def _undo_shape(s: Column, op: Column) -> Column:
    at = F.get(op["params"], F.lit(0))
    ch = F.substring(s, at + 1, F.lit(1))
    up = F.upper(ch)
    mark = F.lit(None).cast("string")
    for char, (_, code) in p.MARK_OPS.items():
        mark = F.when(op["op"] == code, F.lit(char)).otherwise(mark)
    shaped = F.when((op["op"] == p.CAPITALIZE) & (F.length(up) == 1), up).when(
        mark.isNotNull(), F.concat(ch, mark))
    return F.when(at < F.length(s), F.coalesce(_splice(s, at, at + 1, shaped), s)).otherwise(s)


def _undo_repeat(s: Column, op: Column) -> Column:
    ps = op["params"]
    start = F.get(ps, F.lit(0))
    multi = op["op"] == p.MULTIREPEAT
    end = F.when(multi, F.get(ps, F.lit(1))).otherwise(start + 1)
    n = F.when(multi, F.get(ps, F.lit(2))).otherwise(F.get(ps, F.lit(1)))
    copy = F.repeat(F.substring(s, start + 1, end - start), n)
    known = op["op"].isin(p.REPEAT, p.MULTIREPEAT)
    valid = known & n.isNotNull() & (start < end) & (end <= F.length(s))
    return F.when(valid, _splice(s, start, end, copy)).otherwise(s)


def with_decoded(df: DataFrame, encoded_col: str, out: str = "decoded") -> DataFrame:
    """Undo the operators of one encoded piece per row.

    Case and marks first, composition to NFC, then repetition. Operators whose
    position is out of range, or that do not fit their target, change nothing.
    """
    df = t.materialize(df, _p=_parse(F.col(encoded_col)))
    df = t.materialize(df, _shaped=F.aggregate(
        F.reverse(F.filter(F.col("_p.ops"), lambda o: o["op"] < p.REPEAT)),
        F.col("_p.base"), _undo_shape))
    df = df.withColumn("_nfc", t.nfc(F.col("_shaped")))
    df = t.materialize(df, **{out: F.aggregate(
        F.reverse(F.filter(F.col("_p.ops"), lambda o: o["op"] >= p.REPEAT)),
        F.when(F.size("_p.ops") > 0, F.col("_nfc")).otherwise(F.col("_shaped")), _undo_repeat)})
    return df.drop("_p", "_shaped", "_nfc")


def with_decoded_text(df: DataFrame, stream: str, out: str) -> DataFrame:
    """Undo the operators of a whole token stream where it lies.

    Each operator prefix governs the text up to the next prefix; only such stretches
    are parsed, the others are taken as they are.
    """
    shape = F.transform(encoded_units(F.col(stream)), lambda u: F.when(
        F.regexp_like(u, F.lit(f"^{p.OP_TOKEN}")), _parse(u)).otherwise(
        F.struct(_no_ops().alias("ops"), u.alias("base"))))
    df = t.materialize(df, _p=shape)
    df = t.materialize(df, _shaped=F.transform("_p", lambda x: F.when(F.size(x["ops"]) > 0, F.aggregate(
        F.reverse(F.filter(x["ops"], lambda o: o["op"] < p.REPEAT)), x["base"], _undo_shape))))
    df = df.withColumn("_nfc", t.nfc_each(F.col("_shaped")))
    done = F.zip_with("_p", "_nfc", lambda x, s: F.when(s.isNull(), x["base"]).otherwise(F.aggregate(
        F.reverse(F.filter(x["ops"], lambda o: o["op"] >= p.REPEAT)), s, _undo_repeat)))
    return t.materialize(df, **{out: F.array_join(done, "")}).drop("_p", "_shaped", "_nfc")


def decodable(stream: Column) -> Column:
    """Whether a token stream holds whole operators only: each with its parameters, and no parameter alone."""
    return ~F.regexp_like(F.regexp_replace(stream, p.WHOLE_OP, ""), F.lit(r"[\uE000-\uEFFF]"))


def with_decoded_or_joined(df: DataFrame, tokens: str, out: str) -> DataFrame:
    """The text of a token array, or, where its stream can't be decoded, the raw tokens joined by spaces."""
    fused = t.fuse(F.col(tokens))
    df = with_decoded_text(df.withColumn("_stream", F.when(decodable(fused), fused)), "_stream", "_undone")
    return df.withColumn(out, F.coalesce("_undone", F.array_join(tokens, " "))).drop("_stream", "_undone")


def encoded_units(text: Column) -> Column:
    """Cut a decoded token stream into operator prefixes with the text they govern."""
    return F.regexp_extract_all(text, F.lit(p.ENCODED_UNIT), F.lit(0))
