"""Normalisation and string scalar columns."""

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from glyphloom.functions import patterns as p


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    Without the binding, a lambda that refers to a computed column re-evaluates
    that column for every element it visits.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def materialize(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps read many times but the plan computes once.

    A one-row generator keeps the optimizer from inlining the expressions into
    every place that uses them.
    """
    return df.select("*", F.inline(F.array(F.struct(
        *[c.alias(name) for name, c in columns.items()]))))


def is_nonblank(text: Column) -> Column:
    """Has a character that is not Unicode white space."""
    return text.isNotNull() & F.regexp_like(text, F.lit(r"(?U)\S"))


def strip_newline_tab(text: Column) -> Column:
    return F.translate(text, "\n\t", "")


def chars(text: Column) -> Column:
    """Code points of ``text``; an empty string has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


_BORDERS = "\n\x00\x01\x02\x03\x04\x05\x06\x07\x0b\x0c\x0e\x0f\x10\x11\x12"


def nfc_array(texts: pa.Array) -> pa.Array:
    """NFC of all strings of an array in one go.

    Strings are joined by a control character that none of them holds. No such
    character ever composes or is reordered, so the whole is normal where its parts are.
    """
    filled = texts.fill_null("")
    border = next((c for c in _BORDERS if not pc.any(pc.match_substring(filled, c)).as_py()), None)
    if border is None or not len(texts):    # every border occurs in the text
        return pa.array([x and unicodedata.normalize("NFC", x) for x in texts.to_pylist()], pa.string())
    whole = pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], filled), border)[0].as_py()
    parts = pc.split_pattern(pa.array([unicodedata.normalize("NFC", whole)]), border).flatten()
    return pc.if_else(texts.is_valid(), parts, None)


@F.arrow_udf(StringType())
def _nfc(s: pa.Array) -> pa.Array:
    # Arrow's own kernel leaves decomposed letters apart under NFC.
    return nfc_array(s)


@F.arrow_udf(ArrayType(StringType()))
def _nfc_each(s: pa.Array) -> pa.Array:
    done = nfc_array(s.flatten())
    sizes = s.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), done)


@F.arrow_udf(StringType())
def _nfd(s: pa.Array) -> pa.Array:
    return pc.utf8_normalize(s, form="NFD")


def may_compose(text: Column) -> Column:
    """Whether NFC could change the text: it is not ASCII, and goes on after its inert beginning.

    The beginning is taken by one greedy loop; a search for a character of the complement
    starts the regex engine afresh at every character and takes fifteen times as long.
    """
    return (F.octet_length(text) > F.length(text)) & F.regexp_like(
        text, F.lit(rf"\A[{p.NFC_INERT}]*+[^{p.NFC_INERT}]"))


def nfc(text: Column) -> Column:
    """Unicode NFC. Spark has no built-in; only rows that can change reach Python."""
    may_change = may_compose(text)
    return F.coalesce(_nfc(F.when(may_change, text)), text)


def nfc_each(texts: Column) -> Column:
    """NFC of every string of an array; nulls in it stay null."""
    may_change = F.transform(texts, lambda x: F.when(may_compose(x), x))
    return F.zip_with(_nfc_each(may_change), texts, lambda done, x: F.coalesce(done, x))


def nfd(text: Column) -> Column:
    """Unicode NFD; rows of ASCII text are sent to Python as nulls."""
    may_change = F.regexp_like(text, F.lit(r"[^\x00-\x7F]"))
    return F.coalesce(_nfd(F.when(may_change, text)), text)


def strip_pua(text: Column) -> Column:
    """Drop opcode characters of the vocabulary range U+E000-U+F0FF."""
    return F.regexp_replace(text, f"[{p.PUA_VOCAB}]", "")


def strip_pua_wide(text: Column) -> Column:
    """Drop the wider range U+E000-U+F8FF, as used on generated text."""
    return F.regexp_replace(text, f"[{p.PUA_WIDE}]", "")


def is_pua_only(token: Column) -> Column:
    return F.regexp_like(token, F.lit(f"^[{p.PUA_VOCAB}]+$"))


def keep_alphanumeric(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def collapse_repeats(text: Column) -> Column:
    """Runs of three or more equal characters become one; pairs stay."""
    return F.regexp_replace(text, r"(?s)(.)\1{2,}", "$1")


def concept_key(token: Column) -> Column:
    """The root a token stands for: no opcodes, case, marks, punctuation or runs."""
    return collapse_repeats(keep_alphanumeric(nfd(F.lower(strip_pua(token)))))


def to_metaspace(text: Column) -> Column:
    return F.translate(text, " ", p.METASPACE)


def from_metaspace(text: Column) -> Column:
    return F.translate(text, p.METASPACE, " ")


def fuse(tokens: Column) -> Column:
    return F.array_join(tokens, "")
