"""Pre-tokenizers: text -> ordered array of pieces."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphloom.functions import patterns as p
from glyphloom.functions import text as t


def _all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def split_pieces(text: Column) -> Column:
    """Newline runs, tab runs, single spaces, punctuation runs, and the rest."""
    return _all_matches(text, p.SPLIT_PIECE)


def llama_pieces(text: Column) -> Column:
    return _all_matches(text, p.LLAMA_PIECE)


def metaspace_pieces(text: Column) -> Column:
    """Spaces become the metaspace mark, which opens each piece."""
    return _all_matches(t.to_metaspace(text), p.METASPACE_PIECE)


def whitespace_pieces(text: Column) -> Column:
    """Word runs and symbol runs; white space is dropped, so this one is lossy."""
    return _all_matches(text, p.WHITESPACE_PIECE)


def then(pieces: Column, pattern: str) -> Column:
    """Apply a further pre-tokenizer to each piece."""
    return F.flatten(F.transform(pieces, lambda x: _all_matches(x, pattern)))


def metaspace_split_pieces(text: Column) -> Column:
    return then(metaspace_pieces(text), p.SPLIT_PIECE)


def metaspace_whitespace_pieces(text: Column) -> Column:
    return then(metaspace_pieces(text), p.WHITESPACE_PIECE)


PRE_TOKENIZERS = {
    "split": split_pieces,
    "llama": llama_pieces,
    "metaspace": metaspace_pieces,
    "metaspace_split": metaspace_split_pieces,
    "metaspace_whitespace": metaspace_whitespace_pieces,
    "whitespace": whitespace_pieces,
}


def collapse_piece_runs(pieces: Column) -> Column:
    """Array of ``(piece, run)``: 3..255 equal neighbours become one entry.

    Works inside the row, from the indices at which a new run starts, so no
    occurrence is shuffled. Shorter and longer runs stay one entry per piece.
    """

    def runs(ps: Column) -> Column:
        n = F.size(ps)
        heads = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | (F.get(ps, i) != F.get(ps, i - 1)),
        )
        return t.let(heads, lambda hs: F.transform(hs, lambda h, k: F.struct(
            F.get(ps, h).alias("piece"),
            (F.coalesce(F.get(hs, k + 1), n) - h).alias("run"),
        )))

    def spread(rs: Column) -> Column:
        return F.flatten(F.transform(rs, lambda r: F.when(
            (r["run"] >= 3) & (r["run"] <= p.PARAM_MAX) & (F.length(r["piece"]) <= p.PARAM_MAX),
            F.array(r),
        ).otherwise(F.array_repeat(
            F.struct(r["piece"].alias("piece"), F.lit(1).alias("run")), r["run"]))))

    def has_run(ps: Column) -> Column:
        return (F.size(ps) > 2) & F.exists(
            F.sequence(F.lit(2), F.greatest(F.size(ps) - 1, F.lit(2))),
            lambda i: (F.get(ps, i) == F.get(ps, i - 1)) & (F.get(ps, i) == F.get(ps, i - 2)))

    return t.let(pieces, lambda ps: F.when(has_run(ps), spread(runs(ps))).otherwise(single_units(ps)))


def single_units(pieces: Column) -> Column:
    """Array of ``(piece, run)`` with every run 1."""
    return F.transform(pieces, lambda x: F.struct(x.alias("piece"), F.lit(1).alias("run")))


def running_sum(values: Column, chunk: int = 64) -> Column:
    """Exclusive prefix sums of an int array, in chunks so that appends stay short."""
    state = F.expr("CAST(named_struct('total', 0, 'before', array()) AS struct<total:int,before:array<int>>)")

    def scan(xs: Column) -> Column:
        return F.aggregate(xs, state, lambda acc, x: F.struct(
            (acc["total"] + x).alias("total"),
            F.array_append(acc["before"], acc["total"]).alias("before")))

    def chunked(vs: Column) -> Column:
        heads = F.sequence(F.lit(1), F.size(vs), F.lit(chunk))
        parts = F.transform(heads, lambda h: scan(F.slice(vs, h, F.lit(chunk))))
        return t.let(parts, lambda ps: F.flatten(F.zip_with(
            ps, scan(F.transform(ps, lambda x: x["total"]))["before"],
            lambda x, base: F.transform(x["before"], lambda b: b + base))))

    empty = F.array().cast("array<int>")
    return t.let(values, lambda vs: F.when(F.size(vs) > 0, chunked(vs)).otherwise(empty))


def piece_offsets(pieces: Column) -> Column:
    """Array of ``(start, end, piece)`` with character offsets into the text."""
    return t.let(pieces, lambda ps: F.zip_with(
        running_sum(F.transform(ps, F.length)), ps,
        lambda s, x: F.struct(s.alias("start"), (s + F.length(x)).alias("end"), x.alias("piece"))))
