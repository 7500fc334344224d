"""Piece tables and counts. Texts are cut where they lie, a batch at a time; only counts are shuffled."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from glyphloom.functions import cutting as cu
from glyphloom.functions import patterns as p
from glyphloom.functions import text as t
from glyphloom.functions.memory import lean, slim, small_batches, together
from glyphloom.functions.wordtable import buckets_of
from glyphloom.operators.configs import CATALOGUE

ROWS_PACKED = 1 << 18       # rows that a task packs or hands on at once
BYTES_A_BUCKET = 8 << 20    # of input, for each bucket of packed rows

def normalized(corpus: DataFrame) -> DataFrame:
    """NFC text, the input of every configuration."""
    return corpus.withColumn("text", t.nfc(F.col("text")))


def _mapped(corpus: DataFrame, added: str, work, lines: bool = False, kept=None) -> DataFrame:
    """``kept`` columns of ``corpus`` and what ``work`` adds to each slice of a batch.

    ``work(texts, part)`` yields the added arrays of a slice, as often as its rows are to come.
    """
    small_batches(corpus.sparkSession)
    known = cu.kinds(corpus.sparkSession)
    kept = [c for c in corpus.columns if c != "text"] if kept is None else list(kept)
    schema = T.StructType([corpus.schema[c] for c in kept] + T.StructType.fromDDL(added).fields)
    names = [f.name for f in schema]

    def run(batches):
        for batch in batches:
            for part in cu.slices(batch):
                for arrays in work(cu.Texts(part.column("text"), known.value, lines), part):
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *arrays], names=names)

    return corpus.select(*dict.fromkeys([*kept, "text"])).mapInArrow(lean(run), schema)


def _named(name: str, part) -> pa.Array:
    return pa.array([name] * part.num_rows, pa.string())


def piece_arrays(corpus: DataFrame, pre_tokenizers) -> DataFrame:
    """One row per document and pre-tokenizer: ``(label, doc_id, text, pre_tokenizer, pieces)``."""
    def work(texts, part):
        for name in pre_tokenizers:
            cut = texts.cut(name)
            yield [_named(name, part), cu.listed(cut.pieces.cast(pa.string()), cut.rows, part.column("text").is_valid())]

    return _mapped(corpus, "pre_tokenizer string, pieces array<string>", work, kept=("label", "doc_id", "text"))


def piece_sizes(corpus: DataFrame, pre_tokenizers, ends: bool = True) -> DataFrame:
    """``(label, doc_id, pre_tokenizer, n_chars, pieces, chars, first_piece, last_piece)``: what pieces of a document add up to.

    ``n_chars`` is the length of the text, ``chars`` that of its pieces; all are null for a null text.
    Without ``ends`` there is no first and last piece, and no piece is spelled out.
    """
    def work(texts, part):
        null = part.column("text").is_null().to_numpy(zero_copy_only=False)
        for name in pre_tokenizers:
            cut = texts.cut(name)
            n = np.bincount(cut.rows, minlength=part.num_rows)
            chars = np.bincount(cut.rows, cut.lengths, part.num_rows).astype(np.int64)
            last = np.cumsum(n)
            ids = [pa.array(x, pa.int64(), mask=n == 0) for x in (last - n, last - 1)] if ends else ()
            yield [_named(name, part), pa.array(np.diff(texts.heads).astype(np.int32), mask=null),
                         pa.array(n.astype(np.int32), mask=null), pa.array(chars, mask=null),
                         *(cut.pieces.take(x).cast(pa.string()) for x in ids)]

    return _mapped(corpus, "pre_tokenizer string, n_chars int, pieces int, chars bigint"
                   + (", first_piece string, last_piece string" if ends else ""), work, kept=("label", "doc_id"))


def pieces_long(corpus: DataFrame, pre_tokenizers) -> DataFrame:
    """One row per piece, in order."""
    return piece_arrays(corpus, pre_tokenizers).select(
        "label", "doc_id", "pre_tokenizer", F.posexplode("pieces").alias("pos", "piece"))


def _group_ids(part, by) -> tuple[np.ndarray, np.ndarray]:
    """The group of every row, and one row of each group."""
    code = np.zeros(part.num_rows, np.int64)
    for name in by:
        kinds = part.column(name).dictionary_encode("encode")
        code = code * len(kinds.dictionary) + kinds.indices.to_numpy(zero_copy_only=False)
        _, code = np.unique(code, return_inverse=True)
    _, rows, code = np.unique(code, return_index=True, return_inverse=True)
    return code, rows


def _present(gid: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of group and code that occur, as one number each, and which of them every unit is."""
    key = gid * size + code
    most = int(key.max()) + 1 if len(key) else 0
    if most > 4 * len(key) + 1024:      # few units of many: sorting them takes less than a table
        return np.unique(key, return_inverse=True)
    there = np.zeros(most, bool)
    there[key] = True
    kinds = np.flatnonzero(there)
    number = np.zeros(most, np.int64)
    number[kinds] = np.arange(len(kinds))
    return kinds, number[key]


def _added_up(corpus: DataFrame, by, keys: str, sums: str, work, lines: bool = False, beside=(),
              packed: str | None = None) -> DataFrame:
    """Sums per ``by`` and keys: first those of some megabytes of text, then of a task, then by shuffle.

    Rows of a group are cut together, so that what they share is summed before it leaves Python.
    ``work(texts, part)``, whose ``part`` also holds the columns ``beside``, yields, for each name of a stream, its units: (name, row of each unit, key arrays of the
    distinct units, code of each unit, numbers a unit). Columns that start with ``last_`` are largest numbers. With ``packed``, a key
    that most rows have to themselves, rows are shuffled and added up in blocks and not one by one.
    """
    small_batches(corpus.sparkSession)
    known = cu.kinds(corpus.sparkSession)
    schema = T.StructType([corpus.schema[c] for c in by] + T.StructType.fromDDL(f"{keys}, {sums}").fields)
    names, values = [f.name for f in schema], [f.name for f in T.StructType.fromDDL(sums)]
    total = [(c, "max" if c.startswith("last_") else "sum") for c in values]

    def run(batches):
        for batch in cu.gathered(batches):
            batch = batch.take(pa.array(np.argsort(_group_ids(batch, by)[0], kind="stable")))
            for part in cu.slices(batch):
                gid, rows = _group_ids(part, by)
                for name, owner, uniques, code, numbers in work(cu.Texts(part.column("text"), known.value, lines), part):
                    size = len(uniques[0]) if uniques else 1
                    kinds, where = _present(gid[owner], code, size)
                    own = part.select(list(by)).take(pa.array(rows[kinds // size] if size else kinds))
                    unit = pa.array(kinds % size if size else kinds)
                    added = []
                    for (_, how), x in zip(total, numbers):
                        if how == "max":
                            out = np.zeros(len(kinds), np.int64)
                            np.maximum.at(out, where, x)
                        else:
                            out = np.bincount(where, x, len(kinds)).astype(np.int64)
                        added.append(pa.array(out))
                    yield pa.RecordBatch.from_arrays(
                        [*(own.column(c) for c in by), pa.array([name] * len(kinds), pa.string()),
                         *(u.take(unit) for u in uniques), *added], names=names)

    source = corpus.select(*by, *beside, "text")
    if packed:
        return _block_sums(source, run, schema, packed, total)
    found = source.mapInArrow(lean(run), schema)
    return found.groupBy(*[c for c in names if c not in values]).agg(*[getattr(F, how)(c).alias(c) for c, how in total])


def _blocks(run, key: str, buckets: int):
    """What ``run`` makes, as blocks of rows of a bucket, told by the beginning and the length of ``key``."""
    def pack(batches):
        for rows in together(run(batches), ROWS_PACKED):
            bucket = buckets_of(rows.column(key), buckets)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows.take(pa.array(order)), bucket[order]
            heads = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            blocks = [rows.slice(a, b - a).serialize().to_pybytes() for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[heads].astype(np.int32)), pa.array([len(x) for x in blocks], pa.int32()),
                 pa.array([pa.compress(x, "zstd", asbytes=True) for x in blocks], pa.binary())], names=["bucket", "size", "block"])
    return pack


def _block_sums(source: DataFrame, run, schema: T.StructType, key: str, total) -> DataFrame:
    """Sums of the rows that ``run`` makes: buckets of packed rows are shuffled, and a bucket is added up in one go.

    The larger the input, the more buckets there are, so that none holds more than its share.
    """
    spark = source.sparkSession
    most = source.rdd.getNumPartitions() * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-most // BYTES_A_BUCKET))
    arrow = to_arrow_schema(schema)
    keys = [f.name for f in schema if f.name not in dict(total)]

    def summed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        found = pa.Table.from_batches(parts).group_by(keys, use_threads=False).aggregate(total)
        return pa.Table.from_arrays([found.column(c if c in keys else f"{c}_{dict(total)[c]}").cast(arrow.field(c).type) for c in arrow.names],
                                    schema=arrow).combine_chunks().to_batches()[0]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, least = [], 0, ROWS_PACKED
        for batch in batches:
            for raw, block in zip(batch.column("size").to_pylist(), batch.column("block")):
                parts.append(pa.ipc.read_record_batch(pa.decompress(block.as_buffer(), raw, "zstd"), arrow))
                size += parts[-1].num_rows
                if size > 2 * least:
                    parts = [summed(parts)]
                    size = least = parts[0].num_rows
                    least = max(least, ROWS_PACKED)
        whole = summed(parts)
        for at in range(0, whole.num_rows, ROWS_PACKED):
            yield whole.slice(at, ROWS_PACKED)
        del parts, whole
        slim()

    blocks = source.mapInArrow(lean(_blocks(run, key, buckets)), "bucket int, size int, block binary")
    return blocks.groupBy("bucket").applyInArrow(add, schema)


def _coded(cut: cu.Cut) -> tuple[pa.Array, np.ndarray]:
    """Distinct pieces, and the code of each piece."""
    codes = cut.pieces.dictionary_encode()
    return codes.dictionary.cast(pa.string()), codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def piece_counts(corpus: DataFrame, pre_tokenizers, by=("label",)) -> DataFrame:
    """Occurrences per distinct piece. Frequent pieces are summed before the shuffle."""
    def work(texts, _):
        for name in pre_tokenizers:
            cut = texts.cut(name)
            pieces, code = _coded(cut)
            yield name, cut.rows, [pieces], code, [np.ones(len(code))]

    return _added_up(corpus, by, "pre_tokenizer string, piece string", "n bigint", work)


def piece_shares(corpus: DataFrame, pre_tokenizers, held: str, by=("label",)) -> DataFrame:
    """Occurrences per distinct piece in rows that are not ``held`` and in those that are: ``(n_train, n_valid)``."""
    def work(texts, part):
        valid = part.column(held).to_numpy(zero_copy_only=False).astype(np.int64)
        for name in pre_tokenizers:
            cut = texts.cut(name)
            pieces, code = _coded(cut)
            yield name, cut.rows, [pieces], code, [1 - valid[cut.rows], valid[cut.rows]]

    return _added_up(corpus, by, "pre_tokenizer string, piece string", "n_train bigint, n_valid bigint", work, beside=(held,),
                     packed="piece")


def piece_totals(corpus: DataFrame, pre_tokenizers, by=("label",)) -> DataFrame:
    """Characters and pieces per pre-tokenizer, ``(*by, pre_tokenizer, chars, tokens)``: no piece is moved."""
    def work(texts, _):
        for name in pre_tokenizers:
            cut = texts.cut(name)
            yield name, cut.rows, [], np.zeros(len(cut.rows), np.int64), [cut.lengths, np.ones(len(cut.rows))]

    return _added_up(corpus, by, "pre_tokenizer string", "chars bigint, tokens bigint", work)


def piece_spans(corpus: DataFrame, pre_tokenizers, by=("label",)) -> DataFrame:
    """Sums of character offsets per distinct piece: ``(n, sum_start, sum_end, last_end)``."""
    def work(texts, _):
        for name in pre_tokenizers:
            cut = texts.cut(name)
            pieces, code = _coded(cut)
            ends = cut.starts + cut.lengths
            yield name, cut.rows, [pieces], code, [np.ones(len(code)), cut.starts, ends, ends]

    return _added_up(corpus, by, "pre_tokenizer string, piece string",
                     "n bigint, sum_start bigint, sum_end bigint, last_end bigint", work)


def alphabet(counts: DataFrame, by=("label",), word: str = "piece") -> DataFrame:
    """Distinct characters with their occurrences, from distinct pieces."""
    return (counts.select(*by, F.explode(t.chars(F.col(word))).alias("ch"), "n")
            .groupBy(*by, "ch").agg(F.sum("n").alias("n")))


def pair_counts(counts: DataFrame, by=("label",), word: str = "piece") -> DataFrame:
    """Occurrences of adjacent symbols, from distinct pieces cut to characters."""
    symbols = t.chars(F.col(word))
    pairs = t.let(symbols, lambda s: F.when(F.size(s) > 1, F.zip_with(
        F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1),
        lambda a, b: F.struct(a.alias("left"), b.alias("right")))))
    return (counts.select(*by, "n", F.explode(pairs).alias("pair"))
            .groupBy(*by, "pair.left", "pair.right").agg(F.sum("n").alias("n")))


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent pairs: a top-k per partition, then a merge of those."""
    return pairs.orderBy(F.desc("n"), "left", "right").limit(k)


# --- units: pieces with their runs, per stream -------------------------------

def stream_of(config) -> str:
    """Configurations that see the same units share a stream."""
    return config.pre_tokenizer + ("+runs" if config.repeat else "")


def streams_of(config_names) -> list[str]:
    return list(dict.fromkeys(stream_of(CATALOGUE[n]) for n in config_names))


def _unfolded(streams) -> dict[str, list[str]]:
    """Streams by pre-tokenizer, so that each text is cut once for all of them."""
    out: dict[str, list[str]] = {}
    for s in streams:
        out.setdefault(s.removesuffix("+runs"), []).append(s)
    return out


def unit_arrays(corpus: DataFrame, config_names, streams=None) -> DataFrame:
    """One row per document and stream, with ``units``: array of ``(piece, run)``; all streams of the configurations by default."""
    streams = _unfolded(streams or streams_of(config_names))

    def work(texts, part):
        for name, some in streams.items():
            cut = texts.cut(name)
            for stream in some:
                units, rows = cu.units(cut, stream.endswith("+runs"))
                yield [_named(stream, part), cu.listed(units, rows, part.column("text").is_valid())]

    return _mapped(corpus, "stream string, units array<struct<piece: string, run: int>>", work)


def unit_counts(units: DataFrame, by=("label",)) -> DataFrame:
    return (units.select(*by, "stream", F.inline("units"))
            .groupBy(*by, "stream", "piece", "run").agg(F.count("*").alias("n")))


def _unit_work(streams):
    """Units of each stream, coded by piece and run."""
    def work(texts, _):
        for name, some in _unfolded(streams).items():
            cut = texts.cut(name)
            for stream in some:
                if stream.endswith("+runs"):
                    pieces, code, at, run = cu.folded(cut)
                    kinds, unit = np.unique(code[at] << 8 | run, return_inverse=True)
                    keys = [pieces.take(pa.array(kinds >> 8)).cast(pa.string()), pa.array((kinds & 255).astype(np.int32))]
                    yield stream, cut.rows[at], keys, unit, [np.ones(len(unit))]
                else:
                    pieces, code = _coded(cut)
                    yield stream, cut.rows, [pieces, pa.array(np.ones(len(pieces), np.int32))], code, [np.ones(len(code))]
    return work


def counted_units(corpus: DataFrame, config_names, by=("label",), lines: bool = False) -> DataFrame:
    """``(*by, stream, piece, run, n)``: occurrences per distinct unit. With ``lines``, each line is cut by itself.

    A stream with folded runs holds what the plain one does,
    ``run`` pieces a unit, so where both are read only that one is counted by occurrence."""
    streams = streams_of(config_names)
    plain = [s for s in streams if f"{s}+runs" in streams]
    counts = _added_up(corpus, by, "stream string, piece string, run int", "n bigint",
                       _unit_work([s for s in streams if s not in plain]), lines)
    if not plain:
        return counts
    own = F.struct("stream", F.col("run"), F.col("n"))
    single = F.struct(F.regexp_replace("stream", r"\+runs$", "").alias("stream"), F.lit(1).alias("run"),
                      (F.col("n") * F.col("run")).alias("n"))
    both = F.when(F.col("stream").isin([f"{s}+runs" for s in plain]), F.array(own, single)).otherwise(F.array(own))
    return (counts.select(*by, "piece", F.inline(both)).groupBy(*by, "stream", "piece", "run").agg(F.sum("n").alias("n")))


def unit_sizes(corpus: DataFrame, config_names, by=("label",)) -> DataFrame:
    """Units, and the pieces they stand for, per stream: added up in the task, no unit is moved."""
    streams = _unfolded(streams_of(config_names))

    def work(texts, _):
        for name, some in streams.items():
            cut = texts.cut(name)
            for stream in some:
                if stream.endswith("+runs"):
                    _, _, at, run = cu.folded(cut)
                else:
                    at, run = slice(None), np.ones(len(cut.rows))
                yield stream, cut.rows[at], [], np.zeros(len(run), np.int64), [np.ones(len(run)), run]

    return _added_up(corpus, by, "stream string", "units bigint, pieces bigint", work)


def with_configs(df: DataFrame, config_names) -> DataFrame:
    """Fan a stream table out to the configurations that read it; no join, no shuffle."""
    readers: dict[str, list] = {}
    for c in (CATALOGUE[n] for n in config_names):
        readers.setdefault(stream_of(c), []).append(F.struct(
            F.lit(c.name).alias("config"), F.lit(c.capitalize).alias("capitalize"),
            F.lit(c.repeat).alias("repeat"), F.lit(c.serialize).alias("serialize"),
            F.lit(c.split_operators).alias("split_operators")))
    of_stream = F.create_map(*[x for s, rows in readers.items() for x in (F.lit(s), F.array(*rows))])
    return df.select("*", F.inline(F.element_at(of_stream, F.col("stream"))))


# --- comparisons -------------------------------------------------------------

def split_diagnostics(corpus: DataFrame, pre_tokenizers) -> DataFrame:
    """Share of documents per pre-tokenizer that keep line ends, symbol runs and spaces.

    Each share is over the documents that have the feature at all.
    """
    df = piece_arrays(corpus, pre_tokenizers)
    text, pieces = F.col("text"), F.col("pieces")
    runs = F.regexp_extract_all(text, F.lit(p.PUNCTUATION_RUN), F.lit(0))
    line_end = F.regexp_like(text, F.lit(r"[\n\t]"))
    space = F.contains(text, F.lit(" "))
    df = t.materialize(df, _runs=runs)
    df = df.select(
        "pre_tokenizer",
        F.when(line_end, F.exists(pieces, lambda x: F.regexp_like(x, F.lit(r"[\n\t]")))).alias("nl"),
        F.when(F.size("_runs") > 0, F.arrays_overlap("_runs", pieces)).alias("punct"),
        F.when(space, F.exists(pieces, lambda x: F.contains(x, F.lit(" ")))).alias("space"))

    def share(name: str) -> Column:
        return F.round(F.avg(F.col(name).cast("double")) * 100, 6)

    return df.groupBy("pre_tokenizer").agg(
        F.count("nl").alias("docs_with_line_ends"), share("nl").alias("pct_line_ends_kept"),
        F.count("punct").alias("docs_with_symbol_runs"), share("punct").alias("pct_symbol_runs_kept"),
        F.count("space").alias("docs_with_spaces"), share("space").alias("pct_spaces_kept"))
