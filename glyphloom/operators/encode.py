"""Encoding and decoding a corpus with learned vocabularies.

Distinct units are encoded once, in the row. Documents are encoded where they lie:
a task numbers the units of a batch, looks the distinct ones up in a table of
the frequent units, and lays their ids end to end. Units that are not in the table
leave holes; only they, once a document, are shuffled to meet their ids, and only documents with
holes are joined with what comes back. Decoding gathers the bytes of tokens by id.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from glyphloom.functions import opcodes as oc
from glyphloom.functions import patterns as p
from glyphloom.functions import text as t
from glyphloom.functions.memory import lean, small_batches, together
from glyphloom.functions.merging import Merges
from glyphloom.functions.wordtable import LONGEST, WordTable, gather
from glyphloom.operators.configs import CATALOGUE
from glyphloom.operators.pieces import stream_of
from glyphloom.session import written

MAX_BROADCAST_ENTRIES = 8_000_000   # merges + vocabulary entries shipped to a task
HOT_BYTES = 64 << 20                # size of the table of frequent units that tasks look up
_ENTRY = 48                         # bytes of such an entry beside its string and ids
SEEN = 1 << 14                      # short words of a vocabulary whose ids a task remembers
ITEMS = 1 << 18                     # units or ids of documents that a task works on at once
KEYS = ["label", "config"]


# --- vocabularies in tasks -------------------------------------------------------

def _group(by) -> Column:
    return F.concat_ws("\x1f", *by)


def _sets(vocab: DataFrame, merges: DataFrame | None, by) -> list[list[str]]:
    """Groups, in sets that together stay below ``MAX_BROADCAST_ENTRIES``."""
    entries = vocab.select(*by) if merges is None else vocab.select(*by).unionByName(merges.select(*by))
    sizes = {r["group"]: r["count"] for r in entries.groupBy(_group(by).alias("group")).count().collect()}
    sets, load = [[]], 0
    for name in sorted(sizes):
        if load and load + sizes[name] > MAX_BROADCAST_ENTRIES:
            sets.append([])
            load = 0
        sets[-1].append(name)
        load += sizes[name]
    return sets


def _by_group(df: DataFrame, by, names: list[str], *columns: str) -> dict[str, list[pa.Array]]:
    """Columns of each group's rows, in the order of the first column."""
    found = df.filter(_group(by).isin(names)).select(_group(by).alias("_g"), *columns).toArrow()
    found = found.sort_by([("_g", "ascending"), (columns[0], "ascending")]).combine_chunks()
    out = {}
    for name, rows in zip(*_spans(found.column("_g"))):
        out[name] = [found.column(c).slice(*rows).combine_chunks() for c in columns]
    return out


def _limited(batches, column: str):
    """Batches in parts of some ``ITEMS`` items of a list column; a longer list is a part of its own."""
    for batch in batches:
        ends = np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        part = ends // ITEMS
        heads = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(heads, heads[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _spans(column) -> tuple[list, list[tuple[int, int]]]:
    """Distinct values of a sorted column, and (offset, length) of each."""
    runs = pc.run_end_encode(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    if not len(runs):
        return [], []
    ends = runs.run_ends.to_numpy()
    starts = np.concatenate(([0], ends[:-1]))
    return runs.values.to_pylist(), list(zip(starts.tolist(), (ends - starts).tolist()))


# --- words -> ids ------------------------------------------------------------

class _Speller:
    """Words to ids under one vocabulary. Characters outside it yield nothing."""

    def __init__(self, ids: dict[str, int], ranked: list[tuple[str, str]]):
        self.letters = {s: i for s, i in ids.items() if len(s) == 1}
        self.merges = Merges([(ids[a], ids[b], ids[a + b]) for a, b in ranked])
        self.seen: dict[str, tuple[list[int], int]] = {}

    def spelled(self, word: str) -> tuple[list[int], int]:
        """Ids, and how many characters were left out."""
        if len(word) > 8:
            return self._spelled(word)
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) >= SEEN:
                self.seen.clear()
            found = self.seen[word] = self._spelled(word)
        return found

    def _spelled(self, word: str) -> tuple[list[int], int]:
        letters = [self.letters[c] for c in word if c in self.letters]
        return self.merges.applied(letters), len(word) - len(letters)


def _speller(tables):
    """Per batch: the words of each row to the row's ids."""
    def encode(batches):
        spellers = {}
        for batch in together(batches):
            ids, dropped = [], []
            for group, words in zip(batch.column("group").to_pylist(), batch.column("_words").to_pylist()):
                if group not in spellers:
                    (numbers, tokens), (_, left, right) = tables.value[group]
                    spellers[group] = _Speller(dict(zip(tokens.to_pylist(), numbers.to_pylist())),
                                               list(zip(left.to_pylist(), right.to_pylist())))
                done = [spellers[group].spelled(w) for w in words]
                ids.append([i for x, _ in done for i in x])
                dropped.append(sum(n for _, n in done))
            kept = [n for n in batch.schema.names if n not in ("group", "_words")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(ids, pa.list_(pa.int32())),
                                              pa.array(dropped, pa.int32())], names=[*kept, "ids", "dropped"])
    return encode


def _encoded(rows: DataFrame, words: Column, merges: DataFrame, vocab: DataFrame, by) -> DataFrame:
    """``rows`` with the ids of their ``words`` laid end to end, and the characters left out.

    A vocabulary is bounded by its target size, so those of a set of groups can be
    shipped to tasks; sets too large for one broadcast are encoded set by set.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("dropped", T.IntegerType())])
    parts = []
    for names in _sets(vocab, merges, by):
        ids = _by_group(vocab, by, names, "id", "token")
        ranked = _by_group(merges, by, names, "rank", "left", "right")
        none = [pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.string())]
        tables = rows.sparkSession.sparkContext.broadcast({g: (ids[g], ranked.get(g, none)) for g in ids})
        mine = rows.filter(_group(by).isin(names)).withColumn("_words", words).withColumn("group", _group(by))
        parts.append(mine.mapInArrow(lean(_speller(tables)), schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def encode_words(words: DataFrame, merges: DataFrame, vocab: DataFrame, by=tuple(KEYS)) -> DataFrame:
    """Add ``ids`` and ``dropped`` (characters left out) to distinct ``(*by, word)``."""
    return _encoded(words.select(*by, "word"), F.array("word"), merges, vocab, by)


def encode_dictionary(dic: DataFrame, merges: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(label, config, piece, run, n, ids, dropped)``: ids of each distinct unit of a dictionary or of ``spelled``."""
    words = F.col("words") if "words" in dic.columns else oc.words(F.col("ops"), F.col("base"), F.col("split_operators"))
    rows = dic.select(*KEYS, "piece", "run", "n", words.alias("_spelled"))
    return _encoded(rows, F.col("_spelled"), merges, vocab, KEYS).drop("_spelled")


# --- documents ---------------------------------------------------------------

def hot_units(coded: DataFrame, budget: int = HOT_BYTES) -> DataFrame:
    """The units of ``coded`` that occur often enough, by a count for which all of them fit in ``budget`` bytes.

    Sizes are added up by powers of two of the count, a few dozen rows.
    """
    short = coded.filter(F.octet_length("piece") <= LONGEST)
    power = F.floor(F.log2("n")).cast("int")
    size = F.sum(F.octet_length("piece") + 4 * F.size("ids") + _ENTRY)
    least, load = None, 0
    for r in sorted(short.groupBy(power.alias("power")).agg(size.alias("size")).collect(), key=lambda r: -r.power):
        load += r.size
        if load > budget:
            break
        least = 2 ** r.power
    return short.filter(F.col("n") >= least) if least is not None else short.limit(0)


def _tables(hot: DataFrame) -> dict[tuple, WordTable]:
    """A table of the hot units for each label and configuration."""
    rows = hot.select(_group(KEYS).alias("_g"), *KEYS, "piece", "run", F.concat(F.array("dropped"), "ids").alias("ids")).toArrow()
    rows = rows.sort_by("_g").combine_chunks()
    out = {}
    for _, span in zip(*_spans(rows.column("_g"))):
        part = rows.slice(*span)
        key = (part.column("label")[0].as_py(), part.column("config")[0].as_py())
        out[key] = WordTable.of(part.column("piece").combine_chunks(), part.column("run").to_numpy(),
                                part.column("ids").combine_chunks())
    return out


def _numbered(units: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Bounds of each row's units, the number of every unit, and the distinct units by number (piece, run)."""
    sizes = units.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    parts = units.flatten()
    pieces = parts.field("piece").dictionary_encode()
    codes = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    run = parts.field("run").to_numpy(zero_copy_only=False).astype(np.int64)
    kinds, numbers = np.unique(codes << 31 | run, return_inverse=True)
    return (np.concatenate(([0], np.cumsum(sizes))), numbers,
            pieces.dictionary.take(pa.array(kinds >> 31)), kinds & (1 << 31) - 1)


def _encoder(tables, readers, carried):
    """Rows of units to rows of ids, one for each configuration that reads the row's stream.

    ``holes`` are units that are not in the table: each with the places of its
    occurrences, an id position in the high half and the unit's in the low half.
    """
    hole = pa.list_(pa.struct([("piece", pa.string()), ("run", pa.int32()), ("at", pa.list_(pa.int64()))]))

    def encode(batches):
        empty = WordTable.of(pa.array([], pa.string()), np.zeros(0, np.int64), pa.array([], pa.list_(pa.int32())))
        for batch in _limited(batches, "units"):
            bounds, numbers, pieces, run = _numbered(batch.column("units"))
            labels, streams = (batch.column(c).to_pylist() for c in ("label", "stream"))
            kinds: dict[tuple, list[int]] = {}
            for i, kind in enumerate(zip(labels, streams)):
                kinds.setdefault(kind, []).append(i)
            for (label, stream), rows in kinds.items():
                rows = np.array(rows)
                sizes = bounds[rows + 1] - bounds[rows]
                mine = numbers[gather(bounds[rows], sizes)]
                owner = np.repeat(np.arange(len(rows)), sizes)
                place = np.arange(len(mine)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                for config in readers[stream]:
                    table = tables.value.get((label, config), empty)
                    found = table.find(pieces, run)[mine]
                    known = found >= 0
                    lengths = np.zeros(len(mine), np.int64)     # ids of each unit, its first number being what was dropped
                    lengths[known] = table.size[found[known]] - 1
                    ids = table.numbers[gather(table.first[found[known]] + 1, lengths[known])]
                    dropped = np.bincount(owner[known], table.numbers[table.first[found[known]]], len(rows))
                    ends = np.concatenate(([0], np.cumsum(lengths)))
                    edges = ends[np.concatenate(([0], np.cumsum(sizes)))]
                    holes: list[dict] = [{} for _ in rows]
                    before = ends[:-1] - edges[:-1][owner] if len(owner) else ends[:-1]
                    for k in np.flatnonzero(~known).tolist():
                        holes[owner[k]].setdefault(int(mine[k]), []).append(int(before[k]) << 32 | int(place[k]))
                    lists = [[{"piece": pieces[u].as_py(), "run": int(run[u]), "at": at} for u, at in h.items()] for h in holes]
                    rest = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [rest.column("label"), pa.array([config] * len(rows)), *(rest.column(c) for c in carried),
                         pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids)),
                         pa.array(dropped.astype(np.int64)), pa.array(lists, hole)],
                        names=["label", "config", *carried, "ids", "dropped", "holes"])
    return encode


def _filled(batches):
    """Ids with the ids of units from elsewhere put into their holes."""
    for batch in _limited(batches, "ids"):
        out = []
        for ids, fills in zip(batch.column("ids"), batch.column("_fills").to_pylist()):
            ids = ids.values.to_numpy(zero_copy_only=False)
            parts, last = [], 0
            for at, more in sorted((at, f["ids"]) for f in fills for at in f["at"]):
                parts += [ids[last:at >> 32], np.array(more, np.int32)]
                last = at >> 32
            out.append(np.concatenate([*parts, ids[last:]]))
        whole = pa.array(out, pa.list_(pa.int32()))
        kept = [n for n in batch.schema.names if n != "_fills"]
        yield pa.RecordBatch.from_arrays([whole if n == "ids" else batch.column(n) for n in kept], names=kept)


def encode_corpus(units: DataFrame, coded: DataFrame, config_names, budget: int = HOT_BYTES) -> DataFrame:
    """``(label, config, doc_id, ids, dropped)``, one row per document and configuration.

    ``units`` is the output of ``unit_arrays``, whose other columns go along; documents
    with nothing to encode keep an empty array. ``budget`` changes which units are
    shuffled, not results.
    """
    spark: SparkSession = units.sparkSession
    small_batches(spark)
    readers: dict[str, list[str]] = {}
    for c in (CATALOGUE[n] for n in config_names):
        readers.setdefault(stream_of(c), []).append(c.name)
    carried = [c for c in units.columns if c not in ("label", "stream", "units")]
    tables = spark.sparkContext.broadcast(_tables(hot_units(coded, budget)))
    types = {f.name: f for f in units.schema}
    schema = T.StructType([types["label"], T.StructField("config", T.StringType()), *(types[c] for c in carried),
                           *T.StructType.fromDDL("ids array<int>, dropped bigint, holes array<struct<piece: string, "
                                                 "run: int, at: array<bigint>>>").fields])
    rows = written(units.filter(F.col("stream").isin(list(readers))).mapInArrow(lean(_encoder(tables, readers, carried)), schema)
                   .withColumn("_row", F.monotonically_increasing_id()), "encoded")
    missing = rows.select("_row", *KEYS, F.inline("holes"))
    fills = (missing.join(coded.select(*KEYS, "piece", "run", F.col("ids"), F.col("dropped").alias("_n")), [*KEYS, "piece", "run"])
             .groupBy("_row").agg(F.collect_list(F.struct("at", "ids")).alias("_fills"),
                                  F.sum(F.col("_n") * F.size("at")).alias("_more")))
    holed = rows.filter(F.size("holes") > 0).drop("holes").join(fills, "_row", "left")
    holed = holed.withColumn("dropped", F.col("dropped") + F.coalesce("_more", F.lit(0))).withColumn(
        "_fills", F.coalesce("_fills", F.array().cast("array<struct<at: array<bigint>, ids: array<int>>>"))).drop("_row", "_more")
    whole = rows.filter(F.size("holes") == 0).drop("holes", "_row")
    order = ["label", "config", *carried, "ids", "dropped"]
    filled = holed.select(*order, "_fills").mapInArrow(lean(_filled), whole.select(*order).schema)
    return whole.select(*order).unionByName(filled)


# --- ids -> text -----------------------------------------------------------------

def _decoder(tables):
    """Ids to the text of their tokens, by the place of each token's bytes."""
    def decode(batches):
        for batch in _limited(batches, "ids"):
            ids = batch.column("ids")
            sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            texts = np.full(batch.num_rows, "", object)
            unk = np.zeros(batch.num_rows, bool)
            groups = batch.column("group").dictionary_encode()
            for code, name in enumerate(groups.dictionary.to_pylist()):
                starts, lengths, data, unknown = tables.value[name]
                rows = np.flatnonzero(groups.indices.to_numpy(zero_copy_only=False) == code)
                mine = flat[gather(bounds[rows], sizes[rows])]
                owner = np.repeat(np.arange(len(rows)), sizes[rows])
                spelled = data[gather(starts[mine], lengths[mine])].tobytes()
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner, lengths[mine], len(rows)).astype(np.int64))))
                texts[rows] = [spelled[a:b].decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                unk[rows] = np.bincount(owner, mine == unknown, len(rows)) > 0
            kept = [n for n in batch.schema.names if n not in ("group", "ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(texts, pa.string()), pa.array(unk)],
                                             names=[*kept, "tokens_text", "has_unk"])
    return decode


def _spellings(numbers: pa.Array, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Start and length of the token of every id, their bytes, and the id of the unknown token (-1 if there is none)."""
    raw = [x.encode() for x in tokens.to_pylist()]
    ids = numbers.to_numpy()
    starts, lengths = (np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int64) for _ in range(2))
    sizes = np.array([len(x) for x in raw], np.int64)
    starts[ids], lengths[ids] = np.cumsum(sizes) - sizes, sizes
    known = dict(zip(tokens.to_pylist(), ids.tolist()))
    return starts, lengths, np.frombuffer(b"".join(raw) + b"\0", np.uint8), known.get(p.SPECIAL_TOKENS[0], -1)


def decode_ids(encoded: DataFrame, vocab: DataFrame) -> DataFrame:
    """``encoded`` with ``tokens_text``, ``has_unk`` and ``decoded`` instead of ids: one pass, nothing is shuffled."""
    small_batches(encoded.sparkSession)
    schema = T.StructType([f for f in encoded.schema if f.name != "ids"]
                          + T.StructType.fromDDL("tokens_text string, has_unk boolean").fields)
    parts = []
    for names in _sets(vocab, None, KEYS):
        found = _by_group(vocab, KEYS, names, "id", "token")
        tables = encoded.sparkSession.sparkContext.broadcast({g: _spellings(*x) for g, x in found.items()})
        mine = encoded.filter(_group(KEYS).isin(names)).withColumn("group", _group(KEYS))
        parts.append(mine.mapInArrow(lean(_decoder(tables)), schema))
    streams = parts[0]
    for part in parts[1:]:
        streams = streams.unionByName(part)
    return decode_stream(streams, "tokens_text")


def _looked_up(df: DataFrame, vocab: DataFrame, column: str, out: str, kind: T.DataType, table, find) -> DataFrame:
    """``df`` with ``out``: each element of the array ``column`` looked up in the row's vocabulary, where it lies."""
    small_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(kind))])
    parts = []
    for names in _sets(vocab, None, KEYS):
        found = _by_group(vocab, KEYS, names, "id", "token")
        tables = df.sparkSession.sparkContext.broadcast({g: table(*x) for g, x in found.items()})

        def look_up(batches, tables=tables):
            for batch in _limited(batches, column):
                groups = batch.column("group").dictionary_encode()
                codes = groups.indices.to_numpy(zero_copy_only=False)
                rows = [np.flatnonzero(codes == code) for code in range(len(groups.dictionary))]
                lists = [find(tables.value[name], batch.column(column).take(pa.array(r)))
                         for name, r in zip(groups.dictionary.to_pylist(), rows)]
                back = np.argsort(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64))
                kept = [n for n in batch.schema.names if n != "group"]
                whole = pa.concat_arrays(lists).take(pa.array(back)) if lists else batch.column(column).slice(0, 0)
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), whole], names=[*kept, out])

        parts.append(df.filter(_group(KEYS).isin(names)).withColumn("group", _group(KEYS)).mapInArrow(lean(look_up), schema))
    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    return done


def _sized(lists: pa.Array, values: pa.Array) -> pa.ListArray:
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)


def id_to_token(df: DataFrame, vocab: DataFrame, ids: str = "ids", out: str = "tokens") -> DataFrame:
    """``df`` with the token of every id, null for an id the vocabulary doesn't have."""
    def find(tokens: dict, lists: pa.Array) -> pa.ListArray:
        flat = lists.flatten().cast(pa.int64())
        return _sized(lists, tokens["token"].take(pc.index_in(flat, tokens["id"])))

    return _looked_up(df, vocab, ids, out, T.StringType(), lambda i, t: {"id": i, "token": t}, find)


def token_to_id(df: DataFrame, vocab: DataFrame, tokens: str = "tokens", out: str = "ids") -> DataFrame:
    """``df`` with the id of every token, null for a token the vocabulary doesn't have; bytes are compared."""
    def table(ids: pa.Array, names: pa.Array) -> WordTable:
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32)), ids.cast(pa.int32()))
        return WordTable.of(names, np.zeros(len(names), np.int64), rows)

    def find(words: WordTable, lists: pa.Array) -> pa.ListArray:
        kinds = lists.flatten().dictionary_encode()
        at = words.find(kinds.dictionary, np.zeros(len(kinds.dictionary), np.int64))
        own = pa.array(words.numbers[words.first[at]], mask=at < 0) if len(words.first) else pa.nulls(len(at), pa.int32())
        return _sized(lists, own.take(kinds.indices))

    return _looked_up(df, vocab, tokens, out, T.IntegerType(), table, find)


def decode_stream(df: DataFrame, stream: str, out: str = "decoded") -> DataFrame:
    """Undo operators and metaspace in whole token streams, one per document.

    Streams of plain configurations are fused tokens as they are, private-use
    characters included.
    """
    factored = F.col("config").isin([c.name for c in CATALOGUE.values() if c.factored])
    df = oc.with_decoded_text(df.withColumn("_stream", F.when(factored, F.col(stream))), "_stream", "_undone")
    fused = F.when(factored, F.col("_undone")).otherwise(F.col(stream))
    metaspace = F.col("config").startswith("metaspace")
    return df.withColumn(out, F.when(metaspace, t.from_metaspace(fused)).otherwise(fused)).drop("_stream", "_undone")


# --- round trip --------------------------------------------------------------

def with_texts(corpus: DataFrame) -> DataFrame:
    """NFC ``text`` as input of encoding, and beside it ``nfc`` and, where it differs, ``raw``, to compare with later."""
    df = t.materialize(corpus, nfc=t.nfc(F.col("text")))
    return df.withColumn("raw", F.when(F.col("text") != F.col("nfc"), F.col("text"))).withColumn("text", F.col("nfc"))


def letters_of(vocab: DataFrame, by=tuple(KEYS), token: str = "token") -> DataFrame:
    """The characters that each vocabulary can spell, as one array a group; bounded by the alphabet."""
    return vocab.filter(F.length(token) == 1).groupBy(*by).agg(F.collect_set(token).alias("letters"))


def roundtrip_classes(decoded: DataFrame, vocab: DataFrame) -> DataFrame:
    """Class of every document's round trip, from rows that hold ``nfc`` and ``raw`` beside ``decoded``.

    ``lossless`` if the text comes back as it was, ``normalized`` if its NFC form
    does, or for a mismatch: ``unk`` (an unknown token was emitted), ``oov``
    (a lost character is not in the vocabulary), ``opcode_oov`` (an operator or a
    parameter is not), ``long`` (256 characters or more) and ``failure``. Every
    class is reported; none counts as a success.
    """
    lossy = F.col("config").contains("whitespace")
    raw, expected = (F.when(lossy, t.strip_newline_tab(c)).otherwise(c)
                     for c in (F.coalesce("raw", "nfc"), F.col("nfc")))
    df = decoded.join(F.broadcast(letters_of(vocab)), KEYS, "left")
    df = t.materialize(df, _raw=raw, _expected=expected)
    lost = F.array_except(t.chars(F.col("_expected")), t.chars(F.col("decoded")))
    unknown = F.exists(F.array_except(lost, F.coalesce("letters", F.array().cast("array<string>"))),
                       lambda c: F.regexp_like(c, F.lit(r"(?U)\S")))
    return df.select(*KEYS, "doc_id", F.when(F.col("decoded") == F.col("_raw"), "lossless")
                     .when(F.col("decoded") == F.col("_expected"), "normalized").when(F.col("has_unk"), "unk").when(unknown, "oov")
                     .when(F.col("dropped") > 0, "opcode_oov").when(F.length("_expected") < 256, "failure").otherwise("long").alias("outcome"))


def oov_after_decoding(decoded: DataFrame, vocab: DataFrame) -> DataFrame:
    """Characters of ``nfc`` that ``decoded`` has lost and the vocabulary can't spell, with document counts.

    Tested in the row against the vocabulary's letters; only such characters are counted.
    """
    df = decoded.join(F.broadcast(letters_of(vocab)), KEYS, "left")
    lost = F.array_except(F.array_distinct(t.chars(F.col("nfc"))), t.chars(F.col("decoded")))
    odd = F.array_except(lost, F.coalesce("letters", F.array().cast("array<string>")))
    return df.select(*KEYS, F.explode(odd).alias("token")).groupBy(*KEYS, "token").agg(F.count("*").alias("docs"))


def oov_characters(corpus: DataFrame, vocab: DataFrame, by=("label",)) -> DataFrame:
    """Characters of the text that the vocabulary cannot spell, with document counts; tested in the row."""
    df = corpus.join(F.broadcast(letters_of(vocab, by)), list(by), "left")
    odd = F.array_except(F.array_distinct(t.chars(F.col("text"))), F.coalesce("letters", F.array().cast("array<string>")))
    return df.select(*by, F.explode(odd).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("docs"))
