"""Orthographic decomposition of a corpus, over its distinct pieces."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphloom.functions import opcodes as oc
from glyphloom.functions import spelling as sp
from glyphloom.functions import text as t
from glyphloom.functions.memory import lean, together
from glyphloom.operators.configs import CATALOGUE
from glyphloom.operators.pieces import counted_units, normalized, stream_of, with_configs


def dictionary(corpus: DataFrame, config_names, by=("label",), lines: bool = False) -> DataFrame:
    """Distinct units of the corpus with their operators; with ``lines``, each line is cut by itself.

    ``(*by, config, piece, run, n, base, ops, raw)``; ``n`` counts occurrences of
    the unit, and a unit stands for ``run`` neighbouring copies of its piece.
    """
    return factor(counted_units(normalized(corpus), config_names, by, lines), config_names)


def factor(counts: DataFrame, config_names) -> DataFrame:
    df = with_configs(counts, config_names)
    return oc.with_opcodes(df, F.col("capitalize"), F.col("repeat"), F.col("serialize"), run="run").drop(
        "stream", "capitalize", "repeat", "serialize")


def spelled(counts: DataFrame, config_names) -> DataFrame:
    """``(*by, config, piece, run, n, words)``: the words of distinct units under every configuration, without their operators."""
    spark = counts.sparkSession
    known = sp.capitals(spark)
    readers: dict[str, list] = {}
    for c in (CATALOGUE[n] for n in config_names):
        readers.setdefault(stream_of(c), []).append(c)
    by = [c for c in counts.columns if c not in ("stream", "piece", "run", "n")]
    kept = ["piece", "run", "n"]
    schema = T.StructType([*(counts.schema[c] for c in by), T.StructField("config", T.StringType()),
                           *(counts.schema[c] for c in kept), T.StructField("words", T.ArrayType(T.StringType()))])
    names = [f.name for f in schema]

    def spell(batches):
        for batch in together(batches):
            for stream, configs in readers.items():
                mine = batch.filter(pc.equal(batch.column("stream"), stream))
                for c in configs if mine.num_rows else ():
                    words = sp.words(mine.column("piece"), mine.column("run").to_numpy(), c, *known.value)
                    yield pa.RecordBatch.from_arrays(
                        [*(mine.column(k) for k in by), pa.array([c.name] * mine.num_rows, pa.string()),
                         *(mine.column(k) for k in kept), words], names=names)

    return counts.mapInArrow(lean(spell), schema)


def op_occurrences(dic: DataFrame, by=("label", "config")) -> DataFrame:
    """One row per operator use in a distinct unit, weighted by occurrences."""
    return dic.select(*by, "piece", "n", F.explode("ops").alias("o")).select(
        *by, "piece", "n", oc.op_name(F.col("o.op")).alias("op"),
        F.get("o.params", F.lit(0)).alias("pos"), F.col("o.params").alias("params"))


def op_positions(dic: DataFrame, by=("label",)) -> DataFrame:
    """Occurrences per operator and position."""
    return op_occurrences(dic, by).groupBy(*by, "op", "pos").agg(F.sum("n").alias("n"))


def op_frequency(dic: DataFrame, by=("label", "config")) -> DataFrame:
    """How often each operator is used, and by how many distinct pieces."""
    return op_occurrences(dic, by).groupBy(*by, "op").agg(
        F.sum("n").alias("n"), F.count_distinct("piece").alias("pieces"))


def surface_collapse(dic: DataFrame, by=("label", "config")) -> DataFrame:
    """Surface forms that share a base, and the occurrences behind them."""
    return dic.groupBy(*by, "base").agg(
        F.count_distinct("piece").alias("surface_forms"), F.sum("n").alias("n"))


def encode_units(dic: DataFrame) -> DataFrame:
    return dic.withColumn("encoded", oc.encoded(F.col("ops"), F.col("base")))


def decode_units(dic: DataFrame) -> DataFrame:
    """Encode and decode every distinct unit; ``lossless`` compares with the input.

    Units of plain configurations decode to themselves. Others go through the
    decoder, which can't tell private-use text from operators; where it takes such
    text for an operator the unit is reported as not lossless.
    """
    df = oc.with_decoded(encode_units(dic), "encoded")
    surface = F.repeat(F.col("piece"), F.col("run"))
    plain = ~F.col("config").isin([c.name for c in CATALOGUE.values() if c.factored])
    decoded = F.when(plain, F.col("encoded")).otherwise(F.col("decoded"))
    return df.withColumn("decoded", decoded).withColumn("lossless", F.col("decoded") == surface)


def word_counts(dic: DataFrame, by=("label", "config")) -> DataFrame:
    """Vocabulary training input, from a dictionary or from ``spelled``: operator words and base words with occurrences."""
    words = F.col("words") if "words" in dic.columns else oc.words(F.col("ops"), F.col("base"), F.col("split_operators"))
    return (dic.select(*by, "n", F.explode(words).alias("word"))
            .groupBy(*by, "word").agg(F.sum("n").alias("n")))


def char_runs(counts: DataFrame, by=("label",)) -> DataFrame:
    """Runs of three or more equal characters inside pieces: ``(ch, run, n)``.

    Runs past the parameter limit are reported too; the encoder leaves those alone.
    """
    piece = F.col("piece")
    whole = F.regexp_extract_all(piece, F.lit(r"(?s)(.)\1{2,}"), F.lit(0))
    return (counts.select(*by, "n", F.explode(whole).alias("r"))
            .select(*by, "n", F.substring("r", 1, 1).alias("ch"), F.length("r").alias("run"))
            .groupBy(*by, "ch", "run").agg(F.sum("n").alias("n")))


def limits(dic: DataFrame, by=("label",)) -> DataFrame:
    """How much of the corpus runs into the operator limits, per label.

    ``max_param`` never exceeds 255; ``capitals_left`` counts units that keep an
    upper-case character because it has no reversible lower case or lies too far in.
    """
    top = F.array_max(F.flatten(F.transform("ops", lambda o: o["params"])))
    left = F.exists(t.chars(F.col("base")), oc.is_capital)
    return dic.groupBy(*by).agg(
        F.sum("n").alias("units"), F.max(top).cast("bigint").alias("max_param"),
        F.sum(F.when(F.length("piece") > 256, F.col("n")).otherwise(0)).alias("long_units"),
        F.sum(F.when(F.col("raw"), F.col("n")).otherwise(0)).alias("raw_units"),
        F.sum(F.when(left, F.col("n")).otherwise(0)).alias("capitals_left"))
