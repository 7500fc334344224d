"""How the given tables play the inputs of the operators."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.functions import pieces as pc
from glyphloom.operators import generation as gen
from glyphloom.operators import packing
from glyphloom.operators import pieces as pcs
from glyphloom.session import spread
from glyphloom.sources import corpus

SHARDS = 5                       # document shards stand in for training seeds
PLAIN = ("split", "llama", "metaspace")
BASELINES = {"llama": "split", "metaspace": "split"}
SEP = "[SEP]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(spark, sf_dir)


def train(docs: DataFrame) -> DataFrame:
    return docs.filter(~corpus.is_validation(F.col("doc_id")))


def validation(docs: DataFrame) -> DataFrame:
    return docs.filter(corpus.is_validation(F.col("doc_id")))


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as generations, the turn before as prompt.

    Five runs by conversation; tokens are pieces closed by a separator; the tables
    hold no generation time, so a token costs 3 ms and up to 60 % more by conversation.
    """
    turns = spread(table(spark, sf_dir, "conversations"), "conv_id")
    answers = turns.filter(F.col("role") == "assistant")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    tokens = F.concat(pc.split_pieces(F.col("text")), F.array(F.lit(SEP)))
    return answers.join(asked, ["conv_id", "turn"]).select(
        F.concat(F.lit("run"), F.pmod("conv_id", F.lit(SHARDS))).alias("run"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"), "prompt",
        F.col("text").alias("completion"), tokens.alias("tokens"),
        (F.size(tokens) * 0.003 * (1 + F.pmod("conv_id", F.lit(7)) / 10.0)).alias("gen_time"))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function snippets spelled from the ``part`` table, about half of them broken."""
    name, size = F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_size").cast("string")
    kind = F.pmod("p_size", F.lit(5))
    python = (F.when(kind == 0, F.concat(F.lit("    return x + "), size))
              .when(kind == 1, F.concat(F.lit("    return (x + "), size))
              .when(kind == 2, F.lit("  "))
              .when(kind == 3, F.concat(F.lit('    return "'), "p_type", F.lit('"')))
              .otherwise(F.concat(F.lit("return x - "), size)))
    go = (F.when(kind == 0, F.concat(F.lit("\treturn x + "), size, F.lit("\n}")))
          .when(kind == 1, F.concat(F.lit("\treturn (x + "), size, F.lit("\n}")))
          .when(kind == 2, F.lit("  "))
          .when(kind == 3, F.concat(F.lit('\tlog("}) '), "p_type", F.lit('")')))
          .otherwise(F.concat(F.lit("\treturn x[ "), size, F.lit(")"))))
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("run"), F.col("p_partkey").alias("doc_id"), F.inline(F.array(
            F.struct(F.lit("python").alias("label"),
                     F.concat(F.lit("def "), name, F.lit("(x):")).alias("prompt"),
                     python.alias("completion")),
            F.struct(F.lit("go").alias("label"),
                     F.concat(F.lit("func "), name, F.lit("(x int) int {")).alias("prompt"),
                     go.alias("completion"))))
    ).withColumn("text", F.concat("prompt", F.lit("\n"), "completion"))


def doc_sizes(docs: DataFrame, pre_tokenizers=PLAIN) -> DataFrame:
    """``(label, config, doc_id, n_chars, n_tokens)`` with pieces as tokens."""
    return pcs.piece_sizes(docs, pre_tokenizers, ends=False).select(
        "label", F.col("pre_tokenizer").alias("config"), "doc_id", "n_chars", F.col("pieces").alias("n_tokens"))


def run_results(docs: DataFrame, pre_tokenizers=PLAIN) -> DataFrame:
    """One result row per label, configuration and shard, from piece counts."""
    sizes = doc_sizes(docs, pre_tokenizers).withColumn("seed", F.pmod("doc_id", F.lit(SHARDS)))
    ratios = packing.char_ratio(sizes, ("label", "config", "seed"))
    return ratios.select(
        F.col("label").alias("dataset"), "config", "seed",
        F.col("char_ratio").alias("char_to_token_ratio"),
        F.col("tokens").alias("train_tokens_count"), F.col("chars").alias("train_chars_count"))


def piece_metrics(docs: DataFrame, pre_tokenizers=PLAIN) -> DataFrame:
    """Metric rows with distinct pieces of the training share as vocabulary.

    ``(label, config, vocab_size, chars, tokens)``; characters and tokens are
    those of the validation share.
    """
    keys = ("label", "pre_tokenizer")
    df = split_counts(docs, pre_tokenizers).groupBy(*keys).agg(
        (F.count_if(F.col("n_train") > 0) + 5).alias("vocab_size"),
        F.sum(F.length("piece") * F.col("n_valid")).alias("chars"),
        F.sum("n_valid").alias("tokens"))
    return df.withColumnRenamed("pre_tokenizer", "config")


def split_counts(docs: DataFrame, pre_tokenizers, by=("label",)) -> DataFrame:
    """Training and validation occurrences per distinct piece, in one pass."""
    df = docs.withColumn("held", F.coalesce(corpus.is_validation(F.col("doc_id")), F.lit(False)))
    return pcs.piece_shares(df, pre_tokenizers, "held", by)


def generation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored generations, ready for the aggregates of the generation report."""
    df = gen.scored(generations(spark, sf_dir))
    coherent = F.slice("tokens", F.lit(1), F.col("n_coherent"))
    return df.withColumn("coherent_chars", F.length(F.array_join(
        F.filter(coherent, lambda x: x != SEP), "")))
