"""Vocabulary profile: learn, measure and check one vocabulary per label and configuration."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.operators import bpe, encode, metrics
from glyphloom.operators import decompose as dec
from glyphloom.operators import pieces as pcs
from glyphloom.operators.configs import REPORT_CONFIGS
from glyphloom.session import written
from glyphloom.sources.corpus import nonblank

KEYS = ["label", "config"]


@dataclass
class Profile:
    """Tables of one profile run. ``coded`` and ``units`` belong to the validation text."""

    vocabulary: bpe.Vocabulary
    validation: DataFrame
    units: DataFrame
    coded: DataFrame
    target_size: int
    configs: tuple[str, ...]

    def encoded(self) -> DataFrame:
        return encode.encode_corpus(self.units, self.coded, self.configs)

    def metrics(self) -> DataFrame:
        """One row per label and configuration, with the baseline comparison."""
        v = self.vocabulary.vocab
        density = metrics.concept_density(
            v.withColumn("_ops", F.col("config").contains("factored")), KEYS, opcodes="_ops")
        # Tokens from distinct units: no document is put back together for a count.
        tokens = self.coded.groupBy(*KEYS).agg(F.sum(F.size("ids") * F.col("n")).alias("tokens"))
        chars = self.validation.groupBy("label").agg(F.sum(F.length("text")).alias("chars"))
        df = density.join(tokens, KEYS, "left").join(chars, "label", "left").fillna(0, ["tokens", "chars"])
        df = df.withColumnRenamed("vocab_size", "actual_vocab_size")
        df = metrics.with_baseline(df)
        target = F.lit(self.target_size)
        return df.select(
            "label", target.cast("bigint").alias("target_vocab_size"), "config",
            "baseline", "actual_vocab_size", "concepts", "opcode_tokens", "density", "chars", "tokens",
            metrics.ratio(F.col("chars"), F.col("tokens")).alias("chars_per_token"),
            metrics.inflation(F.col("tokens"), F.col("base_tokens")).alias("inflation"),
            metrics.vocab_diff(F.col("actual_vocab_size"), F.col("base_actual_vocab_size"),
                               target).alias("vocab_diff"))

    def decoded(self) -> DataFrame:
        """decode(encode(text)) of all validation documents, beside what it is to be compared with; one scan."""
        units = pcs.unit_arrays(encode.with_texts(self.validation), self.configs)
        return encode.decode_ids(encode.encode_corpus(units, self.coded, self.configs), self.vocabulary.vocab)

    def roundtrip(self) -> DataFrame:
        """Documents per label, configuration and outcome of decode(encode(text))."""
        classes = encode.roundtrip_classes(self.decoded(), self.vocabulary.vocab)
        return classes.groupBy(*KEYS, "outcome").agg(F.count("*").alias("docs"))


def profile(train: DataFrame, validation: DataFrame, target_size: int = 128_000,
            configs=REPORT_CONFIGS, min_pair_count: int = 1) -> Profile:
    """Learn vocabularies on ``train`` and encode the distinct units of ``validation``."""
    # line by line, as in ``training_lines``: no piece, run or composition crosses a line end
    text = nonblank(train).withColumn("text", F.concat("text", F.lit("\n")))
    words = dec.word_counts(dec.spelled(pcs.counted_units(pcs.normalized(text), configs, lines=True), configs))
    vocabulary = bpe.train(words, target_size, min_pair_count=min_pair_count)
    valid = nonblank(validation)
    normal = pcs.normalized(valid)
    units = pcs.unit_arrays(normal, configs)
    dic = dec.spelled(pcs.counted_units(normal, configs), configs)
    coded = written(encode.encode_dictionary(dic, vocabulary.merges, vocabulary.vocab), "coded")
    return Profile(vocabulary, valid, units, coded, target_size, tuple(configs))
