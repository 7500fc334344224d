"""Vocabulary, compression and inflation metrics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.functions import patterns as p
from glyphloom.functions import text as t
from glyphloom.operators.configs import CATALOGUE
from glyphloom.session import written


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, 0 when there is nothing to divide by."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def corpus_totals(counts: DataFrame, by=("label", "pre_tokenizer")) -> DataFrame:
    """Characters and tokens from piece counts; equals the sums over documents."""
    return counts.groupBy(*by).agg(
        F.sum(F.length("piece") * F.col("n")).alias("chars"), F.sum("n").alias("tokens"))


def chars_per_token(totals: DataFrame) -> DataFrame:
    return totals.withColumn("chars_per_token", ratio(F.col("chars"), F.col("tokens")))


def with_baseline(metrics: DataFrame, on=("label",), baselines: dict[str, str] | None = None) -> DataFrame:
    """Add ``base_*`` columns from the row of the baseline configuration (or nulls).

    The metrics table has one row per label and configuration; it is written, as it is read twice.
    """
    metrics = written(metrics, "metrics")
    baselines = baselines or {c.name: c.baseline for c in CATALOGUE.values() if c.baseline}
    pairs = [F.lit(x) for pair in baselines.items() for x in pair]
    df = metrics.withColumn("baseline", F.element_at(F.create_map(*pairs), F.col("config")))
    values = [c for c in metrics.columns if c not in (*on, "config")]
    base = metrics.select(*on, F.col("config").alias("baseline"),
                          *[F.col(c).alias(f"base_{c}") for c in values])
    return df.join(base, [*on, "baseline"], "left")


def inflation(tokens: Column, base_tokens: Column) -> Column:
    """Change in token count against the baseline, in percent; null without one."""
    return F.when(base_tokens > 0, (tokens - base_tokens) / base_tokens * 100)


def vocab_diff(size: Column, base_size: Column, target: Column) -> Column:
    """Change in vocabulary size, only when neither vocabulary was cut by the target."""
    return F.when((base_size < target) & (size < target), (size - base_size) / base_size * 100)


def concept_density(vocab: DataFrame, by=("label",), token: str = "token",
                    opcodes: str | None = None, unlisted: int = 0) -> DataFrame:
    """Distinct concepts, entries and their ratio in percent.

    Special tokens count as entries, not as concepts; where ``opcodes`` names a
    true flag, entries made of operators alone are counted apart. ``unlisted`` is
    the number of special tokens a vocabulary of plain pieces does not list.
    """
    col = F.col(token)
    special = col.isin(*p.SPECIAL_TOKENS)
    opcode = t.is_pua_only(col) & ~special & (F.col(opcodes) if opcodes else F.lit(False))
    df = vocab.withColumn("_key", F.nullif(t.concept_key(col), F.lit("")))
    df = df.withColumn("_key", F.when(~special & ~opcode, F.col("_key")))
    return df.groupBy(*by).agg(
        F.count_distinct("_key").alias("concepts"), (F.count("*") + unlisted).alias("vocab_size"),
        F.count_if(opcode).alias("opcode_tokens"),
    ).withColumn("density", ratio(F.col("concepts") * 100.0, F.col("vocab_size")))
