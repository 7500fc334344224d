"""The minimum end-to-end profile: one scan, two pre-tokenizers, one shuffle of counts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.operators.metrics import ratio
from glyphloom.operators.pieces import piece_counts
from glyphloom.sources.corpus import documents, nonblank


def piece_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = piece_counts(nonblank(documents(spark, sf_dir)), ["split", "llama"])
    df = counts.groupBy("label", F.col("pre_tokenizer").alias("config")).agg(
        F.sum("n").alias("pieces"), F.count("*").alias("distinct_pieces"),
        F.sum(F.length("piece") * F.col("n")).alias("chars"))
    return df.withColumn("chars_per_piece", F.round(ratio(F.col("chars"), F.col("pieces")), 6))
