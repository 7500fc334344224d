"""Result files: one JSON object per run, keyed by the file name."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_FILE = r"results_([^/]+)_seed(\d+)_(\w+)\.json"

RUN_SCHEMA = (
    "dataset string, tokenizer_type string, vocab_size bigint, model_parameters bigint, "
    "total_train_time_sec double, avg_step_time_ms double, tokens_per_sec double, "
    "chars_per_sec double, peak_vram_gb double, final_val_loss double, final_ppl_token double, "
    "final_ppl_char double, char_to_token_ratio double, train_tokens_count bigint, "
    "train_chars_count bigint")


def read_runs(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Run results with ``run``, ``seed`` and ``model_size`` taken from the path.

    ``path`` may be a glob of files ``results_<run>_seed<seed>_<size>.json`` or a
    folder whose sub-folders carry such names.
    """
    df = spark.read.schema(RUN_SCHEMA).option("multiLine", multiline).option(
        "recursiveFileLookup", True).json(path)
    name = F.col("_metadata.file_path")
    return df.select("*", F.regexp_extract(name, RUN_FILE, 1).alias("run"),
                     F.regexp_extract(name, RUN_FILE, 2).cast("bigint").alias("seed"),
                     F.regexp_extract(name, RUN_FILE, 3).alias("model_size"))


def write_runs(results: DataFrame, path: str, model_size: str = "25M") -> None:
    """One folder per run, named as the run's file would be."""
    name = F.concat(F.lit("results_"), "dataset", F.lit("_"), "tokenizer_type", F.lit("_seed"),
                    F.col("seed").cast("string"), F.lit(f"_{model_size}.json"))
    results.withColumn("run_file", name).drop("seed").write.partitionBy("run_file").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric rows as JSON lines; null fields are kept."""
    metrics.write.option("ignoreNullFields", False).json(path)


def read_metrics(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_vocabulary(merges: DataFrame, vocab: DataFrame, path: str) -> None:
    """Save tokenizers as two tables, one partition per label and configuration."""
    merges.write.partitionBy("label", "config").parquet(f"{path}/merges")
    vocab.write.partitionBy("label", "config").parquet(f"{path}/vocab")


def read_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Load saved tokenizers; filters on label and configuration prune files."""
    return spark.read.parquet(f"{path}/merges"), spark.read.parquet(f"{path}/vocab")
