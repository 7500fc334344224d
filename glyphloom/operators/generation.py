"""Evaluation of stored generations.

Input shape: ``(run, prompt_id, prompt, completion, tokens, gen_time)`` with
``tokens`` the generated token strings or ids in order.
"""

import ast
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.functions import scoring as sc

SAMPLE_TOKENS = 20
REPETITION_LIMIT = 0.25


def prose_prompts(corpus: DataFrame) -> DataFrame:
    """``(label, doc_id, prompt, target)`` of texts longer than 60 characters."""
    return (corpus.select("label", "doc_id", sc.prose_prompt(F.col("text")).alias("prompt"),
                          sc.prose_target(F.col("text")).alias("target"))
            .filter(F.col("prompt").isNotNull()))


def code_prompts(code: DataFrame) -> DataFrame:
    """``(label, doc_id, prompt, target)`` of code that opens a function."""
    return (code.select("label", "doc_id", sc.code_prompt(F.col("text")).alias("prompt"),
                        sc.code_target(F.col("text")).alias("target"))
            .filter(F.col("prompt").isNotNull()))


def scored(generations: DataFrame) -> DataFrame:
    """Per-generation scores of prose; an empty completion counts as repetition 1."""
    df = generations.select(
        "*", F.size("tokens").alias("n_tokens"),
        sc.tokens_before_collapse(F.col("tokens")).alias("n_coherent"),
        F.length("completion").alias("n_chars"),
        sc.nonempty_content(F.col("completion")).alias("non_empty"))
    rate = F.when(F.col("non_empty"), sc.repetition_rate(F.col("completion"))).otherwise(F.lit(1.0))
    df = df.withColumn("repetition", rate)
    share = F.when(F.col("n_tokens") > 0, F.col("n_coherent") / F.col("n_tokens")).otherwise(F.lit(0.0))
    return (df.withColumn("success", F.col("non_empty") & (F.col("repetition") < REPETITION_LIMIT))
            .withColumn("coherent_time", F.col("gen_time") * share))


def _pct(flag: Column) -> Column:
    return F.avg(flag.cast("double")) * 100


def summary(scored_df: DataFrame, by=("run",), code: bool = False) -> DataFrame:
    """Averages and success rate per run: 1 - mean repetition, or share that parses."""
    rate = _pct(F.col("success")) if code else (1.0 - F.avg("repetition")) * 100
    return scored_df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("n_tokens").alias("avg_tokens_generated"),
        F.avg("n_coherent").alias("avg_tokens_before_collapse"),
        F.avg("n_chars").alias("avg_chars_generated"),
        _pct(F.col("non_empty")).alias("pct_non_empty"),
        (100.0 - _pct(F.col("non_empty"))).alias("pct_empty"), rate.alias("success_rate"))


def coherent_throughput(scored_df: DataFrame, by=("run",), chars: str = "coherent_chars") -> DataFrame:
    """Coherent tokens and characters per second; 0 when no time was spent."""
    time = F.sum("coherent_time")
    per_sec = [F.when(time > 0, F.sum(c) / time).otherwise(F.lit(0.0)).alias(name)
               for c, name in (("n_coherent", "tokens_per_sec"), (chars, "chars_per_sec"))]
    return scored_df.groupBy(*by).agg(*per_sec)


def first_samples(scored_df: DataFrame, by=("run",)) -> DataFrame:
    """The first success and the first failure of each run.

    ``min_by`` keeps one row per run and outcome while it aggregates, so no run is
    gathered in one place.
    """
    tokens = F.slice("tokens", 1, SAMPLE_TOKENS)
    shown = F.when(F.size("tokens") > SAMPLE_TOKENS,
                   F.concat(tokens, F.array(F.lit("...")))).otherwise(tokens)
    row = F.struct("prompt_id", "prompt", "completion", shown.alias("tokens"))
    return (scored_df.groupBy(*by, "success").agg(F.min_by(row, "prompt_id").alias("s"))
            .select(*by, "success", "s.*"))


def _parses(batches):
    for batch in batches:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            yield batch.assign(parses=[_is_python(code) for code in batch["code"]])


def _is_python(code: str) -> bool:
    try:
        ast.parse(code)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def python_gate(code: DataFrame, by=("run",)) -> DataFrame:
    """Success rate per run: non-empty completions whose source parses.

    Equal snippets are parsed once.
    """
    df = code.withColumn("code", F.concat("prompt", F.lit("\n"), "completion"))
    verdict = df.select("code").distinct().mapInPandas(_parses, "code string, parses boolean")
    ok = F.col("parses") & sc.nonempty_content(F.col("completion"))
    return df.join(verdict, "code").groupBy(*by).agg(
        F.count("*").alias("n"), _pct(ok).alias("success_rate"))


def bracket_gate(code: DataFrame, by=("run",)) -> DataFrame:
    """Success rate per run of Go code by the structural check."""
    source = sc.go_source(F.col("prompt"), F.col("completion"))
    ok = sc.brackets_balanced(source) & sc.nonempty_content(F.col("completion"))
    return code.groupBy(*by).agg(F.count("*").alias("n"), _pct(ok).alias("success_rate"))
