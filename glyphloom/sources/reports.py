"""Markdown reports as DataFrames of lines. Inputs are aggregates, one row per run."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.operators import experiments as ex


def table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def bold(text: Column) -> Column:
    return F.concat(F.lit("**"), text, F.lit("**"))


VOCAB_COLUMNS = ("Tokenizer Type", "Actual Vocab", "Unique Concepts", "Concept Density (%)",
                 "Chars / Token", "Token Inflation vs Baseline (%)", "Vocab Size Δ vs Baseline (%)")
SWEEP_COLUMNS = ("Tokenizer Type", "Vocab Size", "Chars/Token", "Inflation", "Tokens/Sec",
                 "Chars/Sec", "Final Loss", "Token PPL", "Char PPL")
GENERATION_COLUMNS = ("Tokenizer Type", "Avg Tokens Generated", "Avg Tokens Pre-Collapse",
                      "Avg Chars Generated", "Tokens / Sec", "Chars / Sec (Text Speed)", "% Empty")


def with_headings(rows: DataFrame, section: Column, columns, by: list[str]) -> DataFrame:
    """Add the section and table heading lines to ``(*by, ord, line)``."""
    head = "| " + " | ".join(columns) + " |"
    rule = "|" + "---|" * len(columns)
    headings = rows.select(*by).distinct().select(*by, F.inline(F.array(
        F.struct(F.lit(-3).alias("ord"), section.alias("line")),
        F.struct(F.lit(-2).alias("ord"), F.lit(head).alias("line")),
        F.struct(F.lit(-1).alias("ord"), F.lit(rule).alias("line")))))
    return headings.unionByName(rows)


def vocab_report(metrics: DataFrame) -> DataFrame:
    """Vocabulary report lines ``(label, target_vocab_size, ord, line)``."""
    rows = metrics.select(
        "label", "target_vocab_size", ex.order_of(F.col("config")).alias("ord"),
        table_row(
            bold(ex.title_of(F.col("config"))), F.col("actual_vocab_size").cast("string"),
            F.col("concepts").cast("string"), F.format_string("%.2f%%", "density"),
            F.format_string("%.4f", "chars_per_token"), ex.signed_percent(F.col("inflation")),
            ex.signed_percent(F.col("vocab_diff"))).alias("line"))
    section = F.concat(F.lit("## Dataset: "), "label", F.lit(", target vocabulary "),
                       ex.size_label(F.col("target_vocab_size")))
    return with_headings(rows, section, VOCAB_COLUMNS, ["label", "target_vocab_size"])


def _stat(results: DataFrame, value: str, fmt: str, unit: str = "", single: str | None = None) -> Column:
    """``mean ± std`` of a result column inside an aggregation over seeds; ``single`` formats a lone run."""
    return ex.plus_minus(fmt, F.avg(value), F.stddev_pop(value), F.count(value), unit, single)


def sweep_report(results: DataFrame) -> DataFrame:
    """Training sweep lines ``(dataset, ord, line)`` from one row per run."""
    infl = ex.paired_inflation(results).groupBy("dataset", "config").agg(
        ex.plus_minus("%+.2f", F.avg("inflation"), F.stddev_pop("inflation"),
                      F.count("inflation"), "%%").alias("infl"))
    is_base = ex.is_baseline(F.col("config"))
    rows = results.groupBy("dataset", "config").agg(
        _stat(results, "vocab_size", "%,.1f", single="%,.0f").alias("vocab"),
        _stat(results, "char_to_token_ratio", "%.3f").alias("cpt"),
        _stat(results, "tokens_per_sec", "%.1f").alias("tps"),
        _stat(results, "chars_per_sec", "%.1f").alias("cps"),
        _stat(results, "final_val_loss", "%.4f").alias("loss"),
        _stat(results, "final_ppl_token", "%.2f").alias("ppl"),
        _stat(results, "final_ppl_char", "%.4f").alias("cppl"))
    rows = rows.join(infl, ["dataset", "config"], "left").select(
        "dataset", ex.order_of(F.col("config")).alias("ord"),
        table_row(bold(ex.title_of(F.col("config"))), F.col("vocab"), F.col("cpt"),
                  F.when(is_base, "0.00%").otherwise(F.coalesce("infl", F.lit("N/A"))),
                  F.col("tps"), F.col("cps"), F.col("loss"), F.col("ppl"), F.col("cppl")).alias("line"))
    return with_headings(rows, F.concat(F.lit("## Dataset: "), "dataset"), SWEEP_COLUMNS, ["dataset"])


def generation_report(results: DataFrame, metric: str) -> DataFrame:
    """Downstream lines ``(dataset, ord, line)`` from one row per run."""
    rows = results.groupBy("dataset", "config").agg(
        _stat(results, "avg_tokens_generated", "%.1f").alias("a"),
        _stat(results, "avg_tokens_before_collapse", "%.1f").alias("b"),
        _stat(results, "avg_chars_generated", "%.1f").alias("c"),
        _stat(results, "tokens_per_sec", "%.1f").alias("d"),
        _stat(results, "chars_per_sec", "%.1f").alias("e"),
        _stat(results, "pct_empty", "%.1f").alias("f"),
        _stat(results, "success_rate", "%.2f").alias("g"),
    ).select("dataset", ex.order_of(F.col("config")).alias("ord"), table_row(
        bold(ex.title_of(F.col("config"))), *map(F.col, "abcde"),
        F.concat("f", F.lit("%")), F.concat("g", F.lit("%"))).alias("line"))
    return with_headings(rows, F.concat(F.lit("## Dataset: "), "dataset"),
                         (*GENERATION_COLUMNS, metric), ["dataset"])


def _quoted(text: Column) -> Column:
    """A string on one line, control characters and quotes escaped."""
    for raw, shown in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return F.concat(F.lit("'"), text, F.lit("'"))


def sample_report(samples: DataFrame, by=("run",)) -> DataFrame:
    """Lines ``(*by, ord, line)`` of the first success and failure of each run."""
    kind = F.when(F.col("success"), F.lit("Success")).otherwise(F.lit("Failure"))
    shift = F.when(F.col("success"), 0).otherwise(10)
    tokens = F.concat(F.lit("["), F.array_join(F.transform("tokens", _quoted), ", "), F.lit("]"))
    lines = [F.concat(F.lit("#### "), kind, F.lit(" Sample")),
             F.concat(F.lit("* **Prompt**: `"), _quoted(F.col("prompt")), F.lit("`")),
             F.concat(F.lit("* **Generated Tokens (first 20)**: `"), tokens, F.lit("`")),
             F.concat(F.lit("* **Decoded Completion**: `"), _quoted(F.col("completion")), F.lit("`")),
             F.format_string("* **Completion Length (chars)**: %d", F.length("completion"))]
    found = samples.select(*by, F.inline(F.array(*[
        F.struct((shift + i).alias("ord"), line.alias("line")) for i, line in enumerate(lines)])))
    both = samples.select(*by).distinct().withColumn("success", F.explode(F.array(F.lit(True), F.lit(False))))
    absent = both.join(samples.select(*by, "success"), [*by, "success"], "left_anti").select(
        *by, shift.alias("ord"), F.format_string(
            "*No %s sample found for this configuration.*", F.lower(kind)).alias("line"))
    return found.unionByName(absent)


def write_report(lines: DataFrame, path: str, order: list[str]) -> None:
    """Lines as one text file. A report has a few lines per run, so one task writes it."""
    lines.coalesce(1).sortWithinPartitions(*order).select("line").write.text(path)
