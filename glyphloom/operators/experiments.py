"""Sweeps: the grid of runs, their results, and statistics over seeds."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.operators.configs import CATALOGUE


def grid(datasets: DataFrame, configs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every planned run. The inputs are small dimension tables, one row per choice."""
    return datasets.crossJoin(configs).crossJoin(seeds)


def missing_runs(planned: DataFrame, results: DataFrame, on=("dataset", "config", "seed")) -> DataFrame:
    return planned.join(results.select(*on), list(on), "left_anti")


def present_runs(planned: DataFrame, results: DataFrame, on=("dataset", "config", "seed")) -> DataFrame:
    return planned.join(results.select(*on), list(on), "left_semi")


def mean_pop_std(results: DataFrame, value: str, by=("dataset", "config")) -> DataFrame:
    """Mean, population deviation and count over the runs that have a value."""
    return results.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def baseline_of(config: Column, baselines: dict[str, str] | None = None) -> Column:
    """The configuration a run is compared with; a baseline is its own."""
    baselines = baselines or {c.name: c.baseline for c in CATALOGUE.values() if c.baseline}
    pairs = [F.lit(x) for pair in baselines.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), config), config)


def is_baseline(config: Column) -> Column:
    """Whether a configuration of the catalogue has no baseline but itself; unknown ones aren't."""
    return config.isin([c.name for c in CATALOGUE.values() if not c.baseline])


def paired_inflation(results: DataFrame, ratio: str = "char_to_token_ratio",
                     baselines: dict[str, str] | None = None) -> DataFrame:
    """Per-seed inflation in percent against the same seed of the baseline.

    Runs are paired by seed, not by list position, so a missing run leaves one pair
    out and moves none. Pairs without a positive ratio are left out.
    """
    base = results.select("dataset", F.col("config").alias("baseline"), "seed",
                          F.col(ratio).alias("_base"))
    df = results.withColumn("baseline", baseline_of(F.col("config"), baselines))
    if baselines is None:  # a configuration outside the catalogue has nothing to be compared with
        df = df.where(F.col("config").isin(list(CATALOGUE)))
    return (df.join(base, ["dataset", "baseline", "seed"])
            .filter((F.col(ratio) > 0) & (F.col("_base") > 0))
            .select("dataset", "config", "seed",
                    ((F.col("_base") / F.col(ratio) - 1) * 100).alias("inflation")))


# --- formatting --------------------------------------------------------------

def plus_minus(fmt: str, mean: Column, std: Column, n: Column, unit: str = "", single: str | None = None) -> Column:
    """``mean ± std``; the mean alone for one run; ``N/A`` for none."""
    one = F.format_string((single or fmt) + unit, mean)
    return (F.when(F.coalesce(n, F.lit(0)) == 0, "N/A").when(n == 1, one)
            .otherwise(F.format_string(fmt + unit + " ± " + fmt.replace("+", "") + unit, mean, std)))


def signed_percent(value: Column, none: str = "-") -> Column:
    return F.when(value.isNull(), none).otherwise(F.format_string("%+.2f%%", value))


def size_label(size: Column) -> Column:
    """``128k`` for thousands, plain digits below."""
    k = F.format_string("%dk", F.floor(size / 1000))
    return F.when(size >= 1000, k).otherwise(size.cast("string"))


def title_of(config: Column) -> Column:
    """Display name of a configuration, or the configuration itself."""
    pairs = [x for c in CATALOGUE.values() for x in (F.lit(c.name), F.lit(c.title))]
    return F.coalesce(F.element_at(F.create_map(*pairs), config), config)


def order_of(config: Column) -> Column:
    """Place in the catalogue; configurations outside it come after all others."""
    pairs = [x for i, c in enumerate(CATALOGUE) for x in (F.lit(c), F.lit(i))]
    return F.coalesce(F.element_at(F.create_map(*pairs), config), F.lit(len(CATALOGUE)))
