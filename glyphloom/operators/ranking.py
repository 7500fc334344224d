"""Ordered limits, global positions and prefix sums without a one-partition window."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from glyphloom.session import written

#: Rows that one range of ``with_prefix`` holds, about.
ROWS_PER_RANGE = 1_000_000


def first_n(df: DataFrame, n: int, order: str = "doc_id") -> DataFrame:
    """First ``n`` rows in order: a per-partition top-n, then a merge of those."""
    return df.orderBy(order).limit(n)


def first_n_per_group(df: DataFrame, n: int, group: str, order: str = "doc_id",
                      salts: int = 64) -> DataFrame:
    """First ``n`` rows of each group; a hot group is cut by ``salts`` tasks first."""
    salted = Window.partitionBy(group, "_salt").orderBy(order)
    merged = Window.partitionBy(group).orderBy(order)
    return (df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)))
            .withColumn("_rank", F.row_number().over(salted)).filter(F.col("_rank") <= n)
            .withColumn("_rank", F.row_number().over(merged)).filter(F.col("_rank") <= n)
            .drop("_salt", "_rank"))


def with_prefix(df: DataFrame, value: Column, out: str, order: str | tuple[str, ...], group: tuple[str, ...] = (),
                total: str | None = None, buckets: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all earlier rows of the group, in order, nulls first.

    Rows are dealt into sorted ranges of (group, order) and written once, each with
    the running sum of its range. Totals of ranges, a row per range and group, give
    every range its offset. No row moves again, no window covers a table or a group,
    and a range holds some ``ROWS_PER_RANGE`` rows however large the table is. Rows
    with equal order follow each other as they were written. ``total`` names an
    optional column for the sum over the whole group.
    """
    order = (order,) if isinstance(order, str) else tuple(order)
    source = df.withColumn("_value", value.cast("bigint"))
    buckets = buckets or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                             -(-df.count() // ROWS_PER_RANGE))
    keys = [F.col(k).asc_nulls_first() for k in (*group, *order)]
    dealt = (source.repartitionByRange(buckets, *keys).sortWithinPartitions(*keys)
             .withColumn("_range", F.spark_partition_id()))
    schema = StructType([*dealt.schema.fields, StructField("_before", LongType())])
    laid = written(dealt.mapInArrow(_running, schema), "ranges")
    sums = laid.groupBy("_range", *group).agg(F.sum("_value").alias("_sum"), F.min("_before").alias("_first"))
    every = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = every.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    keyed = [F.col(k).alias(f"_group{i}") for i, k in enumerate(group)]
    offsets = written(sums.select(
        F.col("_range").alias("_of"), *keyed,
        (F.coalesce(F.sum("_sum").over(before), F.lit(0)) - F.col("_first")).alias("_offset"),
        *([F.sum("_sum").over(every).alias(total)] if total else [])), "offsets")
    same = F.col("_range") == F.col("_of")
    for i, k in enumerate(group):
        same = same & F.col(k).eqNullSafe(F.col(f"_group{i}"))
    return (laid.join(offsets, same).withColumn(out, F.col("_offset") + F.col("_before"))
            .drop("_value", "_range", "_before", "_of", "_offset", *[f"_group{i}" for i in range(len(group))]))


def _running(batches):
    """Append the sum of ``_value`` over all earlier rows of the partition; values are not negative."""
    at = 0
    for batch in batches:
        values = batch.column("_value").fill_null(0).to_numpy(zero_copy_only=False)
        sums = np.cumsum(values) + at
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums - values)],
                                         names=[*batch.schema.names, "_before"])
        at = int(sums[-1]) if len(sums) else at


def with_position(df: DataFrame, out: str = "position", order: str | tuple[str, ...] = "doc_id",
                  group: tuple[str, ...] = (), total: str | None = None) -> DataFrame:
    """Zero-based position of each row in the whole table (or in its group)."""
    return with_prefix(df, F.lit(1), out, order, group, total)


def positional_split(df: DataFrame, train_share: float = 0.9) -> DataFrame:
    """First share of the positions is ``train``, the rest ``validation``."""
    return with_position(df, total="_rows").withColumn("split", F.when(
        F.col("position") < F.floor(F.col("_rows") * F.lit(train_share)), "train"
    ).otherwise("validation")).drop("_rows")


def positional_split_at(df: DataFrame, train_rows: int, validation_rows: int) -> DataFrame:
    """Fixed sizes: the first rows train, the next validate, later rows are not used."""
    total = train_rows + validation_rows
    return with_position(df).filter(F.col("position") < total).withColumn(
        "split", F.when(F.col("position") < train_rows, "train").otherwise("validation"))
