"""Helpers shared by the operators of this subpackage."""

from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from glyphloom.functions.memory import _BATCH, lean, slim, small_batches

_IN = "_in_"
#: Rows that ``appended`` works on at once, so that Python objects of a batch stay few.
ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing_shuffles(spark: SparkSession):
    """Within, a query's shuffle files go when it ends: for loops whose queries are each run once."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


@contextmanager
def records_a_batch(spark: SparkSession, rows: int):
    """Within, queries that are run send Python so few rows at once: for rows that are large blobs."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def slimmed(compute: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """``compute``, which works on groups, after which its worker is slim again."""
    if compute.__code__.co_argcount == 1:
        def one(group: pa.Table) -> pa.Table:
            out = compute(group)
            slim()
            return out
        return one

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = compute(left, right)
        slim()
        return out
    return two


def quoted(name: str) -> Column:
    """Column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def guarded(docs: DataFrame, known: list[str], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``operator(docs)``, of which the columns of ``docs`` come back, in their order.

    It meets only the ``known`` columns by name. All others travel under private names, so that
    none of them can clash with a name it uses.
    """
    private = {c: f"_other{i}" for i, c in enumerate(docs.columns) if c not in known}
    inner = docs.select(*(quoted(c).alias(private.get(c, c)) for c in docs.columns))
    return operator(inner).select(*(F.col(private[c]).alias(c) if c in private else quoted(c) for c in docs.columns))


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def appended(df: DataFrame, column: str, fields: list[StructField],
             compute: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """``df`` with the columns that ``compute`` makes of ``column``, an Arrow batch at a time.

    A column of ``df`` that bears the name of a new one is replaced.
    """
    small_batches(df.sparkSession)
    new = {f.name for f in fields}
    kept = [c for c in df.columns if c not in new]
    # Python operators can't address names with dots, so columns travel under numbers.
    source = df.select(*(quoted(c).alias(f"_{i}") for i, c in enumerate(kept)), quoted(column).alias(_IN))
    schema = StructType([*source.schema.fields[:-1], *(StructField(f"_{len(kept) + i}", f.dataType, f.nullable)
                                                       for i, f in enumerate(fields))])
    names = schema.names

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                arrays = compute(batch.column(batch.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=names)

    return source.mapInArrow(lean(run), schema).toDF(*kept, *(f.name for f in fields))
