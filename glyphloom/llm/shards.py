"""Vectors dealt into shards of bounded size, and blocks of queries taken to each of them."""

import pickle
from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.session import written

#: Results that a task holds before it lets them go.
HELD = 1_000_000
_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def usable(df: DataFrame, key: str, vector: str, zero: bool = True) -> DataFrame:
    """(id, v): one row an id, without vectors that are null, empty or hold null or non-finite parts.

    Of rows that share an id the smallest vector counts. ``zero`` tells whether
    zero vectors take part.
    """
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull()).where((F.size("v") > 0) & ~bad))
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def matrix(column) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)


def _blocks(df: DataFrame, kind: str, rows: int, pack: Callable) -> tuple[DataFrame, int]:
    """(dim, kind, blob) of ``df`` dealt by id into about so many rows a blob; written, and how many blobs there may be."""
    count = max(1, ceil(df.count() / rows))
    tasks = min(count, max(2 * df.sparkSession.sparkContext.defaultParallelism, count // 8))

    def packed(group: pa.Table) -> pa.Table:
        order = np.argsort(group["id"].to_numpy(), kind="stable")
        blob = pickle.dumps(pack(group["id"].to_numpy()[order], matrix(group["v"])[order]), pickle.HIGHEST_PROTOCOL)
        return pa.table({"dim": group["dim"][:1].cast(pa.int32()), kind: group[kind][:1].cast(pa.int32()),
                         f"{kind}_blob": pa.array([blob], pa.binary())})

    dealt = df.withColumn(kind, F.pmod(F.xxhash64("id", F.lit(len(kind))), F.lit(count)).cast("int"))
    return written(dealt.repartition(tasks, "dim", kind).groupBy("dim", kind)
                   .applyInArrow(packed, f"dim int, {kind} int, {kind}_blob binary"), kind), count


def _best(found: tuple, k: int) -> tuple:
    """The k best of each query: highest score first, then smaller id."""
    query, place, value = found
    order = np.lexsort((place, -value, query))
    query, place, value = query[order], place[order], value[order]
    fresh = np.concatenate(([True], query[1:] != query[:-1])) if len(query) else np.zeros(0, bool)
    rank = np.arange(len(query)) - np.maximum.accumulate(np.where(fresh, np.arange(len(query)), 0))
    return query[rank < k], place[rank < k], value[rank < k]


def nearest(vectors: DataFrame, every: int, k: int, prepare: Callable, search: Callable, score: str,
            shard_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every row whose id ``every`` divides.

    ``prepare(ids, rows)`` makes the index of a shard, once; it is written, and stays
    where it is. ``search(index, query_ids, queries, k)`` gives (query, place, score)
    arrays of one shard and one block of queries. Both are bounded, whatever the
    table's size, and each query's row is never its own candidate. Blocks of queries
    go to every shard; vectors move once, to become an index. Vectors of another
    length aren't comparable and lie in other shards. A task keeps the k best of a
    query over all its shards, and the k best of those are taken while merging.
    """
    spark = vectors.sparkSession
    vectors = written(vectors.withColumn("dim", F.size("v")), "vectors")
    asked = vectors.where(F.pmod(F.col("id"), F.lit(every)) == 0)
    shards, _ = _blocks(vectors, "shard", shard_rows, lambda ids, rows: (ids, prepare(ids, rows)))
    blocks, _ = _blocks(asked, "block", query_rows, lambda ids, rows: (ids, rows))
    kind = pa.int64() if score == "long" else pa.float64()

    def run(batches):
        none = np.zeros(0, np.int64)
        held, name, index = (none, none, none), None, None

        def batch(found):
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()),
                                               pa.array(found[2], kind)], names=["query_id", "vec_id", "score"])

        for rows in batches:
            for dim, shard, shard_blob, other, _, block_blob in zip(*rows.columns):
                if dim != other:
                    continue
                if name != (dim.as_py(), shard.as_py()):
                    name, index = (dim.as_py(), shard.as_py()), pickle.loads(shard_blob.as_buffer())
                query_ids, queries = pickle.loads(block_blob.as_buffer())
                at, place, value = search(index[1], query_ids, queries, k)
                found = query_ids[at], index[0][place], value
                held = _best(tuple(np.concatenate(x) for x in zip(held, found)), k) if len(held[0]) else found
                if len(held[0]) > HELD:
                    yield batch(held)
                    held = none, none, none
        yield batch(held)

    # A stated query set against all rows, block by block: rows of this join are pairs of blobs.
    pairs = shards.crossJoin(blocks.withColumnRenamed("dim", "other"))
    before = spark.conf.get(_RECORDS)
    spark.conf.set(_RECORDS, "4")
    try:
        found = written(pairs.mapInArrow(run, f"query_id long, vec_id long, score {score}"), "found")
    finally:
        spark.conf.set(_RECORDS, before)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
