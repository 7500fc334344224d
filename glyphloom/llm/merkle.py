"""Merkle manifest of a table, with a witness for every row.

Rows are leaves, ordered within their group. Every two consecutive nodes of a level
become one node, a last one alone becomes the hash of itself, until one node, the
group's subroot, is left; subroots in order of their groups are the leaves of one
further tree, whose root stands for the table. A witness lists a leaf's siblings
up to the root, so that anyone who has the row can fold it to the root.

Witnesses grow incrementally. ``Frontier`` takes leaves in order and holds the open
subtrees, the aligned complete ones that still wait for their right neighbour. An
append that completes a subtree extends the witnesses of all its leaves at once,
each half by the other half's digest. Spark deals a group into aligned blocks of
2 ** ``BITS`` leaves, a task streams its blocks through a frontier each, and block
roots are appends of the next round in the same way, so no task holds more than a
block and rounds are few (three for 10**9 leaves). Only digests and keys are
shuffled, never texts.

Defined results: a null field is hashed as ``-``; null keys and null groups come
first; equal keys are ordered by their leaves, so that repeated rows are as many
equal leaves; a group of one leaf has that leaf as subroot, and a table of one group
has that subroot as root, with empty witnesses; an empty table has no rows; long
texts are hashed whole; other columns, whatever their names, are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from glyphloom.llm.frames import quoted
from glyphloom.operators.ranking import with_position
from glyphloom.session import written

BITS = 10
PATH = "array<struct<sibling: string, before: boolean>>"


def field(value: Column) -> Column:
    """A value as its byte count and its text, so that no two rows spell the same leaf."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def joined(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Frontier:
    """Leaves appended in order; witnesses of all of them and the open subtrees.

    ``witness[level][i]`` is the sibling of leaf i's ancestor at that level, None as
    long as it isn't known, and for good where the ancestor stays alone.
    """

    def __init__(self, leaves: int):
        self.witness: list[np.ndarray] = []
        self.open: list[tuple[int, int, int, str]] = []  # first leaf, end, height, digest
        self.leaves, self.size = leaves, 0

    def append(self, digest: str) -> None:
        node = (self.size, self.size + 1, 0, digest)
        self.size += 1
        while self.open and self.open[-1][2] == node[2]:
            node = self._completed(self.open.pop(), node)
        self.open.append(node)

    def _completed(self, left, right):
        level = self._level(left[2])
        level[left[0]:left[1]] = right[3]
        level[right[0]:right[1]] = left[3]
        return left[0], right[1], left[2] + 1, joined(left[3], right[3])

    def _level(self, height: int) -> np.ndarray:
        while len(self.witness) <= height:
            self.witness.append(np.full(self.leaves, None, object))
        return self.witness[height]

    def _raised(self, node):
        self._level(node[2])
        return *node[:2], node[2] + 1, joined(node[3])

    def closed(self, height: int | None = None) -> str:
        """Root once no leaf follows: at ``height``, or else at the first level of one node."""
        node = self.open.pop()
        while self.open:
            node = self._completed(self.open.pop(), node) if self.open[-1][2] == node[2] else self._raised(node)
        while height is not None and node[2] < height:
            node = self._raised(node)
        return node[3]


def _streamed(bits: int):
    """Batches sorted by block: each row gets its path to the block's root, and that root."""

    def finished(rows: list, names: list[str]):
        """Close the block of these rows (all columns but path and top, as tuples)."""
        at = {name: i for i, name in enumerate(names)}
        front = Frontier(len(rows))
        for row in rows:
            front.append(row[at["_digest"]])
        top = front.closed(bits if rows[0][at["_count"]] > 1 << bits else None)
        for i, row in enumerate(rows):
            path = [{"sibling": level[i], "before": None if level[i] is None else bool(i >> h & 1)}
                    for h, level in enumerate(front.witness)]
            yield *row, path, top

    def run(batches):
        names, schema, waiting, key = None, None, [], None
        for batch in batches:
            if names is None:
                names = batch.schema.names
                group, position = names.index("_group"), names.index("_position")
                schema = pa.schema([*batch.schema, pa.field("_path", pa.list_(pa.struct(
                    [("sibling", pa.string()), ("before", pa.bool_())]))), pa.field("_top", pa.string())])
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                block = (row[group], row[position] >> bits)
                if waiting and block != key:
                    done.extend(finished(waiting, names))
                    waiting = []
                key = block
                waiting.append(row)
            if done:
                yield _batch(done, schema)
        if waiting:
            yield _batch(list(finished(waiting, names)), schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _round(nodes: DataFrame, bits: int) -> DataFrame:
    """``nodes`` (_group, _position, _count, _digest, ...) with their path inside their block, and its root."""
    block = F.shiftright("_position", bits)
    dealt = nodes.repartition(F.col("_group"), block).sortWithinPartitions("_group", "_position")
    schema = StructType([*nodes.schema.fields, *StructType.fromDDL(f"_path {PATH}, _top string").fields])
    return written(dealt.mapInArrow(_streamed(bits), schema), "merkle")


def _trees(nodes: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with ``_path`` to their group's root and that root, ``_top``; and the roots (_group, _digest)."""
    rounds = [_round(nodes, bits)]
    most = nodes.agg(F.max("_count")).first()[0] or 0
    while most > 1 << bits:
        most = -(-most >> bits)
        roots = rounds[-1].where((F.col("_position") % (1 << bits) == 0) & (F.col("_count") > 1 << bits)).select(
            "_group", F.shiftright("_position", bits).alias("_position"),
            (-F.shiftright(-F.col("_count"), bits)).alias("_count"), F.col("_top").alias("_digest"))
        rounds.append(_round(roots, bits))
    tops = [r.where((F.col("_position") == 0) & (F.col("_count") <= 1 << bits)).select("_group", F.col("_top").alias("_digest"))
            for r in rounds]
    whole = rounds.pop()
    while rounds:
        upper = whole.select(F.col("_group").alias("_g"), F.col("_position").alias("_block"),
                             F.col("_path").alias("_rest"), F.col("_top").alias("_above"))
        lower = rounds.pop()
        same = lower["_group"].eqNullSafe(F.col("_g")) & (F.shiftright("_position", bits) == F.col("_block"))
        whole = (lower.join(upper, same, "left")
                 .withColumn("_path", F.concat("_path", F.coalesce("_rest", F.array().cast(PATH))))
                 .withColumn("_top", F.coalesce("_above", "_top")).drop("_g", "_block", "_rest", "_above"))
    roots = tops[0]
    for more in tops[1:]:
        roots = roots.unionByName(more)
    return whole, roots


def manifest(rows: DataFrame, key: str, group: str, leaf: Column, carried: dict[str, Column] | None = None,
             bits: int = BITS) -> DataFrame:
    """One row per row: ``key``, ``group``, leaf, subroot, root, path and what is ``carried`` along.

    ``path`` has a step per level: the sibling's digest and whether it goes before;
    both are null where a node stayed alone and was hashed by itself.
    """
    carried = carried or {}
    extra = [f"_carried{i}" for i in range(len(carried))]
    leaves = rows.select(quoted(key).alias("_key"), quoted(group).cast("string").alias("_group"), leaf.alias("_digest"),
                         *(c.alias(x) for c, x in zip(carried.values(), extra)))
    placed = with_position(leaves, "_position", ("_key", "_digest"), ("_group",), "_count")
    trees, roots = _trees(placed, bits)
    one = roots.withColumn("_member", F.col("_group")).withColumn("_group", F.lit(None).cast(StringType()))
    uppers, top = _trees(with_position(written(one, "subroots"), "_position", "_member", ("_group",), "_count"), bits)
    above = uppers.select("_member", F.col("_path").alias("_rest"), F.col("_top").alias("_root"))
    return trees.join(above, trees["_group"].eqNullSafe(F.col("_member"))).select(
        F.col("_key").alias(key), F.col("_group").alias(group), F.col("_digest").alias("leaf"), F.col("_top").alias("subroot"),
        F.col("_root").alias("root"), F.concat("_path", "_rest").alias("path"),
        *(F.col(x).alias(name) for x, name in zip(extra, carried)))


def folded(leaf: Column, path: Column) -> Column:
    """Root that a leaf and its path lead to."""
    def step(digest, s):
        pair = (F.when(s["sibling"].isNull(), digest).when(s["before"], F.concat(s["sibling"], digest))
                .otherwise(F.concat(digest, s["sibling"])))
        return F.sha2(pair.cast("binary"), 256)
    return F.aggregate(path, leaf, step)


def proof_digest(path: Column) -> Column:
    """Hash of a path's siblings, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["sibling"]), "").cast("binary"), 256)
