"""Connected components of a table of links, by alternating star operations.

A large star hangs a vertex's larger neighbours onto its smallest neighbour, a
small star its smaller ones; the two alternate until the edges are stars whose
centre is the smallest id of each component. Every step is an aggregation and a
join over edges, written to the shared folder, so hubs are split by the join and
a lost executor costs one step. Number of steps: logarithmic in the longest path.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.session import written


def _linked(pairs: DataFrame, mins: DataFrame) -> DataFrame:
    return pairs.join(mins, "u").select("v", "m")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    mins = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "mins")
    return _tidy(_linked(both.where("v > u"), mins))


def _small(edges: DataFrame) -> DataFrame:
    mins = written(edges.groupBy("u").agg(F.min("v").alias("m")), "mins")
    return _tidy(_linked(edges, mins).unionByName(mins.select(F.col("u").alias("v"), "m")))


def _tidy(pairs: DataFrame) -> DataFrame:
    """Distinct edges (u, v) with u > v of pairs (v, m)."""
    edge = pairs.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    return written(edge.distinct(), "edges")


def _mark(edges: DataFrame) -> tuple:
    """Tells two edge sets apart: their size and a sum of hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id of its component for every id in ``links`` (two id columns).

    Loops, repeated links and links with a null end change nothing. An empty
    table gives an empty table.
    """
    a, b = links.columns
    edges = _tidy(links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
                  .select(F.col(a).alias("v"), F.col(b).alias("m")))
    mark = _mark(edges)
    while mark[0]:
        edges = _small(_large(edges))
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
