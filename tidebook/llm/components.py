"""Connected components of a graph that is too large for one machine.

Alternating stars (large and small) after Kiveris and others: each round every vertex tells its larger, then its
smaller neighbours of the smallest vertex it knows. Rounds are written to the shared folder, which cuts the lineage and
outlives executors; only one number per round comes to the driver. A vertex with very many neighbours is one row of
minima joined with many edges; both sides of that join are read from files, so that Spark can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.session import scratch


def kept(frame: DataFrame, label: str) -> DataFrame:
    """The frame, written to the shared folder and read again."""
    path = scratch(frame.sparkSession, label)
    schema = frame.schema
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(schema).parquet(path)


def _minima(both: DataFrame, least) -> DataFrame:
    return kept(both.groupBy("a").agg(least.alias("m")), "minima")


def _stars(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = edges.unionByName(turned)
    low = _minima(both, F.least(F.col("a"), F.min("b")))
    large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = kept(large.where("a <> b").distinct(), "large-star")  # each edge (a, b) has a > b
    low = _minima(large, F.min("b"))
    joined = large.join(low, "a")
    own = low.select("a", F.col("m").alias("b"))
    small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)
    return large, kept(small.distinct(), "small-star")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """For every vertex of an edge: ``vertex`` and ``component``, the smallest vertex it can reach.

    Edges count in both directions; loops, repeated edges and edges with a null end add nothing.
    """
    a, b = F.col(a), F.col(b)
    edges = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    edges = kept(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        edges = _stars(edges)[1]
    roots = edges.select(F.col("b").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("component"))
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(roots)
