"""Connected components by alternating large and small stars over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


TASK_EDGES = 400_000


def _print_of(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r.n, r.x


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (x, y) of longs, either direction -> (node, component), component the smallest node reachable.

    Only nodes with an edge come back.  Self-loops, repeated edges and nulls are
    ignored.  Each pass is two shuffles by node with map-side minima and is
    written to the shared folder, so lineage stays short; the number of passes
    is logarithmic in the longest path.
    """
    e = written(edges.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    before = None
    while (now := _print_of(e)) != before:
        before = now
        if not now[0]:
            break
        k = 6 + now[0] // TASK_EDGES  # a task for so many edges is enough; tiny tasks cost more than their work
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(k)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(k)
        large = written(large.distinct().coalesce(k), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(k)
        e = written(small.unionByName(low.select("a", F.col("m").alias("b"))).coalesce(k).distinct().coalesce(k), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
