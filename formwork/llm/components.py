"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formwork.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node reachable) for each node of ``edges`` (a, b: long).

    Alternates large-star and small-star steps: each node ties its larger, then its smaller
    neighbours to the least one it knows, until nothing changes.  The least neighbour is found by an
    aggregate that is combined before the shuffle and joined back, so a node with very many edges is
    neither gathered in a task nor a bar to splitting the join.  Each round's edges are written.
    Loops and repeated edges are allowed; an edge with a null end is ignored; no edges, no rows.
    """
    e = edges.select("a", "b").filter("a <> b").distinct()
    e = written(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        e = written(small.select("e.*").filter("a <> b").distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    stars = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return written(stars.union(roots))
