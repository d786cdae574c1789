"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktl.llm.common import remove, written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b): component is the smallest id that can be reached.

    Every round is a few grouped minima and joins on rows of two longs, written to the shared folder;
    the number of rounds grows with the logarithm of the longest chain. No component is gathered in
    one place. Links of an id to itself and repeated links are fine; no links give no rows.
    """
    spark = links.sparkSession
    edges = written(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).filter("x > y").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x > y").distinct()
        large = written(large, "links")
        parent = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(parent, "x").select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e")).select("e.*").filter("x > y").distinct()
        small = written(small, "links")
        remove(spark, edges, large)
        edges = small
        forked = edges.groupBy("x").count().filter("count > 1")
        deep = edges.select(F.col("y").alias("x")).join(edges.select("x"), "x", "left_semi")
        if forked.select("x").unionByName(deep).isEmpty():
            break
    roots = edges.select(F.col("y").alias("id"), F.col("y").alias("component")).distinct()
    return edges.select(F.col("x").alias("id"), F.col("y").alias("component")).unionByName(roots)
