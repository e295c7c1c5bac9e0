"""Connected groups from links, by alternating stars; nothing but sums comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.session import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])


def components(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(id, group): each linked id with the smallest id that links lead to.

    Every round each id hands its smallest neighbour to the others, first to the larger ones, then to the smaller; the edges
    become stars. Minima are combined before the shuffle and joined back, so a hub's neighbours are never one task's list.
    """
    edges = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = cut(edges, "links")
    old = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        edges = joined.filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(edges, "links")
        now = _state(edges)
        if now == old:
            break
        old = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("group"))).distinct()
