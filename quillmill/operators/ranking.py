"""Ranks over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.session import cut


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Adds the 0-based rank in the order of ``order``, which must be total.

    Rows are range-partitioned by the order, ranked within a range, and the ranges set one after another by a prefix sum over
    their counts. An empty table stays empty; an existing column of that name is replaced.
    """
    spark = df.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "ranked")
    counts = placed.groupBy("__range").agg(F.count("*").alias("__n"))  # one row per range
    base = counts.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return placed.withColumn("__within", within).join(F.broadcast(base), "__range").withColumn(name, (F.col("__base") + F.col("__within")).cast("bigint")).drop("__range", "__within", "__base")


def hash_rank(df: DataFrame, key: Column, seed: str = "1", name: str = "rank") -> DataFrame:
    """A rank in random but repeatable order: by md5 of seed and key, then the key."""
    mixed = df.withColumn("__h", F.md5(F.concat(F.lit(seed + ":"), key.cast("string")))).withColumn("__k", key)
    return global_rank(mixed, F.col("__h"), F.col("__k"), name=name).drop("__h", "__k")


def running_totals(df: DataFrame, *order: Column, **values: Column) -> DataFrame:
    """Adds, by name, the sum of each value up to and with each row in the order of ``order``, over the whole table, as ``global_rank`` ranks."""
    spark = df.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    wide = df.select("*", *[v.alias(f"__v_{k}") for k, v in values.items()])
    placed = cut(wide.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "summed")
    sums = placed.groupBy("__range").agg(*[F.sum(f"__v_{k}").alias(f"__n_{k}") for k in values])  # one row per range
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("__range", *[F.coalesce(F.sum(f"__n_{k}").over(before), F.lit(0)).alias(f"__base_{k}") for k in values])
    own = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = placed.select("*", *[F.sum(f"__v_{k}").over(own).alias(f"__in_{k}") for k in values]).join(F.broadcast(base), "__range")
    return within.select(*[F.col(c) for c in df.columns if c not in values], *[(F.col(f"__base_{k}") + F.col(f"__in_{k}")).alias(k) for k in values])


def running_total(df: DataFrame, *order: Column, value: Column, name: str = "total") -> DataFrame:
    """``running_totals`` of one value."""
    return running_totals(df, *order, **{name: value})
