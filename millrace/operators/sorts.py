"""Total order, ranks, first rows and hash partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.keys import hash_bucket, pad
from millrace.storage import materialized

_IN_PARTITION = (1 << 33) - 1


def total_sort(df: DataFrame, *by: str) -> DataFrame:
    """All rows in order: ranges, each sorted with spilling."""
    return df.orderBy(*by)


def ranked(df: DataFrame, *by: Column | str) -> DataFrame:
    """``df`` with its rank from 1 in the total order.

    Ranges are sorted side by side and materialized once; a row's rank is its place
    in its range plus the rows of the ranges before, so no task meets all rows.
    Without ties in ``by`` ranks are unique to a row.
    """
    ordered = df.repartitionByRange(*(F.col(c) if isinstance(c, str) else c for c in by)).sortWithinPartitions(*by)
    placed = ordered.withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(_IN_PARTITION))
    placed = materialized(placed, "ranked")
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return placed.join(offsets, "_range").withColumn("rank", F.col("_offset") + F.col("_place") + 1).drop("_range", "_place", "_offset")


def first_n(df: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """The first n arrivals, for a dense ``seq`` from 0: a filter that reaches the scan, not a sort."""
    return df.filter(F.col(order) < n)


def arrival_order(df: DataFrame, *by: Column | str) -> DataFrame:
    """``df`` with a dense ``seq`` from 0 in the order of ``by``; by a random key: a shuffle."""
    return ranked(df, *by).withColumn("seq", F.col("rank") - 1).drop("rank")


def bucket_histogram(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """(bucket, n) of the string hash of the padded key."""
    return df.select(hash_bucket(pad(F.col(key)), buckets).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def hash_partitioned(df: DataFrame, buckets: int) -> DataFrame:
    """Rows dealt by key into ``buckets`` partitions, each sorted: input for joins without an exchange."""
    return df.repartition(buckets, "sk").sortWithinPartitions("sk")
