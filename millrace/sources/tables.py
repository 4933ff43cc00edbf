"""Relations over the star-schema tables, and table output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.model import Relation


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> Relation:
    df = table(spark, sf_dir, "orders")
    return Relation(df.select(F.col("o_orderkey").alias("pk"), F.col("o_custkey").alias("sk"), F.col("o_orderkey").alias("seq")), unique=True)


def events(spark: SparkSession, sf_dir: str) -> Relation:
    df = table(spark, sf_dir, "events")
    return Relation(df.select(F.col("event_id").alias("pk"), F.col("user_id").alias("sk"), F.col("event_id").alias("seq")), unique=True)


def line_updates(spark: SparkSession, sf_dir: str) -> Relation:
    """An update stream: order lines arrive again under the same key with another part."""
    df = table(spark, sf_dir, "lineitem")
    pk = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return Relation(df.select(pk.cast("long").alias("pk"), F.col("l_partkey").alias("sk"), F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber").alias("seq"), F.col("l_suppkey").cast("string").alias("payload")))


def small_parts(spark: SparkSession, sf_dir: str) -> Relation:
    df = table(spark, sf_dir, "part").filter("p_size <= 10")
    return Relation(df.select(F.col("p_partkey").alias("pk"), F.col("p_partkey").alias("sk"), F.col("p_partkey").alias("seq")), unique=True)


def save(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """A Parquet table; an existing one is replaced or an error."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def storage_files(df: DataFrame) -> DataFrame:
    """(file, n_rows, n_bytes) of the files behind a table."""
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("n_bytes")).groupBy("file", "n_bytes").agg(F.count("*").alias("n_rows"))
