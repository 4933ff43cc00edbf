"""Counts, with aggregation pushed below the join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.model import Family, JoinSpec
from millrace.operators.index import along
from millrace.operators.joins import hinted
from millrace.operators.upsert import key_set


def group_counts(df: DataFrame, name: str = "n") -> DataFrame:
    """(sk, n): multiplicity of each key."""
    return df.groupBy("sk").agg(F.count("*").alias(name))


def count_product(spec: JoinSpec) -> DataFrame:
    """(sk, n_r, n_s, matches) of a join without making its rows: what is joined has a
    row for each key, so a key with any number of rows costs no more than another."""
    left = group_counts(along(spec.left, spec.left_path), "n_r")
    if spec.family is Family.PRIMARY:
        right = key_set(spec.right).withColumn("n_s", F.lit(1).cast("long"))
    else:
        right = group_counts(along(spec.right, spec.right_path), "n_s")
    return left.join(hinted(right, spec.strategy), "sk").withColumn("matches", F.col("n_r") * F.col("n_s"))


def count_matches(spec: JoinSpec) -> DataFrame:
    """One row: matches."""
    return count_product(spec).agg(F.coalesce(F.sum("matches"), F.lit(0)).cast("long").alias("matches"))


def repetitions(df: DataFrame) -> DataFrame:
    """One row: rows, distinct keys and their average repetition."""
    counts = group_counts(df)
    n, keys = F.coalesce(F.sum("n"), F.lit(0)).cast("long"), F.count("*")
    return counts.agg(n.alias("n_rows"), keys.alias("n_keys"), (F.sum("n") / F.count("*")).alias("avg_repetitions"))
