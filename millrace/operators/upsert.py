"""Last writer wins: the latest row of each key, and key sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.model import Relation


def latest(rel: Relation, *columns: str) -> DataFrame:
    """The last arrival of each pk: pk, ``columns`` (all by default) and seq.

    ``max_by`` is pre-aggregated before the exchange, so a pk with very many arrivals
    sends one row from each task; only the columns asked for are read and sent.
    """
    value = [c for c in rel.df.columns if c not in ("pk", "seq") and (not columns or c in columns)]
    if rel.unique:
        return rel.df.select("pk", *value, "seq")
    newest = F.max_by(value[0] if len(value) == 1 else F.struct(*value), "seq").alias("_value") if value else F.lit(None).alias("_value")
    kept = rel.df.groupBy("pk").agg(newest, F.max("seq").alias("seq"))
    return kept.select("pk", *(F.col("_value").alias(c) if len(value) == 1 else F.col(f"_value.{c}").alias(c) for c in value), "seq")


def latest_by_rank(rel: Relation) -> DataFrame:
    """The same by a window; Spark drops all but the first of each task before the exchange."""
    turn = F.row_number().over(Window.partitionBy("pk").orderBy(F.desc("seq")))
    return rel.df.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def key_set(rel: Relation) -> DataFrame:
    """All join keys that ever arrived: a store under the join key forgets the pk."""
    return rel.df.select("sk").distinct()
