"""Structured Streaming: arrivals applied in micro-batches, last writer wins.

Each micro-batch writes only its own latest rows, under a folder named by the batch, so
a batch that runs again replaces itself.  A reader takes the last whole table and the
batches since.  Every ``compact`` batches these are merged into a new whole table, and
what the table before it and older batches held is dropped; the last whole table but one
stays, for readers that have begun.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.model import Relation
from millrace.operators.upsert import latest
from millrace.storage import discard

COMPACT = 20


def upsert_into(folder: str, compact: int = COMPACT) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: applies (pk, sk, seq[, payload]) arrivals to ``folder``."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest(Relation(batch)).select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if (number + 1) % compact == 0:
            read_version(spark, folder, number, compact, batch.schema, whole=number - compact).write.mode("overwrite").parquet(f"{folder}/whole={number}")
            discard(spark, f"{folder}/whole={number - 2 * compact}")
            for old in range(number - 2 * compact + 1, number - compact + 1):
                discard(spark, f"{folder}/batch={old}")

    return merge


def start(arrivals: DataFrame, folder: str, checkpoint: str, compact: int = COMPACT) -> StreamingQuery:
    """Runs over all that has arrived, then stops."""
    return arrivals.writeStream.foreachBatch(upsert_into(folder, compact)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_version(spark: SparkSession, folder: str, number: int, compact: int = COMPACT, schema=None, whole: int | None = None) -> DataFrame:
    """The latest rows after batch ``number``; the last two whole tables' worth can be read."""
    whole = (number + 1) // compact * compact - 1 if whole is None else whole
    paths = [f"{folder}/whole={whole}"] if whole >= 0 else []
    paths += [f"{folder}/batch={k}" for k in range(whole + 1, number + 1)]
    reader = spark.read.schema(schema) if schema is not None else spark.read
    arrivals = reader.parquet(*paths)
    return latest(Relation(arrivals)).select(*arrivals.columns)
