"""Tables between jobs in the folder that all machines share, and code on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path not used before below ``spark.checkpoint.dir``, which all executors of a
    cluster share; only where that is unset, as in tests, below the context's checkpoint
    folder or, in local mode, a temporary one."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root and not context._jsc.sc().getCheckpointDir().isEmpty():
        root = context._jsc.sc().getCheckpointDir().get()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tables-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str = "stage", folder: str | None = None, parts: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written as a table and read back: one result for all its readers.

    This cuts the lineage, and unlike ``checkpoint()`` the optimizer's constraints too,
    which in loops grow with every round.  ``parts``: columns that are folders.
    """
    folder = folder or shared_folder(df.sparkSession, name)
    df.write.partitionBy(*parts).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def tidy(spark: SparkSession) -> None:
    """Has the driver's JVM give back the heap that past jobs took, for a step in the
    driver's Python: both share one machine's memory."""
    spark._jvm.System.gc()


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Lets Python workers on machines that share this code's folder import it; elsewhere
    send the package with ``--py-files``."""
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    have = environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, have]))
