"""Equi-joins on the secondary key over any access paths.

All strategies and paths of a family give the same rows; they differ in plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.model import AccessPath, Family, JoinSpec, Layout, Relation, Strategy
from millrace.operators.index import access, along
from millrace.operators.upsert import key_set, latest

#: A side is broadcast only up to this size by the planner's statistics.
BROADCAST_BYTES = 64 << 20


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a result's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hinted(df: DataFrame, strategy: Strategy) -> DataFrame:
    """``df`` marked for a strategy; a side too large to broadcast is hashed after a shuffle."""
    if strategy is Strategy.BROADCAST and plan_bytes(df) > BROADCAST_BYTES:
        strategy = Strategy.SHUFFLE_HASH
    return df if strategy is Strategy.AUTO else df.hint(strategy.value)


def rows(spec: JoinSpec) -> DataFrame:
    """Inner family: (sk, r_pk, s_pk).  Primary family: (sk, r_pk) of rows with a match."""
    left = along(spec.left, spec.left_path).select("sk", F.col("pk").alias("r_pk"))
    if spec.family is Family.PRIMARY:
        return left.join(hinted(key_set(spec.right), spec.strategy), "sk", "left_semi")
    right = along(spec.right, spec.right_path).select("sk", F.col("pk").alias("s_pk"))
    return left.join(hinted(right, spec.strategy), "sk")


def index_probe(left: Relation, right: Relation, layout: Layout, covering: bool, strategy: Strategy = Strategy.AUTO) -> DataFrame:
    """Every latest left row against an index of the right: (sk, r_pk, s_pk).

    The left keys meet the index first; only the postings they find are checked
    against the base.
    """
    probing = latest(left, "sk").select("sk", F.col("pk").alias("r_pk"))
    index = access(right, AccessPath(layout, covering))
    return index.met(hinted(probing, strategy)).select("sk", "r_pk", F.col("pk").alias("s_pk"))


def index_merge(left: Relation, right: Relation, left_path: AccessPath, right_path: AccessPath) -> DataFrame:
    """Two access paths merged by key: (sk, n_r, n_s, matches), from counts alone."""

    def counts(rel: Relation, path: AccessPath, name: str) -> DataFrame:
        if path.layout is None:
            found = latest(rel, "sk").groupBy("sk").agg(F.count("*").alias("n"))
        else:
            found = access(rel, path).counts()
        return found.withColumnRenamed("n", name)

    merged = counts(left, left_path, "n_r").join(counts(right, right_path, "n_s").hint("merge"), "sk")
    return merged.withColumn("matches", F.col("n_r") * F.col("n_s"))
