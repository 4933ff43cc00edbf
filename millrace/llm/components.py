"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and joins over the edges.  A vertex may have any
part of all edges: its minimum is pre-aggregated and joined back over salted keys,
so no task meets all neighbours of a vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._session import checkpointed

SALTS = 8


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join on keys of which ``left`` may have very many rows and ``right`` one each.

    ``spread`` names a column of ``left`` that differs between the rows of a key.
    """
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    copies = right.withColumn("_salt", F.explode(F.array(*(F.lit(k).cast("long") for k in range(salts)))))
    return dealt.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")  # nothing here is broadcast: no side has a bound


def dealt_join(left: DataFrame, right: DataFrame, on: str, spread: str, rows: int) -> DataFrame:
    """Inner join on a key of which ``left`` may have very many rows and ``right`` one
    wide one: a key's rows are dealt to tasks of about ``rows``, and ``right`` is copied
    only as often as its key needs."""
    deal = left.groupBy(on).agg(F.ceil(F.count("*") / rows).alias("_deals"))
    copies = right.join(deal, on).withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_deals") - 1)))
    many = deal.filter("_deals > 1").withColumnRenamed("_deals", "_of")
    dealt = salted_join(left, many, [on], spread, "left").withColumn("_deal", F.pmod(F.xxhash64(spread), F.coalesce("_of", F.lit(1))))
    return dealt.drop("_of").join(copies.drop("_deals").hint("merge"), [on, "_deal"]).drop("_deal")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each vertex's larger (or smaller) neighbours to its least one; edges have u > v."""
    around = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = salted_join(around, least, ["u"], "v")
    if large:
        linked = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return linked.filter("u <> v")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every vertex either has one edge down and none up, or only edges up."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    wrong = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or (down = 1 and up = 1)")
    return wrong.isEmpty()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, component) of all vertices with an edge; a component is its least vertex.

    The rounds end when the edges are stars around the components' least vertices.
    """
    now = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())
    while not _are_stars(now):
        now = checkpointed(_star(_star(now, large=True), large=False).distinct())
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
