"""Secondary indexes: composite rows or posting lists by secondary key.

A purged index inverts the latest rows; one that isn't purged inverts all arrivals and
leaves stale postings to the reader's check.  Lists are kept in segments of at most
``SEGMENT`` postings, in order, so a key with any number of rows never becomes one
value in memory, nor do its rows meet in one task.

``store`` builds an index once, as a table bucketed and sorted by secondary key, with
the rows that its reader checks bucketed by (sk, pk).  The relation it returns carries
it, and every reader of that relation by that access path uses it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.model import AccessPath, Layout, Relation
from millrace.operators.sorts import ranked
from millrace.operators.upsert import latest
from millrace.storage import materialized, shared_folder

SEGMENT = 4096
#: Keys of more than a segment are broadcast up to so many (16 bytes each), else joined by a shuffle.
BROADCAST_KEYS = 1_000_000


@dataclass(frozen=True)
class Index:
    """``df``: (sk, pk[, payload]) rows, or (sk, segment, postings) lists."""

    df: DataFrame
    layout: Layout
    covering: bool
    purged: bool
    base: DataFrame

    def _rows(self, df: DataFrame) -> DataFrame:
        """Postings of lists as rows; the columns of ``df`` besides the lists' stay."""
        if self.layout is Layout.COMPOSITE:
            return df
        rest = [c for c in df.columns if c not in ("segment", "postings")]
        return df.select(*rest, F.explode("postings").alias("p")).select(*rest, "p.*")

    def postings(self) -> DataFrame:
        """(sk, pk[, payload]) whatever the layout."""
        return self._rows(self.df)

    def checked(self, postings: DataFrame, how: str = "left_semi") -> DataFrame:
        """Postings whose base row still has their key.  A purged index needs no check."""
        return postings if self.purged and how == "left_semi" else postings.join(self.base.select("sk", "pk"), ["sk", "pk"], how)

    def valid(self) -> DataFrame:
        return self.checked(self.postings())

    def stale(self) -> DataFrame:
        """Postings that the check drops."""
        return self.checked(self.postings(), "left_anti")

    def met(self, keys: DataFrame) -> DataFrame:
        """Valid postings joined with ``keys`` by sk: lists meet the keys before they are
        opened, and only postings of keys that are there are checked."""
        return self.checked(self._rows(self.df.join(keys, "sk")))

    def counts(self) -> DataFrame:
        """(sk, n) of valid postings; lists of a purged index are only measured."""
        if self.purged and self.layout is not Layout.COMPOSITE:
            return self.df.groupBy("sk").agg(F.sum(F.size("postings").cast("long")).alias("n"))
        return self.valid().groupBy("sk").agg(F.count("*").alias("n"))

    def probe(self, low: int, high: int | None = None) -> DataFrame:
        """Valid postings with low <= sk <= high (or sk = low), the key filtered in the scan."""
        at: Column = F.col("sk") == low if high is None else F.col("sk").between(low, high)
        return replace(self, df=self.df.filter(at), base=self.base.filter(at)).valid()


def build(rel: Relation, layout: Layout, covering: bool = False, purged: bool | None = None) -> Index:
    """An index over a relation.  Covering ones carry the payload and are purged, as
    their readers make no check; ``purged`` keeps a plain one in step with its base."""
    purged = covering if purged is None else purged
    if covering and not purged:
        raise ValueError("a covering index is read without a check, so it must be purged")
    value = ["payload"] if covering and rel.covered else []
    base = latest(rel, "sk", *value)
    if layout is Layout.COMPOSITE:
        rows = base.select("sk", "pk", *value) if purged else rel.df.select("sk", "pk").distinct()
        return Index(rows, layout, covering, purged, base)
    newest = layout is Layout.EAGER
    if purged:
        rows = base.select("sk", "pk", *value, "seq")
    else:  # a list is a set: of repeated postings the first in its order counts
        rows = rel.df.groupBy("sk", "pk").agg((F.max if newest else F.min)("seq").alias("seq"))
    return Index(_lists(rows, newest, ["pk", *value]), layout, covering, purged, base)


def _lists(rows: DataFrame, newest: bool, columns: list[str]) -> DataFrame:
    """(sk, segment, postings) from (sk, pk[, payload], seq) rows.

    A key of one segment is one group.  The rows of keys that need more are ranked in
    sorted ranges, so a key of any frequency is spread over tasks.
    """
    rows = materialized(rows, "postings")
    crowded = materialized(rows.groupBy("sk").agg(F.count("*").alias("_n")).filter(F.col("_n") > SEGMENT).select("sk"), "crowded")
    n_crowded = crowded.count()
    posting = F.struct(*columns)
    # a newest-first list is read backwards, and then ties have the larger pk first
    once = F.sort_array(F.collect_list(F.struct("seq", (-F.col("pk") if newest else F.col("pk")).alias("_tie"), posting.alias("p"))))
    kept = F.transform(F.reverse(once) if newest else once, lambda e: e["p"]).alias("postings")
    if not n_crowded:
        return rows.groupBy("sk").agg(kept).select("sk", F.lit(0).cast("long").alias("segment"), "postings")
    keys = F.broadcast(crowded) if n_crowded <= BROADCAST_KEYS else crowded
    few = rows.join(keys, "sk", "left_anti").groupBy("sk").agg(kept).select("sk", F.lit(0).cast("long").alias("segment"), "postings")
    placed = ranked(rows.join(keys, "sk"), F.col("sk"), F.desc("seq") if newest else F.col("seq"), F.col("pk"))
    first = placed.groupBy("sk").agg(F.min("rank").alias("_first"))
    turned = placed.join(F.broadcast(first) if n_crowded <= BROADCAST_KEYS else first, "sk").withColumn("_turn", F.col("rank") - F.col("_first"))
    many = turned.groupBy("sk", F.floor(F.col("_turn") / SEGMENT).alias("segment")).agg(F.sort_array(F.collect_list(F.struct("_turn", posting.alias("p")))).alias("x"))
    return few.unionAll(many.select("sk", "segment", F.transform("x", lambda e: e["p"]).alias("postings")))


def access(rel: Relation, path: AccessPath) -> Index:
    """The index stored for an access path, or one built for this use."""
    path = _whole(path)
    return rel.indexes.get(path) or build(rel, path.layout, path.covering, path.purged)


def _whole(path: AccessPath) -> AccessPath:
    return replace(path, purged=path.purged or path.covering)


def along(rel: Relation, path: AccessPath) -> DataFrame:
    """(sk, pk) of a relation's latest rows, by way of an access path."""
    if path.layout is None:
        return latest(rel, "sk").select("sk", "pk")
    return access(rel, path).valid().select("sk", "pk")


def counters(rel: Relation) -> DataFrame:
    """One row of what building an index in step with its base does: arrivals scanned,
    postings inserted, and postings deleted as their row arrives again."""
    each = rel.df.groupBy("pk").agg(F.count("*").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    return each.agg(total.alias("n_scanned"), total.alias("n_inserted"), (total - F.count("*")).alias("n_deleted"))


def save_bucketed(df: DataFrame, table: str, buckets: int, by: tuple[str, ...] = ("sk",)) -> None:
    """A table bucketed and sorted by key, in the shared folder: joins on it need no exchange."""
    dealt = df.repartition(buckets, *by)  # a file for each bucket, not for each task and bucket
    dealt.write.mode("overwrite").option("path", shared_folder(df.sparkSession, table)).bucketBy(buckets, *by).sortBy(*by).saveAsTable(table)


def store(rel: Relation, path: AccessPath, name: str | None = None, buckets: int | None = None) -> Relation:
    """``rel`` with an index for ``path`` built, saved as the table ``name`` (and, if its
    reader checks, ``name_base``), and read from there."""
    spark, path = rel.df.sparkSession, _whole(path)
    name = name or f"ix_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    built = build(rel, path.layout, path.covering, path.purged)
    save_bucketed(built.df, name, buckets)
    if not path.purged:
        save_bucketed(built.base.select("sk", "pk"), f"{name}_base", buckets, ("sk", "pk"))
    return replace(rel, indexes={**rel.indexes, path: load(spark, name, path)})


def load(spark: SparkSession, name: str, path: AccessPath) -> Index:
    """A stored index."""
    path, df = _whole(path), spark.table(name)
    return Index(df, path.layout, path.covering, path.purged, df.select("sk", "pk") if path.purged and path.layout is Layout.COMPOSITE else spark.table(f"{name}_base") if not path.purged else df)
