"""The experiment grid: entry sizes and key skews over all join operators.

``run`` builds the access paths of each operator of each point as stored indexes, times
that and the join over them apart, and gives metric rows (point, operator, matches,
index_ms, join_ms); ``metrics`` gives them as a DataFrame.  ``tuples`` scales the points.
Keys come from a source: generated, or two key files.
"""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.generators import uniform_key, uniform_pair, zipf_pair
from millrace.functions.keys import payload
from millrace.model import AccessPath, Family, JoinSpec, Layout, Relation, Strategy
from millrace.operators.counts import count_matches
from millrace.operators.index import store
from millrace.operators.joins import index_merge, index_probe
from millrace.sources.u64 import read_keys
from millrace.storage import materialized

#: Fixed values of the grid: bytes of an entry, exponents of the key distribution, rows of a side.
ENTRY_SIZES = (32, 128, 512, 1024, 2048)
SKEWS = (0.1, 0.3, 0.5, 0.7)
TUPLES = 10_000_000
SKEW_VALUE_SIZE = 50


def value_size(entry: int) -> int:
    return math.ceil(0.95 * entry - 10)


@dataclass(frozen=True)
class Generated:
    """Keys that R and S share in part, uniform or, with an exponent, Zipf-distributed."""

    skew: float | None = None

    def keys(self, spark: SparkSession, tuples: int, seed: int) -> tuple[DataFrame, DataFrame]:
        if self.skew is not None:
            return zipf_pair(spark, tuples, tuples, self.skew, seed=seed)
        return uniform_pair(spark, tuples, tuples, digits=max(1, len(str(tuples)) - 1), seed=seed)


@dataclass(frozen=True)
class KeyFiles:
    """Keys of two little-endian uint64 files, of each the first ``tuples``."""

    r: str
    s: str

    def keys(self, spark: SparkSession, tuples: int, seed: int) -> tuple[DataFrame, DataFrame]:
        return tuple(read_keys(spark, path, limit=tuples).select("sk", "seq") for path in (self.r, self.s))


KeySource = Generated | KeyFiles


def key_source(r: str, s: str) -> KeySource:
    """From selectors: ``skew_<exponent>`` (0 where none can be read) stands for generated
    Zipf keys, anything else for key files."""
    if "skew" not in r:
        return KeyFiles(r, s)
    found = re.match(r"skew_([0-9.]+)", r)
    try:
        return Generated(float(found[1]) if found else 0.0)
    except ValueError:
        return Generated(0.0)


@dataclass(frozen=True)
class Point:
    name: str
    value: int
    source: KeySource


def points(files: KeyFiles | None = None) -> list[Point]:
    """Entry sizes over the given key files (else over uniform keys), then skews."""
    return [Point(f"entry {e}", value_size(e), files or Generated()) for e in ENTRY_SIZES] + [Point(f"skew {s}", SKEW_VALUE_SIZE, key_source(f"skew_{s}", f"skew_{s}")) for s in SKEWS]


def relations(spark: SparkSession, point: Point, tuples: int, seed: int = 42) -> tuple[Relation, Relation]:
    """R and S of a point: keys as the point says, random primary keys, padding."""
    pair = point.source.keys(spark, tuples, seed)
    made = [materialized(k.select("sk", "seq", uniform_key(seed + 10 + i, number="seq").alias("pk"), payload(point.value - 10).alias("payload")), "grid") for i, k in enumerate(pair)]
    return Relation(made[0]), Relation(made[1])


Run = Callable[[Relation, Relation], DataFrame]


def operators() -> dict[str, tuple[dict[str, AccessPath], Run]]:
    """For each operator of a point: the access paths it needs on r and s, and its count."""

    def count(**how) -> Run:
        return lambda r, s: count_matches(JoinSpec(r, s, **how))

    primary = Family.PRIMARY
    comp = AccessPath(Layout.COMPOSITE, True, True)
    found: dict[str, tuple[dict[str, AccessPath], Run]] = {
        "nested loop, primary": ({}, count(strategy=Strategy.BROADCAST, family=primary)),
        "hash, primary": ({}, count(strategy=Strategy.SHUFFLE_HASH, family=primary)),
        "sort merge, primary": ({}, count(strategy=Strategy.SORT_MERGE, family=primary)),
        "indexed sort merge, primary": ({"r": comp}, count(strategy=Strategy.SORT_MERGE, family=primary, left_path=comp)),
    }
    for layout, covering in ((Layout.EAGER, True), (Layout.LAZY, False)):
        path = AccessPath(layout, covering, covering)
        found[f"sort merge, {layout.value}{' covering' * covering}"] = ({"r": path, "s": path}, lambda r, s, p=path: index_merge(r, s, p, p).agg(F.coalesce(F.sum("matches"), F.lit(0)).cast("long").alias("matches")))
    for layout in (Layout.COMPOSITE, Layout.EAGER, Layout.LAZY):
        for covering in (True, False):
            path = AccessPath(layout, covering, covering)
            found[f"index probe, {layout.value}{' covering' * covering}"] = ({"s": path}, lambda r, s, a=layout, b=covering: index_probe(r, s, a, b).agg(F.count("*").alias("matches")))
    return found


def run(spark: SparkSession, tuples: int = TUPLES, chosen: list[Point] | None = None) -> Iterator[dict]:
    for point in chosen if chosen is not None else points():
        r, s = relations(spark, point, tuples)
        for name, (paths, matches) in operators().items():
            began = time.perf_counter()
            sides = {side: store(rel, paths[side]) if side in paths else rel for side, rel in (("r", r), ("s", s))}
            indexed = time.perf_counter()
            n = matches(sides["r"], sides["s"]).first()[0]
            yield {"point": point.name, "operator": name, "matches": n, "index_ms": round((indexed - began) * 1e3), "join_ms": round((time.perf_counter() - indexed) * 1e3)}


def metrics(spark: SparkSession, tuples: int = TUPLES, chosen: list[Point] | None = None) -> DataFrame:
    """The metric rows as a DataFrame: a row for each point and operator."""
    return spark.createDataFrame(list(run(spark, tuples, chosen)), "point string, operator string, matches long, index_ms long, join_ms long")
