"""Relations, access paths and join specifications."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame

#: Keys are below 10 ** KEY_DIGITS.
KEY_DIGITS = 10


class Layout(Enum):
    """How a secondary index is laid out."""

    COMPOSITE = "composite"  # a row for each (sk, pk)
    LAZY = "lazy"  # lists of postings by sk, oldest first
    EAGER = "eager"  # lists of postings by sk, newest first


class Strategy(Enum):
    AUTO = None
    BROADCAST = "broadcast"
    SHUFFLE_HASH = "shuffle_hash"
    SORT_MERGE = "merge"


class Family(Enum):
    """Which key the right side is stored under."""

    SECONDARY = "secondary"  # both by primary key: inner join of the latest rows
    PRIMARY = "primary"  # right by join key: semi join with the set of all its keys


@dataclass(frozen=True)
class AccessPath:
    """The base table (no layout) or an index over a relation."""

    layout: Layout | None = None
    covering: bool = False
    purged: bool = False


@dataclass(frozen=True)
class Relation:
    """Arrivals of (pk, sk, seq[, payload]).  ``seq`` orders them, and later ones win;
    ``unique`` says that no pk arrives twice, so the latest rows are the arrivals;
    ``indexes`` are those stored for it, by access path."""

    df: DataFrame
    unique: bool = False
    indexes: Mapping[AccessPath, Any] = field(default_factory=dict)

    @property
    def covered(self) -> bool:
        return "payload" in self.df.columns


@dataclass(frozen=True)
class JoinSpec:
    left: Relation
    right: Relation
    strategy: Strategy = Strategy.AUTO
    family: Family = Family.SECONDARY
    left_path: AccessPath = AccessPath()
    right_path: AccessPath = AccessPath()
