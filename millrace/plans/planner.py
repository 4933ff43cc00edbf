"""Chooses access paths and strategies for joins on the secondary key."""

from __future__ import annotations

from dataclasses import replace

from millrace.model import AccessPath, Family, JoinSpec, Layout, Strategy
from millrace.operators.joins import BROADCAST_BYTES, plan_bytes
from millrace.operators.upsert import key_set, latest


class UnsupportedAccessPath(ValueError):
    """A name that stands for no access path."""


_NAMES = {"reg": None, "comp": Layout.COMPOSITE, "lazy": Layout.LAZY, "eager": Layout.EAGER}


def access_path(name: str) -> AccessPath:
    """From ``reg``, ``comp``, ``lazy`` or ``eager``, with ``covering`` before if so."""
    low = name.lower()
    covering = low.startswith("covering")
    layout = _NAMES.get(low.removeprefix("covering"), UnsupportedAccessPath)
    if layout is UnsupportedAccessPath or (covering and layout is None):
        raise UnsupportedAccessPath(name)
    return AccessPath(layout, covering, purged=covering)


def choose(spec: JoinSpec) -> JoinSpec:
    """Fills in AUTO: broadcast the right side while the optimizer's estimate of its size
    is within the bound, merge where both sides are ordered by key, else leave it to
    Spark, which knows the sizes once the sides have run."""
    if spec.strategy is not Strategy.AUTO:
        return spec
    right = key_set(spec.right) if spec.family is Family.PRIMARY else latest(spec.right, "sk").select("sk", "pk")
    if plan_bytes(right) <= BROADCAST_BYTES // 8:
        return replace(spec, strategy=Strategy.BROADCAST)
    if spec.left_path.layout is not None and spec.right_path.layout is not None:
        return replace(spec, strategy=Strategy.SORT_MERGE)
    return spec
