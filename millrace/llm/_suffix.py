"""Suffix sorting of integer texts by prefix doubling, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_order(keys: np.ndarray, width: int = 1) -> np.ndarray:
    """Positions of a text in suffix order.

    ``keys`` orders the suffixes by their first ``width`` symbols.  Each round
    doubles the width and sorts only suffixes that still tie, so the cost falls
    with the number of true repeats.  A suffix that ends comes first.
    """
    n = len(keys)
    order = np.argsort(keys)
    sorted_keys = keys[order]
    fresh = np.empty(n, bool)
    fresh[:1] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=fresh[1:])
    slots = np.arange(n)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, slots, 0))
    rank[n] = -1
    while True:
        alone = fresh & np.append(fresh[1:], True)
        slots = slots[~alone]
        if not len(slots):
            return order
        tied = order[slots]
        key = (rank[tied] << 32) | (rank[np.minimum(tied + width, n)] + 1)
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        order[slots] = tied
        fresh = np.empty(len(slots), bool)
        fresh[0] = True
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        rank[tied] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        width *= 2
