"""Fitting expressions into a bounded number of shared passes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import TypeVar

X = TypeVar("X")


def fit(items: Sequence[X], capacity: int, tier: Callable[[X], int], cost: Callable[[X], int]) -> tuple[list[X], list[X]]:
    """(kept, dropped): the highest tier goes first and of a tier the last; tier 0 always stays."""
    excess, gone = sum(map(cost, items)) - capacity, set()
    for k in sorted(range(len(items)), key=lambda i: (-tier(items[i]), -i)):
        if excess <= 0 or tier(items[k]) == 0:
            break
        gone.add(k)
        excess -= cost(items[k])
    return [x for k, x in enumerate(items) if k not in gone], [x for k, x in enumerate(items) if k in gone]


def pack(items: Sequence[X], size: int, cost: Callable[[X], int], passes: Sequence[Sequence[X]] = ()) -> list[list[X]]:
    """Fill the last pass before opening another; the order of items stays."""
    out = [list(p) for p in passes]
    used = sum(map(cost, out[-1])) if out else size
    for x in items:
        if not out or used + cost(x) > size:
            out.append([])
            used = 0
        out[-1].append(x)
        used += cost(x)
    return out
