"""Suffix arrays by grouping on Lyndon prefixes."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of ``text``, whose last symbol must be smaller than all others. Linear number of steps.

    First phase: suffixes start in groups by their first symbol. Groups are worked on from the highest down; each
    member finds its previous smaller suffix by following pointers already known. The suffixes pointed to leave their
    groups for new ones right behind them, by how many members point to them: their Lyndon prefix grew by so many
    copies of this group's. At the end each group has the suffixes of one Lyndon prefix, in order.

    Second phase: from the smallest suffix up, the suffix before a placed one, and then its previous smaller ones, take
    the next free places of their groups, so no group is sorted or renamed.
    """
    n = len(text)
    if n == 0:
        return []
    order = sorted(range(n), key=text.__getitem__)
    group, place, size = [0] * n, [0] * n, [0] * n
    start = 0
    for at, s in enumerate(order):
        if at and text[s] != text[order[at - 1]]:
            start = at
        group[s], place[s] = start, at
        size[start] += 1
    previous = [-1] * n
    end = n - 1
    while end >= 0:
        this = group[order[end]]
        pointed: dict[int, int] = {}
        for s in sorted(order[this : end + 1]):
            p = s - 1
            while p >= 0 and group[p] >= this:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, k in pointed.items():
            by_count.setdefault(k, []).append(p)
        for k in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in by_count[k]:
                g = group[p]
                last = g + size[g] - 1
                other, at = order[last], place[p]
                order[at], place[other] = other, at
                order[last], place[p] = p, last
                size[g] -= 1
                moved.setdefault(g, []).append(p)
            for g, members in moved.items():
                new = g + size[g]
                size[new] = len(members)
                for p in members:
                    group[p] = new
        end = this - 1
    out, free, placed = [-1] * n, list(range(n)), [False] * n
    out[0], placed[n - 1] = n - 1, True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = previous[s]
    return out
