"""A suffix array by linear grouping: suffixes are grouped by their Lyndon prefix, then each group's order is emitted.

Grouping takes the groups in descending order. Whatever is above the current group is done, so the previous smaller
suffix of each of its members is the nearest position to the left that is not done yet. Each position found so is
prefixed by a Lyndon word that its members prolong: it leaves its group for a new one right above it, those that gained
more members above those that gained fewer. Afterwards a group holds the suffixes with one Lyndon prefix. Emission goes
through the suffix array from its smallest entry and puts the suffixes whose Lyndon prefix ends at the entry, found along
the previous-smaller pointers, into the next free place of their groups. No names are given and nothing is solved
recursively.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """The suffixes of text in order; its last symbol must be smaller than all others."""
    size = len(text)
    members: list[list[int]] = []  # of each group, with those that have left it since
    group = [0] * size
    by_symbol: dict[int, int] = {}
    for symbol in sorted(set(text)):
        by_symbol[symbol] = len(members)
        members.append([])
    for n, symbol in enumerate(text):
        group[n] = g = by_symbol[symbol]
        members[g].append(n)
    above = [*range(1, len(members)), -1]
    below = list(range(-1, len(members) - 1))
    previous = [-1] * size
    done = [False] * size
    order: list[int] = []  # groups, descending
    current = len(members) - 1
    while current >= 0:
        own = [n for n in members[current] if group[n] == current]
        if not own:
            current = below[current]
            continue
        order.append(current)
        members[current] = own
        for n in own:
            done[n] = True
        gained: dict[int, int] = {}
        for n in own:
            p = n - 1
            while p >= 0 and done[p]:
                p = previous[p]
            previous[n] = p
            if p >= 0:
                gained[p] = gained.get(p, 0) + 1
        if gained:
            moved: dict[tuple[int, int], list[int]] = {}
            for p, times in gained.items():
                moved.setdefault((times, group[p]), []).append(p)
            for times, old in sorted(moved, reverse=True) if len(moved) > 1 else moved:
                new = len(members)
                held = moved[times, old]
                members.append(held)
                for p in held:
                    group[p] = new
                upper = above[old]
                above.append(upper)
                below.append(old)
                above[old] = new
                if upper >= 0:
                    below[upper] = new
        current = below[current]
    free = [0] * len(members)  # the next free place of each group
    place = 0
    for g in reversed(order):
        free[g] = place
        place += len(members[g])
    result = [-1] * size
    put = [False] * size
    result[0] = size - 1
    put[size - 1] = True
    for n in range(size):
        p = result[n] - 1
        while p >= 0 and not put[p]:
            g = group[p]
            result[free[g]] = p
            free[g] += 1
            put[p] = True
            p = previous[p]
    return result
