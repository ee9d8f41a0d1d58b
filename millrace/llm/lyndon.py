"""Suffix order by linear grouping.

First phase: suffixes are grouped by their first symbol, and groups are processed in descending order. Each suffix of the group points to the nearest
suffix before it whose group is smaller; suffixes that are pointed to move, by the number of pointers, to new groups right after their own.
At the end a group holds the suffixes that share their Lyndon prefix, and the pointers lead to the previous smaller suffix.

Second phase: going through the suffixes in order, the one before each, and along its pointers all that aren't placed yet, take the next free place
of their group. No ranks are renamed and nothing recurs.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_order(symbols: Sequence[int]) -> list[int]:
    """Starts of the suffixes of `symbols` in ascending order; an end is smaller than any symbol."""
    n = len(symbols)
    buckets: dict[int, list[int]] = {}
    for i, x in enumerate(symbols):
        buckets.setdefault(x, []).append(i)
    members = [buckets[x] for x in sorted(buckets)]
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    below = list(range(-1, len(members) - 1))  # the next smaller group
    above = list(range(1, len(members) + 1))
    above[-1:] = [-1] * bool(above)
    left = [len(own) for own in members]  # members that haven't moved
    done = bytearray(n)
    back = [-1] * n  # previous smaller suffix
    order = []
    at = len(members) - 1
    while at >= 0:
        if left[at]:
            own = members[at]
            if left[at] < len(own):
                own = members[at] = [i for i in own if group[i] == at]
            order.append(at)
            for i in own:
                done[i] = 1
            targets: list[int] = []
            times: list[int] = []
            last = -1
            for i in own:
                j = i - 1
                while j >= 0 and done[j]:
                    j = back[j]
                back[i] = j
                if j >= 0:
                    if j == last:
                        times[-1] += 1
                    else:
                        targets.append(j)
                        times.append(1)
                        last = j
            if targets:
                if len(targets) == 1:
                    split = {(times[0], group[last]): targets}
                else:
                    split = {}
                    for j, k in zip(targets, times):
                        split.setdefault((k, group[j]), []).append(j)
                for k, old in sorted(split, reverse=True) if len(split) > 1 else split:
                    moved = split[k, old]
                    new = _insert(members, below, above, left, old, moved)
                    left[old] -= len(moved)
                    for j in moved:
                        group[j] = new
        at = below[at]
    first = [0] * len(members)
    total = 1
    for g in reversed(order):
        first[g] = total
        total += len(members[g])
    suffixes = [n] + [-1] * n
    placed = bytearray(n)
    for k in range(n + 1):
        j = suffixes[k] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            suffixes[first[g]] = j
            first[g] += 1
            j = back[j]
    return suffixes[1:]


def _insert(members, below, above, left, old: int, moved: list[int]) -> int:
    """A new group of the moved suffixes as the immediate successor of their old one."""
    new = len(members)
    members.append(moved)
    left.append(len(moved))
    after = above[old]
    below.append(old)
    above.append(after)
    above[old] = new
    if after >= 0:
        below[after] = new
    return new
