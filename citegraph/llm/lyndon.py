"""Linear grouping construction of suffix arrays for many strings at once.

Suffixes are grouped by their Lyndon prefix. Groups are taken in descending order; the previous smaller suffix of each member, which
is the last one before it in a lower group, moves behind its own group, further the more members point to it. No suffix is renamed or
compared again. The order inside groups is then emitted in ascending order along the same pointers. The strings of a batch advance
together, one group each per step, so that a step is a few array operations.
"""

from __future__ import annotations

import numpy as np


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1, ... of ``size[k]`` numbers each, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def grouped(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group (its first slot) and previous smaller suffix (-1: none) of every position."""
    n = len(codes)
    owner = np.repeat(np.arange(len(start)), size)
    sa = np.lexsort((codes, owner))
    slot = np.empty(n, np.int64)
    slot[sa] = np.arange(n)
    head = np.ones(n, bool)
    head[1:] = (codes[sa][1:] != codes[sa][:-1]) | (owner[sa][1:] != owner[sa][:-1])
    heads = np.flatnonzero(head)
    group = np.empty(n, np.int64)
    group[sa] = np.repeat(heads, np.diff(np.append(heads, n)))
    end = np.zeros(n, np.int64)
    end[heads] = np.append(heads[1:], n)
    first = np.zeros(n, np.int64)
    first[end[heads] - 1] = heads
    previous = np.full(n, -1, np.int64)
    member_at, moving = np.zeros(n, np.int64), np.zeros(n, bool)
    active = np.arange(len(start))
    upto = start + size
    while len(active):
        e = upto[active]
        a = first[e - 1]
        mem = sa[ranges(a, e - a)]
        g, low = np.repeat(a, e - a), np.repeat(start[active], e - a)
        j = mem - 1
        todo = np.flatnonzero((j >= low) & (group[j] > g))
        while len(todo):
            j[todo] = previous[j[todo]]
            x = j[todo]
            todo = todo[(x >= low[todo]) & (group[x] > g[todo])]
        same = np.flatnonzero((j >= low) & (group[j] == g))
        if len(same):
            member_at[mem] = np.arange(len(mem))
            while len(same):
                j[same] = j[member_at[j[same]]]
                x = j[same]
                same = same[(x >= low[same]) & (group[x] == g[same])]
        found = j >= low
        previous[mem] = np.where(found, j, -1)
        p = np.sort(j[found])
        if len(p):
            new = np.ones(len(p), bool)
            new[1:] = p[1:] != p[:-1]
            at = np.flatnonzero(new)
            p, times = p[at], np.diff(np.append(at, len(p)))
            of = group[p]
            order = np.lexsort((times, of))
            p, times, of = p[order], times[order], of[order]
            run = np.ones(len(p), bool)
            run[1:] = of[1:] != of[:-1]
            runs = np.flatnonzero(run)
            count = np.diff(np.append(runs, len(p)))
            old = of[runs]
            edge = end[old] - count
            zone = ranges(edge, count)
            moving[p] = True
            there = sa[zone]
            displaced = there[~moving[there]]
            was = slot[p]
            vacated = was[was < np.repeat(edge, count)]
            sa[vacated], slot[displaced] = displaced, vacated
            sa[zone], slot[p] = p, zone
            moving[p] = False
            rest = edge > old
            end[old[rest]] = edge[rest]
            first[edge[rest] - 1] = old[rest]
            run[1:] |= times[1:] != times[:-1]
            parts = np.flatnonzero(run)
            many = np.diff(np.append(parts, len(p)))
            fresh = zone[parts]
            group[p] = np.repeat(fresh, many)
            end[fresh] = fresh + many
            first[fresh + many - 1] = fresh
        upto[active] = a
        active = active[a > start[active]]
    return group, previous


def suffix_arrays(codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Suffix arrays of strings lying one after the other, as positions in ``codes``.

    Each string must end in a code that is smaller than all others in it and occurs once.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    start = np.cumsum(size) - size
    group, previous = grouped(codes, start, size)
    sa, placed, fill = np.full(n, -1, np.int64), np.zeros(n, bool), np.arange(n)
    by_size = np.argsort(-size, kind="stable")
    begin, lengths = start[by_size], size[by_size]
    ends = begin + lengths - 1
    sa[begin], placed[ends] = ends, True
    longer = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left").tolist()
    for i, many in enumerate(longer):
        s, low = sa[begin[:many] + i] - 1, begin[:many]
        while len(s):
            open_ = (s >= low) & ~placed[s]
            s, low = s[open_], low[open_]
            if not len(s):
                break
            of = group[s]
            sa[fill[of]] = s
            fill[of] += 1
            placed[s] = True
            s = previous[s]
    return sa
