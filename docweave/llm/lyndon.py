"""Lyndon arrays by grouping suffixes, and maximal repetitions from them.

Phase one of Baier's suffix sorter: suffixes start in groups by their first
symbol.  Groups are taken from the greatest down; every member of a group finds
the nearest position to its left that is in a lower group, and such a position
with ``l`` members of the group pointing at it has its context extended by ``l``
times the group's context.  Those with the same old group and the same ``l`` form
a new group right above the old one, more members meaning higher.  Where
this ends a group's context is the longest Lyndon word with which its members
start, so the contexts' lengths are the Lyndon array; the sorter's second
phase, which orders suffixes inside groups, is not needed.

Every maximal repetition has a Lyndon root under the ascending or the
descending order of symbols that is the longest Lyndon word at its start, so
extending the words of both arrays to the left and right finds all of them.
"""

from __future__ import annotations

import numpy as np


def lyndon_array(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each position."""
    n = len(symbols)
    members: list[list[int]] = []
    length: list[int] = []
    group = [0] * n
    rank: dict[int, int] = {}
    for s in sorted(set(symbols)):
        rank[s] = len(members)
        members.append([])
        length.append(1)
    for i, s in enumerate(symbols):
        g = rank[s]
        group[i] = g
        members[g].append(i)
    lower = list(range(-1, len(members) - 1))
    upper = [*range(1, len(members)), -1]
    out = [0] * n
    # left[i + 1] leads to the nearest position at or left of i that is in no group taken so far (0: none).
    left = list(range(n + 1))
    g = len(members) - 1
    while g >= 0:
        mine = [i for i in members[g] if group[i] == g]
        members[g] = []
        size = length[g]
        for i in mine:
            out[i] = size
            left[i + 1] = i
        pointed: dict[int, int] = {}
        for i in mine:
            x = i
            while left[x] != x:
                left[x] = x = left[left[x]]
            if x:
                pointed[x - 1] = pointed.get(x - 1, 0) + 1
        by_times: dict[int, list[int]] = {}
        for i, times in pointed.items():
            by_times.setdefault(times, []).append(i)
        for times in sorted(by_times, reverse=True):
            fresh: dict[int, int] = {}
            for i in by_times[times]:
                old = group[i]
                new = fresh.get(old)
                if new is None:
                    fresh[old] = new = len(members)
                    members.append([])
                    length.append(length[old] + times * size)
                    above = upper[old]
                    lower.append(old)
                    upper.append(above)
                    upper[old] = new
                    if above >= 0:
                        lower[above] = new
                members[new].append(i)
                group[i] = new
        g = lower[g]
    return out


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix of two arrays, read in blocks that double."""
    n, at, block = min(len(a), len(b)), 0, 16
    a, b = a[:n], b[:n]
    while at < n:
        differ = a[at:at + block] != b[at:at + block]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at += len(differ)
        block *= 2
    return n


def repetitions(symbols: np.ndarray, exponent: int, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal repetitions with length >= max(least, exponent * period), in order.

    A repetition with that many periods has at least ``exponent - 1`` Lyndon roots
    one after the other, so only places that begin as many are extended.
    """
    n = len(symbols)
    found: set[tuple[int, int, int]] = set()
    if n < max(least, exponent):
        return []
    places = np.arange(n)
    for order in (symbols, symbols.max() - symbols):
        word = np.asarray(lyndon_array(order.tolist()), np.int64)
        begins = places + (exponent - 1) * word <= n
        for j in range(1, exponent - 1):
            ahead = np.minimum(places + j * word, n - 1)
            begins &= (word[ahead] == word) & (symbols[ahead] == symbols)
        starts = places[begins]
        done: dict[int, int] = {}  # end of the last repetition of each period
        for i, p in zip(starts.tolist(), word[starts].tolist()):
            if i + p <= done.get(p, 0):
                continue  # its root lies in that repetition
            right = i + p + _agree(symbols[i:], symbols[i + p:])
            if right - i < (exponent - 1) * p:
                continue
            first = i - _agree(symbols[:i][::-1], symbols[:i + p][::-1])
            done[p] = right
            if right - first >= max(least, exponent * p):
                found.add((first, right - first, p))
    return sorted(found, key=lambda r: (r[0], r[2]))
