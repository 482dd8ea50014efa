"""Sorting suffixes by comparisons in logarithmic time.

Prefix polynomial hashes of a text give the hash of any substring; a binary search over lengths finds how far two
suffixes agree, and the next byte orders them. A bottom-up mergesort uses that comparison, all pairs of runs of a
level at once. Neighbours that agree to the wanted depth are verified byte by byte.
"""

from __future__ import annotations

import numpy as np

from scrivana.llm.common import powers

BASE = 0xA0761D6478BD642F


class Suffixes:
    """Suffixes of one text, compared up to ``depth`` bytes, all of which lie inside the text."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.depth = text, depth
        self.prefix, up = np.zeros(len(text) + 1, dtype=np.uint64), powers(BASE, len(text))
        up *= text
        np.cumsum(up, out=self.prefix[1:])
        del up
        self.down = powers(pow(BASE, -1, 1 << 64), len(text) + 1)

    def hashed(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.prefix[at + length] - self.prefix[at]) * self.down[at]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes two suffixes share, ``depth`` at most."""
        low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), self.depth, dtype=np.int64)
        whole = self.hashed(a, self.depth) == self.hashed(b, self.depth)
        low[whole] = self.depth
        open_ = np.flatnonzero(~whole)
        high[open_] -= 1
        while len(open_):
            middle = (low[open_] + high[open_] + 1) >> 1
            same = self.hashed(a[open_], middle) == self.hashed(b[open_], middle)
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1
            open_ = open_[low[open_] < high[open_]]
        return low

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        """a < b, or a <= b."""
        n = self.common(a, b)
        end = n == self.depth
        x, y = self.text[np.where(end, a, a + n)], self.text[np.where(end, b, b + n)]
        return np.where(end, or_equal, x < y)


def sort_within(suffixes: Suffixes, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of ``at`` (suffix starts) by group, then suffix. Groups are adjacent; only their own members are compared."""
    n = len(at)
    order = np.arange(n)
    if not n:
        return order
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(begins, n))
    first, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
    run = 1
    while run < sizes.max():
        busy = np.flatnonzero(size > run)
        rank = busy - first[busy]
        pair = rank // (2 * run) * (2 * run)
        mine_left = rank % (2 * run) < run
        other = np.where(mine_left, pair + run, pair)
        other_end = np.minimum(other + run, size[busy])
        other = np.minimum(other, other_end)
        low, high = other.copy(), other_end.copy()
        mine = at[order[busy]]
        # how many of the other run stand before: equals of the left run go first
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            theirs = at[order[first[busy[open_]] + middle]]
            left = mine_left[open_]
            ahead = np.empty(len(open_), dtype=bool)
            for is_left in (True, False):
                part = left == is_left
                ahead[part] = suffixes.before(theirs[part], mine[open_[part]], or_equal=not is_left)
            low[open_[ahead]] = middle[ahead] + 1
            high[open_[~ahead]] = middle[~ahead]
            open_ = open_[low[open_] < high[open_]]
        own = rank - np.where(mine_left, pair, pair + run)
        target = first[busy] + pair + own + (low - other)
        merged = order.copy()
        merged[target] = order[busy]
        order = merged
        run *= 2
    return order


def equal_runs(suffixes: Suffixes, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, number): suffixes in sorted order, and a number for each run of suffixes equal to full depth.

    A neighbour that only its hash calls equal breaks the run; its group is then sorted again by its bytes.
    """
    order = sort_within(suffixes, at, group)
    sorted_at, sorted_group = at[order], group[order]
    same = np.zeros(len(at), dtype=bool)
    near = 1 + np.flatnonzero(sorted_group[1:] == sorted_group[:-1])
    whole = suffixes.hashed(sorted_at[near], suffixes.depth) == suffixes.hashed(sorted_at[near - 1], suffixes.depth)
    near = near[whole]
    reach = np.arange(suffixes.depth)
    wrong: set[int] = set()
    for i in range(0, len(near), 1 << 15):
        some = near[i : i + (1 << 15)]
        true = (suffixes.text[sorted_at[some][:, None] + reach] == suffixes.text[sorted_at[some - 1][:, None] + reach]).all(axis=1)
        same[some] = true
        wrong.update(sorted_group[some[~true]].tolist())
    for g in wrong:
        a, b = np.searchsorted(sorted_group, g), np.searchsorted(sorted_group, g, side="right")
        strings = {int(k): suffixes.text[at[k] : at[k] + suffixes.depth].tobytes() for k in order[a:b]}
        order[a:b] = sorted(strings, key=strings.__getitem__)
        same[a + 1 : b] = [strings[int(x)] == strings[int(y)] for x, y in zip(order[a + 1 : b], order[a : b - 1])]
        same[a] = False
    return order, np.cumsum(~same) - 1
