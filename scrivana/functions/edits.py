"""Levenshtein distances of sequences of any length, many pairs at a time.

By diagonals: with e edits, how far along each diagonal of the table of distances can one come? The answer follows from
that for e - 1 edits and from how far both sequences agree from there on (Ukkonen 1985, Landau and Vishkin 1989). A pair
with d edits takes time n + d ** 2 / 2, from both ends, whatever those edits are. Agreement is read 8 bytes at a time from
windows of both sequences, for all diagonals of all pairs in one numpy call; the few long agreements are read on alone.

Pairs that need more edits than some 10 in 100 items (of short ones more; unrelated texts) take a bit-parallel table
instead, whose time is n ** 2 / 64 and whose space is n.

Pairs with many edits are bounded first, in time n. From above: both sequences are cut where a run of items begins that
both have equally often, and the distances of the pieces between the cuts add up. From below: each edit takes away one
surplus item of ``a`` at most and brings one that ``b`` has beyond ``a``. Where both bounds meet they are the distance; all
other pairs go by diagonals as above. So no distance is an estimate.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain

import numpy as np

#: Items of all pairs that are compared at once.
TOGETHER = 1 << 21
#: Items that a table compares with all others in the time of a diagonal's step, and what each of them costs besides.
TABLE_STEP, TABLE_ITEM = 1 / 90, 30
#: Windows that all diagonals read together, and more while so many of them agree; the few others are read on alone.
WINDOWS, ALONE = 6, 32
#: Edits from which on a pair is bounded first; of 2 ** RARE windows, one may be a cut.
MANY, RARE = 12, 4
NONE = -(1 << 30)


def distances(pairs: list[tuple[Sequence, Sequence]]) -> list[int]:
    """The distance of each pair of strings, or of lists of hashable items."""
    out = [-1] * len(pairs)
    held: list[int] = []
    size = 0
    for k, (a, b) in enumerate(pairs):
        if a == b:
            out[k] = 0
        elif not len(a) or not len(b):
            out[k] = max(len(a), len(b))
        else:
            if held and size + len(a) + len(b) > TOGETHER:
                _settle(pairs, held, out)
                held, size = [], 0
            held.append(k)
            size += len(a) + len(b)
    if held:
        _settle(pairs, held, out)
    return out


def _settle(pairs: list[tuple[Sequence, Sequence]], held: list[int], out: list[int]) -> None:
    close = [k for k in held if abs(len(pairs[k][0]) - len(pairs[k][1])) <= most_edits(*map(len, pairs[k]))]
    if close:
        sequences = [s for k in close for s in pairs[k]]
        codes, lengths = coded(sequences), np.array([len(s) for s in sequences])
        for k, d in zip(close, bounded(codes, lengths).tolist()):
            out[k] = d
    for k in held:
        if out[k] < 0:
            out[k] = by_table(*pairs[k])


def most_edits(n, m):
    """Edits up to which diagonals are quicker than the table; of two lengths, or of arrays of them."""
    n = np.maximum(n, m)
    return np.sqrt(TABLE_ITEM * n + TABLE_STEP * n * n).astype(np.int64)


#: Codes that no item has: what stands behind an ``a`` and before it, so that agreement ends with a sequence.
BEHIND, BEFORE = 0, 1


def coded(sequences: list[Sequence]) -> np.ndarray:
    """All items in a row, as numbers from 2 on that are equal where the items are; as few bytes an item as will do."""
    if isinstance(sequences[0], str):
        points = np.frombuffer("".join(sequences).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.intp)
        there = np.zeros(int(points.max()) + 1, dtype=bool)
        there[points] = True
        n = int(there.sum()) + 2
        numbers = np.cumsum(there) + 1
        return numbers.astype(np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32)[points]
    items = list(chain.from_iterable(sequences))
    known = {x: k for k, x in enumerate(dict.fromkeys(items), 2)}
    n = len(known) + 2
    return np.array(list(map(known.__getitem__, items)), dtype=np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32)


def bounded(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The distance of each pair, or -1 where it is above ``most_edits``: by bounds where they meet, or else by diagonals."""
    least = surplus(codes, lengths)
    out = np.full(len(least), -1)
    even = (lengths[::2] == lengths[1::2]).nonzero()[0]
    starts = np.cumsum(lengths) - lengths
    most = replaced(codes, starts[2 * even], starts[2 * even + 1], lengths[2 * even])
    met = (most == least[even]) | (most <= 2)
    out[even[met]] = most[met]
    many = ((out < 0) & (least >= MANY)).nonzero()[0]
    if len(many):
        most = in_pieces(*taken(codes, lengths, many), least[many])
        met = most == least[many]
        out[many[met]] = most[met]
    rest = (out < 0).nonzero()[0]
    if len(rest):
        out[rest] = diagonals(*taken(codes, lengths, rest))
    return out


def replaced(codes: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places at which spans of equal, positive size differ: their distance, if that is 2 at most, or else a bound from above."""
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    places = np.repeat(a - first, sizes) + np.arange(int(sizes.sum()))
    differing = codes[places]
    places += np.repeat(b - a, sizes)
    return np.add.reduceat(differing != codes[places], first, dtype=np.int64)


def taken(codes: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and lengths of some pairs."""
    if 2 * len(which) == len(lengths):
        return codes, lengths
    sequences = np.stack([2 * which, 2 * which + 1], axis=1).reshape(-1)
    return spans(codes, (np.cumsum(lengths) - lengths)[sequences], lengths[sequences]), lengths[sequences]


def spans(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The codes of some spans in a row."""
    return codes[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]


def surplus(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many items, counted by kind, one sequence of each pair has beyond the other's: a bound from below."""
    pairs, kinds = len(lengths) // 2, int(codes.max()) + 1
    if pairs * kinds <= len(codes):
        counts = np.bincount(np.repeat(np.arange(2 * pairs) * kinds, lengths) + codes, minlength=2 * pairs * kinds).reshape(pairs, 2, kinds)
        counts = counts[:, 0] - counts[:, 1]
        return np.maximum(np.maximum(counts, 0).sum(axis=1), np.maximum(-counts, 0).sum(axis=1))
    keys = np.repeat(np.arange(2 * pairs) // 2 * (2 * kinds) + (np.arange(2 * pairs) + 1) % 2, lengths) + 2 * codes.astype(np.int64)
    keys.sort()
    first = np.concatenate([[True], keys[1:] >> 1 != keys[:-1] >> 1]).nonzero()[0]
    counts, of = np.add.reduceat(2 * (keys & 1) - 1, first), (keys[first] >> 1) // kinds
    more, fewer = (np.bincount(of, np.maximum(x, 0), pairs) for x in (counts, -counts))
    return np.maximum(more, fewer).astype(np.int64)


def cuts(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, and the places in their ``a`` and ``b`` where a window begins that both have equally often, none crossing another.
    Windows are chosen by what they hold, so the same ones in both."""
    each, ends = 8 // codes.itemsize, np.cumsum(lengths)
    if len(codes) < each:
        return (np.zeros(0, dtype=np.int64),) * 3
    windows = np.ndarray((len(codes) - each + 1,), "<u8", np.ascontiguousarray(codes), 0, (codes.itemsize,)) * np.uint64(0x9E3779B97F4A7C15)
    places = (windows >> np.uint64(64 - RARE) == 0).nonzero()[0]
    sequences = np.searchsorted(ends, places, side="right")
    inside = places + each <= ends[sequences]
    places, sequences = places[inside], sequences[inside]
    keys = windows[places] ^ (sequences >> 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)  # equal by chance: a cut all the same
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)].nonzero()[0]
    if not len(first):
        return (np.zeros(0, dtype=np.int64),) * 3
    times = np.diff(first, append=len(keys))
    in_a = np.add.reduceat(sequences[order] & 1 == 0, first, dtype=np.int64)
    alike = 2 * in_a == times
    first, times = first[alike], in_a[alike]
    each_a = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    a, b = order[each_a], order[each_a + np.repeat(times, times)]
    both = sequences[b] == sequences[a] + 1
    a, b = a[both], b[both]
    by_place = np.argsort(a)
    a, b = a[by_place], b[by_place]
    if len(a):
        before, behind = np.maximum.accumulate(b), np.minimum.accumulate(b[::-1])[::-1]
        keep = (b == before) & (b == behind)
        if not keep.all():
            some = np.isin(sequences[a], sequences[a[~keep]]).nonzero()[0]
            keep[some] = False
            keep[some[rising(b[some].tolist())]] = True
            a, b = a[keep], b[keep]
    return sequences[a] >> 1, places[a], places[b]


def rising(values: list[int]) -> list[int]:
    """Where a longest rising series of these values stands."""
    least: list[int] = []  # of the series of each length, the least last value
    at: list[int] = []
    before: list[int] = []
    for k, x in enumerate(values):
        n = bisect_left(least, x)
        before.append(at[n - 1] if n else -1)
        least[n : n + 1], at[n : n + 1] = [x], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def in_pieces(codes: np.ndarray, lengths: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The sum of the distances of each pair's pieces between cuts: a bound from above. A piece that alone has more edits than
    ``least`` counts by its size, as the bounds can't meet then."""
    starts, pairs = np.cumsum(lengths) - lengths, len(lengths) // 2
    of, in_a, in_b = cuts(codes, lengths)
    of = np.concatenate([np.arange(pairs), of])
    order = np.argsort(of, kind="stable")  # each pair's start, then its cuts in order
    of, begin = of[order], np.stack([np.concatenate([starts[::2], in_a])[order], np.concatenate([starts[1::2], in_b])[order]], axis=1)
    end = np.concatenate([begin[1:], begin[:1]])
    last = np.concatenate([of[1:] != of[:-1], [True]])
    end[last] = np.stack([(starts + lengths)[::2], (starts + lengths)[1::2]], axis=1)
    sizes = end - begin
    out = sizes.max(axis=1)
    there = sizes.min(axis=1) > 0
    even = ((sizes[:, 0] == sizes[:, 1]) & there).nonzero()[0]
    out[even] = replaced(codes, begin[even, 0], begin[even, 1], sizes[even, 0])
    there[even] = out[even] > 2
    if there.any():
        pieces = sizes[there].reshape(-1)
        found = diagonals(spans(codes, begin[there].reshape(-1), pieces), pieces, least[of[there]])
        out[there] = np.where(found < 0, out[there], found)
    return np.bincount(of, out, pairs).astype(np.int64)


class Both:
    """The sequences of some pairs, then all of them backwards, with a mark at each end, and their windows. Rows: the
    pairs, then the pairs backwards; ``a`` and ``b`` are the places where their sequences start, ``end`` is a's last."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, room: int):
        marks = np.cumsum(lengths + 1)  # the place behind each sequence; the first one starts at 1
        once = np.empty(int(marks[-1]) + 1, dtype=codes.dtype)
        inside = np.ones(len(once), dtype=bool)
        inside[0] = inside[marks] = False
        once[inside] = codes
        once[0], once[marks[::2]], once[marks[1::2]] = BEFORE, BEHIND, BEFORE
        self.items = np.concatenate([once, once[::-1], np.zeros(room + 8 * (WINDOWS + 2), dtype=codes.dtype)])
        self.width, self.each = codes.itemsize, 8 // codes.itemsize
        self.windows = np.ndarray((len(self.items) - self.each + 1,), "<u8", self.items, 0, (self.width,))
        self.n, self.m = lengths[::2], lengths[1::2]
        starts, back = marks - lengths, 2 * len(once) - marks
        self.a, self.b = np.concatenate([starts[::2], back[::2]]), np.concatenate([starts[1::2], back[1::2]])
        self.end = self.a + np.concatenate([self.n, self.n])

    def slide(self, x: np.ndarray, rows: np.ndarray, diagonals: np.ndarray) -> None:
        """Moves the places x in ``a`` along their diagonals as far as both sequences agree, up to the end of ``a``."""
        y = x + (self.b - self.a)[rows][:, None]
        y += diagonals
        flat, y = x.reshape(-1), y.reshape(-1)
        open_ = (self.items.take(flat) == self.items.take(y)).nonzero()[0]  # few diagonals agree at all
        at, to = flat[open_], y[open_]
        room = self.end[rows[open_ // len(diagonals)]] - at
        far, now = np.zeros(len(open_), dtype=np.int64), np.arange(len(open_))
        step = 0
        while len(now) and (step < WINDOWS or len(now) > ALONE):
            step += 1
            differing = self.windows[at] ^ self.windows[to]
            same = np.bitwise_count((differing & (~differing + np.uint64(1))) - np.uint64(1)) // np.uint8(8 * self.width)
            far[now] += same
            on = ((same == self.each) & (far[now] < room[now])).nonzero()[0]
            now, at, to = now[on], at[on] + self.each, to[on] + self.each
        for k, i, j in zip(now.tolist(), at.tolist(), to.tolist()):
            far[k] += self.long_agreement(i, j, int(room[k] - far[k]))
        flat[open_] += np.minimum(far, np.maximum(room, 0))

    def long_agreement(self, x: int, y: int, room: int) -> int:
        done, step = 0, 256
        while done < room:
            take = min(step, room - done)
            differing = self.items[x + done : x + done + take] != self.items[y + done : y + done + take]
            first = int(differing.argmax())
            if differing[first]:
                return done + first
            done, step = done + take, min(step * 4, 1 << 16)
        return room

    def met(self, alive: np.ndarray, ahead: np.ndarray, back: np.ndarray, together: np.ndarray) -> np.ndarray:
        """Whether some diagonal is reached as far from the start as from the end, for each pair of ``alive``; only
        those are looked at whose furthest places of all diagonals come ``together`` that far."""
        ends = self.end[alive] + self.a[len(self.n) + alive]
        near = (together >= ends).nonzero()[0]
        found = np.zeros(len(alive), dtype=bool)
        if len(near):
            column = (self.m - self.n)[alive[near]][:, None] + (ahead.shape[1] // 2 + back.shape[1] // 2 - np.arange(ahead.shape[1]))
            inside = (column >= 0) & (column < back.shape[1])
            other = np.take_along_axis(back[near], np.where(inside, column, 0), axis=1)
            found[near] = (inside & (ahead[near] + other >= ends[near][:, None])).any(axis=1)
        return found


def by_diagonals(pairs: list[tuple[Sequence, Sequence]]) -> list[int]:
    """``diagonals`` of strings, or of lists of hashable items."""
    sequences = [s for pair in pairs for s in pair]
    return diagonals(coded(sequences), np.array([len(s) for s in sequences])).tolist()


def diagonals(codes: np.ndarray, lengths: np.ndarray, most: np.ndarray | int = 0) -> np.ndarray:
    """The distance of each pair, or -1 where it is above both ``most_edits`` and ``most``. Row: a pair; column: a diagonal,
    from -e to e.

    From both ends at once, which takes half of the diagonals: a pair's distance is the least sum of edits with which some
    diagonal is reached as far from the start as from the end, as distances never fall along a diagonal. Places beyond
    the end of a sequence need no care: whoever gets there could have gone to the last place of the diagonal instead.
    """
    n, m = lengths[::2], lengths[1::2]
    most = np.maximum(most_edits(n, m), most)
    both = Both(codes, lengths, int(most.max()) + int(np.abs(n - m).max()))
    out = np.full(len(n), -1)
    alive, rows = np.arange(len(n)), np.arange(2 * len(n))
    reached = both.a[:, None].copy()
    both.slide(reached, rows, np.zeros(1, dtype=np.int64))
    k, furthest = len(alive), reached.max(axis=1)
    over = both.met(alive, reached[:k], reached[k:], furthest[:k] + furthest[k:])
    out[alive[over]] = 0
    e = 0
    while True:
        on = ~over & (most[alive] > 2 * e)
        if not on.any():
            return out
        if not on.all():
            twice = np.concatenate([on, on])
            alive, rows, reached, furthest = alive[on], rows[twice], reached[twice], furthest[twice]
        e += 1
        before = np.full((len(rows), 2 * e + 3), NONE)
        before[:, 2:-2] = reached
        x = np.maximum(before[:, 1:-1], before[:, 2:])
        x += 1
        np.maximum(x, before[:, :-2], out=x)
        both.slide(x, rows, np.arange(-e, e + 1))
        k, now = len(alive), x.max(axis=1)
        odd = both.met(alive, x[:k], reached[k:], now[:k] + furthest[k:])
        over = both.met(alive, x[:k], x[k:], now[:k] + now[k:])
        out[alive[over]] = 2 * e
        out[alive[odd]] = 2 * e - 1
        over |= odd
        reached, furthest = x, now


def by_table(a: Sequence, b: Sequence) -> int:
    """Each item of the shorter updates one column of the table, held as the bits of two whole numbers (Myers 1999,
    Hyyrö 2003)."""
    if len(a) < len(b):
        a, b = b, a
    start, end = 0, 0
    while start < len(b) and a[start] == b[start]:
        start += 1
    while end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    where: dict = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)

    @lru_cache(512)
    def places(x) -> int:
        bits = bytearray(len(a) // 8 + 1)
        for i in where.get(x, ()):
            bits[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(bits, "little")

    every = (1 << len(a)) - 1
    up, down = every, 0
    for x in b:
        same = places(x)
        level = ((((same & up) + up) ^ up) | same | down) & every
        right = (down | (every ^ (level | up))) << 1 | 1
        left = (up & level) << 1
        same |= down
        up = (left | ~(same | right)) & every
        down = right & same & every
    return len(b) + up.bit_count() - down.bit_count()
