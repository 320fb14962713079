"""External induced suffix sorting with common prefixes.

Suffixes are sorted by inducing the order of all from the order of the leftmost-S ones, which are named,
made into a shorter string and sorted by recursion (in memory once it is short enough).  The queues that
carry the suffix tuples (position, common prefix with the tuple before it under the same symbol) are
ordered by symbol and arrival; beyond a limit they go to disk in sorted runs.  Common prefixes are only
followed up to ``cap``.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

MEMORY_TUPLES, BASE_SYMBOLS = 4 << 20, 32 << 20


class BucketQueue:
    """Tuples in the order of (symbol, arrival); symbols must be popped so that none is needed again after
    a later one.  Holds at most ``limit`` tuples in memory."""

    def __init__(self, limit: int = MEMORY_TUPLES):
        self.limit, self.held = limit, 0
        self.parts: dict[int, list[np.ndarray]] = {}
        self.runs: list[tuple] = []

    def push(self, symbols: np.ndarray, tuples: np.ndarray) -> list[int]:
        """Add tuples that are sorted by symbol; returns the distinct symbols."""
        cuts = [0, *(np.flatnonzero(np.diff(symbols)) + 1).tolist(), len(symbols)]
        seen = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                seen.append(int(symbols[a]))
                self.parts.setdefault(seen[-1], []).append(tuples[a:b])
        self.held += len(symbols)
        if self.held > self.limit:
            self._to_disk()
        return seen

    def _to_disk(self) -> None:
        file, index, at = tempfile.TemporaryFile(), {}, 0
        for symbol in sorted(self.parts):
            part = np.ascontiguousarray(np.concatenate(self.parts[symbol]), np.int64)
            file.write(part.tobytes())
            index[symbol] = (at, len(part))
            at += len(part) * 16
        self.runs.append((file, index))
        self.parts, self.held = {}, 0

    def pop(self, symbol: int) -> np.ndarray:
        """All tuples under the symbol, in the order in which they came."""
        out = []
        for file, index in self.runs:
            if symbol in index:
                at, n = index.pop(symbol)
                file.seek(at)
                out.append(np.frombuffer(file.read(16 * n), np.int64).reshape(n, 2))
        held = self.parts.pop(symbol, [])
        self.held -= sum(map(len, held))
        return np.concatenate(out + held) if out or held else np.zeros((0, 2), np.int64)

    def close(self) -> None:
        for file, _ in self.runs:
            file.close()


def s_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol counts as smallest."""
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    at = np.where(differs, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal symbols ends
    return np.append(text[:-1] < text[1:], True)[at]


def run_lengths(text: np.ndarray) -> np.ndarray:
    """For each place, how often its symbol follows from there on, itself counted."""
    n = len(text)
    at = np.where(np.append(text[:-1] != text[1:], True), np.arange(n), n)
    return np.minimum.accumulate(at[::-1])[::-1] - np.arange(n) + 1


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, cap: int) -> np.ndarray:
    """Length of the common prefix of suffix pairs, at most ``cap``, given that ``known`` symbols agree."""
    out, n, step = np.minimum(known, cap), len(text), 8
    live = np.flatnonzero(out < cap)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        offsets = np.arange(step)
        inside = (np.maximum(x, y)[:, None] + offsets) < n
        same = inside & (text[np.minimum(x[:, None] + offsets, n - 1)] == text[np.minimum(y[:, None] + offsets, n - 1)])
        more = np.where(same.all(1), step, np.argmin(same, 1))
        out[live] = np.minimum(out[live] + more, cap)
        live = live[(more == step) & (out[live] < cap)]
    return out


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo:hi]) for each pair, hi > lo."""
    out, width, level, table = np.empty(len(lo), np.int64), hi - lo, 0, values
    while True:
        size = 1 << level
        here = (width >= size) & (width < 2 * size)
        if here.any():
            out[here] = np.minimum(table[lo[here]], table[hi[here] - size])
        level += 1
        if not (width >= 2 * size).any():
            return out
        table = np.minimum(table[:-size], table[size:])


class _Pass:
    """One pass over the suffixes in rising (L) or falling (S) order."""

    def __init__(self, text, wanted, runs, cap, limit):
        self.text, self.wanted, self.runs, self.cap = text, wanted, runs, cap
        self.queue = BucketQueue(limit)
        size = int(text.max()) + 1
        self.epoch, self.last, self.low = 0, np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.touched: list[np.ndarray] = []

    def go(self, seeds: BucketQueue, symbols: list[int], falling: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yields (symbol, induced tuples, seed tuples): each symbol's suffixes in the order of the pass."""
        sign = -1 if falling else 1
        heap, known = [sign * s for s in symbols], set(symbols)
        heapq.heapify(heap)
        while heap:
            symbol = sign * heapq.heappop(heap)
            known.discard(symbol)
            self.epoch, self.touched, first, induced = self.epoch + 1, [], True, []
            while len(batch := self.queue.pop(symbol)):
                if first:
                    batch = batch.copy()
                    batch[0, 1], first = 0, False
                induced.append(batch)
                for s in self._spread(batch):
                    if s != symbol and s not in known:
                        known.add(s)
                        heapq.heappush(heap, sign * s)
            seeded = seeds.pop(symbol)
            if len(seeded):
                seeded = seeded.copy()
                seeded[0, 1] = 0 if first else min(self.runs[seeded[0, 0]], self.runs[induced[-1][-1, 0]], self.cap)
                for s in self._spread(seeded):
                    if s not in known:
                        known.add(s)
                        heapq.heappush(heap, sign * s)
            yield symbol, np.concatenate(induced) if induced else np.zeros((0, 2), np.int64), seeded
        self.queue.close()

    def _spread(self, batch: np.ndarray) -> list[int]:
        """Queue the suffixes one place before those of the batch, with their common prefixes."""
        places, common = batch[:, 0], batch[:, 1]
        before = places - 1
        at = np.flatnonzero((before >= 0) & self.wanted[before])
        down = int(common.min())
        if not len(at):
            for t in self.touched:
                self.low[t] = np.minimum(self.low[t], down)
            return []
        target = self.text[before[at]]
        # Small numbers are sorted by radix.
        order = np.argsort(target.astype(np.uint16) if len(self.last) <= 1 << 16 else target, kind="stable")
        at, target = at[order], target[order]
        if self.cap <= 1:  # only the order is asked for
            return self.queue.push(target, np.stack([before[at], np.zeros(len(at), np.int64)], 1))
        starts = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
        lo = np.append(0, at[:-1] + 1)
        lo[starts] = 0
        least = _range_min(common, lo, at + 1)
        heads = target[starts]
        seen = self.last[heads] == self.epoch
        least[starts] = np.where(seen, np.minimum(least[starts], self.low[heads]), 0)
        for t in self.touched:
            self.low[t] = np.minimum(self.low[t], down)
        ends = at[np.append(starts[1:], len(at)) - 1] + 1
        rest = np.full(len(heads), self.cap, np.int64)
        some = ends < len(common)
        if some.any():
            rest[some] = _range_min(common, ends[some], np.full(int(some.sum()), len(common)))
        self.low[heads] = rest
        fresh = heads[self.last[heads] != self.epoch]
        self.last[heads] = self.epoch
        if len(fresh):
            self.touched.append(fresh)
        return self.queue.push(target, np.stack([before[at], np.minimum(least + 1, self.cap)], 1))


def _sweep(text, is_s, runs, cap, limit, seeds: BucketQueue, symbols: list[int]) -> Iterator[np.ndarray]:
    """Both passes from sorted (or, for naming, unsorted) seeds; falling order, symbol by symbol."""
    rising = _Pass(text, ~is_s, runs, cap, limit)
    stored, found = BucketQueue(limit), []
    for symbol, induced, _ in rising.go(seeds, symbols, falling=False):
        if len(induced):
            back = np.empty_like(induced)
            back[:, 0] = induced[::-1, 0]
            back[0, 1], back[1:, 1] = 0, induced[:0:-1, 1]
            stored.push(np.full(len(back), symbol), back)
            found.append(symbol)
    falling = _Pass(text, is_s, runs, cap, limit)
    for _, induced, seeded in falling.go(stored, found, falling=True):
        yield np.concatenate([induced, seeded])
    stored.close()


def _seeded(text: np.ndarray, places: np.ndarray, common: np.ndarray, limit: int) -> tuple[BucketQueue, list[int]]:
    queue = BucketQueue(limit)
    symbols = text[places]
    order = np.argsort(symbols, kind="stable")
    return queue, sorted(queue.push(symbols[order], np.stack([places[order], common[order]], 1)))


def sorted_suffixes(text: np.ndarray, cap: int, limit: int = MEMORY_TUPLES, base: int = BASE_SYMBOLS) -> Iterator[np.ndarray]:
    """The suffixes of ``text`` (integers from 0 on; the last symbol occurs once and is the smallest), in falling
    order and by first symbol: arrays of (position, common prefix with the suffix before, at most ``cap``).

    The last suffix itself, one symbol long, is left out.
    """
    is_s = s_types(text)
    runs = run_lengths(text)
    left = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1  # leftmost S
    if not len(left):
        return
    names = _names(text, is_s, runs, left, limit)
    if names.max() + 1 == len(names):
        order = np.argsort(names)
        common = np.zeros(len(order), np.int64)
    elif len(names) <= base:
        order, common = _doubled(names, cap)
    else:
        parts = list(sorted_suffixes(names, cap, limit, base))
        falling = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
        order = np.append(len(names) - 1, falling[::-1, 0])
        common = np.concatenate([[0, 0], falling[:0:-1, 1]])[:len(order)]
    # From names to symbols: names that agree stand for the symbols between their places.
    places = left[order]
    known = np.zeros(len(order), np.int64)
    until = np.minimum(order[1:] + common[1:], len(left) - 1)
    known[1:] = left[until] - places[1:]
    known[1:] = common_prefix(text, places[:-1], places[1:], known[1:], cap)
    seeds, symbols = _seeded(text, places, known, limit)
    yield from _sweep(text, is_s, runs, cap, limit, seeds, symbols)
    seeds.close()


def _names(text, is_s, runs, left, limit) -> np.ndarray:
    """Ranks of the substrings from each leftmost-S place to the next, in text order."""
    seeds, symbols = _seeded(text, left, np.zeros(len(left), np.int64), limit)
    is_left = np.zeros(len(text), bool)
    is_left[left] = True
    falling = [p[is_left[p[:, 0]], 0] for p in _sweep(text, is_s, runs, 1, limit, seeds, symbols)]
    seeds.close()
    order = np.append(len(text) - 1, np.concatenate(falling)[::-1]) if falling else np.array([len(text) - 1])
    number = np.searchsorted(left, order)
    ends = np.append(left[1:], len(text) - 1)
    size = ends[number] - order + 1
    same = size[1:] == size[:-1]
    pairs = np.flatnonzero(same)
    at = 0
    while len(pairs):
        alike = text[order[pairs] + at] == text[order[pairs + 1] + at]
        same[pairs[~alike]] = False
        at += 1
        pairs = pairs[alike & (at < size[pairs])]
    rank = np.cumsum(np.append(0, ~same))
    out = np.empty(len(left), np.int64)
    out[number] = rank
    return out


def _doubled(names: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and common prefixes in memory, by doubling the length that ranks stand for.

    Suffixes that agree in ``cap`` symbols stay in any order.  The ranks of all lengths give the common
    prefix in as many steps as there are lengths.
    """
    n, rank, ranks = len(names), names.astype(np.int64), []
    while True:
        ranks.append(rank)
        step = 1 << (len(ranks) - 1)
        follow = np.zeros(n, np.int64)
        follow[:max(n - step, 0)] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + follow
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or 2 * step >= min(n, cap):
            break
    ranks.append(rank)
    a, b, common = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + common, b + common
        fits = (np.maximum(x, y) + (1 << level)) <= n
        common += (fits & (ranks[level][np.minimum(x, n - 1)] == ranks[level][np.minimum(y, n - 1)])) << level
    return order, np.append(0, np.minimum(common, cap))
