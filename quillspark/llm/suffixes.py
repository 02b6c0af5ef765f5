"""External induced suffix sorting: disk-backed bucket queues carry suffixes and common-prefix lengths.

A queue per first symbol works as a monotone priority queue: suffixes are induced in the order of their sources, so each
queue holds (position, common prefix with the entry before it) already sorted by (symbol, rank of the source).
Text, types, queues, names and the reduced text of each recursion are files that are mapped or read in blocks. In memory
are a few blocks of BLOCK entries, POOL entries of all queues together, a reduced text of BASE names or fewer, where the
recursion ends, and below 1 KB for the queues of each distinct name of a longer one.
"""

from __future__ import annotations

import heapq
import os
import shutil
import tempfile
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 18
POOL = 1 << 21  # entries that the queues of one induction hold together before they go to disk
BASE = 1 << 22  # names of a reduced text that is sorted in memory
_ENTRY = np.dtype([("pos", "<i8"), ("lcp", "<u1")])


class Pool:
    """The entries that queues hold in memory, and the file to which all of them go when there are POOL."""

    def __init__(self, path: str):
        self.file, self.held, self.full = open(path, "w+b"), 0, {}  # noqa: SIM115

    def added(self, queue: Queue, n: int) -> None:
        self.held += n
        self.full[id(queue)] = queue
        if self.held > POOL:
            for q in self.full.values():
                q.flush()
            self.held, self.full = 0, {}

    def write(self, entries: list[np.ndarray]) -> int:
        at = self.file.seek(0, os.SEEK_END)
        for e in entries:
            self.file.write(e.tobytes())
        return at

    def read(self, at: int, n: int) -> np.ndarray:
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * _ENTRY.itemsize), _ENTRY)

    def close(self) -> None:
        self.file.close()
        os.unlink(self.file.name)


class Queue:
    """First in, first out, on disk where its pool is full; blocks() and blocks_back() go through it again, from either end."""

    __slots__ = ("at", "held", "n_held", "on_disk", "places", "pool", "starts")

    def __init__(self, pool: Pool):
        self.pool, self.held, self.n_held, self.at = pool, [], 0, 0
        self.starts, self.places, self.on_disk = [], [], 0  # of the parts on disk: first entry, place in the file

    def push(self, entries: np.ndarray) -> None:
        self.held.append(entries)
        self.n_held += len(entries)
        self.pool.added(self, len(entries))

    def flush(self) -> None:
        if self.n_held:
            self.starts.append(self.on_disk)
            self.places.append(self.pool.write(self.held))
            self.on_disk += self.n_held
            self.held, self.n_held = [], 0

    def __len__(self) -> int:
        return self.on_disk + self.n_held

    def _range(self, lo: int, hi: int) -> np.ndarray:
        parts = []
        i = bisect_right(self.starts, lo) - 1
        while lo < min(hi, self.on_disk):
            end = self.starts[i + 1] if i + 1 < len(self.starts) else self.on_disk
            n = min(end, hi) - lo
            parts.append(self.pool.read(self.places[i] + (lo - self.starts[i]) * _ENTRY.itemsize, n))
            lo, i = lo + n, i + 1
        if hi > lo and self.held:
            self.held = [np.concatenate(self.held)] if len(self.held) > 1 else self.held
            parts.append(self.held[0][lo - self.on_disk : hi - self.on_disk])
        return np.concatenate(parts) if len(parts) != 1 else parts[0]

    def pop(self) -> np.ndarray | None:
        """The next block of entries, or None."""
        if self.at >= len(self):
            return None
        hi = min(len(self), self.at + BLOCK)
        lo, self.at = self.at, hi
        return self._range(lo, hi)

    def blocks(self) -> Iterator[np.ndarray]:
        for lo in range(0, len(self), BLOCK):
            yield self._range(lo, min(len(self), lo + BLOCK))

    def blocks_back(self) -> Iterator[np.ndarray]:
        for hi in range(len(self), 0, -BLOCK):
            yield self._range(max(0, hi - BLOCK), hi)[::-1]


class Numbers:
    """A file of whole numbers, written in blocks from the start and then mapped."""

    def __init__(self, path: str, kind=np.int64):
        self.path, self.kind, self.n, self.file = path, kind, 0, open(path, "wb")  # noqa: SIM115

    def append(self, x: np.ndarray) -> None:
        self.file.write(np.asarray(x, self.kind).tobytes())
        self.n += len(x)

    def mapped(self, mode: str = "r") -> np.ndarray:
        self.file.close()
        return np.memmap(self.path, self.kind, mode) if self.n else np.zeros(0, self.kind)


def _entries(pos: np.ndarray, lcp: np.ndarray | int) -> np.ndarray:
    out = np.empty(len(pos), _ENTRY)
    out["pos"], out["lcp"] = pos, lcp
    return out


class _Ranges:
    """Range minima of one block."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        step = 1
        while 2 * step <= len(x):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def min(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima over [lo, hi), none of them empty."""
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.rows[0].dtype)
        for level in np.unique(k):
            own = k == level
            row = self.rows[level]
            out[own] = np.minimum(row[lo[own]], row[hi[own] - (1 << int(level))])
        return out


class _Pusher:
    """Pushes induced suffixes to the queues of their first symbols, with 1 + the least common prefix since the last push."""

    def __init__(self, queues: dict[int, Queue], pool: Pool, sigma: int, depth: int):
        self.queues, self.pool, self.depth = queues, pool, depth
        self.since = np.full(sigma, depth, np.uint8)
        self.fresh: list[int] = []  # symbols whose queue is new

    def push(self, lcp: np.ndarray, which: np.ndarray, pos: np.ndarray, symbols: np.ndarray) -> None:
        """lcp: of a block of sources with the source before each; which: the sources that induce pos (first symbol: symbols)."""
        if not len(which):
            if len(lcp):
                np.minimum(self.since, lcp.min(), out=self.since)
            return
        order = np.argsort(symbols, kind="stable")
        which, pos, symbols = which[order], pos[order], symbols[order]
        ranges = _Ranges(lcp)
        first = np.append(True, symbols[1:] != symbols[:-1])
        lo = np.where(first, 0, np.append(0, which[:-1] + 1))
        least = ranges.min(lo, which + 1)
        least[first] = np.minimum(least[first], self.since[symbols[first]])
        np.minimum(self.since, lcp.min(), out=self.since)
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(which)) - 1
        tail = which[ends] + 1
        rest = np.full(len(ends), self.depth, np.uint8)
        open_ = tail < len(lcp)
        if open_.any():
            rest[open_] = ranges.min(tail[open_], np.full(int(open_.sum()), len(lcp)))
        self.since[symbols[starts]] = rest
        entries = _entries(pos, np.minimum(least.astype(np.int64) + 1, self.depth))
        for a, b in zip(starts.tolist(), (ends + 1).tolist(), strict=True):
            c = int(symbols[a])
            if c not in self.queues:
                self.queues[c] = Queue(self.pool)
                self.fresh.append(c)
            self.queues[c].push(entries[a:b].copy())


def _types(text: np.ndarray, path: str) -> np.ndarray:
    """S-type (True) or L-type of each suffix, in a file; the text ends with a symbol smaller than all others."""
    n = len(text)
    out = np.memmap(path, bool, "w+", shape=(n,))
    out[-1] = True
    after = True
    for hi in range(n - 1, 0, -BLOCK):
        lo = max(0, hi - BLOCK)
        a, b = np.asarray(text[lo:hi]).astype(np.int64), np.asarray(text[lo + 1 : hi + 1]).astype(np.int64)
        sign = np.sign(b - a)
        sign = np.append(sign, 1 if after else -1)
        at = np.where(sign != 0, np.arange(len(sign)), len(sign))
        nxt = np.minimum.accumulate(at[::-1])[::-1]
        out[lo:hi] = sign[nxt[:-1]] > 0
        after = bool(out[lo])
    return out


def _runs(text: np.ndarray, pos: int) -> int:
    """How often the symbol at pos stands there in a row (as far as 255)."""
    own = np.asarray(text[pos : pos + 256])
    differs = np.flatnonzero(own != own[0])
    return int(differs[0]) if len(differs) else len(own)


def _induce(text: np.ndarray, stype: np.ndarray, seeds: dict[int, Queue], sigma: int, depth: int, pool: Pool) -> Iterator[np.ndarray]:
    """All suffixes in order, in blocks, from the sorted S* suffixes of each first symbol; lcp is with the suffix before."""
    left: dict[int, Queue] = {}
    pusher = _Pusher(left, pool, sigma, depth)

    def induced(block: np.ndarray, want_s: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        which = np.flatnonzero(block["pos"] > 0)
        pos = block["pos"][which] - 1
        ok = np.asarray(stype[pos]) == want_s
        return which[ok], pos[ok], np.asarray(text[pos[ok]]).astype(np.int64)

    symbols = sorted(seeds)
    todo = set(symbols)
    heap = list(todo)
    heapq.heapify(heap)

    def meet(sign: int) -> None:
        for d in pusher.fresh:
            if d not in todo:
                todo.add(d)
                heapq.heappush(heap, sign * d)
        pusher.fresh.clear()

    while heap:
        c = heapq.heappop(heap)
        last, first = None, True
        while c in left and (block := left[c].pop()) is not None:
            lcp = block["lcp"].copy()
            if first:
                lcp[0], first = 0, False
            last = int(block["pos"][-1])
            pusher.push(lcp, *induced(block, False))
            meet(1)
        if c in seeds:
            for i, block in enumerate(seeds[c].blocks()):
                lcp = block["lcp"].copy()
                if i == 0:
                    lcp[0] = 0 if last is None else min(depth, _runs(text, last), _runs(text, int(block["pos"][0])))
                pusher.push(lcp, *induced(block, False))
                meet(1)
    # From the end: S suffixes before L suffixes of each symbol. An entry's lcp is with the larger suffix pushed before it.
    right: dict[int, Queue] = {}
    pusher = _Pusher(right, pool, sigma, depth)
    todo = set(left) | {int(text[-1])}
    heap = [-d for d in todo]
    heapq.heapify(heap)
    while heap:
        c = -heapq.heappop(heap)
        last, first = None, True
        while c in right and (block := right[c].pop()) is not None:
            lcp = block["lcp"].copy()
            if first:
                lcp[0], first = 0, False
            last = int(block["pos"][-1])
            pusher.push(lcp, *induced(block, True))
            meet(-1)
        if c in left:
            before = 0 if last is None else min(depth, _runs(text, last), _runs(text, int(_last(left[c])["pos"])))
            for block in left[c].blocks_back():
                # an L entry's lcp is with the smaller one: shift, so that each meets the larger one before it
                lcp = np.append(np.uint8(before), block["lcp"][:-1])
                before = int(block["lcp"][-1])
                pusher.push(lcp, *induced(block, True))
                meet(-1)
    sentinel = int(text[-1])
    for c in sorted(set(left) | set(right) | {sentinel}):
        if c == sentinel:
            yield _entries(np.array([len(text) - 1]), 0)
        tail = None
        if c in left:
            for i, block in enumerate(left[c].blocks()):
                if i == 0:
                    block = block.copy()
                    block["lcp"][0] = 0
                tail = int(block["pos"][-1])
                yield block
        if c in right:
            after = 0 if tail is None else None
            for block in right[c].blocks_back():
                block = block.copy()
                # pushed from large to small: the lcp with the smaller neighbour is that of the entry pushed after it
                own = block["lcp"].copy()
                if after is None:
                    after = min(depth, _runs(text, tail), _runs(text, int(block["pos"][0])))
                block["lcp"] = np.append(np.uint8(after), own[:-1])
                after = int(own[-1])
                yield block


def _last(q: Queue) -> np.ndarray:
    return q._range(len(q) - 1, len(q))[0]


def _doubled(names: np.ndarray) -> np.ndarray:
    """Base case: the order of the suffixes of a string of names that fits in memory, by doubling ranks.

    A rank is the place of the first suffix of its group; each round sorts only what stands in groups of two or more.
    """
    n, step = len(names), 1
    order = np.argsort(names, kind="stable")
    first = np.append(True, names[order[1:]] != names[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    at = np.flatnonzero(~(first & np.append(first[1:], True)))  # places whose group has others
    while len(at):
        own = order[at]
        group = rank[own]
        ahead = own + step
        key = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(group * (n + 1) + key)
        own, group, key = own[by], group[by], key[by]
        order[at] = own
        first = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))
        rank[own] = np.maximum.accumulate(np.where(first, at, 0))
        at = at[~(first & np.append(first[1:], True))]
        step *= 2
    return order


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of suffix pairs, as far as depth: eight symbols at a time where bytes allow it, then one."""
    out = np.zeros(len(a), np.int64)
    n = len(text)
    if text.dtype == np.uint8 and n >= 8:
        eights = np.ndarray((n - 7,), "<u8", text, strides=(1,))
        live = np.arange(len(a))
        while len(live):
            live = live[(np.maximum(a[live], b[live]) + out[live] <= n - 8) & (out[live] + 8 <= depth)]
            live = live[eights[a[live] + out[live]] == eights[b[live] + out[live]]]
            out[live] += 8
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        ok = (x < n) & (y < n) & (out[live] < depth)
        ok[ok] = np.asarray(text[x[ok]]) == np.asarray(text[y[ok]])
        live = live[ok]
        out[live] += 1
    return out


_BASE = 0x9E3779B97F4A7C15
_LOW = 1 << 16


class _Sums:
    """Hashes of any stretch of (symbol, type) pairs, from running sums in a file."""

    def __init__(self, text: np.ndarray, stype: np.ndarray, path: str):
        n = len(text)
        self.low, self.high = self._table(_BASE, n)
        self.back = self._table(pow(_BASE, -1, 1 << 64), n)
        self.sums = np.memmap(path, np.uint64, "w+", shape=(n + 1,))
        total = np.uint64(0)
        with np.errstate(over="ignore"):
            for lo in range(0, n, BLOCK):
                hi = min(n, lo + BLOCK)
                kind = np.asarray(text[lo:hi]).astype(np.uint64) * np.uint64(2) + np.asarray(stype[lo:hi]).astype(np.uint64) + np.uint64(1)
                own = np.cumsum(kind * self._power(self.low, self.high, np.arange(lo, hi))) + total
                self.sums[lo + 1 : hi + 1] = own
                total = own[-1]

    @staticmethod
    def _table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            low = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(_LOW - 1, base, np.uint64))])
            high = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n // _LOW, pow(base, _LOW, 1 << 64), np.uint64))])
        return low, high

    @staticmethod
    def _power(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
        return low[at % _LOW] * high[at // _LOW]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self._power(*self.back, start)


def _sorted_stars(text: np.ndarray, stype: np.ndarray, sigma: int, folder: str, tag: str) -> np.ndarray:
    """Positions of the S* suffixes in their order: sort S* substrings by induction, name them, sort the names' string."""
    path = lambda name: os.path.join(folder, tag + name)
    found = Numbers(path("stars"))
    pool = Pool(path("queues"))
    seeds: dict[int, Queue] = {}
    for lo in range(1, len(text), BLOCK):
        own = np.asarray(stype[lo - 1 : lo + BLOCK])
        star = np.flatnonzero(own[1:] & ~own[:-1]) + lo
        found.append(star)
        chars = np.asarray(text[star]).astype(np.int64)
        order = np.argsort(chars, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(chars[order])) + 1) if len(star) else ():
            c = int(chars[part[0]])
            if c not in seeds:
                seeds[c] = Queue(pool)
            seeds[c].push(_entries(star[part], 0))
    stars = found.mapped()
    if len(stars) <= 1:
        pool.close()
        return stars
    ranked = Numbers(path("ranked"))
    for block in _induce(text, stype, seeds, sigma, 1, pool):
        pos = block["pos"]
        ranked.append(pos[np.asarray(stype[pos]) & (pos > 0) & ~np.asarray(stype[np.maximum(pos - 1, 0)])])
    pool.close()
    order = ranked.mapped()
    # Equal neighbours: same length and same symbols, by the hash of each substring up to the next star.
    sums = _Sums(text, stype, path("sums"))
    names = np.memmap(path("names"), np.int64, "w+", shape=(len(stars),))
    last, kinds = (-1, 0), -1
    for lo in range(0, len(order), BLOCK):
        own = np.asarray(order[lo : lo + BLOCK])
        place = np.searchsorted(stars, own)
        end = np.where(place + 1 < len(stars), stars[np.minimum(place + 1, len(stars) - 1)], len(text) - 1) + 1
        h, size = sums.hashes(own, end), end - own
        differs = np.append((int(size[0]), int(h[0])) != last, (h[1:] != h[:-1]) | (size[1:] != size[:-1]))
        names[place] = kinds + np.cumsum(differs)
        last, kinds = (int(size[-1]), int(h[-1])), kinds + int(differs.sum())
    del sums
    os.unlink(path("sums"))
    kinds += 1
    if kinds == len(stars):
        return order
    if len(stars) <= BASE:
        return stars[_doubled(np.asarray(names))]
    reduced = Numbers(path("reduced"), np.uint32)
    for lo in range(0, len(names), BLOCK):
        reduced.append(np.asarray(names[lo : lo + BLOCK]) + 1)
    reduced.append(np.zeros(1))
    shorter = reduced.mapped()
    out = Numbers(path("order"))
    for i, block in enumerate(_suffixes(shorter, _types(shorter, path("reduced_types")), kinds + 1, 1, folder, tag + "r")):
        out.append(stars[block["pos"][1:] if i == 0 else block["pos"]])  # the first is the end sign
    return out.mapped()


def _suffixes(text: np.ndarray, stype: np.ndarray, sigma: int, depth: int, folder: str, tag: str) -> Iterator[np.ndarray]:
    stars = _sorted_stars(text, stype, sigma, folder, tag)
    pool = Pool(os.path.join(folder, tag + "final"))
    seeds: dict[int, Queue] = {}
    for lo in range(0, len(stars), BLOCK):
        own = np.asarray(stars[lo : lo + BLOCK])
        prev = np.asarray(stars[max(lo - 1, 0) : lo + len(own) - 1])
        lcp = np.zeros(len(own), np.int64)
        if depth > 1:
            lcp[len(own) - len(prev) :] = _common(text, prev, own[len(own) - len(prev) :], depth)
        chars = np.asarray(text[own]).astype(np.int64)
        for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(chars)) + 1):
            c = int(chars[part[0]])
            if c not in seeds:
                seeds[c] = Queue(pool)
            seeds[c].push(_entries(own[part], lcp[part]))
    yield from _induce(text, stype, seeds, sigma, depth, pool)
    pool.close()


def suffix_blocks(text: np.ndarray, depth: int, folder: str | None = None) -> Iterator[np.ndarray]:
    """Suffixes of uint8 text in order, in blocks of (pos, lcp); lcp (with the suffix before) counts up to depth <= 255.

    Text may be a memory-mapped file; a last symbol smaller than all others is required (0, found nowhere else as the
    last of equal ones would do). Work files live in a temporary folder that is gone afterwards.
    """
    own = tempfile.mkdtemp(dir=folder)
    try:
        yield from _suffixes(text, _types(text, os.path.join(own, "types")), 256, depth, own, "")
    finally:
        shutil.rmtree(own, ignore_errors=True)
