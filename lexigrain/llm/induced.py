"""External induced sorting: suffix order and common prefixes of a text on disk.

Suffixes are of type L or S (larger or smaller than the suffix after them);
an S suffix after an L one is a seed. Sorted seeds induce the L suffixes in
one ascending scan and these the S suffixes in one descending scan: scanning a
suffix pushes the suffix before it onto a priority queue whose keys are (first
symbol, time of arrival). A tuple carries the suffix's position and the length of
the prefix it has in common with the one before it, which a push derives from
the minimum over what was scanned since the symbol's last push.

The queue is on disk. Symbols are dealt to ranges that hold a bounded number of
suffixes, or are one symbol. A range is a log in order of arrival; the logs of a
queue share a budget of tuples in memory and one file beyond it. A log of one
symbol is read as it grows, a range of several is sorted when its turn comes.

Seeds are sorted by the same two scans over unsorted seeds, which sorts their
substrings; equal substrings get equal names, and the shorter text of names is
sorted recursively, in memory once it fits. Whatever has an entry for each
symbol, seed or name (types, runs, positions, names, their order) is an array in
a file once it passes the budget, and is read and written in blocks. A scan holds
a fixed number of files open, whatever the text.
"""

from __future__ import annotations

import itertools
import os
import shutil
import tempfile
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np

ITEM = np.dtype([("symbol", np.int64), ("at", np.int64), ("lcp", np.uint16)], align=True)
BLOCK = 1 << 16


def spill_folder() -> str:
    """A folder for one task, in the space where Spark itself spills."""
    where = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if d and os.access(d, os.W_OK)]
    return tempfile.mkdtemp(prefix="induced-", dir=where[0] if where else None)


def blocks(n: int, step: int = BLOCK) -> Iterator[tuple[int, int]]:
    return ((lo, min(n, lo + step)) for lo in range(0, n, step))


def starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.empty(len(values), bool)
    new[:1] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return np.flatnonzero(new)


class Disk:
    """A folder and a budget: arrays of more than a quarter of the budget are files."""

    _numbers = itertools.count()

    def __init__(self, folder: str, budget: int):
        self.folder, self.budget = folder, budget

    def path(self) -> str:
        return os.path.join(self.folder, f"{next(self._numbers)}")

    def array(self, shape: int | tuple[int, int], dtype, fill: int = 0) -> np.ndarray:
        if int(np.prod(shape)) * 4 <= self.budget:
            return np.full(shape, fill, dtype)
        path = self.path()
        out = np.memmap(path, dtype, "w+", shape=shape)
        os.remove(path)  # it lives as long as it is mapped
        if fill:
            for lo, hi in blocks(len(out)):
                out[lo:hi] = fill
        return out


class Log:
    """Items in order of arrival: the first ``on_disk`` in extents of a shared file, the rest as arrays."""

    def __init__(self, queue: Queue):
        self.queue = queue
        self.starts: list[int] = []  # the number of each extent's first item
        self.places: list[int] = []  # where it is in the file
        self.on_disk = self.in_memory = self.next = 0
        self.parts: list[np.ndarray] = []
        self.part = self.skip = 0

    def push(self, items: np.ndarray) -> None:
        self.parts.append(items)
        self.in_memory += len(items)

    def spill(self) -> int:
        """Move everything to disk; returns the number of items."""
        n = self.in_memory
        if n:
            self.starts.append(self.on_disk)
            self.places.append(self.queue.append(self.parts))
            self.on_disk += n
            self.in_memory = self.part = self.skip = 0
            self.parts = []
        return n

    def _extent(self, lo: int, most: int) -> np.ndarray:
        """Items from number ``lo`` to the end of its extent, ``most`` at most."""
        k = bisect_right(self.starts, lo) - 1
        end = self.starts[k + 1] if k + 1 < len(self.starts) else self.on_disk
        return self.queue.fetch(self.places[k] + lo - self.starts[k], min(end - lo, most))

    def read(self) -> np.ndarray | None:
        """The next block; None if all has been read for now."""
        if self.next < self.on_disk:
            items = self._extent(self.next, BLOCK)
            self.next += len(items)
            self.part = self.skip = 0
            return items
        got, n = [], 0
        while n < BLOCK and self.part < len(self.parts):
            items = self.parts[self.part]
            piece = items[self.skip : self.skip + BLOCK - n]
            got.append(piece)
            n, self.skip = n + len(piece), self.skip + len(piece)
            if self.skip == len(items):
                self.part, self.skip = self.part + 1, 0
        self.next += n
        return np.concatenate(got) if got else None

    def backwards(self) -> Iterator[np.ndarray]:
        """All items from the last to the first, in blocks (each still in order of arrival)."""
        for items in reversed(self.parts):
            for hi in range(len(items), 0, -BLOCK):
                yield items[max(0, hi - BLOCK) : hi]
        for k in range(len(self.starts) - 1, -1, -1):
            start, end = self.starts[k], (self.starts[k + 1] if k + 1 < len(self.starts) else self.on_disk)
            for hi in range(end, start, -BLOCK):
                lo = max(start, hi - BLOCK)
                yield self._extent(lo, hi - lo)


class Queue:
    """Items by (symbol, time of arrival); ``edges`` are the first symbols of its ranges."""

    def __init__(self, disk: Disk, edges: np.ndarray, single: np.ndarray):
        self.disk, self.edges, self.single = disk, edges, single
        self.logs: dict[int, Log] = {}
        self.file, self.size, self.held = None, 0, 0
        self.active, self.lists = -1, {}

    def append(self, parts: list[np.ndarray]) -> int:
        if self.file is None:
            path = self.disk.path()
            self.file = open(path, "w+b")  # noqa: SIM115
            os.remove(path)
        self.file.seek(self.size * ITEM.itemsize)
        at = self.size
        for items in parts:
            self.file.write(items.tobytes())
            self.size += len(items)
        return at

    def fetch(self, at: int, n: int) -> np.ndarray:
        self.file.seek(at * ITEM.itemsize)
        return np.frombuffer(self.file.read(n * ITEM.itemsize), ITEM)

    def push(self, symbol: np.ndarray, at: np.ndarray, lcp: np.ndarray) -> None:
        """Add items whose symbols rise."""
        items = np.empty(len(at), ITEM)
        items["symbol"], items["at"], items["lcp"] = symbol, at, lcp
        own = np.searchsorted(self.edges, items["symbol"], "right") - 1
        cut = starts(own)
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(items)], strict=True):
            r = int(own[lo])
            if r not in self.logs:
                self.logs[r] = Log(self)
            self.logs[r].push(items[lo:hi])
            if r == self.active:
                self._list(items[lo:hi])
        self.held += len(items)
        if self.held > self.disk.budget:
            for log in sorted(self.logs.values(), key=lambda x: -x.in_memory):
                self.held -= log.spill()
                if self.held <= self.disk.budget // 2:
                    break

    def _list(self, items: np.ndarray) -> None:
        symbol = items["symbol"]
        cut = starts(symbol)
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(items)], strict=True):
            self.lists.setdefault(int(symbol[lo]), []).append(items[lo:hi])

    def _range(self, c: int) -> int:
        """The range of symbol c; one of several symbols is taken into memory."""
        r = int(np.searchsorted(self.edges, c, "right")) - 1
        if not self.single[r] and self.active != r:
            self.active, self.lists = r, {}
            if r in self.logs:
                parts = list(self.logs[r].backwards())[::-1]
                items = np.concatenate(parts)
                self._list(items[np.argsort(items["symbol"], kind="stable")])
        return r

    def blocks(self, c: int) -> Iterator[np.ndarray]:
        """The items of symbol c in order of arrival, also those that arrive meanwhile."""
        r = self._range(c)
        if self.single[r]:
            while r in self.logs and (items := self.logs[r].read()) is not None:
                yield items
            return
        k = 0
        while k < len(parts := self.lists.get(c, [])):
            for lo, hi in blocks(len(parts[k])):
                yield parts[k][lo:hi]
            k += 1

    def backwards(self, c: int) -> Iterator[np.ndarray]:
        """The items of symbol c from the last to the first, in blocks (each in order of arrival)."""
        r = self._range(c)
        if self.single[r]:
            yield from self.logs[r].backwards() if r in self.logs else ()
            return
        for items in reversed(self.lists.get(c, [])):
            for hi in range(len(items), 0, -BLOCK):
                yield items[max(0, hi - BLOCK) : hi]

    def close(self) -> None:
        if self.file:
            self.file.close()
        self.logs, self.lists = {}, {}


class Minima:
    """Minimum of any range of an array."""

    def __init__(self, values: np.ndarray, disk: Disk | None = None):
        n = len(values)
        levels = max(1, n.bit_length())
        self.rows = disk.array((levels, n), values.dtype) if disk else np.empty((levels, n), values.dtype)
        for lo, hi in blocks(n):
            self.rows[0, lo:hi] = values[lo:hi]
        for k in range(1, levels):
            half, size = 1 << (k - 1), n - (1 << k) + 1
            for lo, hi in blocks(max(size, 0)):
                self.rows[k, lo:hi] = np.minimum(self.rows[k - 1, lo:hi], self.rows[k - 1, lo + half : hi + half])

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of values[lo:hi]; every range must have an element."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        return np.minimum(self.rows[level, lo], self.rows[level, hi - (np.int64(1) << level.astype(np.int64))])


class Level:
    """A text with its types, runs of equal symbols, seeds, and the ranges of its symbols.

    The last symbol must be smaller than all others.
    """

    def __init__(self, text: np.ndarray, symbols: int, disk: Disk):
        self.text, self.symbols, self.disk = text, symbols, disk
        n = len(text)
        #: is a suffix of type S; how many equal symbols it starts with (65535 at most)
        self.is_s, self.run = disk.array(n, bool), disk.array(n, np.uint16)
        self.counts = disk.array(symbols, np.int64)
        n_seeds = 0
        for hi in range(n, 0, -BLOCK):
            lo = max(0, hi - BLOCK)
            t = np.asarray(text[lo : min(hi + 1, n)]).astype(np.int64)
            ends = np.flatnonzero(t[1:] != t[:-1])
            rising = t[ends] < t[ends + 1]
            if hi == n:
                ends, rising = np.append(ends, hi - lo - 1), np.append(rising, True)
                tail, kind = 1, True
            else:
                tail, kind = int(self.run[hi]), bool(self.is_s[hi])
            at = np.arange(hi - lo)
            k = np.searchsorted(ends, at)
            inside = k < len(ends)
            k = np.minimum(k, max(len(ends) - 1, 0))
            length = np.where(inside, ends[k] - at + 1, hi - lo - at + tail) if len(ends) else hi - lo - at + tail
            self.run[lo:hi] = np.minimum(length, 65535)
            self.is_s[lo:hi] = np.where(inside, rising[k], kind) if len(ends) else kind
            values, times = np.unique(t[: hi - lo], return_counts=True)
            self.counts[values] += times
        for lo, hi in blocks(n - 1):
            n_seeds += int((self.is_s[lo + 1 : hi + 1] & ~self.is_s[lo:hi]).sum())
        self.seeds, k = disk.array(n_seeds, np.int64), 0
        for lo, hi in blocks(n - 1):
            found = np.flatnonzero(self.is_s[lo + 1 : hi + 1] & ~self.is_s[lo:hi]) + lo + 1
            self.seeds[k : k + len(found)] = found
            k += len(found)
        upto, total = disk.array(symbols, np.int64), 0
        for lo, hi in blocks(symbols):
            upto[lo:hi] = np.cumsum(self.counts[lo:hi]) + total
            total = int(upto[hi - 1])
        edges, single, c, most = [], [], 0, max(1, disk.budget // 8)
        while c < symbols:
            held = int(upto[c - 1]) if c else 0
            end = max(c + 1, int(np.searchsorted(upto, held + most, "right")))
            edges.append(c)
            single.append(end == c + 1)
            c = end
        self.edges, self.single = np.array(edges, np.int64), np.array(single)

    def queue(self) -> Queue:
        return Queue(self.disk, self.edges, self.single)

    def present(self, back: bool = False) -> Iterator[int]:
        """The symbols that occur, rising or falling."""
        spans = list(range(0, self.symbols, BLOCK))
        for lo in spans[::-1] if back else spans:
            found = (np.flatnonzero(self.counts[lo : lo + BLOCK]) + lo).tolist()
            yield from found[::-1] if back else found

    def is_seed(self, at: np.ndarray) -> np.ndarray:
        return self.is_s[at] & (at > 0) & ~self.is_s[at - 1]


class Scan:
    """One direction of induction: takes scanned suffixes block by block and pushes those before them."""

    def __init__(self, level: Level, queue: Queue, limit: int, carry: bool):
        self.text, self.queue, self.limit, self.carry = level.text, queue, limit, carry
        self.when = level.disk.array(level.symbols, np.int64, -1)  # the scan's item of a symbol's last push
        self.base = self.begin = 0  # items scanned, and before this bucket
        self.bucket = -1
        # the minimum of common prefixes from an item on to the last one: value[k] for items after place[k - 1] up to place[k]
        self.place, self.value = np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def block(self, c: int, at: np.ndarray, lcp: np.ndarray, wanted) -> None:
        """``lcp``: with the suffix scanned before each; 0 for the first of bucket c."""
        if self.bucket != c:
            self.bucket, self.begin = c, self.base
            self.place, self.value = self.place[:0], self.value[:0]
        before = self.text[at - 1]  # the suffix at 0 reads the end of the text, which is smaller than all
        k = np.flatnonzero(wanted(before) & (at > 0))
        if len(k):
            d = before[k]
            order = np.argsort(d, kind="stable")
            k, d = k[order], d[order]
            new = np.zeros(len(k), np.uint16)
            if self.carry:
                edge = starts(d)
                lo = np.empty(len(k), np.int64)
                lo[1:] = k[:-1] + 1
                lo[edge] = 0
                low = Minima(lcp).between(lo, k + 1)
                last = self.when[d[edge]]
                since = np.append(self.value, np.uint16(self.limit))[np.searchsorted(self.place, last + 1)]
                low[edge] = np.minimum(low[edge], np.where(last >= self.begin, since, 0))
                new = np.minimum(low + np.uint16(1), self.limit).astype(np.uint16)
                self.when[d[edge]] = self.base + k[np.r_[edge[1:], len(k)] - 1]
            self.queue.push(d, at[k] - 1, new)
        if self.carry and len(lcp):
            low = np.minimum.accumulate(lcp[::-1])[::-1]
            ends = np.append(starts(low)[1:] - 1, len(low) - 1)
            keep = self.value < low[0]
            self.place = np.r_[self.place[keep], self.base + ends]
            self.value = np.r_[self.value[keep], low[ends]]
        self.base += len(at)


def _induce(level: Level, seeds: Queue, limit: int, carry: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """From seeds (by symbol, in order, with common prefixes) all suffixes but the last symbol's, in descending order.

    Yields (positions, common prefix with the suffix yielded before, type S?).
    """
    run = level.run
    larger, smaller = level.queue(), level.queue()
    both = lambda a, b: min(int(run[a]), int(run[b]), limit) if a >= 0 else 0
    scan = Scan(level, larger, limit, carry)
    for c in level.present():
        last, above = -1, lambda x, c=c: x >= c
        for items in larger.blocks(c):
            at, lcp = items["at"], items["lcp"].copy()
            if last < 0:
                lcp[0] = 0
            last = int(at[-1])
            scan.block(c, at, lcp, above)
        fresh = True
        for items in seeds.blocks(c):
            at, lcp = items["at"], items["lcp"].copy()
            if fresh:
                lcp[0], fresh = both(last, at[0]), False
            scan.block(c, at, lcp, above)
    seeds.close()
    scan = Scan(level, smaller, limit, carry)
    for c in level.present(back=True):
        last, upto, below = -1, lambda x, c=c: x <= c, lambda x, c=c: x < c
        for items in smaller.blocks(c):
            at, lcp = items["at"], items["lcp"].copy()
            if last < 0:
                lcp[0] = 0
            last = int(at[-1])
            yield at, lcp, True
            scan.block(c, at, lcp, upto)
        seam = None
        for items in larger.backwards(c):
            at, lcp = items["at"][::-1], items["lcp"]
            down = np.empty(len(at), np.uint16)
            down[1:] = lcp[:0:-1]
            down[0] = both(last, at[0]) if seam is None else seam
            seam = int(lcp[0])
            yield at, down, False
            scan.block(c, at, down, below)
    larger.close()
    smaller.close()


def _doubling(names: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """In memory: order of the suffixes of a short text and common prefixes, both up to ``limit`` symbols."""
    n = len(names)
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    levels, h = [rank], 1
    order = np.argsort(rank, kind="stable")
    while h < limit:
        ranked = rank[order]
        same = np.r_[False, ranked[1:] == ranked[:-1]]
        open_ = same | np.r_[same[1:], False]
        if not open_.any():
            break
        slots = np.flatnonzero(open_)
        at = order[slots]
        after = np.where(at + h < n, rank[np.minimum(at + h, n - 1)], -1)
        by = np.lexsort((after, rank[at]))
        at, after = at[by], after[by]
        order[slots] = at
        group = rank[at]
        fresh = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        rank = rank.copy()
        # a group's ranks start at the slot of its first member, so that ranks stay comparable
        rank[order] = np.maximum.accumulate(np.where(np.r_[True, ranked[1:] != ranked[:-1]], np.arange(n), 0))
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
        levels.append(rank)
        h *= 2
    lcp = np.zeros(n, np.int64)
    i, j = order[:-1], order[1:]
    off = np.zeros(len(i), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        r = levels[level]
        inside = (i + off < n) & (j + off < n)
        equal = inside & (r[np.minimum(i + off, n - 1)] == r[np.minimum(j + off, n - 1)])
        off += np.where(equal, 1 << level, 0)
    lcp[1:] = np.minimum(off, limit)
    return order, lcp


def _in_substring_order(level: Level, limit: int) -> np.ndarray:
    """The seeds by their substrings (up to the next seed), rising."""
    at, m = level.seeds, len(level.seeds)
    unsorted = level.queue()
    for lo, hi in blocks(m):
        p = np.asarray(at[lo:hi])
        symbol = level.text[p]
        by = np.argsort(symbol, kind="stable")
        unsorted.push(symbol[by], p[by], np.zeros(len(p), np.uint16))
    order, k = level.disk.array(m, np.int64), m
    for p, _, small in _induce(level, unsorted, limit, False):
        if small and len(found := p[level.is_seed(p)]):
            order[k - len(found) : k] = found[::-1]
            k -= len(found)
    order[0] = at[m - 1]  # the last symbol is the smallest seed and induced by none
    return order


def _named(level: Level, order: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Names of the seeds in order of place; how far neighbouring names' substrings agree; how many names.

    Substrings that agree in ``limit`` symbols get one name: what comes after does not count.
    """
    text, is_s, at, m = level.text, level.is_s, level.seeds, len(level.seeds)
    typed = lambda p: text[p].astype(np.int64) * 2 + is_s[p]
    names, edges = level.disk.array(m, np.int64), level.disk.array(m, np.uint16)
    names[int(np.searchsorted(at, order[0]))] = 0
    count = 1
    for lo, hi in blocks(m - 1, BLOCK // 4):
        pair = np.asarray(order[lo : hi + 1])
        place = np.searchsorted(at, pair)
        length = np.minimum(at[np.minimum(place + 1, m - 1)] - pair + 1, limit)
        step = np.minimum(length[1:], length[:-1])
        agree = np.empty(hi - lo, np.int64)
        k = 0
        while k < hi - lo:
            end = min(hi - lo, k + max(1, int(np.searchsorted(np.cumsum(step[k:]), 4 * BLOCK))))
            n = step[k:end]
            first = np.cumsum(n) - n
            inner = np.arange(int(n.sum())) - np.repeat(first, n)
            unlike = typed(np.repeat(pair[k:end], n) + inner) != typed(np.repeat(pair[k + 1 : end + 1], n) + inner)
            agree[k:end] = np.minimum.reduceat(np.where(unlike, inner, 1 << 40), first)
            k = end
        differ = agree < (1 << 40)
        name = count - 1 + np.cumsum(differ)
        names[place[1:]] = name
        edges[name[differ]] = np.minimum(agree[differ], 65535)
        count = int(name[-1]) + 1
    return names, edges, count


def _sorted_seeds(level: Level, limit: int) -> Queue:
    """All seeds in ascending order, with common prefixes."""
    text, run, at, m = level.text, level.run, level.seeds, len(level.seeds)
    disk, out = level.disk, level.queue()
    if m <= 1:
        if m:
            out.push(text[at[:1]], at[:1], np.zeros(1, np.uint16))
        return out
    order = _in_substring_order(level, limit)
    names, edges, count = _named(level, order, limit)
    shorter, common = disk.array(m, np.int64), disk.array(m, np.uint16)
    if count == m:
        for lo, hi in blocks(m):
            shorter[lo:hi] = np.searchsorted(at, order[lo:hi])
    elif m * 2 <= disk.budget:
        shorter, common = _doubling(names, limit)
    else:
        k = 0
        for p, c in suffixes(names, count, limit, disk.folder, disk.budget):
            n = len(p)
            shorter[m - k - n : m - k] = p[::-1]
            # c: with the suffix before, which is the one after in rising order
            skip = int(k == 0)
            common[m - k - n + 1 : m - k + 1 - skip] = c[skip:][::-1]
            k += n
        common[0] = 0
    del order
    least = Minima(edges[:count], disk)
    # from names in common to symbols in common
    for lo, hi in blocks(m):
        j = np.asarray(shorter[lo:hi])
        i = np.r_[j[:1], j[:-1]] if lo == 0 else np.asarray(shorter[lo - 1 : hi - 1])
        c = np.asarray(common[lo:hi]).astype(np.int64)
        p, q = np.minimum(i + c, m - 1), np.minimum(j + c, m - 1)
        a, b = names[p], names[q]
        apart = a != b
        deep = np.zeros(len(j), np.int64)
        if apart.any():
            off = least.between(np.minimum(a, b)[apart] + 1, np.maximum(a, b)[apart] + 1).astype(np.int64)
            x, y = np.minimum(at[p[apart]] + off, len(text) - 1), np.minimum(at[q[apart]] + off, len(text) - 1)
            deep[apart] = off + np.where(text[x] == text[y], np.minimum(run[x], run[y]), 0)
        found = np.minimum(np.where(apart, at[p] - at[i] + deep, limit), limit)
        if lo == 0:
            found[0] = 0
        where = at[j]
        out.push(text[where], where, found.astype(np.uint16))
    return out


def suffixes(text: np.ndarray, symbols: int, limit: int, folder: str, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of ``text`` in descending order, in blocks (positions, common prefix with the one before).

    Order and prefixes count up to ``limit`` symbols (below 65000). The last
    symbol must be smaller than all others. ``budget``: tuples that a queue holds
    in memory, and entries of an array that is no file, times four.
    """
    if len(text) > 1:
        level = Level(text, symbols, Disk(folder, budget))
        for at, lcp, _ in _induce(level, _sorted_seeds(level, limit), limit, True):
            yield at, lcp
    yield np.array([len(text) - 1]), np.zeros(1, np.uint16)


def repeated(text: np.ndarray, symbols: int, width: int, budget: int, folder: str) -> np.ndarray:
    """For each position of ``text``: do its next ``width`` symbols also start elsewhere?"""
    flags, last = Disk(folder, budget).array(len(text), bool), np.zeros(0, np.int64)
    for at, lcp in suffixes(text, symbols, width, folder, budget):
        linked = lcp >= width
        if linked[0]:
            flags[last] = True
        flags[at[linked | np.r_[linked[1:], False]]] = True
        last = at[-1:]
    return flags


def remove(folder: str) -> None:
    shutil.rmtree(folder, ignore_errors=True)
