"""External induced sorting of suffixes with common-prefix values, for integer texts.

The text is cut at its S* positions (the leftmost of the suffixes smaller than their right neighbour). The pieces between them are
sorted externally and named, the string of names is sorted by recursion, and its order and common-prefix values seed two
inducing passes. Each pass pops suffix tuples from a disk-backed priority queue: a tuple carries the characters before
its suffix down to the previous S* position, so a pass never looks into the text, and the common-prefix value with its predecessor
in its bucket, which is one more than the least value visited since that predecessor's source (kept by a stack of
ascending values). Where an L-type and an S-type suffix meet in a bucket, the shorter of their leading runs is the value.
"""

from __future__ import annotations

import heapq
import marshal
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np

LIMIT = 400_000
"""Tuples that a queue, a sorter or a stack holds in memory before it writes the rest to the spill folder."""


class Spill:
    """Runs of tuples as files in a folder (any file system that pyarrow knows)."""

    def __init__(self, folder: str, limit: int = LIMIT):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        self.limit, self.made = limit, False

    def write(self, rows: list, block: int = 8192) -> list[tuple[str, int, int]]:
        """Blocks of a new run: (file, offset, length)."""
        if not self.made:
            self.fs.create_dir(self.root, recursive=True)
            self.made = True
        name, blocks, at = f"{self.root}/{uuid.uuid4().hex}", [], 0
        with self.fs.open_output_stream(name) as f:
            for a in range(0, len(rows), block):
                data = marshal.dumps(rows[a : a + block])
                f.write(data)
                blocks.append((name, at, len(data)))
                at += len(data)
        return blocks

    def read(self, block: tuple[str, int, int]) -> list:
        with self.fs.open_input_file(block[0]) as f:
            f.seek(block[1])
            return marshal.loads(f.read(block[2]))

    def clear(self) -> None:
        if self.made:
            self.fs.delete_dir(self.root)
            self.made = False


class Queue:
    """A priority queue of tuples. `heap` is its part in memory; call settle() before looking at heap[0]."""

    def __init__(self, spill: Spill):
        self.spill, self.heap, self.runs, self.floor = spill, [], [], None

    def settle(self) -> None:
        """Make the least tuple of all be in the heap, and the heap small."""
        heap = self.heap
        if len(heap) > self.spill.limit:
            heap.sort()
            keep = len(heap) // 4
            rest, heap[:] = heap[keep:], heap[:keep]
            self.runs.append((rest[0], self.spill.write(rest)[::-1]))
            heapq.heapify(self.runs)
            self.floor = self.runs[0][0]
        while self.runs and (not heap or heap[0] >= self.floor):
            _, blocks = heapq.heappop(self.runs)
            for row in self.spill.read(blocks.pop()):
                heapq.heappush(heap, row)
            if blocks:
                heapq.heappush(self.runs, (self.spill.read(blocks[-1])[0], blocks))
            self.floor = self.runs[0][0] if self.runs else None


def external_sort(rows: Iterator[tuple], spill: Spill) -> Iterator[tuple]:
    """rows in order, sorted in runs of bounded size that are merged."""
    held, runs = [], []
    for r in rows:
        held.append(r)
        if len(held) > spill.limit:
            held.sort()
            runs.append(spill.write(held))
            held = []
    held.sort()
    if not runs:
        return iter(held)
    return heapq.merge(held, *((row for b in blocks for row in spill.read(b)) for blocks in runs))


class Backwards:
    """Rows that are appended and then read from the last to the first."""

    def __init__(self, spill: Spill):
        self.spill, self.held, self.blocks = spill, [], []

    def append(self, row: tuple) -> None:
        self.held.append(row)
        if len(self.held) > self.spill.limit:
            self.blocks += self.spill.write(self.held)
            self.held = []

    def __iter__(self) -> Iterator[tuple]:
        yield from reversed(self.held)
        for b in reversed(self.blocks):
            yield from reversed(self.spill.read(b))


def _slices(t: np.ndarray, begin: np.ndarray, end: np.ndarray, block: int = 1 << 15) -> Iterator[list[int]]:
    """t[begin[i] : end[i]] as lists, for ascending begin and end, reading t in long stretches."""
    for a in range(0, len(begin), block):
        b = min(len(begin), a + block)
        low = int(begin[a:b].min())
        part = t[low : int(end[a:b].max())].tolist()
        for x, y in zip((begin[a:b] - low).tolist(), (end[a:b] - low).tolist(), strict=True):
            yield part[x:y]


def suffixes(t: np.ndarray, spill: Spill) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of t and the common prefix of each suffix with the one before it. t ends with 0, which occurs nowhere else."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    # Types: S where the next differing character is larger; the last is S.
    change = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
    run_end = change[np.searchsorted(change, np.arange(n))]  # last position of the run
    s_type = np.ones(n, bool)
    inner = run_end < n - 1
    s_type[inner] = t[run_end[inner]] < t[run_end[inner] + 1]
    star = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    m = len(star)
    nxt = np.append(star[1:], n - 1)
    run = (run_end - np.arange(n) + 1)[star]
    # Names: a piece reaches to the next S* position, over the run there and the character after it; none is a prefix of another.
    upto = np.minimum(run_end[nxt] + 2, n)
    names, name_lcp = np.zeros(m, np.int64), [0]
    last, count = None, -1
    for key, i in external_sort(zip(map(tuple, _slices(t, star, upto)), range(m)), spill):
        if key != last:
            if last is not None:
                c = 0
                for x, y in zip(last, key):
                    if x != y:
                        break
                    c += 1
                name_lcp.append(c)
            last, count = key, count + 1
        names[i] = count
    if count + 1 == m:
        order, shared = np.empty(m, np.int64), np.zeros(m, np.int64)
        order[names] = np.arange(m)
    else:
        order, shared = suffixes(names, spill)
    # Common prefixes of neighbouring S* suffixes: whole pieces in common, then the pieces that differ.
    star_lcp = np.zeros(m, np.int64)
    if m > 1:
        u, v, k = order[:-1], order[1:], shared[1:]
        x, y = names[u + k], names[v + k]
        star_lcp[1:] = star[u + k] - star[u] + _range_min(np.array(name_lcp, np.int64), x + 1, y)
    before = np.append(0, star[:-1])
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    # What each S* suffix carries: the characters before it, nearest first, down to the previous S* position.
    seeds = external_sort(((r, i, tuple(c[::-1])) for r, i, c in zip(place.tolist(), range(m), _slices(t, before, star))), spill)
    heads, runs, stars, lcps = t[star].tolist(), run.tolist(), star.tolist(), star_lcp.tolist()

    # First pass, ascending: L-type suffixes.
    found = Backwards(spill)
    queue = Queue(spill)
    heap, push, pop = queue.heap, heapq.heappush, heapq.heappop
    at, value, source = [], [], {}
    seq = now = 0
    last_c, last_rep, last_l = -1, 0, False
    seed = next(seeds, None)
    rank = 0
    while heap or queue.runs or seed is not None:
        if queue.runs or len(heap) > spill.limit:
            queue.settle()
        if heap and (seed is None or heap[0][0] <= heads[seed[1]]):
            c, _, pos, k, pre, rep, lcp = pop(heap)
            found.append((c, pos, k, pre, rep, lcp))
            is_l = True
        else:
            _, i, pre = seed
            c, pos, k, rep = heads[i], stars[i], 0, runs[i]
            lcp = 0 if c != last_c else min(last_rep, rep) if last_l else lcps[rank]
            is_l = False
            rank += 1
            seed = next(seeds, None)
        while value and value[-1] >= lcp:
            value.pop()
            at.pop()
        value.append(lcp)
        at.append(now)
        if k < len(pre):
            p = pre[k]
            if p >= c:
                a = source.get(p)
                seq += 1
                push(heap, (p, seq, pos - 1, k + 1, pre, rep + 1 if p == c else 1, 0 if a is None else 1 + value[bisect_right(at, a)]))
                source[p] = now
        last_c, last_rep, last_l = c, rep, is_l
        now += 1

    # Second pass, descending: S-type suffixes, and with the L-type ones the whole array from its end.
    sa, lcp_out = np.empty(n, np.int64), np.zeros(n, np.int64)
    queue = Queue(spill)
    heap = queue.heap
    at, value, source = [], [], {}
    seq = now = 0
    last_c, last_rep, last_l, carried = -1, 0, False, 0
    larger = iter(found)
    item = next(larger, None)
    out = n - 1
    while heap or queue.runs or item is not None:
        if queue.runs or len(heap) > spill.limit:
            queue.settle()
        if heap and (item is None or -heap[0][0] >= item[0]):
            c, _, pos, k, pre, rep, lcp = pop(heap)
            c = -c
            is_l = False
        else:
            c, pos, k, pre, rep, below = item
            lcp = 0 if c != last_c else carried if last_l else min(last_rep, rep)
            carried = below
            is_l = True
            item = next(larger, None)
        sa[out] = pos
        if out + 1 < n:
            lcp_out[out + 1] = lcp
        out -= 1
        while value and value[-1] >= lcp:
            value.pop()
            at.pop()
        value.append(lcp)
        at.append(now)
        if k < len(pre):
            p = pre[k]
            if p < c or (p == c and not is_l):
                a = source.get(p)
                seq += 1
                push(heap, (-p, seq, pos - 1, k + 1, pre, rep + 1 if p == c else 1, 0 if a is None else 1 + value[bisect_right(at, a)]))
                source[p] = now
        last_c, last_rep, last_l = c, rep, is_l
        now += 1
    sa[0] = n - 1
    return sa, lcp_out


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low[i] .. high[i]]) for low <= high, by tables of doubling width, one at a time."""
    span = high - low + 1
    level = np.frexp(span)[1] - 1
    out = np.empty(len(low), np.int64)
    table, width = values, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        q = level == k
        out[q] = np.minimum(table[low[q]], table[high[q] - width + 1])
        table, width = np.minimum(table[:-width], table[width:]) if len(table) > width else table, 2 * width
    return out
