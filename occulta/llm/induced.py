"""External induced sorting of a shard's suffixes, with their common prefixes.

Suffixes are told apart by their first ``CAP`` bytes; of those that agree in all
of them any order will do. The steps are those of induced sorting:

* positions are of type S or L (less or greater than the next suffix), and the
  S positions behind an L position are the samples. What lies between two
  samples is a tuple of up to eight bytes; longer stretches are cut into
  several. Tuples get ranks, pairs of neighbouring ranks get ranks, and so on,
  recursively, until the samples are told apart by ``CAP`` bytes;
* sorted samples induce the L suffixes, those the S suffixes. Whatever is
  scanned puts the suffix before it into a priority queue, as a tuple of place
  and common prefix; the priority is the byte it begins with, and among equals
  the order of arrival. The common prefix with the suffix put there before is
  one more than the least of what was scanned since.

Queues, and arrays of more than ``MEMORY`` bytes, are in files of the task's own
scratch folder, and scanning goes by batches, so a shard may be far larger than
memory. The folder goes with the task; a lost task starts again from its rows.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

CAP = 200
#: A byte that UTF-8 text never has: it ends each piece of a shard's text.
END = 0xF8
#: Bytes of one array or queue kept in memory; entries scanned in one go.
MEMORY, BATCH = 64 << 20, 1 << 18
ENTRY = np.dtype([("place", np.int64), ("common", np.uint8)])


class Scratch:
    """Arrays in memory up to ``memory`` bytes each, in files beyond it."""

    def __init__(self, memory: int = 0):
        self.memory, self._folder, self._files = memory or MEMORY, None, 0

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        if self._folder is not None:
            self._folder.cleanup()

    def path(self) -> str:
        self._folder = self._folder or tempfile.TemporaryDirectory(prefix="suffixes-")
        self._files += 1
        return os.path.join(self._folder.name, str(self._files))

    def array(self, n: int, dtype) -> np.ndarray:
        dtype = np.dtype(dtype)
        return np.empty(n, dtype) if n * dtype.itemsize <= self.memory else np.memmap(self.path(), dtype, "w+", shape=(n,))


class Queue:
    """A disk-backed monotone priority queue: 256 priorities, equal ones in order of arrival.

    Entries stay in memory until there are ``memory`` bytes of them; then all
    go to the end of one file, each priority's as one run.
    """

    def __init__(self, scratch: Scratch, dtype=ENTRY):
        self.scratch, self.dtype, self.held, self.file = scratch, np.dtype(dtype), 0, None
        self.parts: list[list] = [[] for _ in range(256)]

    def put(self, priority: int, entries: np.ndarray) -> None:
        if not len(entries):
            return
        self.parts[priority].append(entries)
        self.held += entries.nbytes
        if self.held > self.scratch.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = open(self.scratch.path(), "w+b")
        for parts in self.parts:
            fresh = [x for x in parts if isinstance(x, np.ndarray)]
            if fresh:
                at = self.file.seek(0, 2)
                self.file.write(np.concatenate(fresh).tobytes())
                kept = [x for x in parts if not isinstance(x, np.ndarray)]
                parts[:] = [*kept, (at, sum(len(x) for x in fresh))]
        self.held = 0

    def _read(self, at: int, n: int) -> np.ndarray:
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * self.dtype.itemsize), self.dtype)

    def take(self, priority: int, last: bool = False) -> np.ndarray | None:
        """The first entries of a priority, up to about ``BATCH`` of them, or the last ones; none if it is empty."""
        parts, out, n = self.parts[priority], [], 0
        while parts and n < BATCH:
            x = parts.pop() if last else parts.pop(0)
            if isinstance(x, np.ndarray):
                self.held -= x.nbytes
            else:
                at, size = x
                some = min(size, BATCH)
                if size > some:
                    rest = (at, size - some) if last else (at + some * self.dtype.itemsize, size - some)
                    parts.insert(len(parts) if last else 0, rest)
                x = self._read(at + (size - some) * self.dtype.itemsize if last else at, some)
            out.append(x)
            n += len(x)
        return np.concatenate(out[::-1] if last else out) if out else None

    def all(self, priority: int) -> Iterator[np.ndarray]:
        while (some := self.take(priority)) is not None:
            yield some


def types(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Whether each suffix is of type S; the last one is L. Read from the end, block by block."""
    n = len(text)
    out = scratch.array(n, bool)
    after, less = 0, False  # the byte behind the block, and the type there
    for a in range((n - 1) // BATCH * BATCH, -1, -BATCH):
        block = np.append(text[a : a + BATCH], np.uint8(after)).astype(np.int16)
        step = np.sign(block[1:] - block[:-1])
        if a + BATCH >= n:
            step[-1] = -1
        # a position like the next one has the type of the first that differs
        known = np.where(step != 0, np.arange(len(step)), len(step))
        known = np.minimum.accumulate(known[::-1])[::-1]
        out[a : a + BATCH] = np.where(known < len(step), step[np.minimum(known, len(step) - 1)] > 0, less)
        after, less = text[a], out[a]
    return out


def words(padded: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    return np.ndarray((len(padded) - 7,), np.dtype(f"{order}u8"), padded, 0, (1,))


def common_prefix(padded: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """How many bytes, ``cap`` at most, the suffixes at ``a`` and ``b`` share."""
    out, live, eight = np.full(len(a), cap, np.int64), np.arange(len(a)), words(padded, "<")
    for k in range(0, cap, 8):
        x = eight[a[live] + k] ^ eight[b[live] + k]
        differ = x != 0
        some = x[differ]
        out[live[differ]] = np.minimum(cap, k + np.bitwise_count((some & (~some + np.uint64(1))) - np.uint64(1)) // 8)
        live = live[~differ]
        if not len(live):
            break
    return out


def dense(keys: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(order, ranks) of numbers, equal ones of equal rank: sorted in memory, or dealt by value to a queue's runs and sorted run by run."""
    n = len(keys)
    ranks = scratch.array(n, np.int64)
    order = scratch.array(n, np.int64)
    if keys.nbytes <= scratch.memory:
        runs: Iterator = iter([np.arange(n)])
    else:
        cuts = np.unique(np.sort(keys[np.random.default_rng(0).integers(n, size=1 << 14)])[:: 1 << 6])[:255]
        queue = Queue(scratch, np.int64)
        for a in range(0, n, BATCH):
            to = np.searchsorted(cuts, keys[a : a + BATCH], "right").astype(np.uint8)
            by = np.argsort(to, kind="stable")
            for p, some in _grouped(to[by], by + a):
                queue.put(p, some)
        runs = (np.concatenate(parts) for p in range(256) if (parts := list(queue.all(p))))
    at, rank = 0, 0
    for places in runs:
        if not len(places):
            continue
        values = keys[places]
        by = np.argsort(values)
        values = values[by]
        new = np.concatenate([[False], values[1:] != values[:-1]])
        order[at : at + len(by)] = places[by]
        ranks[places[by]] = rank + np.cumsum(new)
        at += len(by)
        rank += int(new.sum()) + 1
    return order, ranks


def _grouped(priorities: np.ndarray, values: np.ndarray):
    """(priority, its values) of sorted priorities."""
    cuts = np.flatnonzero(np.concatenate([[True], priorities[1:] != priorities[:-1]])) if len(priorities) else []
    for a, b in zip(cuts, [*cuts[1:], len(priorities)]):
        yield int(priorities[a]), values[a:b]


def ranked(ranks: np.ndarray, step: int, cap: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(order, ranks) of tuples by what begins with them, given the ranks of ``step`` tuples each; tuples move on two bytes at least on the average."""
    highest = int(ranks.max(initial=0))
    if 2 * step >= cap + 16 or highest + 1 == len(ranks):
        return dense(ranks, scratch)
    pairs = scratch.array(len(ranks), np.uint64)
    for a in range(0, len(ranks), BATCH):
        here, there = ranks[a : a + BATCH], ranks[a + step : a + step + BATCH]
        pairs[a : a + BATCH] = here.astype(np.uint64) << np.uint64(32)
        pairs[a : a + len(there)] |= (there + 1).astype(np.uint64)
    return ranked(dense(pairs, scratch)[1], 2 * step, cap, scratch)


def samples(padded: np.ndarray, n: int, less: np.ndarray, cap: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The sample suffixes in order, and the common prefix of each with the one before it."""
    first = np.flatnonzero(less[1:n] & ~less[: n - 1]) + 1
    if not len(first):
        return first, np.zeros(0, np.uint8)
    # tuples: a stretch with the next sample's byte and an end mark if it fits, else eight bytes of it, and on after six
    length = np.diff(np.append(first, n))
    pieces = np.where(length <= 6, 1, -(-length // 6))
    start = np.repeat(first, pieces) + 6 * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    left = np.repeat(first + length, pieces) - start
    keys = words(padded, ">")[start].astype(np.uint64)
    short = left <= 6
    mask = (np.uint64(1) << (np.uint64(8) * (7 - left[short]).astype(np.uint64))) - np.uint64(1)
    keys[short] |= mask
    order, ranks = ranked(dense(keys, scratch)[1], 1, cap, scratch)
    whole = np.zeros(len(start), bool)
    whole[np.cumsum(pieces) - pieces] = True
    order = order[whole[order]]
    placed, ranks = start[order], ranks[order]
    common = np.zeros(len(placed), np.uint8)
    for a in range(1, len(placed), BATCH):
        x, y = placed[a - 1 : a - 1 + BATCH], placed[a : a + BATCH]
        common[a : a + BATCH] = common_prefix(padded, x[: len(y)], y, cap)
    return placed, common


class Scan:
    """What is scanned induces what stands before it: entries of a queue, with their common prefixes."""

    def __init__(self, text: np.ndarray, less: np.ndarray, wanted: bool, cap: int, queue: Queue):
        self.text, self.less, self.wanted, self.cap, self.queue = text, less, wanted, cap, queue
        #: By byte: the least common prefix since something was put there; whether anything was.
        self.since, self.begun = np.full(256, 255, np.uint8), np.zeros(256, bool)

    def read(self, place: np.ndarray, common: np.ndarray) -> None:
        """Scan entries; ``common`` is each one's common prefix with the entry scanned before."""
        at = np.flatnonzero(place > 0)
        at = at[self.less[place[at] - 1] == self.wanted]
        byte = self.text[place[at] - 1]
        by = np.argsort(byte, kind="stable")
        at, byte = at[by], byte[by]
        lowest = np.minimum.accumulate(common)
        if len(at):
            new = np.concatenate([[True], byte[1:] != byte[:-1]])
            least = np.empty(len(at), np.uint8)
            least[new] = np.minimum(self.since[byte[new]], lowest[at[new]])
            rest = np.flatnonzero(~new)
            if len(rest):
                least[rest] = range_least(common, at[rest - 1] + 1, at[rest])
            shared = np.minimum(self.cap, least.astype(np.int64) + 1)
            shared[new] *= self.begun[byte[new]]
            entries = np.empty(len(at), ENTRY)
            entries["place"], entries["common"] = place[at] - 1, shared
            for b, some in _grouped(byte, entries):
                self.queue.put(b, some)
        self.since = np.minimum(self.since, lowest[-1])
        if len(at):
            last = np.flatnonzero(np.append(new[1:], True))
            behind = np.append(np.minimum.accumulate(common[::-1])[::-1], np.uint8(255))
            self.since[byte[last]] = behind[at[last] + 1]
            self.begun[byte[last]] = True


def range_least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of ``values[a : b + 1]`` for each pair, by tables of powers of two."""
    level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    out, table, width = np.empty(len(a), values.dtype), values, 1
    for k in range(int(level.max()) + 1):
        if k:
            table, width = np.minimum(table[:-width], table[width:]), 2 * width
        some = np.flatnonzero(level == k)
        if len(some):
            out[some] = np.minimum(table[a[some]], table[b[some] - width + 1])
    return out


def repeated(text: np.ndarray, cap: int = CAP, memory: int = 0) -> np.ndarray:
    """Whether the ``cap`` bytes from each place of ``text`` on also begin at another place.

    ``text``: bytes, each piece closed by ``END``; strings over an ``END``
    don't count, as the pieces' order means nothing.
    """
    n = len(text)
    with Scratch(memory) as scratch:
        out = np.zeros(n, bool)
        if n < 2:
            return out
        padded = scratch.array(n + cap + 16, np.uint8)
        padded[:n], padded[n:] = text, 0xFF
        text = padded[:n]
        less = types(text, scratch)
        placed, common = samples(padded, n, less, cap, scratch)
        begin = np.searchsorted(text[placed], np.arange(257))
        # from the least to the greatest: the empty suffix, then of each byte the L suffixes and the samples
        large, kept = Queue(scratch), Queue(scratch)
        scan = Scan(text, less, False, cap, large)
        scan.read(np.array([n]), np.zeros(1, np.uint8))
        for byte in range(256):
            last = None
            while (some := large.take(byte)) is not None:
                scan.read(some["place"], some["common"])
                kept.put(byte, some)
                last = int(some["place"][-1])
            for a in range(begin[byte], begin[byte + 1], BATCH):
                b = min(a + BATCH, begin[byte + 1])
                shared = common[a:b].copy()
                if a == begin[byte]:
                    shared[0] = 0 if last is None else common_prefix(padded, np.array([last]), placed[a : a + 1], cap)[0]
                scan.read(placed[a:b], shared)
        # from the greatest to the least: of each byte the S suffixes, then the L suffixes; by then the order is whole
        small = Queue(scratch)
        scan = Scan(text, less, True, cap, small)
        before = -1

        def final(place: np.ndarray, shared: np.ndarray) -> None:
            nonlocal before
            twin = np.flatnonzero(shared >= cap)
            out[place[twin]] = True
            out[place[twin[twin > 0] - 1]] = True
            if len(twin) and twin[0] == 0 and before >= 0:
                out[before] = True
            before = int(place[-1])
            scan.read(place, shared)

        for byte in range(255, -1, -1):
            met = False
            while (some := small.take(byte)) is not None:
                final(some["place"], some["common"])
                met = True
            behind = None  # the common prefix of the entry scanned last with the next
            while (some := kept.take(byte, last=True)) is not None:
                place, shared = some["place"][::-1], some["common"][::-1]
                if behind is None:
                    behind = common_prefix(padded, np.array([before]), place[:1], cap)[0] if met else 0
                final(place, np.concatenate([[np.uint8(behind)], shared[:-1]]).astype(np.uint8))
                behind = shared[-1]
        return out
