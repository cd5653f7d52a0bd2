"""External induced sorting of the suffixes of one shard, with their common-prefix values.

The shard's segments are joined by a separator that sorts before every byte. The suffixes that begin
a rising run (S*) are sorted by recursion on their names; all others are induced from them, first the
falling ones in ascending order, then the rising ones in descending order. The priority queue of an
induction is one queue per first symbol: suffixes reach a queue in the order of their rank, so each
queue is sorted as it is filled. Queues hold tuples (suffix, common prefix with the one before) and
move to an unnamed scratch file when they outgrow their memory. The common prefix of an induced
suffix is one more than the least value passed since the queue was last fed.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes that the queues of one induction hold in memory.
QUEUE_BYTES = 96 << 20
_SCAN = 1 << 20


class BucketQueues:
    """First-in first-out queues of (suffix, common prefix), one per symbol; over their memory they go to a scratch file that ends with its task."""

    def __init__(self, buckets: int, memory: int):
        self.parts: list[list] = [[] for _ in range(buckets)]
        self.memory, self.held, self.file = memory, 0, None

    def put(self, bucket: int, places: np.ndarray, shared: np.ndarray) -> None:
        self.parts[bucket].append((places, shared))
        self.held += places.nbytes + shared.nbytes
        if self.held > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            for parts in self.parts:
                for i, part in enumerate(parts):
                    if isinstance(part[0], np.ndarray):
                        at = self.file.tell()
                        self.file.write(part[0].tobytes() + part[1].tobytes())
                        parts[i] = (at, len(part[0]))
            self.held = 0

    def read(self, part: tuple) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(part[0], np.ndarray):
            return part
        self.file.seek(part[0])
        return np.frombuffer(self.file.read(8 * part[1]), np.int64), np.frombuffer(self.file.read(2 * part[1]), np.int16)

    def rounds(self, bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The bucket's tuples in order, with those that are put while it is read."""
        at, parts = 0, self.parts[bucket]
        while at < len(parts):
            group, size = [], 0
            while at < len(parts) and (not group or size < _SCAN):
                group.append(self.read(parts[at]))
                size += len(group[-1][0])
                at += 1
            yield group[0] if len(group) == 1 else (np.concatenate([g[0] for g in group]), np.concatenate([g[1] for g in group]))

    def backwards(self, bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in reversed(self.parts[bucket]):
            yield self.read(part)


class _Feed:
    """Sends the predecessors of scanned suffixes to their queues."""

    def __init__(self, text: np.ndarray, queues: BucketQueues, cap: int, with_shared: bool):
        self.text, self.queues, self.cap, self.with_shared = text, queues, cap, with_shared
        self.least = np.full(len(queues.parts), cap, np.int16)

    def scan(self, places: np.ndarray, shared: np.ndarray, symbol: int, rising: bool, strict: bool) -> None:
        before = places - 1
        symbols = self.text[before]
        fits = (symbols < symbol if strict else symbols <= symbol) if rising else (symbols > symbol if strict else symbols >= symbol)
        at = np.flatnonzero(fits & (places > 0))
        if self.with_shared:
            least = np.minimum(self.least, shared.min()) if len(shared) else self.least
        if len(at):
            to = symbols[at]
            order = np.argsort(to, kind="stable")
            to, at = to[order], at[order]
            edges = np.concatenate(([0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)])).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own, bucket = at[a:b], int(to[a])
                if self.with_shared:
                    last = own[-1] + 1 == len(shared)
                    mins = np.minimum.reduceat(shared, np.concatenate(([0], own[:-1] + 1 if last else own + 1)))
                    mins[0] = min(mins[0], self.least[bucket])
                    least[bucket] = self.cap if last else mins[-1]
                    self.queues.put(bucket, before[own], np.minimum(mins[: b - a] + 1, self.cap).astype(np.int16))
                else:
                    self.queues.put(bucket, before[own], np.zeros(b - a, np.int16))
        if self.with_shared:
            self.least = least


def _common(text: np.ndarray, a: int, b: int, cap: int) -> int:
    """The length of the common prefix of two suffixes, up to cap."""
    n = min(cap, len(text) - max(a, b))
    other = np.flatnonzero(text[a : a + n] != text[b : b + n])
    return int(other[0]) if len(other) else n


def _induce(text: np.ndarray, symbols: int, stars: np.ndarray, star_shared: np.ndarray, cap: int, with_shared: bool, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in descending order, in runs of (suffixes, common prefix with the one before), from the S* suffixes in ascending order."""
    falling = BucketQueues(symbols, memory)
    feed = _Feed(text, falling, cap, with_shared)
    ends = np.searchsorted(text[stars], np.arange(symbols + 1))
    for symbol in range(symbols):
        last = -1
        for places, shared in falling.rounds(symbol):
            if last < 0 and with_shared:
                shared = np.concatenate((np.zeros(1, np.int16), shared[1:]))
            last = int(places[-1])
            feed.scan(places, shared, symbol, rising=False, strict=False)
        a, b = ends[symbol], ends[symbol + 1]
        if b > a:
            shared = star_shared[a:b].copy()
            if with_shared:
                shared[0] = _common(text, last, int(stars[a]), cap) if last >= 0 else 0
            feed.scan(stars[a:b], shared, symbol, rising=False, strict=True)
    rising = BucketQueues(symbols, memory)
    feed = _Feed(text, rising, cap, with_shared)
    for symbol in range(symbols - 1, -1, -1):
        last = -1
        for places, shared in rising.rounds(symbol):
            if last < 0 and with_shared:
                shared = np.concatenate((np.zeros(1, np.int16), shared[1:]))
            last = int(places[-1])
            feed.scan(places, shared, symbol, rising=True, strict=False)
            yield places, shared
        rising.parts[symbol] = []
        carried = np.int16(_common(text, last, int(falling.read(falling.parts[symbol][-1])[0][-1]), cap) if with_shared and last >= 0 and falling.parts[symbol] else 0)
        for places, shared in falling.backwards(symbol):
            turned = np.concatenate(([carried], shared[:0:-1])).astype(np.int16)
            carried = shared[0]
            places = places[::-1]
            feed.scan(places, turned, symbol, rising=True, strict=True)
            yield places, turned
        falling.parts[symbol] = []
    yield np.array([len(text) - 1]), np.zeros(1, np.int16)


def _same(text: np.ndarray, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether the substrings at a and b, of the given sizes, are equal, symbol by symbol."""
    same = n_a == n_b
    left, k = np.flatnonzero(same), 0
    while len(left):
        alike = text[a[left] + k] == text[b[left] + k]
        same[left[~alike]] = False
        k += 1
        left = left[alike & (n_a[left] > k)]
    return same


def _by_doubling(names: np.ndarray, cap: int) -> np.ndarray:
    """The order of the suffixes of a string of names by their first cap names: where most names differ, ranks are doubled in length."""
    rank, reach, n = names.astype(np.int64), 1, len(names)
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - reach)] = rank[reach:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate(([0], np.cumsum(key[order[1:]] != key[order[:-1]])))
        rank[order] = fresh
        reach *= 2
        if fresh[-1] == n - 1 or reach >= cap:
            return order


def _sorted_stars(text: np.ndarray, symbols: int, cap: int, memory: int) -> np.ndarray:
    """The S* suffixes in ascending order of their first cap symbols at least; the last place is one of them."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int64)))
    nearest = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    up = np.append(np.append(step, 1)[nearest] > 0, True)
    stars = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    if len(stars) < 2:
        return stars
    by_symbol = stars[np.argsort(text[stars], kind="stable")]
    is_star = np.zeros(n, bool)
    is_star[stars] = True
    found = [places[is_star[places]] for places, _ in _induce(text, symbols, by_symbol, np.zeros(len(stars), np.int16), cap, False, memory)]
    order = np.concatenate(found)[::-1]
    # equal substrings from one S* to the next, both included, get equal names
    sizes = np.append(stars[1:], n - 1)[np.searchsorted(stars, order)] + 1 - order
    other = ~_same(text, order[:-1], sizes[:-1], order[1:], sizes[1:])
    name = np.concatenate(([0], np.cumsum(other)))
    if name[-1] == len(order) - 1:
        return order
    place = np.searchsorted(stars, order)
    names = np.empty(len(stars), np.int64)
    names[place] = name
    kinds = int(name[-1]) + 1
    if len(names) >= 64 * kinds:  # many suffixes a name: induction again
        inner = _sorted_stars(names, kinds, cap, memory)
        runs = [places for places, _ in _induce(names, kinds, inner, np.zeros(len(inner), np.int16), cap, False, memory)]
        return stars[np.concatenate(runs)[::-1]]
    return stars[_by_doubling(names, cap)]


def _neighbours_share(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """The common prefix of each suffix with the one before in order, up to cap."""
    padded = np.concatenate((text.astype(np.uint8), np.zeros(8, np.uint8)))
    words = np.ndarray(len(text), "<u8", padded, strides=(1,))
    shared = np.zeros(len(order), np.int64)
    left = np.arange(1, len(order))
    last = len(text) - 1
    for done in range(0, cap, 8):
        if not len(left):
            break
        a, b = np.minimum(order[left - 1] + done, last), np.minimum(order[left] + done, last)
        x = words[a] ^ words[b]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
        shared[left] += same
        left = left[same == 8]
    return np.minimum(shared, cap).astype(np.int16)


def repeated_starts(segments: list[bytes], length: int, memory: int = QUEUE_BYTES) -> np.ndarray:
    """The places in the segments, joined with one byte between two, whose next ``length`` bytes lie within one segment and start at another place too."""
    joined = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8) + np.uint8(1)  # UTF-8 has no byte 0xff: separators become 0
    stars = _sorted_stars(joined, 256, length, memory)
    twice = np.zeros(len(joined), bool)
    last = -1
    for places, shared in _induce(joined, 256, stars, _neighbours_share(joined, stars, length), length, True, memory):
        same = shared >= length
        twice[places[same]] = True
        twice[places[:-1][same[1:]]] = True
        if same[0] and last >= 0:
            twice[last] = True
        last = int(places[-1])
    room = np.concatenate([np.arange(len(s), -1, -1) for s in segments])
    return np.flatnonzero(twice & (room >= length))
