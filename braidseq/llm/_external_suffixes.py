"""Suffix and common-prefix arrays by external induced sorting (after Bingmann, Fischer and Osipov, 2013).

Left-most S suffixes ("seeds") are sorted first. A pass of the induction from the seeds in order of their
first symbol alone puts the substrings between seeds in order, which gives each a name; the string of names
is a third of the text at most and is sorted by the same procedure, down to a few thousand names. From the
seeds in order all other suffixes are induced: a queue ordered by (symbol, arrival) hands out suffixes in
final order, and each puts the suffix one symbol to its left back into the queue, with the length of the
prefix it shares with the one before it in its bucket, which is one more than the least such length between
the two sources. Texts, types, names, queues and results beyond a memory budget lie in files and are read and
written a chunk at a time; mapped pages are given back as the work goes on, so memory does not grow with the
text. Prefix lengths are capped, as nobody asks for more.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 17
SMALL = 1 << 16
MAX_ROUNDS, IN_A_ROW = 48, 12


class Space:
    """Arrays in memory up to a budget for each, in files of a temporary folder beyond it."""

    def __init__(self, budget: int = 1 << 22, folder: str | None = None):
        self.budget, self.folder, self.files = budget, tempfile.TemporaryDirectory(prefix="suffixes-", dir=folder), 0
        self.on_disk = self.levels = self.touched = 0
        self.maps: dict[int, np.memmap] = {}  # by the plain array that is handed out

    def array(self, n: int, kind) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if size <= self.budget:
            return np.zeros(n, kind)
        self.files += 1
        self.on_disk += size
        return self._keep(np.memmap(os.path.join(self.folder.name, str(self.files)), dtype=kind, mode="w+", shape=(n,)))

    def open(self, path: str, kind) -> np.ndarray:
        """The array in a file: read where it fits into the budget, mapped beyond it."""
        if os.path.getsize(path) <= self.budget:
            return np.fromfile(path, kind)
        return self._keep(np.memmap(path, kind, "r"))

    def _keep(self, mapped: np.memmap) -> np.ndarray:
        plain = mapped.view(np.ndarray)  # without the cost that a memmap adds to each access
        self.maps[id(plain)] = mapped
        return plain

    def free(self, *arrays: np.ndarray) -> None:
        """Delete the files of arrays that are done with."""
        for array in arrays:
            mapped = self.maps.pop(id(array), None)
            if mapped is not None:
                os.unlink(mapped.filename)

    def visit(self, n: int) -> None:
        """Called with the number of entries worked on; now and then mapped pages are given back."""
        self.touched += n
        if self.touched >= 4 * CHUNK:
            self.touched = 0
            for mapped in self.maps.values():
                mapped._mmap.madvise(mmap.MADV_DONTNEED)

    def close(self) -> None:
        self.maps.clear()
        self.folder.cleanup()


def s_types(text: np.ndarray, space: Space) -> np.ndarray:
    """1 where a suffix is smaller than the one to its right; the end counts as the smallest symbol."""
    n = len(text)
    out = space.array(n, np.uint8)
    after, type_after = None, 0
    for to in range(n, 0, -CHUNK):
        at = max(0, to - CHUNK)
        part = np.asarray(text[at:to]).astype(np.int64)
        step = np.diff(np.append(part, -1 if after is None else after))
        known = np.where(step > 0, 1, np.where(step < 0, 0, -1)).astype(np.int8)
        if known[-1] < 0:
            known[-1] = type_after
        # an equal neighbour passes its type on: take the nearest known one to the right
        where = np.where(known >= 0, np.arange(len(known)), len(known))
        nearest = np.minimum.accumulate(where[::-1])[::-1]
        out[at:to] = known[nearest]
        after, type_after = part[0], out[at]
    return out


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, have: np.ndarray, cap) -> np.ndarray:
    """Symbols shared by the suffixes a and b of each pair, of which `have` are known; cap (one or each its own) at most."""
    cap = np.broadcast_to(np.asarray(cap, np.int64), len(have))
    n, out = len(text), np.minimum(have, cap).astype(np.int64)
    a, b, active = np.asarray(a, np.int64), np.asarray(b, np.int64), np.flatnonzero(out < cap)
    if text.dtype == np.uint8 and n >= 8:  # eight bytes at a time while both suffixes have them
        wide = np.ndarray((n - 7,), "<u8", buffer=text, strides=(1,))
        rest = []
        while len(active):
            p, q = a[active] + out[active], b[active] + out[active]
            short = np.maximum(p, q) > n - 8
            rest.append(active[short])
            active, p, q = active[~short], p[~short], q[~short]
            differ = wide[p] ^ wide[q]
            low = (differ & (~differ + np.uint64(1))).astype(np.float64)
            run = np.where(differ == 0, 8, np.log2(np.maximum(low, 1)).astype(np.int64) >> 3)
            out[active] += run
            active = active[(run == 8) & (out[active] < cap[active])]
        out = np.minimum(out, cap)
        active = np.concatenate(rest) if rest else active
        active = active[out[active] < cap[active]]
    width = 4
    while len(active):
        p, q = a[active] + out[active], b[active] + out[active]
        room = np.minimum(np.minimum(n - np.maximum(p, q), cap[active] - out[active]), width)
        same = np.ones(len(active), bool)
        run = np.zeros(len(active), np.int64)
        for j in range(width):
            same &= j < room
            hit = np.flatnonzero(same)
            if not len(hit):
                break
            same[hit[text[p[hit] + j] != text[q[hit] + j]]] = False
            run += same
        out[active] += run
        active = active[same & (run == width)]
        width = min(64, width * 2)
    return out


def _small_order(text: np.ndarray) -> np.ndarray:
    """Suffixes of a short string of integers, sorted in memory by prefix doubling."""
    n = len(text)
    rank, h = np.unique(np.asarray(text), return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - h)] = rank[h:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key)
        new = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        h *= 2
        if h >= n or (n and new[-1] == n - 1):
            return order


class _Queue:
    """A queue by (symbol, arrival): one stretch of the arrays per bucket, with a read and a write end.

    Buckets follow the symbols upwards for the larger (L) suffixes and downwards for the smaller (S) ones, so
    that either queue hands out its buckets from the first to the last.
    """

    def __init__(self, counts: np.ndarray, kind: int, text: np.ndarray, types: np.ndarray, space: Space, cap: int | None):
        self.text, self.types, self.kind, self.space, self.cap, self.top = text, types, kind, space, cap, len(counts) - 1
        self.start = np.append(0, np.cumsum(counts[::-1] if kind else counts)).astype(np.int64)
        self.tail = self.start[:-1].copy()
        total = int(self.start[-1])
        self.at = space.array(total, np.int32 if len(text) < 2**31 else np.int64)
        if cap is not None:
            self.lcp = space.array(total, np.uint16)
            self.last = np.full(len(counts), -1, np.int64)  # bucket of the last source
            self.least = np.zeros(len(counts), np.int64)  # least shared length since then
            self.touched = np.zeros(0, np.int64)

    def bucket(self, positions: np.ndarray) -> np.ndarray:
        symbols = np.asarray(self.text[positions]).astype(np.int64)
        return self.top - symbols if self.kind else symbols

    def begin(self) -> None:
        self.touched = np.zeros(0, np.int64)

    def feed(self, bucket: int, sources: np.ndarray, shared: np.ndarray | None) -> None:
        """Induce from sources of a bucket in final order; shared[j] is the prefix that source j shares with the one before it."""
        self.space.visit(len(sources))
        left = sources.astype(np.int64) - 1
        chosen = left >= 0
        chosen[chosen] = self.types[left[chosen]] == self.kind
        j = np.flatnonzero(chosen)
        if self.cap is None:
            if len(j):
                self.append(left[j])
            return
        shared = shared.astype(np.int64)
        if len(self.touched):
            # the least up to each source matters for the first one of a bucket, the whole for the buckets left alone
            running = np.minimum.accumulate(shared)
        if len(j):
            left = left[j]
            to = self.bucket(left)
            order = np.argsort(to, kind="stable")
            j, left, to = j[order], left[order], to[order]
            first = np.append(True, to[1:] != to[:-1])
            group = np.flatnonzero(first)
            lcp = np.zeros(len(j), np.int64)
            inner = np.flatnonzero(~first)
            if len(inner):
                ends = np.stack([j[inner - 1] + 1, j[inner] + 1], 1).reshape(-1)
                lcp[inner] = 1 + np.minimum.reduceat(np.append(shared, 0), ends)[::2]
            heads = to[group]
            old = self.last[heads]
            again = old == bucket
            value = np.where(old < 0, 0, 1)
            if again.any():
                value[again] = 1 + np.minimum(self.least[heads[again]], running[j[group[again]]])
            lcp[group] = value
            count = np.diff(np.append(group, len(j)))
            place = self.tail[to] + np.arange(len(j)) - np.repeat(group, count)
            self.at[place] = left
            self.lcp[place] = np.minimum(lcp, self.cap)
            self.tail[heads] += count
        if len(self.touched):
            self.least[self.touched] = np.minimum(self.least[self.touched], running[-1])
        if len(j):
            ends = j[np.append(group[1:], len(j)) - 1] + 1
            inf = 1 << 40
            tails = np.minimum.reduceat(np.append(shared, inf), np.stack([ends, np.full(len(ends), len(shared))], 1).reshape(-1))[::2]
            self.least[heads] = np.where(ends < len(shared), tails, inf)
            self.last[heads] = bucket
            self.touched = np.union1d(self.touched, heads)

    def chain(self, bucket: int, sources: np.ndarray) -> None:
        """Hand out the last arrivals of a bucket with all that they put into the same bucket in turn, as repeats of one
        symbol do; no prefixes are kept."""
        links, size = [], 0
        while True:
            left = sources - 1
            left = left[left >= 0]
            left = left[self.types[left] == self.kind]
            to = self.bucket(left)
            away = to != bucket
            links.append(left[away])
            size += len(sources)
            sources = left[~away]
            if not len(sources):
                break
            tail = int(self.tail[bucket])
            self.at[tail : tail + len(sources)] = sources
            self.tail[bucket] += len(sources)
            if size > CHUNK:
                self.append(np.concatenate(links))
                self.space.visit(size)
                links, size = [], 0
        self.append(np.concatenate(links)) if links else None
        self.space.visit(size)

    def append(self, positions: np.ndarray) -> None:
        if not len(positions):
            return
        to = self.bucket(positions)
        order = np.argsort(to, kind="stable")
        to = to[order]
        group = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        count = np.diff(np.append(group, len(to)))
        self.at[self.tail[to] + np.arange(len(to)) - np.repeat(group, count)] = positions[order]
        self.tail[to[group]] += count

    def stretch(self, b0: int, b1: int, others: np.ndarray) -> bool:
        """Hand out the small buckets b0..b1-1 together. others: sources in order of their bucket, which come after
        those in the queue. What the sources put into these same buckets is found first, in rounds, and then
        ordered by (bucket, order of the source) until nothing moves. False, with nothing done, if it takes too many rounds.
        """
        lo, hi = int(self.start[b0]), int(self.start[b1])
        own = np.repeat(np.arange(b0, b1), np.diff(self.start[b0 : b1 + 1]))
        here = np.arange(lo, hi) < self.tail[own]
        at = [np.array(self.at[lo:hi])[here].astype(np.int64), others.astype(np.int64)]
        buckets = [own[here], self.bucket(others)]
        n, known = sum(map(len, at)), len(at[0])
        after, ids, parents = np.concatenate(at), np.arange(n), []
        outside = []
        for _ in range(MAX_ROUNDS):
            left = after - 1
            some = left >= 0
            some[some] = self.types[left[some]] == self.kind
            ids, left = ids[some], left[some]
            to = self.bucket(left)
            inside = to < b1
            outside.append((ids[~inside], left[~inside]))
            if not inside.any():
                break
            after = left[inside]
            at.append(after)
            buckets.append(to[inside])
            parents.append(ids[inside])
            ids = n + np.arange(len(after))
            n += len(after)
        else:
            return False
        at, buckets = np.concatenate(at), np.concatenate(buckets)
        rank = np.arange(n)
        part = np.concatenate([np.zeros(known, np.int64), np.full(len(others), 2), np.ones(n - known - len(others), np.int64)])
        given = known + len(others)
        major, key = (buckets - b0) * 3 + part << 32, np.arange(n)
        while True:
            if parents:
                key[given:] = rank[np.concatenate(parents)]
            order = np.argsort(major + key)
            moved = np.empty(n, np.int64)
            moved[order] = np.arange(n)
            if not parents or np.array_equal(moved, rank):
                break
            rank = moved
        self.at[lo:hi] = at[order[part[order] < 2]]
        self.tail[b0:b1] = self.start[b0 + 1 : b1 + 1]
        ids, left = (np.concatenate(x) for x in zip(*outside))
        if len(ids):
            self.append(left[np.argsort(moved[ids], kind="stable")])
        self.space.visit(2 * n)
        return True

    def full(self, bucket: int) -> slice:
        return slice(int(self.start[bucket]), int(self.tail[bucket]))


def _chunks(lo: int, hi: int) -> Iterator[tuple[int, int]]:
    for at in range(lo, hi, CHUNK):
        yield at, min(hi, at + CHUNK)


def _stretches(weights: np.ndarray, alone: np.ndarray | None) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of buckets that hold about CHUNK entries together. Large ones and those marked
    stand alone (all, if nothing is said of them), empty ones are left out."""
    if alone is None:
        yield from ((int(c), int(c) + 1) for c in np.flatnonzero(weights))
        return
    many, turn = (weights > CHUNK // 4) | alone, np.cumsum(weights) // CHUNK
    new = np.append(True, (turn[1:] != turn[:-1]) | many[1:] | many[:-1])
    first = np.flatnonzero(new)
    held = np.add.reduceat(weights, first)
    ends = np.append(first[1:], len(weights))
    yield from ((int(a), int(b)) for a, b, w in zip(first, ends, held) if w)


def induce(text: np.ndarray, types: np.ndarray, counts: tuple[np.ndarray, np.ndarray], first_seed: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray | None, in_a_row: np.ndarray, cap: int, space: Space) -> tuple[_Queue, _Queue]:
    """The queues of larger and smaller suffixes, all handed out, from the seeds in order (by bucket).

    in_a_row: whether a symbol follows itself many times; such buckets feed themselves and are handed out alone.
    """
    keep = seed_lcp is not None
    symbols = len(counts[0])

    def edge(a: int, b: int) -> int:
        return int(common_prefixes(text, np.array([a]), np.array([b]), np.zeros(1, np.int64), cap)[0]) if a >= 0 else 0

    def arrivals(queue: _Queue, b: int) -> int:
        """Hand out the arrivals of a bucket, which can grow meanwhile; the last of them."""
        queue.begin() if keep else None
        head, last = int(queue.start[b]), -1
        while head < queue.tail[b]:
            to = min(int(queue.tail[b]), head + CHUNK)
            at = np.array(queue.at[head:to])
            if not keep and to == queue.tail[b]:
                queue.chain(b, at.astype(np.int64))
                break
            lcp = np.array(queue.lcp[head:to]) if keep else None
            if keep and last < 0:
                lcp[0] = 0
            queue.feed(b, at, lcp)
            last, head = int(at[-1]), to
        return last

    larger = _Queue(counts[0], 0, text, types, space, cap if keep else None)
    larger.feed(symbols, np.array([len(text)]), np.zeros(1, np.int64))  # the end of the text
    weights = counts[0] + np.diff(first_seed)

    def up(c0: int, c1: int) -> None:
        if c1 - c0 > 1:
            if not larger.stretch(c0, c1, np.array(seeds[first_seed[c0] : first_seed[c1]])):
                up(c0, (c0 + c1) // 2)
                up((c0 + c1) // 2, c1)
        elif weights[c0]:
            last = arrivals(larger, c0)
            for lo, hi in _chunks(int(first_seed[c0]), int(first_seed[c1])):
                at, lcp = np.array(seeds[lo:hi]), np.array(seed_lcp[lo:hi]) if keep else None
                if keep and lo == first_seed[c0]:
                    lcp[0] = edge(last, int(at[0]))
                larger.feed(c0, at, lcp)

    for stretch in _stretches(weights, None if keep else in_a_row):
        up(*stretch)
    smaller = _Queue(counts[1], 1, text, types, space, cap if keep else None)
    top, totals = symbols - 1, (counts[0] + counts[1])[::-1]

    def down(b0: int, b1: int) -> None:
        if b1 - b0 > 1:
            if not smaller.stretch(b0, b1, np.array(larger.at[larger.start[top - b1 + 1] : larger.start[top - b0 + 1]])[::-1]):
                down(b0, (b0 + b1) // 2)
                down((b0 + b1) // 2, b1)
        elif totals[b0]:
            last = arrivals(smaller, b0)
            own = larger.full(top - b0)
            for hi in range(own.stop, own.start, -CHUNK):
                lo = max(own.start, hi - CHUNK)
                at, lcp = np.array(larger.at[lo:hi])[::-1], None
                if keep:
                    beside = np.array(larger.lcp[lo : hi + 1])
                    if hi == own.stop:
                        beside = np.append(beside[: hi - lo], edge(last, int(at[0])))
                    lcp = beside[1:][::-1]
                smaller.feed(b0, at, lcp)

    for stretch in _stretches(totals, None if keep else in_a_row[::-1]):
        down(*stretch)
    return larger, smaller


def _seed_mask(types: np.ndarray, at: int, to: int) -> np.ndarray:
    kind = types[at:to]
    return (kind == 1) & (np.append(types[at - 1] if at else 1, kind[:-1]) == 0)


def _names(text: np.ndarray, seeds: np.ndarray, smaller: _Queue, types: np.ndarray, space: Space) -> tuple[np.ndarray, int]:
    """(name of each seed in text order, number of names): equal for seeds with equal substrings up to the next
    seed, it included; names are in order of the substrings. smaller holds the seeds in that order among others."""
    n, m, total = len(text), len(seeds), len(smaller.at)
    names = space.array(m, np.int32 if m < 2**31 else np.int64)
    name, last, last_size = -1, -1, -1
    for hi in range(total, 0, -CHUNK):
        at = np.array(smaller.at[max(0, hi - CHUNK) : hi])[::-1].astype(np.int64)
        at = at[(at > 0) & (types[at - 1] == 0)]
        if not len(at):
            continue
        nth = np.searchsorted(seeds, at)
        size = np.where(nth + 1 < m, seeds[np.minimum(nth + 1, m - 1)].astype(np.int64) - at + 1, 0)  # the last one is like no other
        prior, prior_size = np.append(last, at[:-1]), np.append(last_size, size[:-1])
        same = np.flatnonzero((size == prior_size) & (size > 0))
        equal = np.zeros(len(at), bool)
        equal[same] = common_prefixes(text, prior[same], at[same], np.zeros(len(same), np.int64), size[same]) >= size[same]
        own = name + np.cumsum(~equal)
        names[nth] = own
        name, last, last_size = int(own[-1]), int(at[-1]), int(size[-1])
        space.visit(2 * len(at))
    return names, name + 1


def suffix_array(text: np.ndarray, symbols: int, cap: int, space: Space, small: int | None = None, carry: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): all suffixes of a string over 0..symbols-1 in order, and the prefix each shares with the
    one before it, cap at most. Strings of up to `small` symbols are ordered in memory. carry: whether
    prefixes are carried through the queues (for small alphabets) or compared afterwards.
    """
    n, small = len(text), SMALL if small is None else small
    index = np.int32 if n < 2**31 else np.int64
    order, shared = space.array(n, index), space.array(n, np.uint16)
    if not n:
        return order, shared
    if n <= small:
        order[:] = _small_order(text)
        _compare(text, order, shared, cap, space)
        return order, shared
    space.levels += 1
    types = s_types(text, space)
    count_l, count_s, count_seed = (np.zeros(symbols, np.int64) for _ in range(3))
    in_a_row = np.zeros(symbols, bool)
    for at, to in _chunks(0, n):
        near = np.asarray(text[max(0, at - IN_A_ROW) : to])
        moves = np.append(0, np.cumsum(near[1:] != near[:-1]))
        in_a_row[near[IN_A_ROW:][moves[IN_A_ROW:] == moves[:-IN_A_ROW]]] = True
        part, kind, seed = np.asarray(text[at:to]).astype(np.int64), types[at:to], _seed_mask(types, at, to)
        for count, which in ((count_l, kind == 0), (count_s, kind == 1), (count_seed, seed)):
            found, times = np.unique(part[which], return_counts=True)
            count[found] += times
    m = int(count_seed.sum())
    first_seed = np.append(0, np.cumsum(count_seed))
    seeds, by_symbol, tail = space.array(m, index), space.array(m, index), first_seed[:-1].copy()
    done = 0
    for at, to in _chunks(0, n):
        own = np.flatnonzero(_seed_mask(types, at, to)) + at
        if not len(own):
            continue
        seeds[done : done + len(own)] = own
        done += len(own)
        symbol = np.asarray(text[own]).astype(np.int64)
        turn = np.argsort(symbol, kind="stable")
        symbol = symbol[turn]
        group = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
        count = np.diff(np.append(group, len(own)))
        by_symbol[tail[symbol] + np.arange(len(own)) - np.repeat(group, count)] = own[turn]
        tail[symbol[group]] += count
        space.visit(2 * len(own))
    seed_order, seed_lcp = space.array(m, index), space.array(m, np.uint16) if carry else None
    if m:
        larger, smaller = induce(text, types, (count_l, count_s), first_seed, by_symbol, None, in_a_row, cap, space)
        names, n_names = _names(text, seeds, smaller, types, space)
        space.free(larger.at, smaller.at, by_symbol)
        name_lcp = None
        if n_names == m:
            by = space.array(m, index)
            for at, to in _chunks(0, m):
                by[names[at:to]] = np.arange(at, to)
        else:  # a seed stands for two symbols or more
            by, name_lcp = suffix_array(names, n_names, cap // 2 + 2, space, small, False)
        for at, to in _chunks(0, m):
            now = np.asarray(by[at:to]).astype(np.int64)
            own = seeds[now].astype(np.int64)
            seed_order[at:to] = own
            space.visit(2 * len(own))
            if not carry:
                continue
            prior = seeds[np.append(by[at - 1] if at else now[0], now[:-1])].astype(np.int64)
            have = np.zeros(to - at, np.int64)
            if name_lcp is not None:  # shared names, less the last one's final symbol, which the next compare decides
                ahead = np.minimum(now + np.asarray(name_lcp[at:to]), m - 1)
                have = np.maximum(seeds[ahead].astype(np.int64) - own, 0)
            found = common_prefixes(text, prior, own, have, cap)
            if at == 0:
                found[0] = 0
            seed_lcp[at:to] = found
        space.free(names, seeds, by, *(() if name_lcp is None else (name_lcp,)))
    larger, smaller = induce(text, types, (count_l, count_s), first_seed, seed_order, seed_lcp, in_a_row, cap, space)
    before = np.append(0, np.cumsum(count_s))  # smaller suffixes of smaller symbols
    upto = np.cumsum(count_l)
    for at, to in _chunks(0, len(larger.at)):
        own = np.array(larger.at[at:to])
        place = np.arange(at, to) + before[text[own]]
        order[place] = own
        if carry:
            shared[place] = larger.lcp[at:to]
        space.visit(2 * len(own))
    total, top = len(smaller.at), symbols - 1
    for at, to in _chunks(0, total):
        own = np.array(smaller.at[total - to : total - at])[::-1]
        place = np.arange(at, to) + upto[text[own]]
        order[place] = own
        if carry:  # the queue keeps what a suffix shares with the next larger one
            lower = np.array(smaller.lcp[total - to + 1 : total - at + 1])[::-1]
            shared[place] = lower if at else np.append(0, lower)
        space.visit(2 * len(own))
    if carry:  # where a bucket's smaller suffixes begin, no queue has compared them with its larger ones
        for c in np.flatnonzero(count_s).tolist():
            least = int(smaller.tail[top - c]) - 1
            pair = np.array([larger.at[larger.tail[c] - 1] if count_l[c] else n, smaller.at[least]], np.int64)
            shared[total - 1 - least + upto[c]] = common_prefixes(text, pair[:1], pair[1:], np.zeros(1, np.int64), cap)[0] if count_l[c] else 0
    else:
        _compare(text, order, shared, cap, space)
    space.free(types, larger.at, smaller.at, seed_order, *((larger.lcp, smaller.lcp, seed_lcp) if carry else ()))
    return order, shared


def _compare(text: np.ndarray, order: np.ndarray, shared: np.ndarray, cap: int, space: Space) -> None:
    """Fill shared by comparing neighbours."""
    for at, to in _chunks(0, len(order)):
        own = np.asarray(order[at:to]).astype(np.int64)
        found = common_prefixes(text, np.append(order[at - 1] if at else own[0], own[:-1]), own, np.zeros(to - at, np.int64), cap)
        if at == 0:
            found[0] = 0
        shared[at:to] = found
        space.visit(2 * len(own))


def repeated_starts(text: np.ndarray, symbols: int, length: int, space: Space, owner_of=None, small: int | None = None) -> np.ndarray:
    """1 at each start of a string of `length` symbols that starts elsewhere in text too.

    owner_of: owners of an array of places; then the string must start at places of two owners.
    """
    order, shared = suffix_array(text, symbols, length, space, small, symbols <= 256)
    out = space.array(len(text), np.uint8)
    at = 0
    while at < len(order):  # whole groups of equal strings at a time
        to = min(len(order), at + CHUNK)
        part = np.asarray(shared[at:to]) < length
        part[0] = True
        while to < len(order) and shared[to] >= length and not part[1:].any():
            more = min(len(order), to + CHUNK)
            part, to = np.append(part, np.asarray(shared[to:more]) < length), more
        first = np.flatnonzero(part)
        if to < len(order) and shared[to] >= length:
            to, first = at + int(first[-1]), first[:-1]
        own = np.asarray(order[at:to])
        if owner_of is None:
            often = np.diff(np.append(first, to - at)) > 1
        else:
            owners = owner_of(own)
            often = np.minimum.reduceat(owners, first) < np.maximum.reduceat(owners, first)
        out[own[np.repeat(often, np.diff(np.append(first, to - at)))]] = 1
        space.visit(2 * len(own))
        at = to
    return out
