"""Suffix and common-prefix arrays by external induced sorting.

The order of the leftmost S-type suffixes is found by recursion on the string of their names (or,
that string has at most DOUBLED names, by doubling). It then induces the order of the L-type
suffixes, and that the order of the S-type ones. The suffixes that wait in a character's bucket
stand in a monotone priority queue: they arrive in their final order, as tuples of a position and
the length of the prefix shared with the tuple before, and leave in that order. A queue keeps a
bounded number of tuples in memory and the rest in files of the folder it is given, so a shard may
be far larger than memory. Tuples are handled in blocks: one block induces at once, and the shared
prefixes of what it induces are range minima over the block.

Prefixes are compared up to `cap` characters; suffixes that share so many stand in any order.
"""

from __future__ import annotations

import uuid

import numpy as np

from .common import scratch_fs

FAR = np.int32(1 << 30)
#: A block with fewer tuples is not worth a file; strings of at most so many names are ordered by doubling.
LEAST_FILE, DOUBLED = 1 << 12, 1 << 20


class Queue:
    """Blocks of (positions, shared prefixes) in order of arrival; what exceeds the memory is on disk."""

    def __init__(self, store: "Store"):
        self.store, self.blocks = store, []

    def put(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        if len(pos):
            self.blocks.append(self.store.keep(pos, lcp))

    def take(self) -> tuple[np.ndarray, np.ndarray] | None:
        """All that waits, at most about half the memory at once; None if nothing does."""
        if not self.blocks:
            return None
        out, size = [], 0
        while self.blocks and (not out or size < self.store.memory // 2):
            out.append(self.store.load(self.blocks.pop(0)))
            size += len(out[-1][0])
        return (out[0] if len(out) == 1 else (np.concatenate([p for p, _ in out]), np.concatenate([x for _, x in out])))


class Store:
    """Keeps up to `memory` tuples of all queues in memory and the others in files under `folder`."""

    def __init__(self, memory: int, folder: str | None):
        self.memory, self.folder, self.held, self.files = memory, folder, 0, 0

    def keep(self, pos: np.ndarray, lcp: np.ndarray):
        if self.folder is None or self.held + len(pos) <= self.memory or len(pos) < LEAST_FILE:
            self.held += len(pos)
            return pos, lcp
        uri = f"{self.folder}/{uuid.uuid4().hex}.run"
        fs, name = scratch_fs(uri)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(name) as f:
            f.write(pos.astype("<i8").tobytes() + lcp.astype("<i4").tobytes())
        self.files += 1
        return uri, len(pos)

    def load(self, block) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(block[0], np.ndarray):
            self.held -= len(block[0])
            return block
        fs, name = scratch_fs(block[0])
        with fs.open_input_file(name) as f:
            raw = f.read()
        fs.delete_file(name)
        return np.frombuffer(raw, "<i8", block[1]), np.frombuffer(raw, "<i4", block[1], 8 * block[1])


def types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is S-type; the end counts as smaller than any character."""
    n = len(s)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    rise[-1] = -1
    at = np.where(rise != 0, np.arange(n), n)
    return rise[np.minimum.accumulate(at[::-1])[::-1]] > 0


class Minima:
    """Range minima over a block: min(values[a..b]) for many a <= b."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        width = 1
        while 2 * width <= len(values):
            low = self.rows[-1]
            self.rows.append(np.minimum(low[:-width], low[width:]))
            width *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = np.log2(b - a + 1).astype(np.int64)
        out = np.empty(len(a), self.rows[0].dtype)
        for k in np.unique(level):
            m = level == k
            row = self.rows[k]
            out[m] = np.minimum(row[a[m]], row[b[m] - (1 << int(k)) + 1])
        return out


class Induction:
    """One direction of induction: what is put in is what has been placed, in order of placement."""

    def __init__(self, s: np.ndarray, wanted: np.ndarray, k: int, store: Store, cap: int, prefixes: bool):
        self.s, self.wanted, self.cap, self.prefixes, self.store = s, wanted, cap, prefixes, store
        self.queues: dict[int, Queue] = {}
        self.least = np.full(k, FAR, np.int32) if prefixes else None  # of prefixes since the bucket's last tuple
        self.met = np.zeros(k, bool) if prefixes else None

    def induce(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        before = pos - 1
        at = np.flatnonzero((pos > 0) & self.wanted[before])
        if not len(at):
            if self.prefixes and len(lcp):
                np.minimum(self.least, lcp.min(), out=self.least)
            return
        target = self.s[before[at]]
        order = np.argsort(target, kind="stable")
        at, target = at[order], target[order]
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        if self.prefixes:
            m = np.empty(len(at), np.int32)
            rest = np.ones(len(at), bool)
            rest[first] = False
            rest = np.flatnonzero(rest)
            minima = Minima(lcp)
            if len(rest):
                m[rest] = minima(at[rest - 1] + 1, at[rest])
            m[first] = np.minimum(self.least[target[first]], np.minimum.accumulate(lcp)[at[first]])
            new = np.minimum(m + 1, self.cap).astype(np.int32)
            new[first[~self.met[target[first]]]] = 0
            np.minimum(self.least, lcp.min(), out=self.least)
            last = np.r_[first[1:], len(at)] - 1
            tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1], FAR)
            self.least[target[last]] = tail[at[last] + 1]
            self.met[target[last]] = True
        else:
            new = np.zeros(len(at), np.int32)
        found = before[at]
        for a, b in zip(first, np.r_[first[1:], len(at)], strict=True):
            c = int(target[a])
            if c not in self.queues:
                self.queues[c] = Queue(self.store)
            self.queues[c].put(found[a:b], new[a:b])

    def drain(self, c: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and induces from all that stands or comes to stand in bucket c."""
        out = []
        queue = self.queues.get(c)
        while queue and (block := queue.take()):
            out.append(block)
            self.induce(*block)
            queue = self.queues.get(c)
        return out


def joined(blocks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not blocks:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate([p for p, _ in blocks]), np.concatenate([x for _, x in blocks])


def shared_prefix(s: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int, known: np.ndarray | None = None) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to cap, by comparison from `known` on."""
    out = np.zeros(len(a), np.int64) if known is None else known.astype(np.int64)
    n, live = len(s), np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        fits = (x < n) & (y < n) & (out[live] < cap)
        live, x, y = live[fits], x[fits], y[fits]
        same = s[x] == s[y]
        live = live[same]
        out[live] += 1
    return np.minimum(out, cap).astype(np.int32)


def induced(s: np.ndarray, stype: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray, k: int, store: Store, cap: int, prefixes: bool) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, from the leftmost S-type ones in order; and their shared prefixes."""
    chars = s[seeds] if len(seeds) else np.zeros(0, np.int64)
    cuts = np.searchsorted(chars, np.arange(k + 1))
    up = Induction(s, ~stype, k, store, cap, prefixes)
    n = len(s)
    up.induce(np.array([n], np.int64), np.zeros(1, np.int32))  # the end itself comes first
    large: list[tuple[np.ndarray, np.ndarray]] = []
    for c in range(k):
        pos, lcp = joined(up.drain(c))
        large.append((pos, lcp))
        own, own_lcp = seeds[cuts[c] : cuts[c + 1]], seed_lcp[cuts[c] : cuts[c + 1]].copy()
        if len(own):
            if prefixes:
                own_lcp[0] = shared_prefix(s, pos[-1:], own[:1], cap)[0] if len(pos) else 0
            up.induce(own, own_lcp)
    down = Induction(s, stype, k, store, cap, prefixes)
    order, common = [None] * k, [None] * k
    for c in range(k - 1, -1, -1):
        small, small_lcp = joined(down.drain(c))
        pos, lcp = large[c]
        seam = 0
        if len(pos):
            if prefixes and len(small):
                seam = shared_prefix(s, pos[-1:], small[-1:], cap)[0]
            down.induce(pos[::-1], np.append(np.int32(seam), lcp[:0:-1]).astype(np.int32))
        order[c] = np.concatenate([pos, small[::-1]])
        tail = np.append(np.int32(seam), small_lcp[:0:-1]).astype(np.int32) if len(small) else small_lcp
        common[c] = np.concatenate([lcp, tail])
        large[c] = None
    return np.concatenate(order), np.concatenate(common)


def doubled(names: np.ndarray, most: int) -> np.ndarray:
    """Suffix order of a string that fits in memory, up to `most` names."""
    rank, step, n = names.astype(np.int64) + 1, 1, len(names)
    order = np.argsort(rank, kind="stable")
    while True:
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:] if step < n else 0
        key = rank * (n + 2) + later
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.cumsum(np.r_[True, key[1:] != key[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        step *= 2
        if fresh[-1] == n or step >= most or step >= n:
            return order


def suffix_array(s: np.ndarray, k: int, cap: int, memory: int = 1 << 22, folder: str | None = None, prefixes: bool = True, store: Store | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions in order of their suffixes, length of the prefix shared with the one before, up to
    cap) of a string of characters 0..k-1. `memory`: tuples held; the others go to files in `folder`."""
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    s = s.astype(np.int64) if s.dtype.kind != "i" else s
    store = store or Store(memory, folder)
    stype = types(s)
    lms = np.flatnonzero(stype[1:] & ~stype[:-1]) + 1
    if len(lms) == 0:
        return induced(s, stype, lms, np.zeros(0, np.int32), k, store, cap, prefixes)
    # order of the leftmost S-type substrings, by induction from their first characters
    by_char = lms[np.argsort(s[lms], kind="stable")]
    rough, _ = induced(s, stype, by_char, np.zeros(len(lms), np.int32), k, store, cap, False)
    mark = np.zeros(n, bool)
    mark[lms] = True
    rough = rough[mark[rough]]
    number = np.empty(n, np.int64)
    number[lms] = np.arange(len(lms))
    ends = np.append(lms[1:], n)  # a substring reaches to the next one's first character
    length = (ends - lms)[number[rough]] + 1
    a, b = rough[:-1], rough[1:]
    same = length[:-1] == length[1:]
    whole = np.zeros(len(a), bool)
    at = np.flatnonzero(same & (a + length[:-1] <= n) & (b + length[:-1] <= n))
    whole[at] = shared_prefix(s, a[at], b[at], 1 << 30, None) >= length[at] if len(at) and int(length[at].max()) > 64 else _equal(s, a[at], b[at], length[at])
    names = np.empty(len(lms), np.int64)
    names[number[rough]] = np.cumsum(np.r_[0, ~whole])
    kinds = int(names.max()) + 1
    if kinds == len(lms):
        seeds = rough
    elif len(lms) <= DOUBLED:
        seeds = lms[doubled(names, cap)]
    else:
        deeper, _ = suffix_array(names, kinds, cap, memory, folder, False, store)
        seeds = lms[deeper]
    seed_lcp = np.zeros(len(seeds), np.int32)
    if prefixes:
        seed_lcp[1:] = shared_prefix(s, seeds[:-1], seeds[1:], cap)
    return induced(s, stype, seeds, seed_lcp, k, store, cap, prefixes)


def _equal(s: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    same = np.ones(len(a), bool)
    for k in range(int(length.max()) if len(length) else 0):
        on = np.flatnonzero(same & (length > k))
        if not len(on):
            break
        same[on] = s[a[on] + k] == s[b[on] + k]
    return same
