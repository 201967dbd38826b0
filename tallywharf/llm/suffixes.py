"""Suffix sorting by induction over buckets that may lie on disk, and what it tells of repeats.

The suffix array of a byte string is induced from its sorted LMS suffixes (those that start an ascent): scanning the buckets of first characters upwards
puts the suffixes before a descent in order, scanning them downwards puts the others in order. The scan is driven by a priority queue whose key is the
first character: an entry is a suffix's position, entries of a key leave in the order of entry, and what a bucket's entries induce is pushed for all
entries at once. Entries beyond a bound of memory wait in an unnamed file. The LMS substrings are ranked by the same induction; if ranks tie, the string of
ranks is the smaller problem, whose order comes from doubled prefixes.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of queue entries that one sort keeps in memory.
HELD_BYTES = 64_000_000


class BucketQueue:
    """First-in, first-out lists by key; arrays wait in memory, or in an unnamed file once `held` bytes are exceeded."""

    def __init__(self, keys: int, held: int = HELD_BYTES):
        self.lists: list[list] = [[] for _ in range(keys)]
        self.left, self.file, self.end = held, None, 0

    def push(self, key: int, entries: np.ndarray) -> None:
        if self.left >= entries.nbytes:
            self.left -= entries.nbytes
            self.lists[key].append(entries)
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(self.end)
        self.file.write(entries.tobytes())
        self.lists[key].append((self.end, len(entries)))
        self.end += entries.nbytes

    def push_all(self, keys: np.ndarray, entries: np.ndarray) -> None:
        """Pushes entries to their keys, keeping their order within each key."""
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, entries = keys[order], entries[order]
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for part, at in zip(np.split(entries, cut), [0, *cut.tolist()], strict=True):
            self.push(int(keys[at]), part)

    def pop(self, key: int) -> np.ndarray:
        """All entries of a key, in order; the key is empty afterwards."""
        parts, self.lists[key] = self.lists[key], []
        out = []
        for p in parts:
            if isinstance(p, tuple):
                self.file.seek(p[0])
                out.append(np.frombuffer(self.file.read(4 * p[1]), np.int32))
            else:
                self.left += p.nbytes
                out.append(p)
        return np.concatenate(out) if len(out) > 1 else out[0] if out else np.zeros(0, np.int32)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def ascents(s: np.ndarray) -> np.ndarray:
    """For each position whether its suffix is smaller than the next one; the last position is (its symbol is the smallest)."""
    n = len(s)
    up = np.zeros(n, bool)
    up[-1] = True
    step = s[1:].astype(np.int32) - s[:-1]
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    nxt = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
    up[:-1] = np.concatenate([step, [1]])[nxt] > 0
    return up


def induce(s: np.ndarray, up: np.ndarray, lms: np.ndarray, keys: int, held: int) -> np.ndarray:
    """All suffixes in the order that follows from LMS suffixes given in order (in text order: sorted by LMS substring)."""
    seeds = BucketQueue(keys, held)
    seeds.push_all(s[lms], lms)
    queue = BucketQueue(keys, held)
    down: list[np.ndarray] = []

    def pushed(entries: np.ndarray, rising: bool) -> None:
        prev = entries[entries > 0] - np.int32(1)
        prev = prev[up[prev] == rising]
        queue.push_all(s[prev], prev)

    for c in range(keys):
        rounds = []
        while len(got := queue.pop(c)):
            rounds.append(got)
            pushed(got, False)
        down.append(np.concatenate(rounds) if rounds else np.zeros(0, np.int32))
        pushed(seeds.pop(c), False)
    out: list[np.ndarray] = []
    queue.push(0, np.array([len(s) - 1], np.int32))
    for c in range(keys - 1, -1, -1):
        rounds = []
        while len(got := queue.pop(c)):
            rounds.append(got)
            pushed(got, True)
        pushed(down[c][::-1], True)
        if rounds:
            out.append(np.concatenate(rounds))
        if len(down[c]):
            out.append(down[c][::-1])
    queue.close()
    seeds.close()
    return np.concatenate(out)[::-1]


def ranked(names: np.ndarray) -> np.ndarray:
    """The suffix array of a string of ranks, by doubling the prefix that ranks stand for."""
    n = len(names)
    rank = names.astype(np.int64)
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1 if width < n else 0
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


def suffix_array(s: np.ndarray, keys: int, held: int = HELD_BYTES) -> np.ndarray:
    """Positions in the order of their suffixes. s: symbols below `keys`; the last is 0 and the only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int32)
    up = ascents(s)
    is_lms = np.concatenate([[False], up[1:] & ~up[:-1]])
    lms = np.flatnonzero(is_lms).astype(np.int32)
    if len(lms) > 1:
        first = induce(s, up, lms, keys, held)
        by_substring = first[is_lms[first]]
        # length of each LMS substring, with the start of the next one
        end = np.concatenate([lms[1:], [n - 1]])
        place = np.empty(n, np.int32)
        place[lms] = np.arange(len(lms), dtype=np.int32)
        size = (end - lms)[place[by_substring]]
        a, b = by_substring[:-1], by_substring[1:]
        differ = size[1:] != size[:-1]
        live = np.flatnonzero(~differ)
        k = 0
        while len(live):
            apart = s[a[live] + k] != s[b[live] + k]
            differ[live[apart]] = True
            live = live[~apart]
            live = live[size[live] > k]
            k += 1
        names = np.empty(len(lms), np.int64)
        names[place[by_substring]] = np.cumsum(np.concatenate([[0], differ]))
        lms = lms[ranked(names)] if differ.sum() < len(lms) - 1 else by_substring
    return induce(s, up, lms, keys, held)


def repeated(parts: list[bytes], length: int, held: int = HELD_BYTES) -> list[np.ndarray]:
    """For each part a flag for each start of a `length`-byte string within it: whether the same string starts anywhere else in the parts."""
    sizes = np.array([len(p) for p in parts], np.int64)
    # bytes are 2 to 257; 1 parts them; 0 ends all
    flat = np.frombuffer(b"\0".join(parts) + b"\0\0", np.uint8)
    s = flat.astype(np.uint16) + np.uint16(2)
    ends = np.cumsum(sizes + 1) - 1
    s[ends] = 1
    s[-1] = 0
    n = len(s)
    start = ends - sizes
    inside = np.zeros(n + 1, np.int32)
    many = sizes >= length
    np.add.at(inside, start[many], 1)
    np.add.at(inside, (ends - length + 1)[many], -1)
    valid = np.cumsum(inside[:-1]) > 0
    order = suffix_array(s, 258, held)
    order = order[valid[order]]
    words = np.zeros(n, np.uint64)
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    for k in range(8):
        words |= padded[k : n + k].astype(np.uint64) << np.uint64(8 * k)
    p, q = order[1:], order[:-1]
    live = np.arange(len(p))
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 and length > 8 else [])]:
        live = live[words[p[live] + k] == words[q[live] + k]]
    flags = np.zeros(n, bool)
    flags[p[live]] = True
    flags[q[live]] = True
    return [flags[a : max(a, e - length + 1)] for a, e in zip(start.tolist(), ends.tolist(), strict=True)]
