"""Suffix order by induced sorting, with bucket queues that move to disk.

The queue of a first byte is a list of suffix arrays in their final relative order, so
taking buckets in order is what a priority queue of suffix tuples would give. Only the
suffixes at the leftmost-S places are sorted as such, by words of seven bytes and only as deep
as ties go, and the order of all others is induced from them: larger-type suffixes
by a pass upwards, smaller-type ones by a pass downwards. Each step handles all suffixes
of a bucket and round at once.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Values compared at once; 258 ** 7 is under 2 ** 63.
STEP = 7


class BucketQueues:
    """First-in first-out queues of arrays by bucket; beyond ``memory`` bytes, arrays wait on disk."""

    def __init__(self, buckets: int, memory: int, kind: type = np.int64):
        self.parts, self.kind = [[] for _ in range(buckets)], np.dtype(kind)
        self.memory, self.held, self.file = memory, 0, None

    def put(self, chars: np.ndarray, suffixes: np.ndarray) -> None:
        order = np.argsort(chars.astype(np.uint16, copy=False), kind="stable")  # sorted by radix
        chars, suffixes = chars[order], suffixes[order]
        cuts = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1]]) if len(chars) else []
        for a, b in zip(cuts, [*cuts[1:], len(chars)]):
            part = suffixes[a:b]
            if self.held + part.nbytes > self.memory:
                self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115
                at = self.file.seek(0, 2)
                self.file.write(part.tobytes())
                part = (at, len(part))
            else:
                self.held += part.nbytes
            self.parts[chars[a]].append(part)

    def take(self, char: int) -> np.ndarray:
        out = []
        for part in self.parts[char]:
            if isinstance(part, tuple):
                self.file.seek(part[0])
                part = np.frombuffer(self.file.read(part[1] * self.kind.itemsize), self.kind)
            else:
                self.held -= part.nbytes
            out.append(part)
        self.parts[char] = []
        return np.concatenate(out) if out else np.zeros(0, self.kind)


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S), False where it is larger (L)."""
    last = np.flatnonzero(np.r_[t[1:] != t[:-1], True])  # last place of each run
    after = np.r_[t[1:], -1][last]  # what follows the run; nothing is smallest
    return np.repeat(after > t[last], np.diff(np.r_[-1, last]))


def packed(t: np.ndarray, depth: int) -> np.ndarray:
    """The STEP values from each place on as one number, and zeros for ``depth`` places beyond the end."""
    padded = np.r_[t.astype(np.int64) + 1, np.zeros(depth + 2 * STEP, np.int64)]
    n = len(t) + depth + STEP
    out = padded[:n].copy()
    for j in range(1, STEP):
        out *= 258
        out += padded[j : n + j]
    return out


def _lms_order(words: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """Leftmost-S places in order of ``depth`` values: each turn refines only those still tied."""
    key = words[lms]
    order = np.argsort(key)
    key, order = key[order], lms[order]
    new = np.r_[True, key[1:] != key[:-1]]
    tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
    new = new[tied]
    for k in range(STEP, depth, STEP):
        if not len(tied):
            break
        at = order[tied]
        key = words[at + k]
        by_key = np.argsort(key)
        key = key[by_key]
        rank = np.empty(len(key), np.int64)
        rank[by_key] = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        both = np.cumsum(new) << 32 | rank  # the group, then the rank of the next values
        inner = np.argsort(both)
        order[tied] = at[inner]
        both = both[inner]
        new = np.r_[True, both[1:] != both[:-1]]
        more = ~(new & np.r_[new[1:], True])
        tied, new = tied[more], new[more]
    return order


def suffix_order(t: np.ndarray, depth: int, memory: int = 1 << 28, words: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of ``t`` (values from 0 to 256) ordered by at least their first ``depth`` values; ``words`` are those of ``packed``."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    words = packed(t, depth) if words is None else words
    kind = np.int32 if n < 1 << 31 else np.int64
    small = _types(t)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(kind)
    ordered = _lms_order(words, lms, depth) if len(lms) else lms
    both = t.astype(np.uint16) << 1 | small  # value and type of a suffix are looked up together
    heads, seeds, larger, tails = (BucketQueues(257, memory, kind) for _ in range(4))
    seeds.put(both[ordered] >> 1, ordered)
    heads.put(both[-1:] >> 1, np.array([n - 1], kind))  # the suffix before the end is of type L

    def put_before(queues: BucketQueues, suffixes: np.ndarray, kind: bool) -> None:
        p = suffixes[suffixes > 0] - 1
        found = both[p]
        mine = (found & 1) == kind
        queues.put(found[mine] >> 1, p[mine])

    for c in range(257):
        while len(now := heads.take(c)):
            larger.put(np.full(len(now), c, np.uint16), now)
            put_before(heads, now, False)
        put_before(heads, seeds.take(c), False)
    out = []
    for c in range(256, -1, -1):
        smaller = []
        while len(now := tails.take(c)):
            smaller.append(now)
            put_before(tails, now, True)
        big = larger.take(c)
        put_before(tails, big[::-1], True)
        out.append(np.concatenate([big, *[x[::-1] for x in reversed(smaller)]]))
    return np.concatenate(out[::-1])


def same_prefix(t: np.ndarray, order: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """True where a suffix shares its first ``depth`` values with the one before it in order; ``order`` may leave suffixes out."""
    words = packed(t, depth) if words is None else words
    out = np.zeros(len(order), bool)
    alive = np.arange(1, len(order))
    for k in [*range(0, depth - STEP, STEP), depth - STEP]:
        alive = alive[words[order[alive - 1] + k] == words[order[alive] + k]]
    # beyond the end are zeros, which no value is: equal words are equal values
    out[alive[order[alive] + depth <= len(t)]] = True
    return out
