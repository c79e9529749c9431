"""Pieces of many texts at once: their code points in one array, equal pieces found by hash and verified letter by letter."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def powers(n: int) -> np.ndarray:
    """Powers of an odd base modulo 2 ** 64, kept for as many letters as a block had."""
    if not _powers or len(_powers[0]) < n:
        steps = np.full(n, _BASE, np.uint64)
        steps[0] = 1
        _powers[:] = [np.multiply.accumulate(steps)]
    return _powers[0][:n]


def inverse_powers(at: np.ndarray, longest: int) -> np.ndarray:
    """Powers of the base that bring the pieces that begin at ``at`` to a common place."""
    return powers(longest)[longest - 1 - at]


def distinct(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One piece of each spelling and, for every piece, which of those it equals."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(codes) + 1
    sums = np.zeros(n, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(n)[:-1], out=sums[1:])
    key = (sums[ends] - sums[starts]) * inverse_powers(starts, n)
    key ^= key >> np.uint64(32)
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    size = ends - starts
    like = first[which]
    same = size[like] == size
    if same.all():
        shift = np.repeat(starts[like] - starts, size)
        at = np.flatnonzero(shift)  # letters that are not their own example
        here = letters(starts, size)[at]
        if (codes[here] == codes[here + shift[at]]).all():
            return first, which
    found: dict[bytes, int] = {}  # two spellings of one hash: rare beyond measure, but then still exact
    which = np.array([found.setdefault(codes[a:b].tobytes(), len(found)) for a, b in zip(starts.tolist(), ends.tolist())])
    return np.unique(which, return_index=True)[1], which


def letters(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all letters of pieces, piece by piece."""
    ends = np.cumsum(size)
    return np.repeat(starts - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class PairTable:
    """An exact map of pairs of numbers under 2 ** 16 to numbers under 2 ** 16 - 1, held in levels of slots."""

    NONE = (1 << 16) - 1

    def __init__(self, pairs: np.ndarray, values: np.ndarray, bits: int = 18):
        keys, self.levels, salt = pairs[:, 0].astype(np.uint64) << np.uint64(16) | pairs[:, 1].astype(np.uint64), [], _BASE
        values = values.astype(np.uint64)
        while len(keys):
            shift = np.uint64(64 - bits)
            slot = (keys * np.uint64(salt)) >> shift
            _, first = np.unique(slot, return_index=True)
            held = np.full(1 << bits, (1 << 64) - 1, np.uint64)
            held[slot[first]] = keys[first] << np.uint64(16) | values[first]
            self.levels.append((np.uint64(salt), shift, held))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, salt, bits = keys[rest], values[rest], salt * salt % (1 << 64) | 1, max(6, bits - 3)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The value of each pair, NONE where it has none."""
        keys = left.astype(np.uint64) << np.uint64(16) | right
        out = None
        for salt, shift, held in self.levels:
            got = held[(keys * salt) >> shift]
            miss = (got >> np.uint64(16)) != keys
            got = (got & np.uint64(self.NONE)).astype(np.uint16)
            if out is None:
                got[miss] = self.NONE
                out = got
            else:
                np.copyto(out, got, where=~miss)
        return out


def merge_all(symbols: np.ndarray, sizes: np.ndarray, ranks: PairTable, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte-pair merges of many words at once: symbols and size of each word after them.

    In every round each word merges the places of its pair of least rank, leftmost first, and looks up the pairs beside
    them; words without a pair leave.
    """
    n, none = len(sizes), np.uint16(PairTable.NONE)
    word, left, order = np.repeat(np.arange(n, dtype=np.int32), sizes), symbols.astype(np.uint16), []

    def looked_up(at: np.ndarray) -> np.ndarray:
        """The ranks of the pairs that begin at these places; none at the end of a word."""
        found = ranks.get(left[at], left[np.minimum(at + 1, len(left) - 1)])
        found[word[np.minimum(at + 1, len(word) - 1)] != word[at]] = none
        if len(at) and at[-1] == len(left) - 1:
            found[-1] = none
        return found

    rank = looked_up(np.arange(len(left)))
    while len(left):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        best = np.minimum.reduceat(rank, starts)
        size = np.diff(np.r_[starts, len(word)])
        if (best == none).any():
            live = np.repeat(best != none, size)
            order.append((word[~live], left[~live]))
            word, left, rank = word[live], left[live], rank[live]
            size, best = size[best != none], best[best != none]
            if not len(left):
                break
        hit = np.flatnonzero(rank == np.repeat(best, size))
        run = np.maximum.accumulate(np.where(np.r_[True, np.diff(hit) != 1], np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        left[hit] = made[rank[hit]]
        live = np.ones(len(left), bool)
        live[hit + 1] = False
        word, left, rank = word[live], left[live], rank[live]
        hit -= np.arange(len(hit))
        near = np.zeros(len(left), bool)
        near[hit] = True
        near[np.maximum(hit - 1, 0)] = True
        near = np.flatnonzero(near)
        rank[near] = looked_up(near)
    if not order:
        return np.zeros(0, np.uint16), np.zeros(n, np.int64)
    words, out = (np.concatenate(x) for x in zip(*order))
    return out[np.argsort(words, kind="stable")], np.bincount(words, minlength=n)
