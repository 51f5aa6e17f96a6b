"""Suffix arrays by the difference-cover algorithm, in vector operations."""

from __future__ import annotations

import numpy as np

ROOM = 1 << 62


def _pair(a: np.ndarray, b: np.ndarray, base: int) -> tuple[np.ndarray, int]:
    """Numbers in the order of (a, b), where b < base, and a bound on them; made dense where they would overflow."""
    top = int(a.max(initial=0)) + 1
    if top >= ROOM // base:
        a, top = np.unique(a, return_inverse=True)[1], len(a)
    return a * base + b, top * base


def _names(parts: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Numbers in the order of the tuples of `parts` (values and a bound on them)."""
    key = parts[0][0]
    for values, base in parts[1:]:
        key = _pair(key, values, base)[0]
    return key


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The places of `s` (positive whole numbers) in the order of the suffixes that start there.

    Triples at places 1 and 2 modulo 3 are sorted and named; unless all names differ, the string of names is sorted by
    recursion, which orders those suffixes. The remaining ones are sorted by their first symbol and the rank behind it, and
    merged: a place 0 compares with a place 1 by one symbol and a rank, with a place 2 by two symbols and a rank."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    base = int(s.max()) + 1
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    distinct, names = np.unique(_names([(s[sample], base), (s[sample + 1], base), (s[sample + 2], base)]), return_inverse=True)
    names = names.astype(np.int64) + 1
    if len(distinct) < len(sample):
        order = suffix_array(names)
        names = np.empty(len(sample), np.int64)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    ranks = len(sample) + 2
    sampled = np.empty(len(sample), np.int64)
    sampled[names - 1] = sample
    sampled = sampled[sampled < n]  # the place behind the end, if it was needed

    zeros = np.arange(0, n, 3)
    key = _names([(s[zeros], base), (rank[zeros + 1], ranks)])
    order = np.argsort(key, kind="stable")
    zeros, key = zeros[order], key[order]
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(_names([(s[first], base), (rank[first + 1], ranks)]), key) if base < ROOM // ranks else _count(s, rank, first, zeros, base, ranks, 1)
    before = before + _count(s, rank, second, zeros, base, ranks, 2)
    out = np.empty(n, np.int64)
    at = np.arange(len(zeros)) + before
    rest = np.ones(n, bool)
    rest[at] = False
    out[at], out[rest] = zeros, sampled
    return out


def _count(s: np.ndarray, rank: np.ndarray, among: np.ndarray, zeros: np.ndarray, base: int, ranks: int, symbols: int) -> np.ndarray:
    """For each of `zeros`, how many of `among`, both sorted, come before it by that many symbols and the rank behind them."""
    both = np.concatenate([among, zeros])
    key = _names([*[(s[both + k], base) for k in range(symbols)], (rank[both + symbols], ranks)])
    return np.searchsorted(key[: len(among)], key[len(among) :])
