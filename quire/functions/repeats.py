"""Fragments that stand several times in a row. A pattern with a back-reference tries every length at every place; here it is
tried only where a text can repeat, which vector operations tell: without white space, a fragment that stands `times` times in a
row leaves `times - 1` periods of characters that equal those one period on, and such a stretch holds an aligned block of half its
length or more, so that for each period only every so many places are looked at."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import cache
from typing import NamedTuple

import numpy as np

#: Characters that are looked at together, and as few as a pattern alone does sooner.
AT_ONCE, FEW = 1_000_000, 150


class Stutter(NamedTuple):
    """A fragment of `least` to `most` characters that stands `times` times or more, white space between; without `ascii_only`, that
    of Unicode; fragments hold line breaks only if `across`."""

    least: int
    most: int
    times: int
    ascii_only: bool
    across: bool


@cache
def _pattern(s: Stutter) -> re.Pattern:
    white = r"[ \t\n\x0b\f\r]" if s.ascii_only else r"\s"
    return re.compile(rf"(.{{{s.least},{s.most}}}?)(?:{white}*\1){{{s.times - 1},}}", re.S if s.across else 0)


@cache
def _white(ascii_only: bool) -> np.ndarray:
    return np.array([chr(i) in " \t\n\x0b\f\r" if ascii_only else chr(i).isspace() for i in range(0x3002)])


def _starts(c: np.ndarray, before: np.ndarray, after: np.ndarray, s: Stutter) -> np.ndarray:
    """Places of `c`, characters without white space, where a fragment may begin. `before` and `after`: how far back and on in the text
    the white space beside each reaches."""
    found, n = [], len(c)
    for p in range(1, min(s.most, n // s.times) + 1):
        need = (s.times - 1) * p
        h = (need + 1) // 2
        a = c[: n - p : h]
        k = np.flatnonzero(a == c[p::h][: len(a)]) * h
        k = k[k + h + p <= n]
        # The text around must be long enough for the fragments, which rules out nearly all short periods.
        k = k[after[np.minimum(k + h + need + p, n) - 1] - before[np.maximum(k - need, 0)] >= s.least * s.times]
        for t in range(1, min(h, 8)):
            k = k[c[k + t] == c[k + t + p]]
        if h > 8 and len(k):
            at = k[:, None] + np.arange(8, h)
            k = k[(c[at] == c[at + p]).all(1)]
        if not len(k):
            continue
        # How far the stretch goes on either side of the block.
        reach = np.arange(need - h + 1)
        left = k[:, None] - 1 - reach
        left = np.where(left >= 0, c[left] == c[left + p], False)
        right = k[:, None] + h + reach
        inside = right + p < n
        right = np.where(inside, c[np.where(inside, right, 0)] == c[np.where(inside, right + p, 0)], False)
        left[:, -1] = right[:, -1] = False
        first, last = k - left.argmin(1), k + h + right.argmin(1) - need
        some = np.maximum(last - first + 1, 0)
        q = np.repeat(first - np.cumsum(some) + some, some) + np.arange(some.sum())
        found.append(q[after[q + s.times * p - 1] - before[q] >= s.least * s.times])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _places(texts: Sequence[str], s: Stutter) -> list[list[int]]:
    """For each text, in order, the places where the pattern can match."""
    codes = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    ends = begins[1:-1] - 1
    codes[ends] = 0x110000 + np.arange(len(ends))  # what ends a text equals nothing
    table = _white(s.ascii_only)
    white = table[np.minimum(codes, len(table) - 1)]
    at = np.flatnonzero(~white)
    before, after = np.concatenate([[0], at[:-1] + 1]), np.concatenate([at[1:], [len(codes)]]) if len(at) else at
    q = _starts(codes[at], before, after, s)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], white, [False]]).astype(np.int8)))
    blank = [(a, b) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= s.least * s.times]
    spans = [(before[i], at[i] + 1) for i in q] + blank
    places = np.unique(np.concatenate([np.arange(a, b) for a, b in spans])) if spans else np.empty(0, np.int64)
    cut = np.searchsorted(places, begins)
    return [(places[a:b] - start).tolist() for a, b, start in zip(cut, cut[1:], begins, strict=False)]


def _collapsed(text: str, places: Iterable[int], pattern: re.Pattern) -> tuple[str, int]:
    out, done, n = [], 0, 0
    for i in places:
        if i >= done and (m := pattern.match(text, i)):
            out += text[done:i], m[1]
            done, n = m.end(), n + 1
    return ("".join(out) + text[done:], n) if n else (text, 0)


def collapsed(texts: Iterable[str], s: Stutter) -> list[tuple[str, int]]:
    """Each text with every stuttering fragment once, as the pattern's substitution gives it, and how many there were."""
    pattern, out, held, size = _pattern(s), [], [], 0

    def flush() -> None:
        if size < FEW:
            out.extend(pattern.subn(r"\1", t) for t in held)
        else:
            out.extend(_collapsed(t, p, pattern) for t, p in zip(held, _places(held, s), strict=True))

    for t in texts:
        if held and size + len(t) > AT_ONCE:
            flush()
            held, size = [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        flush()
    return out
