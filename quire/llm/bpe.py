"""Byte-level BPE of many words at once, in vector operations.

Words of the same number of symbols are the rows of one array. In each step every row takes its best merge (the least rank, the
leftmost of equals), so all rows that go on get shorter by one and stay an array; rows without a merge are done."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np

NEVER = np.int32(2**31 - 1)
BITS = 18
SPREAD = np.uint32(0x9E3779B1)


def byte_marks() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others in order from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Bpe:
    """The merges of a vocabulary file with an end-of-word suffix. `whole` says whether it is of that kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        marks = byte_marks()
        self.whole = bool(end) and max(vocab.values()) < 1 << 16 and all(m in vocab and m + end in vocab for m in marks)
        if not self.whole:
            return
        self.inner = np.array([vocab[m] for m in marks], np.uint32)
        self.last = np.array([vocab[m + end] for m in marks], np.uint32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        self.keys, self.ranks = np.zeros(1 << BITS, np.uint32), np.full(1 << BITS, NEVER, np.int32)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        # Open addressing: what finds its slot taken goes on to the next one.
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.ranks[slot] == NEVER
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[todo[put]], todo[put]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, slot = todo[rest], (slot[rest] + 1) & ((1 << BITS) - 1)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * SPREAD) >> np.uint32(32 - BITS)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = ((a << np.uint32(16)) | b).ravel()
        slot = self._slot(keys)
        out = self.ranks[slot]
        miss = np.flatnonzero((self.keys[slot] != keys) & (out != NEVER))
        out[miss] = NEVER
        slot = slot[miss]
        while len(miss):
            slot = (slot + 1) & ((1 << BITS) - 1)
            there, found = self.ranks[slot], self.keys[slot] == keys[miss]
            hit = found & (there != NEVER)
            out[miss[hit]] = there[hit]
            go = ~found & (there != NEVER)
            miss, slot = miss[go], slot[go]
        return out.reshape(a.shape)

    def encode(self, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, ids) of words of one length, given as rows of bytes: ids is an array whose rows are those words' ids. Words with
        as many ids come together, each word once."""
        symbols = self.inner[letters]
        symbols[:, -1] = self.last[letters[:, -1]]
        rows = np.arange(len(letters))
        rank = self._rank(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            n = symbols.shape[1]
            if n == 1:
                yield rows, symbols
                return
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            done = best == NEVER
            if done.any():
                yield rows[done], symbols[done]
                rows, symbols, rank, at, best = (x[~done] for x in (rows, symbols, rank, at, best))
            line = np.arange(len(rows))
            symbols[line, at] = self.made[best]
            keep = np.ones(symbols.shape, bool)
            keep[line, at + 1] = False
            symbols = symbols[keep].reshape(len(rows), n - 1)
            keep = np.ones(rank.shape, bool)
            keep[line, at] = False
            rank = rank[keep].reshape(len(rows), n - 2)
            for left in (at - 1, at):  # the new symbol's pairs
                ok = np.flatnonzero((left >= 0) & (left < n - 2))
                rank[ok, left[ok]] = self._rank(symbols[ok, left[ok]], symbols[ok, left[ok] + 1])


class Table:
    """A hash table from 64-bit keys (not 0) to places, for many keys at once."""

    def __init__(self, bits: int):
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.places = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The places of `keys`, -1 for those that aren't there."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.places[slot], -1)
        left = np.flatnonzero((there != keys) & (there != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.places[slot[hit]]
            go = ~hit & (there != 0)
            left, slot = left[go], slot[go]
        return out

    def add(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Different keys that aren't there yet. What finds its slot taken goes on to the next one."""
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            put = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[put]], self.places[slot[put]] = keys[put], places[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, places, slot = keys[rest], places[rest], (slot[rest] + 1) & self.mask
