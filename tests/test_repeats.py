"""Stuttering fragments: the vector search against the pattern that it stands for."""

import random
import time
from difflib import SequenceMatcher

from quire.functions import folds, repeats

KINDS = [repeats.Stutter(4, 200, 3, True, True), repeats.Stutter(8, 400, 3, True, True), folds.STUTTER]
UNITS = ["a", "b", "ab", "word ", "  ", " ", "\n", "\t", "甲乙", "　", "xyz", "abcabcabc", "the line of text, ", " " * 12, "1234567890ab", "\x0b", "\x1c", "\0", "😀"]


def stuttering(rng):
    x = "".join(rng.choice(UNITS) for _ in range(rng.randrange(40)))
    if rng.random() < 0.6:
        fragment = "".join(rng.choice(UNITS) for _ in range(rng.randrange(1, 12)))
        x += "".join(fragment + rng.choice(["", "", " ", "\n", "   "]) for _ in range(rng.randrange(1, 6))) + rng.choice(UNITS)
    return x * rng.choice([1, 1, 1, 1, 3])


def test_collapsed_as_by_the_pattern(monkeypatch):
    monkeypatch.setattr(repeats, "FEW", 0)
    rng = random.Random(5)
    for n in range(150):
        monkeypatch.setattr(repeats, "AT_ONCE", rng.choice([1, 100, 10**6]))
        texts = [stuttering(rng) for _ in range(n % 8)]
        for kind in KINDS:
            assert repeats.collapsed(texts, kind) == [repeats._pattern(kind).subn(r"\1", t) for t in texts]


def test_prose_is_not_searched_place_by_place():
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("enirsatdhu") for _ in range(rng.randrange(2, 9))) for _ in range(300)) for _ in range(40)]
    for kind in (KINDS[0], folds.STUTTER):
        start = time.perf_counter()
        want = [repeats._pattern(kind).subn(r"\1", t) for t in texts]
        middle = time.perf_counter()
        assert repeats.collapsed(texts, kind) == want
        assert 3 * (time.perf_counter() - middle) < middle - start


def test_paragraphs_lose_their_stutter_together():
    line = "one line of some length, "
    assert folds.without_stutter([[line * 4 + "end", None], [], [" x "]]) == [[line + "end", ""], [], ["x"]]
    assert folds.collapse_pages([line * 4 + "end\n\nx y z a b c", None]) == [line + "end\n\nx y z a b c", ""]


def test_plain_matcher_is_difflib_s():
    rng = random.Random(7)
    pairs = [("".join(rng.choice("ab ") for _ in range(rng.randrange(40))), "".join(rng.choice("ab c") for _ in range(rng.randrange(40)))) for _ in range(400)]
    texts = [stuttering(rng) + stuttering(rng) for _ in range(100)]
    pairs += [(t, t.replace("the", "teh").replace("  ", " ")) for t in texts] + list(zip(texts, texts[1:], strict=False))
    prose = " ".join(rng.choice(["the", "then", "other", "word", "a"]) for _ in range(150))
    pairs.append((prose, prose.replace("the", "teh")))
    for a, b in pairs:
        assert folds.Plain(a, b).get_opcodes() == SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    start = time.perf_counter()
    SequenceMatcher(None, *pairs[-1], autojunk=False).get_opcodes()
    middle = time.perf_counter()
    folds.change_pairs(*pairs[-1])
    assert 2 * (time.perf_counter() - middle) < middle - start
