"""Common stretches found by pieces against difflib."""

from __future__ import annotations

import difflib
import random
import time

import pytest

from cueline.functions.alignment import matching_blocks


def by_difflib(a, b):
    return [tuple(x) for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()]


def changed(rng, text, edits, letters):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out) + 1)
        kind = rng.randrange(4)
        some = rng.randrange(1, 12)
        if kind == 0:
            out[at : at + some] = []
        elif kind == 1:
            out[at:at] = rng.choices(letters, k=some)
        elif kind == 2:
            out[at:at] = out[max(0, at - 40) : at]
        else:
            out[at : at + 1] = rng.choices(letters, k=1)
    return "".join(out)


@pytest.mark.parametrize("letters,edits", [("ab", 3), ("abcdefgh", 12), ("abcdefghijklmnopqrstuvwxyz字😀", 30), ("abc", 0)])
def test_matching_blocks_are_those_of_difflib(letters, edits):
    rng = random.Random(edits)
    for _ in range(150):
        a = "".join(rng.choices(letters, k=rng.randrange(0, 400)))
        if rng.random() < 0.3:
            a = a + a[: len(a) // 2] + a
        b = changed(rng, a, edits, letters) if rng.random() < 0.9 else "".join(rng.choices(letters, k=200))
        assert matching_blocks(a, b) == by_difflib(a, b)


def test_long_texts_take_no_square_of_their_length():
    rng = random.Random(3)
    a = "".join(rng.choices("abcdefghijklmnopqrst", k=60_000))
    b = "".join(("zzz" if at % 3000 == 0 else "") + letter for at, letter in enumerate(a))
    began = time.process_time()
    found = matching_blocks(a, b)
    # difflib takes minutes of these
    assert time.process_time() - began < 10
    assert sum(n for _, _, n in found) == len(a)
