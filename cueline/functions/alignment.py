"""Common stretches of two texts, those that difflib finds, without its search through every place of every letter."""

from __future__ import annotations

import difflib

import numpy as np

#: Characters whose hash finds a common stretch; a power of two.
PIECE = 16


def _hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The characters, and a hash of the ``PIECE`` characters from each place on."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    found, width = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    while width < PIECE:
        found = (found[:-width] ^ (found[:-width] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + found[width:]
        width *= 2
    return codes, found


def _longest(flags: np.ndarray) -> int:
    """The most neighbours that are all set."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def _stretches(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """Common stretches ``(start in a, start in b, size)`` around pieces that stand once in either text, as long as can
    be; and the places of ``a`` whose piece is in ``b`` too, but in none of these stretches."""
    (codes_a, pieces_a), (codes_b, pieces_b) = _hashes(a), _hashes(b)
    known_a, at_a, times_a = np.unique(pieces_a, return_index=True, return_counts=True)
    known_b, at_b, times_b = np.unique(pieces_b, return_index=True, return_counts=True)
    _, once_a, once_b = np.intersect1d(known_a[times_a == 1], known_b[times_b == 1], assume_unique=True, return_indices=True)
    i, j = at_a[times_a == 1][once_a], at_b[times_b == 1][once_b]
    order = np.argsort(i)
    i, j = i[order], j[order]
    repeated = np.isin(pieces_a, known_b)
    found, reached = [], {}
    for x, y in zip(i.tolist(), j.tolist()):
        if reached.get(x - y, -1) >= x + PIECE or not (codes_a[x : x + PIECE] == codes_b[y : y + PIECE]).all():
            continue
        back = min(x, y)
        differs = np.flatnonzero(codes_a[x - back : x][::-1] != codes_b[y - back : y][::-1])
        back = int(differs[0]) if len(differs) else back
        ahead = min(len(a) - x, len(b) - y)
        differs = np.flatnonzero(codes_a[x : x + ahead] != codes_b[y : y + ahead])
        ahead = int(differs[0]) if len(differs) else ahead
        reached[x - y] = x + ahead
        found.append((x - back, y - back, back + ahead))
    repeated[i] = False
    return np.array(found, dtype=np.int64).reshape(-1, 3), repeated


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """What ``difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()`` gives.

    The longest common stretch of a window holds a piece that stands once in either text, or all its pieces are repeated
    ones; a stretch of the first kind that is longer than any of the second can be is taken without a search.
    """
    if a == b:
        return [(0, 0, len(a)), (len(a), len(b), 0)] if a else [(0, 0, 0)]
    if min(len(a), len(b)) < 2 * PIECE:
        return [tuple(x) for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()]
    stretches, repeated = _stretches(a, b)
    most = _longest(repeated)
    windows, found = [(0, len(a), 0, len(b), stretches)], []
    while windows:
        low_a, high_a, low_b, high_b, near = windows.pop()
        if low_a == high_a or low_b == high_b:
            continue
        if len(near):
            cut = np.maximum(0, np.maximum(low_a - near[:, 0], low_b - near[:, 1]))
            size = np.minimum(near[:, 2], np.minimum(high_a - near[:, 0], high_b - near[:, 1])) - cut
            near, cut, size = near[size > 0], cut[size > 0], size[size > 0]
        if len(near):
            begin_a, begin_b = near[:, 0] + cut, near[:, 1] + cut
            best = np.lexsort((begin_b, begin_a, -size))[0]
            x, y, n = int(begin_a[best]), int(begin_b[best]), int(size[best])
            if n >= most + PIECE or n >= _longest(repeated[low_a:high_a]) + PIECE:
                found.append((x, y, n))
                windows += [(low_a, x, low_b, y, near), (x + n, high_a, y + n, high_b, near)]
                continue
        for x, y, n in difflib.SequenceMatcher(None, a[low_a:high_a], b[low_b:high_b], autojunk=False).get_matching_blocks()[:-1]:
            found.append((low_a + x, low_b + y, n))
    merged: list[tuple[int, int, int]] = []
    for x, y, n in sorted(found):
        if merged and merged[-1][0] + merged[-1][2] == x and merged[-1][1] + merged[-1][2] == y:
            merged[-1] = (*merged[-1][:2], merged[-1][2] + n)
        else:
            merged.append((x, y, n))
    return [*merged, (len(a), len(b), 0)]
