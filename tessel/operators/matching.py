"""difflib's similarity ratio of two strings, the same number, worked out over arrays of seeds.

A seed is a pair of places with the same character, of characters that difflib doesn't take for popular.
difflib finds them anew in each window, one character at a time; here they are found once, with the
length of the run of seeds that ends at each, and a window cuts them.
"""

from __future__ import annotations

import difflib

import numpy as np

#: Seeds that are held at once; a pair of strings with more is left to difflib, which takes more time and less memory.
MOST_SEEDS = 2_000_000
#: Seeds from which on arrays are faster than lists.
FEW = 40


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _seeds(a: str, b: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """i, j, length of the run that ends there, in order of i, then j; None beyond MOST_SEEDS."""
    x, y = _codes(a), _codes(b)
    order = np.argsort(y, kind="stable")
    known, begin, count = np.unique(y[order], return_index=True, return_counts=True)
    if len(y) >= 200:  # difflib's rule for popular characters
        rare = count <= len(y) // 100 + 1
        known, begin, count = known[rare], begin[rare], count[rare]
    if not len(known):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    held = np.flatnonzero(known[at] == x)
    at = at[held]
    many = count[at]
    if many.sum() > MOST_SEEDS:
        return None
    i = np.repeat(held, many)
    j = order[np.repeat(begin[at] - np.cumsum(many) + many, many) + np.arange(len(i))]
    # seeds in a row on one diagonal are a run
    key = (i - j + len(y)) * (len(x) + 2) + i
    along = np.argsort(key, kind="stable")
    placed = key[along]
    first = np.ones(len(i), bool)
    first[1:] = placed[1:] != placed[:-1] + 1
    place = np.arange(len(i))
    run = np.empty(len(i), np.int64)
    run[along] = place - np.maximum.accumulate(np.where(first, place, 0)) + 1
    return i, j, run


def _best(i, j, run, alo: int, blo: int) -> tuple[int, int, int]:
    """The longest run within the window, the first of these by i, then j: its start and length."""
    if isinstance(i, list):
        best = 0, 0, 0
        for p, q, k in zip(i, j, run, strict=True):
            k = min(k, p - alo + 1, q - blo + 1)
            if k > best[2]:
                best = p - k + 1, q - k + 1, k
        return best
    k = np.minimum(run, np.minimum(i - alo, j - blo) + 1)
    at = int(k.argmax())
    size = int(k[at])
    return int(i[at]) - size + 1, int(j[at]) - size + 1, size


def _within(i, j, run, alo: int, ahi: int, blo: int, bhi: int):
    """The seeds of a window; few of them as lists."""
    if isinstance(i, list):
        on = [n for n, (p, q) in enumerate(zip(i, j, strict=True)) if alo <= p < ahi and blo <= q < bhi]
        return [i[n] for n in on], [j[n] for n in on], [run[n] for n in on]
    s = slice(*np.searchsorted(i, (alo, ahi)))
    on = np.flatnonzero((j[s] >= blo) & (j[s] < bhi))
    out = i[s][on], j[s][on], run[s][on]
    return tuple(x.tolist() for x in out) if len(on) < FEW else out


def ratio(a: str, b: str) -> float:
    """difflib.SequenceMatcher(None, a, b).ratio()."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    seeds = _seeds(a, b)
    if seeds is None:
        return difflib.SequenceMatcher(None, a, b).ratio()
    met, windows = 0, [(0, len(a), 0, len(b), seeds)]
    while windows:
        alo, ahi, blo, bhi, seeds = windows.pop()
        p, q, k = _best(*seeds, alo, blo) if len(seeds[0]) else (alo, blo, 0)
        while p > alo and q > blo and a[p - 1] == b[q - 1]:
            p, q, k = p - 1, q - 1, k + 1
        while p + k < ahi and q + k < bhi and a[p + k] == b[q + k]:
            k += 1
        if k:
            met += k
            if alo < p and blo < q:
                windows.append((alo, p, blo, q, _within(*seeds, alo, p, blo, q)))
            if p + k < ahi and q + k < bhi:
                windows.append((p + k, ahi, q + k, bhi, _within(*seeds, p + k, ahi, q + k, bhi)))
    return 2.0 * met / (len(a) + len(b))
