"""Content-defined anchors: every window of `width` symbols has one, chosen by the window's content alone.

The anchor of a window is the smallest hash of the k-grams inside it, the last one of equals. Two windows with the same
content therefore have the same anchor at the same place, however far apart they stand. Consecutive windows mostly share
their anchor, so a run of windows is described by one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
PLACE_BITS = 24
#: Symbols hashed at once; places within must fit PLACE_BITS.
SLICE = 1 << 20


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of each k consecutive codes (uint64)."""
    powers, n = {}, 1
    level = codes
    out, taken = None, 0
    base = BASE
    with np.errstate(over="ignore"):
        while True:
            if k & n:
                part = level[taken : len(codes) - k + 1 + taken]
                out = part.copy() if out is None else out * np.uint64(base) + part
                taken += n
            powers[n] = base
            if 2 * n > k:
                break
            level = level[: len(level) - n] * np.uint64(base) + level[n:]
            base = base * base % (1 << 64)
            n *= 2
        out ^= out >> np.uint64(33)
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(33)
        out *= np.uint64(0xC4CEB9FE1A85EC53)
        out ^= out >> np.uint64(33)
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i."""
    span, out = 1, x
    while 2 * span <= w:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs(codes: np.ndarray, ends: np.ndarray, width: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, last window, anchor place, anchor hash) of each run, over texts laid end to end.

    `ends` are the texts' ends in `codes`; windows never cross them. Arrays come slice by slice.
    """
    n = len(codes)
    starts = np.concatenate([[0], ends[:-1]])
    low = np.uint64((1 << PLACE_BITS) - 1)
    for at in range(0, max(n - width + 1, 0), SLICE):
        part = codes[at : at + SLICE + width - 1]
        grams = gram_hashes(part, k)
        places = np.arange(len(grams), dtype=np.uint64)
        best = sliding_min((grams & ~low) | (low - places), width - k + 1)
        anchor = (low - (best & low)).astype(np.int64)
        # windows that lie in one text
        whole = np.zeros(len(anchor) + 1, np.int32)
        a, b = np.maximum(starts - at, 0), np.minimum(ends - at - width + 1, len(anchor))
        real = (a < b) & (a < len(anchor))
        np.add.at(whole, a[real], 1)
        np.add.at(whole, b[real], -1)
        inside = np.cumsum(whole[:-1]) > 0
        edge = np.ones(len(anchor), bool)
        edge[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        # texts that follow each other without a gap have different anchors, as those lie in the texts
        first = np.flatnonzero(edge & inside)
        stop = np.ones(len(anchor), bool)
        stop[:-1] = edge[1:] | ~inside[1:]
        last = np.flatnonzero(stop & inside)
        yield first + at, last + at, anchor[first] + at, grams[anchor[first]]
