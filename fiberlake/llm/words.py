"""Words of many texts as arrays: places and 64-bit codes, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of text laid end to end; a longer text is laid out alone.
CHUNK = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


@dataclass
class Laid:
    """Texts laid end to end. rows: their numbers; data: their bytes; starts, stops, codes: of each word; ends: the
    number of words up to the end of each text."""

    rows: list[int]
    data: bytes
    starts: np.ndarray
    stops: np.ndarray
    codes: np.ndarray
    ends: np.ndarray

    def words(self, first: int, end: int) -> bytes:
        """The words first .. end - 1 joined by one space."""
        return b" ".join(self.data[self.starts[first] : self.stops[end - 1]].split())


def codes_of(data: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit code of each word; data has 8 bytes after the last word. Words of up to 8 bytes never share a code with
    another of their length."""
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    left = stops - starts
    with np.errstate(over="ignore"):
        h = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        own, at = slice(None), starts
        while True:
            x = h[own] ^ (eights[at] & _LOW[np.minimum(left, 8)])
            x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            h[own] = x ^ x >> np.uint64(32)
            more = np.flatnonzero(left > 8)
            if not len(more):
                return h
            own = more if isinstance(own, slice) else own[more]
            at, left = at[more] + 8, left[more] - 8


def _lay(rows: list[int], held: list[bytes]) -> Laid:
    data = b" ".join([*held, b"", b" " * 8])
    space = _SPACE[np.frombuffer(data, np.uint8)].view(np.int8)
    change = np.diff(space, prepend=np.int8(1))
    starts, stops = np.flatnonzero(change < 0), np.flatnonzero(change > 0)
    byte_ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1)
    return Laid(rows, data, starts, stops, codes_of(data, starts, stops), np.searchsorted(starts, byte_ends))


def laid(texts: Iterable[bytes], chunk: int = CHUNK) -> Iterator[Laid]:
    rows, held, size = [], [], 0
    for row, text in enumerate(texts):
        rows.append(row)
        held.append(text)
        size += len(text)
        if size >= chunk:
            yield _lay(rows, held)
            rows, held, size = [], [], 0
    if rows:
        yield _lay(rows, held)
