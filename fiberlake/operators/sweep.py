"""Files of a time cell and their ships, all files of a run at once.

Sorted by their centres, the files that a ship's report holds for are a run of them. On a file's plane the squared
distance of a position and a ship is s * dlon^2 + dlat^2, where s, the squared scale of a degree of longitude, depends on
the ships' mean latitude alone and hardly changes from file to file. It grows with s, so the least and the greatest s of
a run bound all of its distances: what the bounds leave open is measured on each file's own plane. So a pair of a ship
and a position is looked at once for a run of files, and far positions are ruled out by blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ..schema import METERS_PER_DEGREE_LAT, NO_SHIP_SENTINEL_M

#: Distances are rounded to 0.1 m; bounds have this much to spare for it.
HALF_STEP_M = 0.05 + 1e-3
SLACK = 1 + 1e-9
#: Cells of a table of files and positions, and pairs that are measured at once.
CELLS, PAIRS = 1 << 22, 1 << 19


def _running(size: int, first: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The sum of the values of those that are there, for each file."""
    steps = np.bincount(first, value, size + 1) - np.bincount(end, value, size + 1)
    return np.cumsum(steps)[:size]


def _ragged(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of `count` places each: the owner of each place and its number."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


class Sweep:
    """Files with these centres, in order, over a cable (annotate.Cable) of finite places. ships: latitudes, longitudes,
    and the first and last microsecond of each."""

    def __init__(self, cable, ships: list[np.ndarray], centres: np.ndarray):
        lat, lon, begins, ends = ships
        first, end = np.searchsorted(centres, begins), np.searchsorted(centres, ends, side="right")
        there = np.flatnonzero(first < end)
        self.cable, self.n = cable, len(centres)
        self.lat, self.lon, self.first, self.end = lat[there], lon[there], first[there], end[there]
        (middle_lat, half_lat), (middle_lon, half_lon) = cable.boxes[0]
        self.blocks = middle_lat, half_lat, middle_lon, half_lon
        self.ships = np.rint(_running(self.n, self.first, self.end, np.ones(len(there)))).astype(np.int64)
        base = self.lat[0] if len(there) else 0.0
        mean = base + _running(self.n, self.first, self.end, self.lat - base) / np.maximum(self.ships, 1)
        self.s = (METERS_PER_DEGREE_LAT * np.cos(np.radians(mean))) ** 2
        used = self.s[self.ships > 0]
        self.low, self.high = (used.min() / SLACK, used.max() * SLACK) if len(used) else (0.0, 0.0)

    def _boxes(self, a: int, b: int, blocks: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the squared distances of ships a to b from each of the blocks."""
        middle_lat, half_lat, middle_lon, half_lon = (x[blocks] for x in self.blocks)
        x, y = np.abs(middle_lon - self.lon[a:b, None]), np.abs(middle_lat - self.lat[a:b, None])
        near = self.low * np.maximum(x - half_lon, 0) ** 2 + (np.maximum(y - half_lat, 0) * METERS_PER_DEGREE_LAT) ** 2
        far = self.high * (x + half_lon) ** 2 + ((y + half_lat) * METERS_PER_DEGREE_LAT) ** 2
        return near / SLACK, far * SLACK

    def _near(self, reach: float, blocks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ship, place in blocks) of those that may be within `reach`, rounded distances included."""
        step = max(1, PAIRS // max(1, len(blocks)))
        most = PAIRS // self.cable.width + 1
        for a in range(0, len(self.lat), step):
            ship, at = np.nonzero(self._boxes(a, a + step, blocks)[0] <= (reach + HALF_STEP_M) ** 2 * SLACK)
            for i in range(0, len(ship), most):
                yield a + ship[i : i + most], at[i : i + most]

    def _measured(self, ship: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared degrees east and squared metres north of a ship and each position of a block."""
        pos = block[:, None] * self.cable.width + np.arange(self.cable.width)
        x, y = self.cable.lon[pos] - self.lon[ship, None], (self.cable.lat[pos] - self.lat[ship, None]) * METERS_PER_DEGREE_LAT
        return x * x, y * y

    def nearest(self) -> np.ndarray:
        """The least distance of any position to any ship, for each file, to 0.1 m; NO_SHIP_SENTINEL_M without ships."""
        held, bound = [], np.full(self.n, np.inf)
        step = max(1, PAIRS // len(self.blocks[0]))
        for start in range(0, len(self.lat), step):
            near, far = self._boxes(start, start + step, slice(None))
            ship, block = np.nonzero(near <= far.min(axis=1, keepdims=True))  # those that may hold a ship's nearest position
            ship += start
            x, y = self._measured(ship, block)
            at = np.flatnonzero(np.diff(ship, prepend=-1))
            low, high = self.low * x + y, self.high * x + y
            least, most = (np.minimum.reduceat(d.min(axis=1), at) for d in (low, high))
            for i, d in zip(ship[at], most, strict=True):
                part = bound[self.first[i] : self.end[i]]
                np.minimum(part, d, out=part)
            row, place = np.nonzero(low <= np.repeat(most * SLACK, np.diff(at, append=len(ship)))[:, None])
            held.append((ship[at], least, ship[row], x[row, place], y[row, place]))
        best = np.full(self.n, np.inf)
        for ships, least, owner, x, y in held:
            edges = np.searchsorted(owner, ships), np.searchsorted(owner, ships, side="right")
            for i, d, a, b in zip(ships, least, *edges, strict=True):
                at = self.first[i] + np.flatnonzero(bound[self.first[i] : self.end[i]] * SLACK >= d)
                if len(at):
                    best[at] = np.minimum(best[at], (self.s[at, None] * x[a:b] + y[a:b]).min(axis=1))
        return np.where(self.ships > 0, np.rint(np.sqrt(best) * 10) / 10, NO_SHIP_SENTINEL_M)

    def reached(self, reach: float) -> np.ndarray:
        """The blocks that a ship may be within `reach` of, rounded distances included."""
        every = np.arange(len(self.blocks[0]))
        mark = np.zeros(len(every), bool)
        for _, at in self._near(reach, every):
            mark[at] = True
        return np.flatnonzero(mark)

    def covered(self, edges: list[float], blocks: np.ndarray) -> list[np.ndarray]:
        """For each edge a table of files and the positions of these blocks, which hold all that are reached(): whether a
        ship is within it, by distances rounded to 0.1 m. Files without ships are False."""
        width, size = self.cable.width, len(blocks)
        steps = [np.zeros(((self.n + 1) * size, width), np.int16 if len(self.lat) < 1 << 15 else np.int32) for _ in edges]
        unsure: list[list[tuple]] = [[] for _ in edges]
        for ship, at in self._near(max(edges), blocks):
            x, y = self._measured(ship, blocks[at])
            low, high = self.low * x + y, self.high * x + y
            runs = []  # rows of ships that come, and go, at one file and block
            for file in (self.first, self.end):
                row = file[ship] * size + at
                order = np.argsort(row, kind="stable")
                start = np.flatnonzero(np.diff(row[order], prepend=-1))
                runs.append((order, start, row[order[start]]))
            for k, edge in enumerate(edges):
                inner, outer = max(edge - HALF_STEP_M, 0.0), max(edge + HALF_STEP_M, 0.0)
                sure = high * SLACK <= inner * inner if edge > HALF_STEP_M else np.zeros(high.shape, bool)
                for (order, start, row), add in zip(runs, (np.add, np.subtract), strict=True):
                    steps[k][row] = add(steps[k][row], np.add.reduceat(sure[order], start, axis=0, dtype=steps[k].dtype))
                pair, place = np.nonzero((low <= outer * outer * SLACK) & ~sure)
                if len(pair):
                    unsure[k].append((ship[pair], at[pair] * width + place, x[pair, place], y[pair, place]))
        tables = []
        for k, edge in enumerate(edges):
            count = steps[k].reshape(self.n + 1, size * width)
            for i in range(1, self.n):
                np.add(count[i - 1], count[i], out=count[i])
            table = count[: self.n] > 0
            steps[k] = count = None
            if unsure[k]:
                self._settle(table, edge, *(np.concatenate(part) for part in zip(*unsure[k], strict=True)))
            tables.append(table)
        return tables

    def _settle(self, table: np.ndarray, edge: float, ship: np.ndarray, column: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """Measures pairs whose bounds lie on both sides of the edge, in files whose position is not covered yet."""
        count = self.end[ship] - self.first[ship]
        ends = np.cumsum(count)
        a = 0
        while a < len(ship):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
            owner, number = _ragged(count[a:b])
            owner += a
            file = self.first[ship[owner]] + number
            open_ = np.flatnonzero(~table[file, column[owner]])
            owner, file = owner[open_], file[open_]
            within = np.rint(np.sqrt(self.s[file] * x[owner] + y[owner]) * 10) / 10 <= edge
            table[file[within], column[owner[within]]] = True
            a = b
