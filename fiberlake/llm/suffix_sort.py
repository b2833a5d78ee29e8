"""External induced suffix sorting with common-prefix values, up to a depth.

A text is an array of symbols whose last one, 0, is the smallest and is there once. Suffixes are of type S if they are
smaller than the next one and of type L else; S* suffixes are S after L. Sorting goes as induced sorting does:

1. The S* substrings (from one S* to the next) are sorted and named; names in text order are a text at most half as
   long, which is sorted by recursion, or at once where it fits the memory. That sorts the S* suffixes.
2. L suffixes are induced in rising order: each suffix, as its turn comes, queues the one before it if that is L. A
   queue of (symbol, place, common prefix) tuples keeps them by symbol and then in the order they came, which is their
   order; what does not fit the memory goes to sorted runs on disk.
3. S suffixes are induced from the L suffixes in falling order in the same way.

The common prefix of two suffixes that are queued one after the other for the same symbol is 1 more than the least
common prefix between the suffixes that queued them, so values are carried along and no text is compared again. Equal
symbols make batches, in which numpy does the work. Recursion carries the order alone; the common prefixes of
neighbouring S* suffixes are read from the text. All that grows with the text lies in files of a scratch folder, which
the caller removes; memory holds `memory` tuples.

Beyond `depth` symbols the order is not defined: suffixes with `depth` equal symbols stand together, and their value is
depth.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Callable, Iterator

import numpy as np

FAR = np.uint16(0xFFFF)


class Scratch:
    """Arrays in files of a folder; those of up to `small` values stay in memory."""

    def __init__(self, folder: str, small: int = 0):
        self.folder, self.small, self.made = folder, small, 0

    def array(self, size: int, dtype) -> np.ndarray:
        if size <= self.small or not size:
            return np.zeros(size, dtype)
        self.made += 1
        return np.memmap(os.path.join(self.folder, f"{self.made}.bin"), dtype, "w+", shape=(size,))

    def keep(self, values: np.ndarray) -> np.ndarray:
        out = self.array(len(values), values.dtype)
        out[:] = values
        return out

    def drop(self, values: np.ndarray) -> None:
        name = getattr(values, "filename", None)
        if name and os.path.exists(name):
            os.remove(name)


class Queue:
    """Tuples (symbol, place, common prefix), taken by rising symbol and then in the order they came."""

    def __init__(self, scratch: Scratch, memory: int):
        self.scratch, self.memory = scratch, memory
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.keys: list[int] = []
        self.size = 0
        #: sorted runs on disk, in the order they were written, and how far each is read
        self.runs: list[list] = []

    def put(self, symbols: np.ndarray, places: np.ndarray, common: np.ndarray) -> None:
        """symbols are sorted."""
        if not len(symbols):
            return
        edges = np.flatnonzero(np.diff(symbols)) + 1
        for s, p, c in zip(symbols[np.concatenate([[0], edges])].tolist(), np.split(places, edges), np.split(common, edges), strict=True):
            if s not in self.held:
                self.held[s] = []
                heapq.heappush(self.keys, s)
            self.held[s].append((p, c))
        self.size += len(symbols)
        if self.size > self.memory:
            self._spill()

    def _spill(self) -> None:
        symbols = sorted(self.held)
        sizes = [sum(len(p) for p, _ in self.held[s]) for s in symbols]
        keep = self.scratch.keep
        parts = [x for s in symbols for x in self.held[s]]
        run = [keep(np.repeat(np.array(symbols, np.int64), sizes)), keep(np.concatenate([p for p, _ in parts])), keep(np.concatenate([c for _, c in parts])), 0]
        self.runs.append(run)
        self.held, self.keys, self.size = {}, [], 0

    def least(self) -> int | None:
        found = [int(r[0][r[3]]) for r in self.runs if r[3] < len(r[0])]
        if self.keys:
            found.append(self.keys[0])
        return min(found, default=None)

    def take(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples of the least symbol, in parts."""
        runs, held = list(self.runs), []
        if self.keys and self.keys[0] == symbol:
            heapq.heappop(self.keys)
            held = self.held.pop(symbol)
            self.size -= sum(len(p) for p, _ in held)
        # what is put from now on comes after all of these
        parts = []
        for run in runs:
            at = run[3]
            if run[0][at] == symbol:
                run[3] = int(np.searchsorted(run[0], symbol, "right"))
                parts.append((run, at, run[3]))
        self.runs = [r for r in runs if r[3] < len(r[0])]
        for run, at, end in parts:
            for begin in range(at, end, self.memory):
                yield np.array(run[1][begin : min(end, begin + self.memory)]), np.array(run[2][begin : min(end, begin + self.memory)])
            if end == len(run[0]):
                for x in run[:3]:
                    self.scratch.drop(x)
        if held:  # no more than the memory
            yield np.concatenate([p for p, _ in held]), np.concatenate([c for _, c in held])


class _Least:
    """Least values of ranges of an array."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        span = 1
        while 2 * span <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-span], last[span:]))
            span *= 2

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """min(values[first : last + 1]) for each pair."""
        level = np.frexp((last - first + 1).astype(float))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level):
            own = level == k
            a, b = first[own], last[own]
            out[own] = np.minimum(self.levels[k][a], self.levels[k][b - (1 << int(k)) + 1])
        return out


def suffix_types(text: np.ndarray, scratch: Scratch, memory: int) -> np.ndarray:
    """Whether each suffix is of type S; the last one is."""
    n = len(text)
    types = scratch.array(n, np.bool_)
    types[n - 1] = True
    after, type_after = int(text[n - 1]), True
    for end in range(n - 1, 0, -memory):
        begin = max(0, end - memory)
        x = np.concatenate([text[begin:end], [after]]).astype(np.int64)
        rise = np.sign(np.diff(x))
        rise = np.concatenate([rise, [1 if type_after else -1]])
        # equal symbols take the type of the next change
        at = np.where(rise != 0, np.arange(len(rise)), len(rise))
        at = np.minimum.accumulate(at[::-1])[::-1]
        part = rise[at[:-1]] > 0
        types[begin:end] = part
        after, type_after = int(text[begin]), bool(part[0])
    return types


def _stars(text: np.ndarray, types: np.ndarray, scratch: Scratch, memory: int) -> np.ndarray:
    """Places of the S* suffixes, in text order."""
    found = []
    for begin in range(1, len(text), memory):
        end = min(len(text), begin + memory)
        found.append(np.flatnonzero(types[begin:end] & ~types[begin - 1 : end - 1]) + begin)
    return scratch.keep(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _words(text: np.ndarray, first: np.ndarray, left: np.ndarray, bits: int) -> np.ndarray:
    """The next 63 // bits symbols of each place as a number; symbols past `left` count as larger than all."""
    out, top = np.zeros(len(first), np.int64), (1 << bits) - 1
    last = len(text) - 1
    for k in range(63 // bits):
        inside = left > k
        out = out << bits | np.where(inside, text[np.minimum(first + k, last)].astype(np.int64), top)
    return out


def _named(text: np.ndarray, stars: np.ndarray, ends: np.ndarray, depth: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the S* substrings sorted, and where a new one begins. A substring that begins another one is the
    larger, as the other goes on with a symbol of type L where it ends."""
    n, per = len(stars), 63 // bits
    size = np.minimum(ends - stars + 1, depth)
    order, new = np.arange(n), np.zeros(n, bool)
    if n:
        new[0] = True
    todo = np.arange(n)  # ranks whose order is not known
    at = 0
    while len(todo):
        own = order[todo]
        block = np.cumsum(new)[todo]
        word = _words(text, stars[own] + at, size[own] - at, bits)
        by = np.argsort(word)
        if at:
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            by = np.argsort(block * len(by) + place)
        own, block, word = own[by], block[by], word[by]
        order[todo] = own
        new[todo[1:]] |= (word[1:] != word[:-1]) | (block[1:] != block[:-1])
        at += per
        # substrings that are alone or at their end are done
        group = np.cumsum(new)[todo]
        alone = np.bincount(group)[group] < 2
        longest = np.zeros(group.max() + 1, np.int64)
        np.maximum.at(longest, group, size[own])
        todo = todo[~alone & (longest[group] > at)]
    return order, new


def _named_external(text: np.ndarray, stars: np.ndarray, ends: np.ndarray, depth: int, bits: int, scratch: Scratch, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """_named() in parts, as (numbers of substrings, new): substrings are dealt to parts that fit the memory by sampled
    words of their content, one word after another."""
    per = 63 // bits

    def deal(numbers: np.ndarray, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(numbers) <= memory:
            own = np.array(numbers)
            order, new = _named(text, stars[own], ends[own], depth, bits)
            yield own[order], new
            return
        if at >= depth:  # equal as far as they count
            for begin in range(0, len(numbers), memory):
                part = np.array(numbers[begin : begin + memory])
                new = np.zeros(len(part), bool)
                new[0] = begin == 0
                yield part, new
            return

        def words(own: np.ndarray) -> np.ndarray:
            return _words(text, stars[own] + at, np.minimum(ends[own] - stars[own] + 1, depth) - at, bits)

        sample = np.unique(words(np.array(numbers[:: max(1, len(numbers) // 4096)])))
        cuts = sample[:: max(1, len(sample) // 32)]
        # odd parts hold one word alone, even parts the words between
        sizes = np.zeros(2 * len(cuts) + 1, np.int64)

        def part_of(own: np.ndarray) -> np.ndarray:
            w = words(own)
            k = np.searchsorted(cuts, w, "left")
            return 2 * k + (cuts[np.minimum(k, len(cuts) - 1)] == w) * (k < len(cuts))

        for begin in range(0, len(numbers), memory):
            sizes += np.bincount(part_of(np.array(numbers[begin : begin + memory])), minlength=len(sizes))
        files = [scratch.array(int(s), np.int64) for s in sizes]
        fill = np.zeros(len(sizes), np.int64)
        for begin in range(0, len(numbers), memory):
            own = np.array(numbers[begin : begin + memory])
            part = part_of(own)
            for p in np.unique(part):
                mine = own[part == p]
                files[p][fill[p] : fill[p] + len(mine)] = mine
                fill[p] += len(mine)
        for p, file in enumerate(files):
            if len(file):
                yield from deal(file, at + per if p % 2 else at)
                scratch.drop(file)

    if len(stars):
        yield from deal(np.arange(len(stars)), 0)


def _sorted_small(text: np.ndarray, steps: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order, levels) by doubling in memory, by the first `steps` symbols at least. Suffixes are equal in levels[k] if
    they are equal in their first 2 ** k symbols."""
    n = len(text)
    order = np.argsort(text)
    rank = np.empty(n, np.int32)
    rank[order] = np.concatenate([[0], np.cumsum(np.diff(text[order]) != 0)])
    levels = []
    span = 1
    todo = np.arange(n)
    # ranks become the places of the first suffix that shares them
    first = np.flatnonzero(np.concatenate([[True], np.diff(rank[order]) != 0]))
    rank = first.astype(np.int32)[rank]
    while True:
        levels.append(rank.copy())
        if span >= steps or not len(todo):
            return order, levels
        own = order[todo]
        after = np.where(own + span < n, rank[np.minimum(own + span, n - 1)] + 1, 0)
        by = np.argsort(rank[own].astype(np.int64) * (n + 1) + after)
        own, after = own[by], after[by]
        order[todo] = own
        group = rank[own]
        new = np.ones(len(own), bool)
        new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        first = np.maximum.accumulate(np.where(new, todo, 0))
        rank[own] = first
        alone = new & np.append(new[1:], True)
        todo = todo[~alone]
        span *= 2


def _star_order(text: np.ndarray, types: np.ndarray, stars: np.ndarray, depth: int, bits: int, scratch: Scratch, memory: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The S* suffixes in order, as numbers of stars, and levels() of the names if they were sorted in memory."""
    n = len(stars)
    ends = np.append(stars[1:], len(text) - 1)
    reduced = scratch.array(n, np.int64)
    order = scratch.array(n, np.int64)
    names, at = 0, 0
    for own, new in _named_external(text, stars, ends, depth, bits, scratch, memory):
        name = names + np.cumsum(new) - 1
        reduced[own] = name
        order[at : at + len(own)] = own
        names, at = int(name[-1]) + 1, at + len(own)
    if names == n:
        scratch.drop(reduced)
        return order, []
    scratch.drop(order)
    # an S* substring has 2 symbols at least beside the next one's first
    steps = depth // 2 + 1
    if n <= memory:
        out = _sorted_small(np.array(reduced), steps)
    else:
        out = suffix_order(reduced, steps, scratch, memory), []
    scratch.drop(reduced)
    return out


def suffix_order(text: np.ndarray, depth: int, scratch: Scratch, memory: int) -> np.ndarray:
    """Suffixes of a text whose last symbol need not be the smallest, in order, by the first `depth` symbols at least."""
    n = len(text)
    ended = scratch.array(n + 1, np.int64)
    for begin in range(0, n, memory):
        ended[begin : begin + memory][: n - begin] = text[begin : begin + memory] + 1
    ended[n] = 0
    out, at = scratch.array(n, np.int64), 0
    for places, _ in _induced(ended, depth, scratch, memory, False):
        places = places[places < n]
        out[at : at + len(places)] = places
        at += len(places)
    scratch.drop(ended)
    return out[::-1]


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """The common prefix of pairs of suffixes, depth at most."""
    out = np.full(len(a), depth, np.uint16)
    own = np.arange(len(a))
    last = len(text) - 1
    for k in range(depth):
        same = (a + k <= last) & (b + k <= last)
        same &= text[np.minimum(a + k, last)] == text[np.minimum(b + k, last)]
        out[own[~same]] = k
        own, a, b = own[same], a[same], b[same]
        if not len(own):
            break
    return out


def _star_common(text: np.ndarray, stars: np.ndarray, levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """_common() of S* suffixes, given as numbers of stars: whole names are stepped over by levels."""
    n, at = len(stars), np.array(a)
    a, b = np.array(a), np.array(b)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        same = (a + step < n) & (b + step < n) & (levels[k][a] == levels[k][b])
        a[same] += step
        b[same] += step
    over = stars[a] - stars[at]
    out = np.minimum(over, depth)
    left = np.flatnonzero(over < depth)
    out[left] += _common(text, stars[a[left]], stars[b[left]], depth)
    return np.minimum(out, depth).astype(np.uint16)


def _run_length(text: np.ndarray, place: int, depth: int) -> int:
    """Equal symbols from a place on."""
    part = np.asarray(text[place : place + depth])
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


class _Pass:
    """One induction. Batches come in the order of their suffixes; `common` of a suffix is with the one before it."""

    def __init__(self, text: np.ndarray, types: np.ndarray, kind: bool, symbols: int, depth: int, queue: Queue, carry: bool):
        self.text, self.types, self.kind, self.depth, self.queue, self.carry = text, types, kind, depth, queue, carry
        self.top = symbols
        if carry:
            #: the least common prefix since the last suffix queued for each symbol; -1 before the first
            self.open = np.full(symbols + 1, -1, np.int32)

    def key(self, symbols: np.ndarray) -> np.ndarray:
        return self.top - symbols if self.kind else symbols

    def induce(self, places: np.ndarray, common: np.ndarray, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """Queue the suffixes before these that are of the kind; those of the same symbol are returned, as their turn is
        next."""
        before = places - 1
        own = np.flatnonzero((before >= 0) & (self.types[np.maximum(before, 0)] == self.kind))
        symbols = self.text[before[own]]
        by = np.argsort(symbols, kind="stable")  # of 16-bit symbols, a radix sort
        own, symbols = own[by], symbols[by].astype(np.int64)
        values = np.zeros(len(own), np.uint16)
        if self.carry:
            least = _Least(common)
            first = np.ones(len(own), bool)
            first[1:] = symbols[1:] != symbols[:-1]
            begin = np.zeros(len(own), np.int64)
            begin[1:] = own[:-1] + 1
            begin[first] = 0
            values = least(begin, own).astype(np.int32) if len(own) else values.astype(np.int32)
            had = self.open[symbols[first]]
            # -1: nothing was queued for the symbol before, so the next smaller suffix begins otherwise
            values[first] = np.where(had < 0, -1, np.minimum(values[first], had))
            values = np.minimum(values + 1, self.depth).astype(np.uint16)
            lowest = int(common.min())
            np.minimum(self.open, lowest, out=self.open, where=self.open >= 0)
            last = np.ones(len(own), bool)
            last[:-1] = symbols[:-1] != symbols[1:]
            ends = own[last]
            rest = np.full(len(ends), int(FAR), np.int32)
            some = ends + 1 < len(common)
            if some.any():
                tail = np.minimum.accumulate(common[::-1])[::-1]
                rest[some] = tail[ends[some] + 1]
            self.open[symbols[last]] = rest
        before = before[own]
        same = symbols == symbol
        keys = self.key(symbols[~same])
        places_, values_ = before[~same], values[~same]
        if self.kind:  # keys fall as symbols rise; equal ones keep their order
            by = np.argsort(keys, kind="stable")
            keys, places_, values_ = keys[by], places_[by], values_[by]
        self.queue.put(keys, places_, values_)
        return before[same], values[same]


def _induced(text: np.ndarray, depth: int, scratch: Scratch, memory: int, carry: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes but the last one in falling order, in batches (places, common prefix with the next larger one)."""
    symbols = int(max(int(text[i : i + memory].max()) for i in range(0, len(text), memory)))
    bits = (symbols + 2).bit_length()
    types = suffix_types(text, scratch, memory)
    stars = _stars(text, types, scratch, memory)
    order, levels = _star_order(text, types, stars, depth, bits, scratch, memory)
    heads = scratch.array(len(order), np.int64)
    for i in range(0, len(order), memory):
        heads[i : i + memory] = text[stars[order[i : i + memory]]]

    # L suffixes, rising
    queue = Queue(scratch, memory)
    forth = _Pass(text, types, False, symbols, depth, queue, carry)
    buckets: list[tuple[int, int, int]] = []  # symbol, first and end in the L files
    total = int(len(text) - sum(int(types[i : i + memory].sum()) for i in range(0, len(text), memory)))
    l_places, l_common, l_at = scratch.array(total, np.int64), scratch.array(total, np.uint16), 0
    star_at = 0
    while True:
        head = int(heads[star_at]) if star_at < len(order) else None
        least = queue.least()
        if head is None and least is None:
            break
        symbol = min(x for x in (head, least) if x is not None)
        first = l_at
        last = None
        if least == symbol:
            while queue.least() == symbol:
                for places, common in queue.take(symbol):
                    l_places[l_at : l_at + len(places)], l_common[l_at : l_at + len(places)] = places, common
                    l_at += len(places)
                    last = int(places[-1])
                    places, common = forth.induce(places, common, symbol)
                    if len(places):
                        queue.put(np.full(len(places), symbol, np.int64), places, common)
            buckets.append((symbol, first, l_at))
        if head == symbol:
            end = int(np.searchsorted(heads, symbol, "right"))
            for begin in range(star_at, end, memory):
                places = np.array(stars[order[begin : min(end, begin + memory)]])
                common = np.zeros(len(places), np.uint16)
                if carry:
                    own = np.array(order[max(begin - 1, star_at) : min(end, begin + memory)])
                    common[len(places) - len(own) + 1 :] = _star_common(text, stars, levels, own[:-1], own[1:], depth)
                    if begin == star_at and last is not None:  # after the L suffixes of the symbol: as far as both repeat it
                        common[0] = min(_run_length(text, last, depth), _run_length(text, int(places[0]), depth))
                forth.induce(places, common, symbol)
            star_at = end
    scratch.drop(heads)
    levels.clear()

    # S suffixes, falling
    queue = Queue(scratch, memory)
    back = _Pass(text, types, True, symbols, depth, queue, carry)
    while buckets or queue.least() is not None:
        least = queue.least()
        candidates = ([symbols - least] if least is not None else []) + ([buckets[-1][0]] if buckets else [])
        symbol = max(candidates)
        last = None
        while queue.least() == symbols - symbol:
            for places, common in queue.take(symbols - symbol):
                yield places, common
                last = int(places[-1])
                places, common = back.induce(places, common, symbol)
                if len(places):
                    queue.put(np.full(len(places), symbols - symbol, np.int64), places, common)
        if buckets and buckets[-1][0] == symbol:
            _, first, end = buckets.pop()
            for stop in range(end, first, -memory):
                begin = max(first, stop - memory)
                places = np.array(l_places[begin:stop])[::-1]
                # common with the next larger one is what that one has with the smaller
                common = np.zeros(len(places), np.uint16)
                common[1:] = np.array(l_common[begin + 1 : stop])[::-1]
                if stop < end:
                    common[0] = l_common[stop]
                elif last is not None and carry:
                    common[0] = min(_run_length(text, last, depth), _run_length(text, int(places[0]), depth))
                yield places, common
                back.induce(places, common, symbol)
    for x in (types, l_places, l_common, stars):
        scratch.drop(x)


def repeated(text: np.ndarray, depth: int, scratch: Scratch, memory: int, mark: Callable[[np.ndarray], None]) -> None:
    """mark(places) for all suffixes that share their first `depth` symbols with another one."""
    last = -1
    for places, common in _induced(text, depth, scratch, memory, True):
        hit = np.flatnonzero(common >= depth)
        if len(hit):
            mark(places[hit])
            before = np.where(hit > 0, places[hit - 1], last)
            mark(before)
        if len(places):
            last = int(places[-1])
