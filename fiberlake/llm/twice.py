"""Which hashes of a corpus are seen at least twice.

Where a filter of MAX_FILTER_BITS suffices, a pair of Bloom filters tells: hashes seen once and hashes seen twice; the
second is broadcast. A larger corpus would fill it, so there the hashes themselves are counted, by a shuffle of 8 bytes
each, and every row is given those of its own hashes that are repeated. Both let through every repeat; the results of
the operators are the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import power_of_two, record_batches, stored

#: The filter is broadcast, so it never grows beyond this many bits (64 MB).
MAX_FILTER_BITS = 1 << 29
MIN_FILTER_BITS = 1 << 20
BITS_PER_HASH = 8
#: A full-sized filter serves down to so many bits a hash; it then lets through about a seventh of the hashes seen once.
LEAST_BITS_PER_HASH = 4
#: Bytes of text with about one hash.
BYTES_PER_HASH = 100
CHUNKS = 64
SUSPECTS = "__suspects"


def filter_bits(rows: DataFrame, hashes: Column) -> int:
    """Bits for the hashes that the rows are expected to have."""
    return max(MIN_FILTER_BITS, power_of_two(BITS_PER_HASH * (rows.agg(F.sum(hashes)).first()[0] or 0)))


def hashes_of_text(column: str = "text") -> Column:
    return F.octet_length(column) / BYTES_PER_HASH


@dataclass
class Suspects:
    #: the rows, with their repeated hashes in SUSPECTS if these were counted
    rows: DataFrame
    #: for a batch of rows and hashes of them, which hashes may be repeated
    test: Callable[[pa.RecordBatch, np.ndarray], np.ndarray]


def suspects(rows: DataFrame, key: list[str], column: str, hashes: Callable[[pa.RecordBatch], np.ndarray], expected: Column, most: int = MAX_FILTER_BITS) -> Suspects:
    """Suspects among the hashes of a column of rows, which `key` tells apart but for equal ones. `hashes` gives the
    uint64 hashes of a batch of that column alone."""
    bits = filter_bits(rows, expected)
    if bits <= most * BITS_PER_HASH // LEAST_BITS_PER_HASH:
        bits = min(bits, most)
        twice = rows.sparkSession.sparkContext.broadcast(seen_twice(rows.select(column), bits, hashes))
        return Suspects(rows, lambda batch, found: suspected(found, twice.value, bits))
    place = rows.columns.index(column)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, count = np.unique(hashes(batch), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.minimum(count, 2))], names=["hash", "n"])

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(hashes(batch.select([place]).slice(i, 1))) for i in range(batch.num_rows)]
            row = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            keys = [batch.column(k).take(row) for k in key]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64))], names=[*key, "hash"])

    again = stored(rows.select(column).mapInArrow(counted, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 1").select("hash"))
    lists = rows.mapInArrow(owned, ", ".join([f"{k} long" for k in key] + ["hash long"])).join(again, "hash").groupBy(*key).agg(F.collect_set("hash").alias(SUSPECTS))

    def test(batch: pa.RecordBatch, found: np.ndarray) -> np.ndarray:
        return np.isin(found, batch.column(SUSPECTS).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))

    return Suspects(rows.join(lists, key, "left"), test)


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two filter positions a hash."""
    mask = np.uint64(bits - 1)
    with np.errstate(over="ignore"):
        return np.concatenate([hashes & mask, (hashes >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20) & mask])


def suspected(hashes: np.ndarray, twice: np.ndarray, bits: int) -> np.ndarray:
    """Whether each hash is in the filter of those seen twice."""
    at = positions(hashes, bits).astype(np.int64)
    return (twice[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).reshape(2, -1).all(axis=0)


def seen_twice(rows: DataFrame, bits: int, hashes: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    return seen(rows, bits, hashes, 2)


def seen(rows: DataFrame, bits: int, hashes: Callable[[pa.RecordBatch], np.ndarray], times: int) -> np.ndarray:
    """The filter of hashes seen `times` (1 or 2) times at least, as packed bits. `hashes` gives the uint64 hashes of a
    batch of rows.

    Each task sends the positions its own two filters hold. A position in the first filters of two tasks, or in the
    second filter of one, belongs to the second filter of the whole corpus.
    """
    span = bits // CHUNKS

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64), *(hashes(batch) for batch in batches)]
        once, count = np.unique(np.concatenate(held), return_counts=True)
        ones, twos = (np.unique(positions(x, bits)) for x in (once, once[count >= times]))
        edges = np.arange(CHUNKS + 1, dtype=np.uint64) * np.uint64(span)
        a, b = np.searchsorted(ones, edges), np.searchsorted(twos, edges)
        found = (
            (c, *(zlib.compress((x[i[c] : i[c + 1]] - edges[c]).astype("<u4").tobytes(), 1) for x, i in ((ones, a), (twos, b))))
            for c in range(CHUNKS)
            if a[c] < a[c + 1]
        )
        yield from record_batches(found, pa.schema([("chunk", pa.int32()), ("ones", pa.binary()), ("twos", pa.binary())]), 16)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("chunk", pa.int32()), ("bits", pa.binary())])
        chunk, one, two = None, np.zeros(0, bool), np.zeros(0, bool)
        for batch in batches:
            for c, ones, twos in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != chunk:
                    if chunk is not None:
                        yield from record_batches([(chunk, np.packbits(two).tobytes())], out)
                    chunk, one, two = c, np.zeros(span, bool), np.zeros(span, bool)
                here = np.frombuffer(zlib.decompress(ones), "<u4")
                two[here[one[here]]] = True
                two[np.frombuffer(zlib.decompress(twos), "<u4")] = True
                one[here] = True
        if chunk is not None:
            yield from record_batches([(chunk, np.packbits(two).tobytes())], out)

    parts = rows.mapInArrow(fill, "chunk int, ones binary, twos binary")
    merged = parts.repartition(CHUNKS, "chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk int, bits binary")
    whole = np.zeros(bits // 8, np.uint8)
    for row in merged.collect():  # CHUNKS rows, bits / 8 bytes
        whole[row.chunk * span // 8 : (row.chunk + 1) * span // 8] = np.frombuffer(row.bits, np.uint8)
    return whole
