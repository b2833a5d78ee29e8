"""Classes of equal runs, met by the seeds that their windows share.

`met` has a row for each run: (seed, digest, windows, place, run), where equal runs have equal digests and the run's bytes
are there once a task at least. Only seeds with several classes need the bytes compared. A Bloom filter of those seeds
keeps all other bytes from being shuffled; what it lets through by mistake is dropped when the seed's rows are together. A
semi-join takes its place where the seeds are too many for one broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, power_of_two, stored
from .twice import MAX_FILTER_BITS, MIN_FILTER_BITS, seen, suspected

BITS_PER_SEED = 16


@dataclass
class Classes:
    #: (digest, windows): runs that are the only class of their seed and are there more than once
    alone: DataFrame
    #: (seed, classes) of the other seeds
    several: DataFrame
    #: (seed, digest, windows, count, place, run) of those seeds: a row with count for each class, and rows with run
    rows: DataFrame


def classes_of(met: DataFrame, max_filter_bits: int = MAX_FILTER_BITS) -> Classes:
    counts = stored(met.groupBy("seed", "digest").agg(F.count(F.lit(1)).alias("count"), F.first("windows").alias("windows")))
    seeds = counts.groupBy("seed").agg(F.count(F.lit(1)).alias("classes"), F.max("count").alias("count"), F.first("digest").alias("digest"), F.first("windows").alias("windows"))
    alone = seeds.filter("classes = 1 and count > 1").select("digest", "windows")
    several = checkpointed(seeds.filter("classes > 1").select("seed", "classes"))
    rows = counts.select("seed", "digest", "windows", "count", F.lit(None).cast("int").alias("place"), F.lit(None).cast("binary").alias("run"))
    runs = met.filter("run is not null").select("seed", "digest", "windows", F.lit(None).cast("long").alias("count"), "place", "run")
    both = rows.unionByName(runs)
    bits = max(MIN_FILTER_BITS, power_of_two(BITS_PER_SEED * several.count()))
    if bits > max_filter_bits:  # more seeds than one broadcast filter can tell apart
        return Classes(alone, several, both.join(several.select("seed"), "seed", "left_semi").select(both.columns))
    shared = met.sparkSession.sparkContext.broadcast(seen(several.select("seed"), bits, lambda b: b.column(0).to_numpy().view(np.uint64), 1))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(suspected(batch.column(0).to_numpy().view(np.uint64), shared.value, bits)))

    return Classes(alone, several, both.mapInArrow(likely, both.schema))


def classes_in_order(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[tuple[tuple, bytes, list]]:
    """(key, digest, [run, place, windows, count]) of each class, of rows that are sorted by key and digest."""
    now, entry = None, None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in (*key, "digest", "windows", "count", "place", "run")]
        for row in zip(*columns, strict=True):
            group, (windows, count, place, run) = row[: len(key) + 1], row[len(key) + 1 :]
            if group != now:
                if entry is not None:
                    yield now[:-1], now[-1], entry
                now, entry = group, [None, 0, windows, 0]
            if run is None:
                entry[3] += count
            elif entry[0] is None:
                entry[0], entry[1] = run, place
    if entry is not None:
        yield now[:-1], now[-1], entry


def gathered(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[tuple[tuple, dict[bytes, list]]]:
    """(key, classes) of each group: digest to [run, place, windows, count]."""
    now, held = None, {}
    for group, digest, entry in classes_in_order(batches, *key):
        if group != now:
            if held:
                yield now, held
            now, held = group, {}
        held[digest] = entry
    if held:
        yield now, held
