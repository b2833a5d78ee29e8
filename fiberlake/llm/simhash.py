"""SimHash near-dedup with pigeonring filtering.

Fingerprints are compared in classes: equal fingerprints are one class, represented by the smallest document id. The
64 bits form a ring of four segments. If two fingerprints differ in at most t = 3 bits, the pigeonring principle gives
a segment from which every chain of l consecutive segments differs in at most l * t / 4 bits, rounded down: 0 bits in
the first segment, 1 in two, 2 in three and 3 in all. Classes meet by the exact first segment and one half of the
second, which holds for a difference of one bit at most; the longer chains are then tested before the Hamming check.

Three bits are far from all near copies: at a Jaccard similarity of 0.8 about a seventh of all bits differ, and no number
of bits is a sharp limit. `dedup` therefore confirms what these links join by the shingles themselves, and an exact check
finds the near copies further apart (near_copies). `wide_links` joins wide
fingerprints that share a segment; it misses some pairs near its limit, and `dedup` does not use it.

Within a group, classes are linked by a spanning forest, never by all pairs; groups over BLOCK classes are dealt out as
pairs of blocks, so that no task holds more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, id_or_last, lean, null_if_last, own_names, partitions, record_batches, row_key, small_batches, table, texts
from .components import connected_components

#: Classes that a task compares at once.
BLOCK = 4096
SEGMENTS = 4
MAX_BITS = 3
#: Words of a wide fingerprint.
WORDS = 8


def _spread(h: np.ndarray, word: int) -> np.ndarray:
    """Further hash words from a 64-bit hash; word 0 is the hash itself."""
    if not word:
        return h
    with np.errstate(over="ignore"):
        h = (h ^ h >> np.uint64(30)) + np.uint64(word) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return h ^ h >> np.uint64(31)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42, words: int = 1) -> np.ndarray:
    """A bit is 1 if over half of the shingles' hashes have it; all 0 for a text without words."""
    found = text.lower().split()
    if not found:
        return np.zeros(words, np.uint64)
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    count = max(1, len(found) - shingle + 1)
    last = ends[min(shingle, len(found)) - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros((words, 64), np.int64)
    for at in range(0, count, 16384):
        a, b = starts[at : min(at + 16384, count)].tolist(), last[at : min(at + 16384, count)].tolist()
        h = np.array([digest(joined[i:j], seed) for i, j in zip(a, b, strict=True)], "<u8")
        for w in range(words):
            bits = np.unpackbits(_spread(h, w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[w] += bits.sum(axis=0, dtype=np.uint16 if len(h) < 65536 else np.int64)
    return np.packbits(counts * 2 > count, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): id is doc_id, or NO_ID for null; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle, seed)[0] for t in texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(id_or_last().alias("id"), F.col("text").cast("binary")).mapInArrow(run, "id long, fp long")


def _segment(fp: F.Column, i: int) -> F.Column:
    return F.shiftrightunsigned(fp, 16 * (i % SEGMENTS)).bitwiseAND(F.lit(0xFFFF).cast("long"))


def _meeting_keys(fp: F.Column) -> F.Column:
    """For each start on the ring: its segment and either half of the next one."""
    keys = []
    for i in range(SEGMENTS):
        first, after = _segment(fp, i), _segment(fp, i + 1)
        for half in (0, 1):
            part = F.shiftrightunsigned(after, 8 * half).bitwiseAND(F.lit(0xFF).cast("long"))
            keys.append(F.lit((2 * i + half) << 24).cast("long") + F.shiftleft(first, 8) + part)
    return F.array(*keys)


def chain_passes(x: np.ndarray, y: np.ndarray, start: int) -> np.ndarray:
    """Whether the chains of 1 to 4 segments from `start` stay within their budgets, for XOR-able arrays."""
    diff = x ^ y
    total = np.zeros(diff.shape, np.uint8)
    ok = np.ones(diff.shape, bool)
    for n in range(1, SEGMENTS + 1):
        total = total + np.bitwise_count(diff >> np.uint64(16 * ((start + n - 1) % SEGMENTS)) & np.uint64(0xFFFF))
        ok &= total <= n * MAX_BITS // SEGMENTS
    return ok


def forest(ids: np.ndarray, near) -> list[tuple[int, int]]:
    """Edges that join the classes of one group as its links do, one fewer than the classes they join; near(i, others)
    tells which of the others i links to."""
    left = np.ones(len(ids), bool)
    edges: list[tuple[int, int]] = []
    for root in range(len(ids)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            found = rest[near(at, rest)]
            left[found] = False
            queue += found.tolist()
            edges += [(int(ids[at]), int(ids[j])) for j in found]
    return edges


def _dealt(keyed: DataFrame) -> DataFrame:
    """keyed (key, fp, id), as rows (key, a, b, fp, id) sorted by group (key, a, b); keys of one class are left out, and
    those of over BLOCK classes are dealt out as pairs of blocks."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = sizes.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    held = keyed.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp", "id")
    return dealt.repartition(partitions(keyed.sparkSession), "key", "a", "b").sortWithinPartitions("key", "a", "b")


def _forests(dealt: DataFrame, edges_of) -> DataFrame:
    """(u, v): edges_of(key, ids, fps) for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        group, ids, fps = None, [], []

        def close() -> list[tuple[int, int]]:
            return edges_of(group[0], np.array(ids, np.int64), fps) if len(ids) > 1 else []

        for batch in batches:
            found: list[tuple[int, int]] = []
            for key, a, b, fp, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, a, b) != group:
                    found += close()
                    group, ids, fps = (key, a, b), [], []
                ids.append(i)
                fps.append(fp)
            yield from record_batches(found, schema, 65536)
        yield from record_batches(close(), schema, 65536)

    return dealt.mapInArrow(lean(run), "u long, v long").distinct()


def links(classes: DataFrame) -> DataFrame:
    """(u, v): edges between class representatives; their connected components are those of all links within MAX_BITS."""

    def edges_of(key: int, ids: np.ndarray, held: list[int]) -> list[tuple[int, int]]:
        fps = np.array(held, np.int64).view(np.uint64)
        return forest(ids, lambda i, others: chain_passes(fps[others], fps[i], key >> 25))

    return _forests(_dealt(classes.select("id", "fp", F.explode(_meeting_keys(F.col("fp"))).alias("key"))), edges_of)


def wide_links(classes: DataFrame, most: int, words: int = WORDS) -> DataFrame:
    """The same for wide fingerprints (binary) that differ in at most `most` bits and share a segment."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            segments = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(n, 4 * words)
            key = segments.astype(np.int64) + (np.arange(4 * words, dtype=np.int64) << 16)
            for column in range(4 * words):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key[:, column])], names=["id", "fp", "key"])

    budget = [most * n / words + 3 * math.sqrt(most * n / words) for n in range(1, words)] + [most]

    def edges_of(key: int, ids: np.ndarray, held: list[bytes]) -> list[tuple[int, int]]:
        fps = np.frombuffer(b"".join(held), "<u8").reshape(len(held), words)
        start = key >> 18

        def near(i: int, others: np.ndarray) -> np.ndarray:
            ok, total = np.arange(len(others)), np.zeros(len(others), np.int64)
            for n in range(words):
                w = (start + n) % words
                total = total[: len(ok)] + np.bitwise_count(fps[others[ok], w] ^ fps[i, w])
                within = total <= budget[n]
                ok, total = ok[within], total[within]
            hit = np.zeros(len(others), bool)
            hit[ok] = True
            return hit

        return forest(ids, near)

    return _forests(_dealt(classes.select("id", "fp").mapInArrow(keys, "id long, fp binary, key long")), edges_of)


def _lowest(classes: DataFrame, reach: DataFrame, node: str) -> DataFrame:
    """(node, component): the smallest id that links reach from each class, of classes (node, id) and reach (node,
    component). Nodes are the classes' own keys, as ids may be null or shared."""
    reach = reach.select(F.col("node").alias("__node"), F.col("component").alias("__own"))
    owned = classes.join(reach, classes[node] == reach["__node"], "left").select(node, "id", F.coalesce("__own", node).alias("__own"))
    lowest = owned.groupBy("__own").agg(F.min("id").alias("component"))
    return owned.select(node, "__own").join(lowest, "__own").select(node, "component")


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document row.

    fingerprint is 16 hexadecimal digits, component_id the smallest doc_id that links reach. Null and empty texts have
    fingerprint zero and link like any other. Rows whose doc_id is null rank last: they reach the smallest doc_id of
    their component, or null if all of it is null. An empty table gives an empty table.
    """
    rows = checkpointed(fingerprints(docs, shingle, seed))
    classes = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("id")))
    reach = connected_components(links(classes.select(F.col("fp").alias("id"), "fp")))
    labelled = _lowest(classes, reach, "fp")
    return rows.join(labelled, "fp").select(
        null_if_last("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), null_if_last("component").alias("component_id")
    )


@own_names
def dedup(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, seed: int = 42) -> DataFrame:
    """docs with one document of each near-duplicate group: the one with the smallest doc_id.

    Two documents are linked if the Jaccard similarity of their sets of word shingles is `similarity` at least (see
    near_copies); a group is what links reach. Rows that share the smallest doc_id of their group stay together; without
    ids, all rows of a group that has none stay. Texts without words are equal. All columns stay; an empty table gives
    an empty table.
    """
    from . import near_copies

    least = Fraction(str(similarity))
    with small_batches(docs.sparkSession):
        rows = checkpointed(near_copies.shingled(docs, least, shingle, seed))
        classes = near_copies.classed(rows)
        firsts = rows.groupBy("node").agg(F.min("id").alias("id"))
        labelled = _lowest(firsts, connected_components(near_copies.links(docs, classes, least, shingle, seed)), "node")
    gone = rows.select("id", "text_key", "node").join(labelled, "node").filter("component < id")
    gone = gone.select(F.col("id").alias("__id"), F.col("text_key").alias("__text_key")).distinct()
    return row_key(docs).join(gone, ["__id", "__text_key"], "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
