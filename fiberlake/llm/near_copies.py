"""Exact near-copy links: pairs of texts whose sets of word shingles have a Jaccard similarity of `similarity` or more.

Texts with equal shingle sets are one class, its node a 64-bit hash of the set. Shingles are compared by 64-bit hashes.

Candidates come first from SimHash: fingerprints of the shingle sets that the pigeonring chains of op 7 link (simhash.links)
are confirmed by the sets. Sets at `similarity` may differ in more bits, so an exact check follows for the classes that this
leaves in several components, by a prefix filter. All shingles have one order: a class of n shingles that reaches similarity s with
another shares s * n of them at least, so the smallest shared one is among its first n - ceil(s * n) + 1, and so it is in
the other class. Classes meet by any of these. The order puts shingles of crowded counters last, so that a common passage
is met only by classes that hold little else; any order gives the same pairs.

Within a group, pairs are ruled out by their sizes and by parity bitmaps, which differ in no more bits than the sets do
in shingles; neither rules out a link. What is left is confirmed by the shingle sets. That is done in two steps, so
that a large group of copies does not make all its pairs: first a spanning forest of each group's candidates over the
components so far, then all candidates whose ends the confirmed links have not joined.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import checkpointed, lean, partitions, power_of_two, record_batches, row_key, stored, texts
from .components import connected_components
from .twice import MAX_FILTER_BITS, suspects

#: Counters of shingles, for their order alone.
COUNTERS = 1 << 20
CHUNKS = 16
#: Counters over so many times the mean are crowded.
CROWDED = 4
BITMAP = 512
WIDEST = 1 << 20
#: Pairs of one class that a task confirms at once.
PAIRS = 256


def shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; a text of fewer words is one shingle, one of none has none."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    count = max(1, len(found) - shingle + 1)
    starts, last = (ends - lengths)[:count].tolist(), ends[min(shingle, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[i:j], seed) for i, j in zip(starts, last, strict=True)], np.uint64))


def _levels(docs: DataFrame, shingle: int, seed: int) -> np.ndarray:
    """A level for each counter: 0, or more the more crowded it is."""
    span = COUNTERS // CHUNKS

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            held = [shingle_hashes(t, shingle, seed) for t in texts(batch.column(0))]
            if held:
                counts += np.bincount((np.concatenate(held) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        if counts.any():
            found = ((c, zlib.compress(counts[c * span : (c + 1) * span].astype("<u4").tobytes(), 1)) for c in range(CHUNKS))
            yield from record_batches(found, pa.schema([("chunk", pa.int32()), ("counts", pa.binary())]), 4)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, counts in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                sums[c] = sums.get(c, 0) + np.frombuffer(zlib.decompress(counts), "<u4").astype(np.int64)
        yield from record_batches(((c, s.astype("<i8").tobytes()) for c, s in sums.items()), pa.schema([("chunk", pa.int32()), ("counts", pa.binary())]), 4)

    parts = docs.select(F.col("text").cast("binary")).mapInArrow(lean(fill), "chunk int, counts binary")
    merged = parts.repartition(CHUNKS, "chunk").mapInArrow(lean(merge), "chunk int, counts binary")
    whole = np.zeros(COUNTERS, np.int64)
    for row in merged.collect():  # CHUNKS rows, 8 bytes a counter
        whole[row.chunk * span : (row.chunk + 1) * span] = np.frombuffer(row.counts, "<i8")
    return np.ceil(np.log2(np.maximum(1, whole / (CROWDED * (whole.mean() + 1))))).astype(np.uint8)


def fingerprint_of(found: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes: a bit is 1 if over half of them have it."""
    bits = np.unpackbits(found.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(found), bitorder="little").view("<i8")[0])


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A parity bitmap as one of fewer bytes."""
    return np.bitwise_xor.reduce(bits.reshape(-1, width), axis=0)


def shingled(docs: DataFrame, similarity: Fraction, shingle: int, seed: int) -> DataFrame:
    """(id, text_key, node, shape, wide, keys, fp) of every row: its class, the class's size with a parity bitmap, the same
    with about a bit a shingle, its prefix and its fingerprint."""
    levels = docs.sparkSession.sparkContext.broadcast(_levels(docs, shingle, seed))
    p, q = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            nodes, shapes, wide, keys, fps = [], [], [], [], []
            for text in texts(batch.column(2)):
                found = shingle_hashes(text, shingle, seed)
                n = len(found)
                fps.append(fingerprint_of(found))
                nodes.append(xxhash.xxh64_intdigest(found.tobytes()))
                width = min(WIDEST, max(BITMAP, power_of_two(n)))
                odd = np.bincount((found >> np.uint64(40)).astype(np.int64) % width, minlength=width) & 1
                bits = np.packbits(odd.astype(bool))
                shapes.append(n.to_bytes(4, "little") + _folded(bits, BITMAP // 8).tobytes())
                wide.append(n.to_bytes(4, "little") + bits.tobytes())
                order = np.argsort(level[(found & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")
                keys.append(found[order[: n + (-p * n // q) + 1]].view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            columns = [batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(shapes, pa.binary()), pa.array(wide, pa.binary()), lists, pa.array(fps, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_key", "node", "shape", "wide", "keys", "fp"])

    rows = row_key(docs).select("__id", "__text_key", F.col("text").cast("binary"))
    return rows.mapInArrow(lean(run), "id long, text_key long, node long, shape binary, wide binary, keys array<long>, fp long")


def classed(rows: DataFrame, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One of the rows of shingled() for each class, with the keys that may be seen more than once."""

    def flat(column: pa.ListArray) -> np.ndarray:
        return np.asarray(column.flatten(), np.int64).view(np.uint64)

    suspected = suspects(rows, ["id", "text_key"], "keys", lambda batch: flat(batch.column(0)), F.size("keys"), max_filter_bits)
    asked, may_repeat = suspected.rows, suspected.test
    names = rows.columns

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = flat(batch.column(5))
            hit = may_repeat(batch, keys)
            ends = np.cumsum([0, *batch.column(5).value_lengths().to_pylist()])
            offsets = np.concatenate([[0], np.cumsum(hit)])[ends]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[hit].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], lists, batch.column(6)], names=names)

    return checkpointed(asked.select(*names, *[c for c in asked.columns if c not in names]).mapInArrow(lean(prune), rows.schema).dropDuplicates(["node"]))


def _near(ids: np.ndarray, held: list[bytes], similarity: Fraction):
    """near(i, others): which of the others i may be linked to, by sizes and bitmaps; held are size and bitmap."""
    both = np.frombuffer(b"".join(held), np.uint8).reshape(len(ids), 4 + BITMAP // 8)
    sizes = np.ascontiguousarray(both[:, :4]).view("<i4").ravel().astype(np.int64)
    bits = np.ascontiguousarray(both[:, 4:]).view("<u8")
    p, q = similarity.numerator, similarity.denominator

    def near(i: int, others: np.ndarray) -> np.ndarray:
        n = sizes[others]
        hit = q * np.minimum(n, sizes[i]) >= p * np.maximum(n, sizes[i])
        at = others[hit]
        apart = np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64)
        hit[hit] = (p + q) * apart <= (q - p) * (n[hit] + sizes[i])
        return hit

    return near


def _beside(pairs: DataFrame, column: str, sets: DataFrame, name: str) -> DataFrame:
    """pairs with the words of the class in a column; classes of many pairs are dealt out."""
    hot = F.broadcast(pairs.groupBy(column).agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("parts")).filter("parts > 1"))
    salted = pairs.join(hot, column, "left").withColumn("salt", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("u", "v"), F.col("parts"))).cast("int"))
    copies = sets.select(F.col("node").alias(column), F.col("words").alias(name)).join(hot, column, "left")
    copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")
    return salted.drop("parts").join(copies, [column, "salt"]).drop("salt")


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, similarity: Fraction, shingle: int, seed: int) -> DataFrame:
    """The pairs (u, v) of classes that reach the similarity, by their shingle sets."""
    p, q = similarity.numerator, similarity.denominator

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [zlib.compress(b" ".join(t.lower().split())) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], names=["node", "words"])

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                width = min(len(x), len(y)) - 4
                a, b = (_folded(np.frombuffer(z, np.uint8, offset=4), width) for z in (x, y))
                n = int.from_bytes(x[:4], "little") + int.from_bytes(y[:4], "little")
                ok.append((p + q) * int(np.bitwise_count(a ^ b).sum(dtype=np.int64)) <= (q - p) * n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = functools.lru_cache(64)(lambda words: shingle_hashes(zlib.decompress(words), shingle, seed))
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = hashes(x.as_py()), hashes(y.as_py())
                ok.append((p + q) * len(np.intersect1d(a, b, assume_unique=True)) >= p * (len(a) + len(b)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    wide = classes.select("node", F.col("wide").alias("words"))
    pairs = checkpointed(_beside(_beside(pairs, "u", wide, "x"), "v", wide, "y").select("u", "v", "x", "y").mapInArrow(lean(possible), "u long, v long"))
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    need = classes.select("node", F.col("id").alias("__id"), F.col("text_key").alias("__text_key")).join(nodes, "node")
    # written first, so that its size is known and the texts are not shuffled for a small one
    need = stored(need)
    rows = row_key(docs.select("doc_id", "text")).join(need, ["__id", "__text_key"]).select("node", F.col("text").cast("binary"))
    sets = checkpointed(rows.mapInArrow(lean(packed), "node long, words binary").dropDuplicates(["node"]))
    return _beside(_beside(pairs, "u", sets, "x"), "v", sets, "y").select("u", "v", "x", "y").mapInArrow(lean(test), "u long, v long")


def links(docs: DataFrame, classes: DataFrame, similarity: Fraction, shingle: int, seed: int) -> DataFrame:
    """(u, v): confirmed links whose connected components are those of all pairs of classes that reach the similarity."""
    keyed = classes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / simhash.BLOCK).cast("int").alias("blocks"))
    met = checkpointed(keyed.join(shared, "key"))
    shapes = classes.select("node", "shape")

    def unpacked(held: list[bytes]) -> np.ndarray:
        return np.array([int.from_bytes(h[:8], "big", signed=True) for h in held], np.int64)

    def spanning(key: int, ids: np.ndarray, held: list[bytes]) -> list[tuple[int, int]]:
        """A forest of candidates over the components so far."""
        order = np.argsort(ids)
        ids, held = ids[order], [held[i] for i in order]
        own, near = unpacked(held), _near(ids, [h[8:] for h in held], similarity)
        component = dict(zip(ids.tolist(), own.tolist(), strict=True))
        edges = simhash.forest(ids, lambda i, others: (own[others] == own[i]) | near(i, others))
        return [(u, v) for u, v in edges if component[u] != component[v]]

    def apart(key: int, ids: np.ndarray, held: list[bytes]) -> list[tuple[int, int]]:
        """Candidates between components; the largest component's members need no turn of their own."""
        own = unpacked(held)
        near = _near(ids, [h[8:] for h in held], similarity)
        found, counts = np.unique(own, return_counts=True)
        left, edges = np.ones(len(ids), bool), []
        for i in np.flatnonzero(own != found[counts.argmax()]):
            left[i] = False
            others = np.flatnonzero(left & (own != own[i]))
            edges += [(int(ids[i]), int(ids[j])) for j in others[near(i, others)]]
        return edges

    def sure(found: DataFrame) -> DataFrame:
        return checkpointed(confirmed(checkpointed(found), docs, classes, similarity, shingle, seed))

    def beyond(linked: DataFrame, edges_of) -> DataFrame:
        """Links of groups in which the links so far leave several components; as simhash._dealt, with the shapes joined last."""
        reach = connected_components(linked).withColumnRenamed("node", "reached")
        own = met.join(reach, met.node == reach.reached, "left").select("key", "node", "blocks", F.coalesce("component", "node").alias("own"))
        mixed = own.groupBy("key").agg(F.min("own").alias("least"), F.max("own").alias("most")).filter("least < most").select("key")
        mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        dealt = own.join(mixed, "key").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(shapes, "node")
        packed = F.concat(F.unhex(F.lpad(F.hex("own"), 16, "0")), F.col("shape"))
        dealt = dealt.select("key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), packed.alias("fp"), F.col("node").alias("id"))
        dealt = dealt.repartition(partitions(docs.sparkSession), "key", "a", "b").sortWithinPartitions("key", "a", "b")
        return linked.unionByName(sure(simhash._forests(dealt, edges_of)))

    linked = sure(simhash.links(classes.select(F.col("node").alias("id"), "fp")))
    return beyond(beyond(linked, spanning), apart)
