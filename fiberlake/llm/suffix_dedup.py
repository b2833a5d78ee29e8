"""Suffix-array dedup: bytes of repeated strings, found by external induced sorting.

Every string of `window` bytes has an anchor, chosen by its content (see anchors.py), so equal strings share theirs. The
strings of consecutive starts with one anchor are a run, and the run's bytes hold all of them. Two Bloom filters drop
runs whose anchor is single; equal runs are one class with a count. Classes are dealt to shards by anchor, so equal
strings meet in one shard, and each shard's text, its classes laid end to end, is suffix sorted with common prefixes
(suffix_sort.py): strings whose suffixes share `window` bytes with a neighbour are repeated. An anchor with one class
needs no sorting, as its strings are repeated if the class is. Nor does a class that no other can share a string with:
equal strings have the anchor at one place, so they share the bytes around it that all strings with it thereabouts hold.

A shard has about SHARD_BYTES, whatever the corpus; one that does not fit MEMORY tuples is sorted on disk. Sorting scratch
is the task's own and goes when the shard is done. Anchors with more than GROUP classes (texts around a very common
passage) are no shard: their windows are met one by one by hashes, which spreads them over all tasks.
"""

from __future__ import annotations

import itertools
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import gram_hashes, runs
from .common import few, own_names, record_batches, row_key, stored, table, texts
from .seeds import classes_in_order, classes_of
from .suffix_sort import Scratch, repeated
from .twice import MAX_FILTER_BITS, hashes_of_text, suspects

WINDOW = 400
GRAM = 128
#: Parts of an anchor's possible places in a window, each with a context of its own.
PLACES = 8
SHARD_BYTES = 2 << 20
#: Tuples that sorting holds in memory.
MEMORY = 4 << 20
#: Bytes laid end to end for hashing.
CHUNK = 1 << 20
#: Digests of runs that a task remembers having sent.
SENT = 50_000
#: Classes of an anchor that one task sorts together.
GROUP = 20_000
END, GAP, FIRST = 0, 1, 2
_CODE, _OTHER = (np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed) for b in range(256)], np.uint64) for seed in (7, 8))


def _laid(values: Iterator[bytes]) -> Iterator[tuple[list[int], bytes, np.ndarray]]:
    """(row numbers, texts end to end, ends) for groups of texts of about CHUNK bytes."""
    rows, held, size = [], [], 0
    for row, text in enumerate(values):
        rows.append(row)
        held.append(text)
        size += len(text)
        if size >= CHUNK:
            yield rows, b"".join(held), np.cumsum([len(x) for x in held])
            rows, held, size = [], [], 0
    if rows:
        yield rows, b"".join(held), np.cumsum([len(x) for x in held])


def _seeds(window: int, gram: int):
    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        found = [np.zeros(0, np.uint64)]
        for _, data, ends in _laid(texts(batch.column(0))):
            found += [h for _, _, _, h in runs(_CODE[np.frombuffer(data, np.uint8)], ends, window, gram)]
        return np.concatenate(found)

    return hashes


class Shard:
    """The text of a shard, in a file, and what its classes are."""

    def __init__(self, window: int, memory: int):
        self.window, self.memory = window, memory
        self.folder = tempfile.mkdtemp(prefix="suffixes-")
        self.file = open(os.path.join(self.folder, "text.bin"), "wb")
        self.digests: list[bytes] = []
        self.counts: list[int] = []
        self.windows: list[int] = []
        self.starts: list[int] = []
        self.size = 0

    def add(self, digest: bytes, data: bytes, windows: int, count: int) -> None:
        self.digests.append(digest)
        self.counts.append(count)
        self.windows.append(windows)
        self.starts.append(self.size)
        symbols = np.full(len(data) + 1, GAP, np.uint16)
        symbols[:-1] = np.frombuffer(data, np.uint8)
        symbols[:-1] += FIRST
        symbols.tofile(self.file)
        self.size += len(symbols)

    def spans(self) -> Iterator[tuple[bytes, list[int]]]:
        """(digest, [first, end, ..]): the repeated window starts of each class that has some."""
        np.array([END], np.uint16).tofile(self.file)
        self.file.close()
        n = self.size + 1
        path = os.path.join(self.folder, "text.bin")
        text = np.fromfile(path, np.uint16) if n <= self.memory else np.memmap(path, np.uint16, "r", shape=(n,))
        scratch = Scratch(self.folder, self.memory)
        flags = scratch.array(n + 1, np.bool_)

        def mark(places: np.ndarray) -> None:
            flags[places] = True

        repeated(text, self.window, scratch, self.memory, mark)
        for digest, count, windows, start in zip(self.digests, self.counts, self.windows, self.starts, strict=True):
            own = np.ones(windows, bool) if count > 1 else np.array(flags[start : start + windows])
            if own.any():
                yield digest, np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).tolist()

    def close(self) -> None:
        self.file.close()
        shutil.rmtree(self.folder, ignore_errors=True)


def _meeting(classes: list[tuple], window: int, gram: int) -> set[int]:
    """Which of the classes (digest, run, place, windows, count) of one anchor must be sorted: those that share the context
    of some of their windows with another class, unless all that share it are repeated anyway."""
    span = window - gram + 1
    edges = [span * k // PLACES for k in range(PLACES + 1)]
    sharing: dict[tuple[int, int], list[int]] = {}
    for i, (_, run, place, windows, _) in enumerate(classes):
        for low, high in itertools.pairwise(edges):
            # windows in which the anchor is at low or later, but before high
            if low <= place and place - windows + 1 < high and low < high:
                sharing.setdefault((low, xxhash.xxh3_64_intdigest(run[place - low : place + window - high + 1])), []).append(i)
    return {i for own in sharing.values() if len(own) > 1 and any(classes[j][4] == 1 for j in own) for i in own}


def _sorted_shards(window: int, gram: int, memory: int):
    """Rows of Classes with a shard, sorted by shard, seed and digest, to (digest, spans)."""
    schema = pa.schema([("digest", pa.binary()), ("spans", pa.list_(pa.int32()))])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[int]]]:
        shard, now, seed = None, None, None
        held: list[tuple] = []  # the seed's classes so far

        def close() -> Iterator[tuple[bytes, list[int]]]:
            """The seed's classes go to the shard, if they need it; an only class is none of Classes.rows."""
            nonlocal shard
            if len(held) > 1:
                sort = _meeting(held, window, gram)
                for i, (digest, run, _, windows, count) in enumerate(held):
                    if i in sort:
                        shard = shard or Shard(window, memory)
                        shard.add(digest, run, windows, count)
                    elif count > 1:
                        yield digest, [0, windows]
            held.clear()

        try:
            for (number, s), digest, (run, place, windows, count) in classes_in_order(batches, "shard", "seed"):
                if (number, s) != (now, seed):
                    yield from close()
                if number != now and shard is not None:
                    yield from shard.spans()
                    shard.close()
                    shard = None
                now, seed = number, s
                held.append((digest, run, place, windows, count))
            yield from close()
            if shard is not None:
                yield from shard.spans()
        finally:
            if shard is not None:
                shard.close()

    return lambda batches: record_batches(found(batches), schema, 16384)


def _by_window(large: DataFrame, window: int) -> DataFrame:
    """(digest, spans) for the classes (digest, run, windows, count) of very common anchors, each window met by 128 bits of
    its own hash, so that such an anchor's classes are spread over all tasks."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                digest, run, count = (batch.column(c)[i].as_py() for c in ("digest", "run", "count"))
                data = np.frombuffer(run, np.uint8)
                a, b = (gram_hashes(code[data], window).view(np.int64) for code in (_CODE, _OTHER))
                n = len(a)
                yield pa.RecordBatch.from_arrays([pa.array([digest] * n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(a), pa.array(b), pa.array(np.full(n, count))], names=["digest", "at", "a", "b", "count"])

    each = large.mapInArrow(hashes, "digest binary, at int, a long, b long, count long")
    again = each.groupBy("a", "b").agg(F.sum("count").alias("n")).filter("n > 1").select("a", "b")
    places = each.join(again, ["a", "b"]).groupBy("digest").agg(F.sort_array(F.collect_list("at")).alias("at"))  # `window` places at most

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("digest", pa.binary()), ("spans", pa.list_(pa.int32()))])
        for batch in batches:
            out = []
            for at in batch.column(1).to_pylist():
                at = np.array(at)
                first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
                last = np.concatenate([first[1:], [len(at)]]) - 1
                out.append(np.stack([at[first], at[last] + 1], axis=1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, schema.field(1).type)], schema=schema)

    return places.mapInArrow(spans, "digest binary, spans array<int>")


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, memory: int = MEMORY, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """(__id, __text_key, __found): an array of (start, spans); of each row, the window starts start + [spans[0],
    spans[1]), start + [spans[2], spans[3]), .. are repeated. Rows without repeats are absent."""
    if not 1 <= gram <= window:
        raise ValueError("an anchor must fit the window")
    keyed = row_key(docs.select("doc_id", "text")).select("__id", "__text_key", F.col("text").cast("binary"))
    suspected = suspects(keyed, ["__id", "__text_key"], "text", _seeds(window, gram), hashes_of_text(), max_filter_bits)
    asked, may_repeat = suspected.rows, suspected.test

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each run with a suspected anchor; its bytes are sent once a task."""
        schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("seed", pa.int64()), ("digest", pa.binary()), ("run", pa.binary()), ("place", pa.int32()), ("windows", pa.int32())])
        sent: set[bytes] = set()
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for rows, whole, ends in _laid(texts(batch.column(2))):
                begins = np.concatenate([[0], ends[:-1]])
                for first, last, anchor, seed in runs(_CODE[np.frombuffer(whole, np.uint8)], ends, window, gram):
                    hit = np.flatnonzero(may_repeat(batch, seed))
                    text = np.searchsorted(ends, first[hit], side="right")
                    out = []
                    for t, a, b, at, place, s in zip(text.tolist(), first[hit].tolist(), last[hit].tolist(), (first[hit] - begins[text]).tolist(), (anchor - first)[hit].tolist(), seed[hit].view(np.int64).tolist(), strict=True):
                        data = whole[a : b + window]
                        digest = xxhash.xxh3_128_digest(data)
                        if digest in sent:
                            data = None
                        else:
                            if len(sent) >= SENT:
                                sent.clear()
                            sent.add(digest)
                        out.append((ids[rows[t]], keys[rows[t]], at, s, digest, data, place, b - a + 1))
                    yield from record_batches(out, schema, 4096)

    met = stored(asked.mapInArrow(meet, "id long, key long, start long, seed long, digest binary, run binary, place int, windows int"))
    classes = classes_of(met, max_filter_bits)
    common = classes.several.filter(F.col("classes") > GROUP).select("seed")  # one in GROUP classes at most
    rows, large = classes.rows, None
    if not common.isEmpty():
        common = few(common)
        large = rows.join(common, "seed", "left_semi").groupBy("digest").agg(F.first("run", ignorenulls=True).alias("run"), F.first("windows").alias("windows"), F.sum("count").alias("count"))
        rows = rows.join(common, "seed", "left_anti").select(rows.columns)
    # each class has one row with a count
    total = rows.filter("count is not null").agg(F.sum(F.col("windows") + window)).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("seed"), F.lit(shards)))
    spans = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "seed", "digest").mapInArrow(_sorted_shards(window, gram, memory), "digest binary, spans array<int>")
    spans = spans.unionByName(classes.alone.select("digest", F.array(F.lit(0), "windows").alias("spans")))
    if large is not None:
        spans = spans.unionByName(_by_window(large, window))
    found = met.select("id", "key", "start", "digest").join(spans, "digest").groupBy("id", "key").agg(F.collect_list(F.struct("start", "spans")).alias("found"))
    return found.select(F.col("id").alias("__id"), F.col("key").alias("__text_key"), F.col("found").alias("__found"))


def covered(found: list[dict] | None, n: int, window: int) -> np.ndarray:
    """The maximal runs of covered bytes, as rows (first, end)."""
    if not found:
        return np.zeros((0, 2), np.int64)
    spans = np.concatenate([np.array(x["spans"], np.int64).reshape(-1, 2) + x["start"] for x in found])
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, spans[:, 0], 1)
    np.add.at(change, spans[:, 1] - 1 + window, -1)
    inside = np.cumsum(change) > 0
    return np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))).reshape(-1, 2)


@own_names
def dedup_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, memory: int = MEMORY, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """docs without the bytes that lie in a string of `window` bytes that also starts anywhere else.

    Matches lie within one row's UTF-8 bytes; the other start may be in the same row or another, repeated rows included,
    and strings are judged on the input. kept (binary, as cuts may split a character), n_bytes (before), n_removed and
    removed_spans (array of [first, end)) are added, replacing columns of these names; `text` stays. Null text counts as
    empty; rows whose doc_id is null take part like others; texts under `window` bytes lose nothing. An empty table gives
    an empty table.
    """
    found = repeats(docs, window, gram, shard_bytes, memory, max_filter_bits)
    docs = docs.drop("kept", "n_bytes", "n_removed", "removed_spans")
    fields = docs.schema.fields
    added = [T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_spans", T.ArrayType(T.ArrayType(T.LongType())))]
    schema = T.StructType([*fields, *added])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                kept, counts, removed, spans = [], [], [], []
                for text, own in zip(texts(batch.column("text")), batch.column("__found").to_pylist(), strict=True):
                    gone = covered(own, len(text), window)
                    cuts = [0, *gone.ravel().tolist(), len(text)]
                    kept.append(b"".join([text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)]))
                    counts.append(len(text))
                    removed.append(len(text) - len(kept[-1]))
                    spans.append(gone.tolist())
                columns = [batch.column(f.name) for f in fields]
                columns += [pa.array(kept, pa.binary()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return row_key(docs).join(found, ["__id", "__text_key"], "left").mapInArrow(clean, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
