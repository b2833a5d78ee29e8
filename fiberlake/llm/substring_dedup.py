"""Substring dedup by seed and extend.

Seeds are winnowed anchors: every window of `window` words has one, chosen by its content (see anchors.py), so repeated
windows share their seed. A run is the consecutive windows of one document with the same seed; its text is all they
need. Seeds that two Bloom filters show to be single are dropped; the others' runs meet by the seed's hash. Equal runs
meet as one class with a count. Classes of one seed are then extended both ways from it, word by word: all classes at
once by refining their partition, or a pair at a time where there are few. A window is repeated if its extension to the
left and to the right is shared, and the maximal repeats are the unions of repeated windows.

Seeds with more than GROUP classes (texts around a very common passage) are met again by the digest of each whole
window, which spreads them over all tasks: extension has then reached the window's ends.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import runs
from .common import few, own_names, partitions, record_batches, row_key, stored, table, texts
from .seeds import classes_of, gathered
from .twice import MAX_FILTER_BITS, hashes_of_text, suspects
from .words import laid

WINDOW = 35
GRAM = 10
#: Classes of a seed that one task extends together.
GROUP = 20_000
#: Seeds of up to so many classes are extended a pair at a time.
FEW = 8
#: Digests of runs that a task remembers having sent.
SENT = 100_000


def _seeds(window: int, gram: int):
    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        found = [np.zeros(0, np.uint64)]
        for lay in laid(texts(batch.column(0))):
            found += [h for _, _, _, h in runs(lay.codes, lay.ends, window, gram)]
        return np.concatenate(found)

    return hashes


def extend_pairs(classes: list[tuple[list[bytes], int, int, int]], window: int, gram: int) -> list[int]:
    """Masks of the repeated windows of classes (words, place of the seed, windows, count), a pair at a time."""
    masks = [(1 << n) - 1 if count > 1 else 0 for _, _, n, count in classes]
    for i, (x, p, n, _) in enumerate(classes):
        for j in range(i):
            y, q, m, _ = classes[j]
            left, most = 0, min(p, q)
            while left < most and x[p - 1 - left] == y[q - 1 - left]:
                left += 1
            right, most = 0, min(len(x) - p, len(y) - q)
            while right < most and x[p + right] == y[q + right]:
                right += 1
            # windows that start a words before the seed, for reach <= a <= left
            for a in range(max(0, window - right), left + 1):
                if p - a < n and q - a < m:
                    masks[i] |= 1 << (p - a)
                    masks[j] |= 1 << (q - a)
    return masks


def extend_all(classes: list[tuple[list[bytes], int, int, int]], window: int, gram: int) -> list[int]:
    """The same by refining the partition of all classes, a word further in each step."""
    g, reach = len(classes), window - gram
    names: dict[bytes, int] = {}
    right = np.full((g, window), -1, np.int64)
    left = np.full((g, reach), -1, np.int64)
    place = np.array([p for _, p, _, _ in classes])
    size = np.array([n for _, _, n, _ in classes])
    count = np.array([c for _, _, _, c in classes])
    for i, (words, p, _, _) in enumerate(classes):
        ids = [names.setdefault(w, len(names)) for w in words]
        after, before = ids[p : p + window], ids[max(0, p - reach) : p][::-1]
        right[i, : len(after)] = after
        left[i, : len(before)] = before
    span = len(names) + 1

    def refined(columns: np.ndarray) -> list[np.ndarray]:
        out = [np.zeros(g, np.int64)]
        for c in range(columns.shape[1]):
            out.append(np.unique(out[-1] * span + columns[:, c] + 1, return_inverse=True)[1])
        return out

    lefts, rights = refined(left), refined(right)
    masks = [0] * g
    for a in range(reach + 1):
        start = place - a
        own = np.flatnonzero((start >= 0) & (start < size))
        if not len(own):
            continue
        name = lefts[a][own] * g + rights[window - a][own]
        _, inverse = np.unique(name, return_inverse=True)
        total = np.bincount(inverse, weights=count[own])
        for i in own[total[inverse] > 1]:
            masks[i] |= 1 << int(start[i])
    return masks


def _masks(window: int, gram: int):
    """Rows of Classes, sorted by seed and digest, to (digest, mask)."""
    schema = pa.schema([("digest", pa.binary()), ("mask", pa.int64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int]]:
        for _, held in gathered(batches, "seed"):
            if len(held) > 1:
                classes = [(run.split(), place, windows, count) for run, place, windows, count in held.values()]
                masks = (extend_pairs if len(classes) <= FEW else extend_all)(classes, window, gram)
                yield from ((d, m) for d, m in zip(held, masks, strict=True) if m)

    return lambda batches: record_batches(found(batches), schema, 16384)


def _by_window(large: DataFrame, window: int) -> DataFrame:
    """(digest, mask) for the classes (digest, run, windows, count) of very common seeds, each window met by its own
    digest."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("digest", pa.binary()), ("at", pa.int32()), ("window", pa.binary()), ("count", pa.int64())])
        for batch in batches:
            rows = (
                (digest, at, xxhash.xxh3_128_digest(b" ".join(split[at : at + window])), count)
                for digest, words, windows, count in zip(*(batch.column(c).to_pylist() for c in ("digest", "run", "windows", "count")), strict=True)
                for split in [words.split()]
                for at in range(windows)
            )
            yield from record_batches(rows, schema)

    each = large.mapInArrow(digests, "digest binary, at int, window binary, count long")
    again = each.groupBy("window").agg(F.sum("count").alias("n")).filter("n > 1").select("window")
    bit = F.expr("shiftleft(1L, at)")
    return each.join(again, "window").groupBy("digest").agg(F.bit_or(bit).alias("mask"))


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """(__id, __text_key, __found): an array of (start, mask); window start + b of that row is repeated if bit b
    of mask is set. Rows without repeats are absent."""
    if not (1 <= gram <= window and window - gram < 63):
        raise ValueError("the windows of a seed must fit a 64-bit mask")
    keyed = row_key(docs.select("doc_id", "text")).select("__id", "__text_key", F.col("text").cast("binary"))
    suspected = suspects(keyed, ["__id", "__text_key"], "text", _seeds(window, gram), hashes_of_text(), max_filter_bits)
    asked, may_repeat = suspected.rows, suspected.test

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each run with a suspected seed; the run's words are sent once a task."""
        schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("seed", pa.int64()), ("digest", pa.binary()), ("run", pa.binary()), ("place", pa.int32()), ("windows", pa.int32())])
        sent: set[bytes] = set()
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lay in laid(texts(batch.column(2))):
                begins = np.concatenate([[0], lay.ends[:-1]])
                for first, last, place, seed in runs(lay.codes, lay.ends, window, gram):
                    hit = np.flatnonzero(may_repeat(batch, seed))
                    text = np.searchsorted(lay.ends, first[hit], side="right")
                    out = []
                    for t, a, b, p, at, s in zip(text.tolist(), first[hit].tolist(), last[hit].tolist(), place[hit].tolist(), (first[hit] - begins[text]).tolist(), seed[hit].view(np.int64).tolist(), strict=True):
                        data, digest = None, xxhash.xxh3_128_digest(b"%d %d " % (p - a, b - a) + lay.codes[a : b + window].tobytes())
                        if digest not in sent:
                            if len(sent) >= SENT:
                                sent.clear()
                            sent.add(digest)
                            data = lay.words(a, b + window)
                        out.append((ids[lay.rows[t]], keys[lay.rows[t]], at, s, digest, data, p - a, b - a + 1))
                    yield from record_batches(out, schema, 16384)

    met = stored(asked.mapInArrow(meet, "id long, key long, start int, seed long, digest binary, run binary, place int, windows int"))
    classes = classes_of(met, max_filter_bits)
    common = classes.several.filter(F.col("classes") > GROUP).select("seed")  # one in GROUP classes at most
    large, rows = not common.isEmpty(), classes.rows
    common = few(common)
    small = rows.join(common, "seed", "left_anti").select(rows.columns) if large else rows
    # dealt by a column of its own: Spark takes a join by seed for the same dealing, but may split its partitions
    dealt = small.withColumn("place_of", F.xxhash64("seed")).repartition(partitions(docs.sparkSession), "place_of").sortWithinPartitions("seed", "digest").drop("place_of")
    masks = dealt.mapInArrow(_masks(window, gram), "digest binary, mask long")
    masks = masks.unionByName(classes.alone.select("digest", F.expr("shiftleft(1L, windows) - 1").alias("mask")))
    if large:
        whole = rows.join(common, "seed", "left_semi").groupBy("digest").agg(F.first("run", ignorenulls=True).alias("run"), F.first("windows").alias("windows"), F.sum("count").alias("count"))
        masks = masks.unionByName(_by_window(whole, window))
    found = met.select("id", "key", "start", "digest").join(masks, "digest").groupBy("id", "key").agg(F.collect_list(F.struct("start", "mask")).alias("found"))
    return found.select(F.col("id").alias("__id"), F.col("key").alias("__text_key"), F.col("found").alias("__found"))


def covered(found: list[dict] | None, n: int, window: int) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    if not found:
        return np.zeros(n, bool)
    change = np.zeros(n + 1, np.int32)
    for x in found:
        mask, start = x["mask"], x["start"]
        while mask:
            low = mask & -mask
            at = start + low.bit_length() - 1
            change[at] += 1
            change[at + window] -= 1
            mask ^= low
    return np.cumsum(change[:-1]) > 0


@own_names
def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """docs with the words of repeated windows removed: `text` holds the other words joined by one space; n_words (before),
    n_removed and removed_spans (array of [first word, end)) are added, replacing columns of these names.

    A window is `window` consecutive words of one row and is repeated if its word sequence also starts anywhere else,
    in the same row or another, repeated rows included. Null and empty texts have no words; rows whose doc_id is null
    take part like others. An empty table gives an empty table.
    """
    found = repeats(docs, window, gram, max_filter_bits)
    docs = docs.drop("n_words", "n_removed", "removed_spans")
    fields = [f for f in docs.schema.fields if f.name != "text"]
    added = [T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_spans", T.ArrayType(T.ArrayType(T.IntegerType())))]
    schema = T.StructType([*fields, *added])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts, removed, spans = [], [], [], []
            for text, runs_ in zip(texts(batch.column("text")), batch.column("__found").to_pylist(), strict=True):
                words = text.split()
                gone = covered(runs_, len(words), window)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
                kept.append(b" ".join(words) if not len(edges) else b" ".join([words[i] for i in np.flatnonzero(~gone)]))
                counts.append(len(words))
                removed.append(int(gone.sum()))
                spans.append(edges.tolist())
            columns = [batch.column(f.name) for f in fields]
            columns += [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return row_key(docs).join(found, ["__id", "__text_key"], "left").mapInArrow(clean, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
windows AS (
  SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS win FROM words),
keyed AS (SELECT doc_id, i, sha256(array_to_string(win, ' ')) AS k FROM windows WHERE len(win) = 35),
repeated AS (SELECT doc_id, i FROM keyed JOIN (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1) USING (k)),
marked AS (
  SELECT words.doc_id, words.i, word,
         max(r.i) OVER (PARTITION BY words.doc_id ORDER BY words.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before
  FROM words LEFT JOIN repeated r ON r.doc_id = words.doc_id AND r.i = words.i),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE before > i - 35) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE before IS NULL OR before <= i - 35), '') AS t
  FROM marked GROUP BY doc_id)
SELECT docs.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""
