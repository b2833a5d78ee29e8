"""Line dedup over a whole corpus with two Bloom filters.

Pass 1 hashes every line key and fills two filters, one for hashes seen once and one for hashes seen at least twice.
Pass 2 tests the keys again; only suspected repeats, those in the second filter, are shuffled. They are confirmed
exactly by their full key text, and each confirmed key keeps its lines in the smallest document id alone.

A filter never misses a repeat, so its size changes what is shuffled but never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, code_points, own_names, record_batches, row_key, table, texts
from .twice import MAX_FILTER_BITS, hashes_of_text, suspects


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line that is already lower-cased in A-Z, or None if it is shorter than min_chars code points."""
    key = line.strip()
    if len(key) < min_chars or (len(key) < 4 * min_chars and code_points(key) < min_chars):
        return None
    return key


def _keys(text: bytes, min_chars: int) -> set[bytes]:
    found = {line_key(line, min_chars) for line in text.lower().split(b"\n")}
    found.discard(None)
    return found


def repeated_lines(docs: DataFrame, min_chars: int = 10, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """(id, text_key, drop): the digests of the keys that each row of docs loses. Rows that lose none are absent. Keys are
    confirmed by their text; the digests, of 128 bits, only name confirmed keys."""

    def key_hashes(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(k) for text in texts(batch.column(0)) for k in _keys(text, min_chars)], np.uint64)

    keyed = row_key(docs.select("doc_id", "text")).select("__id", "__text_key", F.col("text").cast("binary"))
    suspected = suspects(keyed, ["__id", "__text_key"], "text", key_hashes, hashes_of_text(), max_filter_bits)
    asked, may_repeat = suspected.rows, suspected.test

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("digest", pa.binary()), ("key", pa.binary())])
        for batch in batches:
            keys, owners = [], []
            for owner, text in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), texts(batch.column(2)), strict=True):
                found = _keys(text, min_chars)
                keys += found
                owners += [owner] * len(found)
            if not keys:
                continue
            hit = may_repeat(batch, np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))
            yield from record_batches(((*owners[i], xxhash.xxh3_128_digest(keys[i]), keys[i]) for i in np.flatnonzero(hit)), schema)

    found = checkpointed(asked.mapInArrow(repeats, "id long, text_key long, digest binary, key binary"))
    confirmed = found.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.first("digest").alias("digest")).filter("first < last").select("digest", "first")
    return found.select("id", "text_key", "digest").join(confirmed, "digest").filter("id > first").groupBy("id", "text_key").agg(F.collect_set("digest").alias("drop"))


@own_names
def dedup_lines(docs: DataFrame, min_chars: int = 10, max_filter_bits: int = MAX_FILTER_BITS, counts: bool = True) -> DataFrame:
    """docs with the lines of repeated keys dropped from all but the smallest doc_id that holds the key.

    A line's key is the line without surrounding `[\\x20\\x09-\\x0D]`, A-Z lower-cased; shorter keys than min_chars code
    points never count as repeats. All columns stay; `text` holds the kept lines, and n_lines (before dropping) and
    n_dropped are added, replacing columns of these names, unless counts is false.

    Null or empty text is one empty line and gives an empty text. Rows that share a doc_id are one document; rows whose
    doc_id is null are together one document that ranks last. An empty table gives an empty table.
    """
    drop = repeated_lines(docs, min_chars, max_filter_bits).withColumnsRenamed({"id": "__id", "text_key": "__text_key", "drop": "__drop"})
    if counts:
        docs = docs.drop("n_lines", "n_dropped")
    fields = [f for f in docs.schema.fields if f.name != "text"]
    added = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())] if counts else []
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), *added])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lines_, dropped = [], [], []
            for text, drop in zip(texts(batch.column("text")), batch.column("__drop").to_pylist(), strict=True):
                lines = text.split(b"\n")
                left = lines
                if drop:
                    gone = set(drop)
                    left = [x for x in lines if (k := line_key(x.lower(), min_chars)) is None or xxhash.xxh3_128_digest(k) not in gone]
                kept.append(b"\n".join(left))
                lines_.append(len(lines))
                dropped.append(len(lines) - len(left))
            columns = [batch.column(f.name) for f in fields] + [pa.array(kept, pa.binary()).cast(pa.string())]
            columns += [pa.array(lines_, pa.int64()), pa.array(dropped, pa.int64())] if counts else []
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return row_key(docs).join(drop, ["__id", "__text_key"], "left").mapInArrow(clean, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
repeated AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)),
marked AS (
  SELECT keyed.doc_id, i, line, coalesce(keeper < keyed.doc_id, false) AS gone
  FROM keyed LEFT JOIN repeated ON keyed.k = repeated.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
