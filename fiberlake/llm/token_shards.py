"""Training-order token shards.

The documents' token ids, an end token after each, are one stream, cut into sequences of a fixed length. A keyed Feistel
permutation with cycle-walking gives sequence number s its global slot, so the training order is a function of the key
and the number of sequences and needs no sort of random numbers. Shard k holds the slots
[k * per_shard, (k + 1) * per_shard) as records of a fixed stride: record r of shard k starts at byte r * stride. A
reader takes up training at any slot by one seek.

A record is `length` little-endian ids and the MARK. Shards are written by Spark's own writer, one folder a shard with
one file, so a lost executor or a second attempt leaves no half shard and any file system that Spark knows will do.

Texts are encoded once, into a staged table whose rows know their place in their task's part of the stream; the parts'
totals, one number a task, place the parts. Only pieces of sequences are shuffled: a task gathers those of one range of
slots, some whole shards of RANGE_BYTES together, and packs them. The task of a range lays the pieces where they belong,
so nothing is sorted, and its memory is that of the range, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Shared, Tokenizer, default_path
from .common import record_batches, shared_folder, small_batches, stored, table, texts

#: Ends each record, as Spark's text writer ends each row.
MARK = "\n"
ROUNDS = 6
#: Records that one task puts together.
RANGE_BYTES = 16 << 20
#: Pieces that a task gathers before it packs them.
GATHERED = 8 << 20
LEVEL = 6


class Feistel:
    """A permutation of 0 .. n-1 for each key."""

    def __init__(self, n: int, key: int):
        self.n, self.half = n, max(1, math.ceil(max(1, (n - 1).bit_length()) / 2))
        self.low = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(xxhash.xxh3_64_intdigest(f"{key} {r}".encode())) for r in range(ROUNDS)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x ^ key) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
        return (x ^ x >> np.uint64(32)) & self.low

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        half = np.uint64(self.half)
        a, b = x >> half, x & self.low
        for key in reversed(self.keys) if back else self.keys:
            a, b = (b ^ self._mix(a, key), a) if back else (b, a ^ self._mix(b, key))
        return a << half | b

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), back)
        while len(far := np.flatnonzero(out >= self.n)):  # walk the cycle back into the domain
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, False)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


@dataclass(frozen=True)
class Layout:
    """What a reader needs to know."""

    tokens: int
    sequences: int
    length: int
    per_shard: int
    width: int
    end_id: int
    key: int

    @property
    def stride(self) -> int:
        return self.length * self.width + len(MARK)

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.per_shard)

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(f"<u{self.width}")


class ByteBpe:
    """A byte-level BPE vocabulary of ranks (one `base64 rank` a line), with the first free id as the end token."""

    def __init__(self, lines: str):
        import base64

        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line)}
        self.coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end_id = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2" if self.end_id < 65536 else "<u4")

    def encode_bytes(self, text: str) -> bytes:
        return np.array(self.coder.encode_ordinary(text), self.dtype).tobytes()


_made: dict[str, ByteBpe] = {}


class Vocabulary:
    """A vocabulary file for executors: its text is broadcast (a few MB), each Python worker compiles it once. A JSON file
    is the tokenization automaton of bpe.py, and compiled for it too; others are ranks."""

    def __init__(self, spark: SparkSession, path: str):
        self.words = Shared(spark, path) if path.endswith(".json") else None
        if self.words is None:
            with open(path, encoding="utf-8") as file:
                text = file.read()
            self.key = hashlib.sha256(text.encode()).hexdigest()
            self.text = spark.sparkContext.broadcast(text)

    def get(self) -> ByteBpe | Tokenizer:
        if self.words is not None:
            return self.words.get()
        if self.key not in _made:
            _made[self.key] = ByteBpe(self.text.value)
        return _made[self.key]


def _staged(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(task, at, doc_id, ids): ids of a row and the end token, and their place in the task's part of the stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.get()
        end, at = np.array([v.end_id], v.dtype).tobytes(), 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                ids = [v.encode_bytes(x.decode("utf-8", "replace")) + end for x in texts(part.column(1))]
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // v.dtype.itemsize
                places = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array([task] * len(ids), pa.int32()), pa.array(places), pa.array(n), part.column(0), pa.array(ids, pa.binary())], names=["task", "at", "n", "doc_id", "ids"])

    schema = T.StructType([T.StructField("task", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType()), docs.schema["doc_id"], T.StructField("ids", T.BinaryType())])
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, schema)


def write_shards(docs: DataFrame, path: str, length: int = 1024, per_shard: int = 8192, key: int = 0, vocabulary: str | None = None) -> Layout:
    """Write the shards of docs under path/shards, the layout as JSON under path/layout, and under path/documents where
    each document stands in the stream (doc_id, first, n_tokens); return the layout.

    The stream has the documents in the order of the scan. Rows without an id take part, repeated rows each count, null
    and empty texts are an end token alone. The last sequence is filled up with end tokens. An empty table writes no
    shard.
    """
    spark = docs.sparkSession
    shared = Vocabulary(spark, vocabulary or default_path())
    end_id, dtype = shared.get().end_id, shared.get().dtype
    rows = stored(_staged(docs, shared), LEVEL)
    begins, tokens = {}, 0
    for r in rows.groupBy("task").agg(F.sum("n").alias("n")).orderBy("task").collect():  # a row a task
        begins[r.task], tokens = tokens, tokens + r.n
    base = spark.sparkContext.broadcast(begins)
    layout = Layout(tokens, -(-tokens // length), length, per_shard, dtype.itemsize, end_id, key)
    permutation, width = Feistel(max(1, layout.sequences), key), dtype.itemsize

    each = max(1, RANGE_BYTES // (per_shard * layout.stride))  # shards of a range
    span, most = each * per_shard, GATHERED

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("range", pa.int64()), ("pieces", pa.binary())])
        press = zstandard.ZstdCompressor(level=LEVEL).compress
        held: dict[int, list] = {}
        size = 0

        def packed() -> Iterator[tuple[int, bytes]]:
            for r, pieces in held.items():
                rows, places, data = zip(*pieces, strict=True)
                numbers = np.array([rows, places, [len(x) // width for x in data]], "<u4")
                yield r, press(b"".join([len(pieces).to_bytes(4, "little"), numbers.tobytes(), *data]))
            held.clear()

        for batch in batches:
            at = np.array([base.value[t] for t in batch.column(0).to_pylist()], np.int64) + batch.column(1).to_numpy()
            n, first = batch.column(2).to_numpy(), at // length
            counts = (at + n - 1) // length - first + 1
            doc = np.repeat(np.arange(len(at)), counts)
            sequence = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            slot, begin = permutation.slot(sequence), at[doc] - sequence * length
            numbers = zip(doc.tolist(), (slot // span).tolist(), (slot % span).tolist(), np.maximum(begin, 0).tolist(), np.maximum(-begin * width, 0).tolist(), ((length - begin) * width).tolist(), strict=True)
            row = -1
            for d, r, s, place, low, high in numbers:
                if d != row:
                    row, data = d, batch.column(3)[d].as_py()
                    size += len(data)
                    if size >= most:
                        yield from record_batches(packed(), schema, 64)
                        size = len(data)
                held.setdefault(r, []).append((s, place, data[low:high]))
        yield from record_batches(packed(), schema, 64)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), ("record", pa.binary())])
        open_ = zstandard.ZstdDecompressor().decompress
        now, records = None, np.zeros((0, length), dtype)

        def rows() -> Iterator[pa.RecordBatch]:
            begin = 0 if now is None else now * span
            return record_batches(((s // per_shard, s, records[s - begin].tobytes()) for s in range(begin, begin + len(records))), schema, 1024)

        for batch in batches:
            for r, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if r != now:
                    yield from rows()
                    now, records = r, np.full((min(span, layout.sequences - r * span), length), end_id, dtype)
                data = open_(data.as_buffer())
                count = int.from_bytes(data[:4], "little")
                numbers = np.frombuffer(data, "<u4", 3 * count, 4).reshape(3, count)
                ids = np.frombuffer(data, dtype, -1, 4 + numbers.nbytes)
                ends = np.cumsum(numbers[2], dtype=np.int64).tolist()
                for row, place, size, end in zip(*numbers.tolist(), ends, strict=True):
                    records[row, place : place + size] = ids[end - size : end]
        yield from rows()

    if layout.sequences:
        pieces = rows.select("task", "at", "n", "ids").mapInArrow(cut, "range long, pieces binary")
        dealt = pieces.repartitionById(-(-layout.sequences // span), F.col("range").cast("int"))
        records = dealt.mapInArrow(joined, "shard long, slot long, record binary").sortWithinPartitions("shard", "slot")
        with small_batches(spark):
            records.select("shard", F.col("record").cast("string").alias("value")).write.mode("overwrite").option("lineSep", MARK).partitionBy("shard").text(f"{path}/shards")
    offsets = spark.createDataFrame(list(begins.items()) or [(0, 0)], "task int, base long")
    rows.join(offsets, "task").select("doc_id", (F.col("base") + F.col("at")).alias("first"), F.col("n").alias("n_tokens")).write.mode("overwrite").parquet(f"{path}/documents")
    spark.createDataFrame([asdict(layout)], LAYOUT).coalesce(1).write.mode("overwrite").json(f"{path}/layout")
    return layout


LAYOUT = "tokens long, sequences long, length long, per_shard long, width long, end_id long, key long"


def read_layout(spark: SparkSession, path: str) -> Layout:
    return Layout(**spark.read.schema(LAYOUT).json(f"{path}/layout").first().asDict())


def read_shards(spark: SparkSession, path: str, layout: Layout | None = None, first_slot: int = 0) -> DataFrame:
    """(shard, slot, ids): the records from first_slot on; shards before it are not opened. Records are cut where the
    file is read, by expressions alone."""
    layout = layout or read_layout(spark, path)
    if first_slot >= layout.sequences:
        return spark.createDataFrame([], "shard long, slot long, ids binary")
    stride, per_shard = layout.stride, layout.per_shard
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards")
    shard, size = F.col("shard").cast("long").alias("shard"), F.length("content")
    broken = F.raise_error(F.concat(F.lit("a shard ends within a record: "), F.col("shard").cast("string")))
    whole = F.when(size % stride == 0, size / stride).otherwise(broken).cast("int")
    begin = F.greatest(F.lit(first_slot).cast("long") - F.col("shard") * per_shard, F.lit(0)).cast("int")
    files = files.filter(F.col("shard") >= first_slot // per_shard).select(shard, "content", F.explode(F.sequence(begin, whole - 1)).alias("record"))
    ids = F.substring("content", F.col("record") * stride + 1, F.lit(layout.length * layout.width))
    return files.select("shard", (F.col("shard") * per_shard + F.col("record")).alias("slot"), ids.alias("ids"))


def sequence_of(slot: F.Column, layout: Layout) -> F.Column:
    """The number in the stream of the sequence at a slot."""
    permutation = Feistel(max(1, layout.sequences), layout.key)

    @F.arrow_udf("long")
    def run(slots: pa.Array) -> pa.Array:
        return pa.array(permutation.sequence(slots.to_numpy(zero_copy_only=False)))

    return run(slot)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that were written, read again: slot, shard, sequence and a digest of the ids as they are stored."""
    import public_tokenizers

    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    layout = write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), path, key=2024, vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    records = read_shards(spark, path, layout).select("slot", "shard", F.sha2("ids", 256).alias("ids_sha256"))
    return records.withColumn("sequence", sequence_of(F.col("slot"), layout))
