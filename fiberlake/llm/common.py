"""Helpers shared by the corpus operators: table reading, checkpoints and Arrow access to text."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document without an id ranks after every document with one.
NO_ID = (1 << 63) - 1
#: Rows with texts that Python is sent at once.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder that the cluster names in spark.checkpoint.dir; set one only where there is none, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named is None and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="fiberlake-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application, for written tables that later stages read."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Actions inside send Python at most so many rows at once; texts are long, and each batch is held on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: What operators keep in a Python worker for their next tasks. Workers outlive the operators.
KEPT: list[dict] = []


def release(kept: bool = False) -> None:
    """Return this worker's unused memory to the system; with `kept`, also what operators keep there."""
    if kept:
        for x in KEPT:
            x.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not the GNU library
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, in a worker that holds nothing of other operators and little after the task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(kept=True)
        yield from run(batches)
        release()

    return wrapped


def stored(df: DataFrame, level: int = 3) -> DataFrame:
    """df as a compressed Parquet table in the shared checkpoint folder; the table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a number or two that are broadcast (16 MB at most).
MOST_BROADCAST = 1 << 20


def few(rows: DataFrame) -> DataFrame:
    """A stored table of narrow rows, broadcast if it is counted to be small."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def own_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator of docs whose columns may have any name: those that begin with two underscores, as columns do that
    operators add for a while, have another name inside."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        inside: dict[str, str] = {}
        for c in docs.columns:
            if c.startswith("__"):
                name = "own" + c
                while name.lower() in {x.lower() for x in (*docs.columns, *inside.values())}:
                    name += "_"
                inside[c] = name
        out = operator(docs.withColumnsRenamed(inside), *args, **kwargs)
        return out.withColumnsRenamed({new: old for old, new in inside.items()})

    return run


def row_key(docs: DataFrame) -> DataFrame:
    """docs with __id and __text_key, which tell rows apart unless they share both doc_id and text."""
    return docs.withColumns({"__id": id_or_last(), "__text_key": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})


def id_or_last(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def null_if_last(column: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def texts(column: pa.Array) -> Iterator[bytes]:
    """The values of a string or binary Arrow column as UTF-8 bytes, one at a time; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from texts(chunk)
        return
    data = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary())
    for value in data:
        yield value.as_py() or b""


def code_points(data: bytes) -> int:
    """Unicode code points in valid UTF-8."""
    return len(data.decode("utf-8", "surrogatepass")) if not data.isascii() else len(data)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def power_of_two(least: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(least, 1))))


def record_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most `size` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
