"""A data source for .npy files of raw strain: (samples, channels) arrays, one a short window, named HHMMSS*.npy.

    spark.dataSource.register(NpyDataSource)
    spark.read.format("npy").option("path", folder).option("date", "2025-01-01").option("channels", "0,50,100").load()

Each file and block of channels is a partition; only the header and the block's columns are read, and each channel is
a row (file, file_ts, channel, samples). Paths are local or mounted on all executors; for object stores, index the files
with Spark's binaryFile source and use decode_files().
"""

from __future__ import annotations

import glob
import io
import os
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, file_ts timestamp_ntz, channel int, samples array<double>"
#: Channels of a partition.
BLOCK = 512


def time_of(path: str, date: str) -> datetime:
    """The date with the HHMMSS that the file's name begins with."""
    return datetime.strptime(f"{date} {os.path.basename(path)[:6]}", "%Y-%m-%d %H%M%S")


class Block(InputPartition):
    def __init__(self, path: str, channels: list[int]):
        super().__init__((path, channels))
        self.path, self.channels = path, channels


class NpyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.date = options["date"]
        self.paths = sorted(p for d in options["path"].split(",") for p in (glob.glob(os.path.join(d, options.get("pattern", "*.npy"))) if os.path.isdir(d) else [d]))
        if not self.paths:
            raise FileNotFoundError(options["path"])
        self.channels = [int(c) for c in options["channels"].split(",")] if options.get("channels") else None

    def partitions(self) -> list[Block]:
        out = []
        for path in self.paths:
            n = np.load(path, mmap_mode="r").shape[1]
            wanted = list(range(n)) if self.channels is None else [c for c in self.channels if c < n]
            out += [Block(path, wanted[i : i + BLOCK]) for i in range(0, len(wanted), BLOCK)]
        return out

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        data = np.load(partition.path, mmap_mode="r")
        ts = time_of(partition.path, self.date)
        for i in range(0, len(partition.channels), 64):
            own = partition.channels[i : i + 64]
            columns = np.asarray(data[:, own], np.float64).T
            yield pa.RecordBatch.from_arrays(
                [pa.array([partition.path] * len(own)), pa.array([ts] * len(own), pa.timestamp("us")), pa.array(own, pa.int32()), pa.array(list(columns), pa.list_(pa.float64()))],
                names=["file", "file_ts", "channel", "samples"],
            )


class NpyDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader(dict(self.options))


def decode_files(files: DataFrame, date: str, channels: list[int] | None = None) -> DataFrame:
    """The same rows from a binaryFile table (path, content), which any file system can serve; a file a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.load(io.BytesIO(content))
                wanted = [c for c in (range(data.shape[1]) if channels is None else channels) if c < data.shape[1]]
                for i in range(0, len(wanted), 64):
                    own = wanted[i : i + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(own)), pa.array([time_of(path, date)] * len(own), pa.timestamp("us")), pa.array(own, pa.int32()), pa.array(list(np.asarray(data[:, own], np.float64).T), pa.list_(pa.float64()))],
                        names=["file", "file_ts", "channel", "samples"],
                    )

    return files.select("path", "content").mapInArrow(run, SCHEMA)
