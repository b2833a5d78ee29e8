"""Indexes of raw files and samples of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def modal_size(files: DataFrame, size: str = "size") -> DataFrame:
    """The files of the most frequent size, the largest of equally frequent ones."""
    counts = files.groupBy(size).agg(F.count(F.lit(1)).alias("n"))
    mode = counts.agg(F.max(F.struct("n", size)).alias("m")).select(F.col(f"m.{size}").alias("__mode"))
    return files.crossJoin(F.broadcast(mode)).filter(F.col(size) == F.col("__mode")).drop("__mode")


def index_files(spark: SparkSession, directories: list[str], date: str, pattern: str = "*.npy") -> DataFrame:
    """(file, file_ts, size) of the files of modal size; the time is the date and the HHMMSS that the name begins with.

    Only listings are read, not contents. No file at all is an error.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directories).select(F.col("path").alias("file"), F.col("length").alias("size"))
    if found.isEmpty():
        raise FileNotFoundError(f"no {pattern} in {directories}")
    time = F.regexp_extract("file", r"/(\d{6})[^/]*$", 1)
    return modal_size(found).select("file", F.to_timestamp_ntz(F.concat(F.lit(f"{date} "), time), F.lit("yyyy-MM-dd HHmmss")).alias("file_ts"), "size")


def stride_sample(files: DataFrame, cap: int, order: tuple[str, ...] = ("file_ts",), by: str = "dir") -> DataFrame:
    """Every n // cap-th file of each folder, cap at most."""
    w = Window.partitionBy(by)
    rows = files.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count(F.lit(1)).over(w)})
    stride = F.greatest(F.lit(1), F.floor(F.col("__n") / cap))
    return rows.filter((F.col("__i") % stride == 0) & (F.col("__i") / stride < cap)).drop("__i", "__n")


def head_sample(files: DataFrame, cap: int, order: tuple[str, ...] = ("file_ts",), by: str = "dir") -> DataFrame:
    """The first cap files of each folder."""
    return files.withColumn("__i", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("__i") <= cap).drop("__i")
