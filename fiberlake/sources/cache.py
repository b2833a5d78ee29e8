"""Computed images kept as Parquet, and used again while they still fit their files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "tag string, n_files long, state long"


def file_state(files: DataFrame) -> tuple[int, int]:
    """(number of files, a sum over their names and sizes) of an index (file, size)."""
    row = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("file", "size").bitwiseAND(F.lit((1 << 40) - 1).cast("long"))).alias("s")).first()
    return row.n, row.s or 0


def cached(spark: SparkSession, path: str, tag: str, files: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
    """make(), or what an earlier call wrote under path with the same tag (the reducer, band and so on) for files of the
    same names and sizes. The manifest is written last, so a broken write is made again."""
    n, state = file_state(files)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    manifest = f"{path}/manifest"
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{manifest}/_SUCCESS")):
        row = spark.read.schema(MANIFEST).json(manifest).first()
        if row is not None and (row.tag, row.n_files, row.state) == (tag, n, state):
            return spark.read.parquet(f"{path}/image")
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(manifest), True)
    make().write.mode("overwrite").parquet(f"{path}/image")
    spark.createDataFrame([(tag, n, state)], MANIFEST).coalesce(1).write.mode("overwrite").json(manifest)
    return spark.read.parquet(f"{path}/image")
