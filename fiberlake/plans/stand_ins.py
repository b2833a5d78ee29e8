"""The data model's tables, taken from the driver's tables by fixed expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import image as im
from ..operators.geo import positions_sorted

#: Time bins of the image that count as one file.
FILE = 50
#: Sample rate of the 64-sample signals.
FS = 64.0
CLASSES = ("click", "view")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def image(spark: SparkSession, sf: str) -> DataFrame:
    """Time bins are vectors, channels their components."""
    return im.from_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding")


def energy(spark: SparkSession, sf: str) -> DataFrame:
    return image(spark, sf).withColumn("value", F.col("value") * F.col("value"))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector is a signal of 64 samples."""
    samples = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", "label", samples.alias("samples"))


def waveform(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector is the samples of a channel of a file; eight vectors make a file."""
    file = F.floor(F.col("vec_id") / 8)
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=file)
    return signals(spark, sf).select(F.concat(F.lit("f"), F.lpad(file.cast("string"), 6, "0")).alias("file"), ts.alias("file_ts"), F.pmod("vec_id", F.lit(8)).cast("int").alias("channel"), "samples")


def positions(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(key.cast("int").alias("channel_id"), (F.lit(55.3) + key * F.lit(2e-5)).alias("lat"), (F.lit(11.0) + key * F.lit(1e-4)).alias("lon"))
    return positions_sorted(rows)


def ais(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        e.alias("ord"), F.col("ts").alias("Timestamp"), F.col("event_type").alias("Type of mobile"), F.col("user_id").alias("MMSI"), F.col("value").alias("SOG"),
        (F.lit(55.3) + F.pmod(e * 37, F.lit(1000)) / F.lit(10000.0)).alias("Latitude"), (F.lit(11.0) + F.pmod(e * 61, F.lit(1000)) / F.lit(10000.0)).alias("Longitude"),
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    """A file starts at every event."""
    return table(spark, sf, "events").select(F.col("event_id").alias("file"), F.col("ts").alias("file_ts"))
