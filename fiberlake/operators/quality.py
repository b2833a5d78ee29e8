"""Quality of the channels of an image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import channel_stats, with_median


def persistence_score(image: DataFrame, band: float = 2.0) -> DataFrame:
    """(channel, persistence): the share of time at which a channel is within a factor of its median."""
    inside = (F.col("value") >= F.col("median") / band) & (F.col("value") <= F.col("median") * band)
    return with_median(image, "channel").groupBy("channel").agg(F.avg(inside.cast("double")).alias("persistence"))


def channel_quality(image: DataFrame, int16_bits: int | None = None) -> DataFrame:
    """channel_stats with persistence, noise_floor and good (no dropout, no saturation, persistence of 0.9)."""
    good = (F.col("dropout_frac") <= 0) & (F.col("saturation_frac") <= 0) & (F.col("persistence") >= 0.9)
    return channel_stats(image, int16_bits).join(persistence_score(image), "channel").withColumn("noise_floor", F.col("median")).withColumn("good", good)


def measure_noise(image: DataFrame, int16_bits: int | None = None) -> DataFrame:
    """(channel, noise): persistence without dropout and saturation; higher is better."""
    score = F.col("persistence") * (1 - F.col("dropout_frac")) * (1 - F.col("saturation_frac"))
    return channel_quality(image, int16_bits).select("channel", score.alias("noise"))


def select_persistent_channels(image: DataFrame, floor_quantiles: tuple[float, float] = (0.05, 0.95), min_persistence: float = 0.9, max_dropout: float = 0.0, max_saturation: float = 0.0, int16_bits: int | None = None) -> DataFrame:
    """channel_quality with keep: within the limits and with a noise floor between the quantiles of all floors, both
    included; place numbers the kept channels by falling persistence."""
    quality = channel_quality(image, int16_bits)
    edges = F.broadcast(quality.agg(F.percentile("noise_floor", F.lit(floor_quantiles[0])).alias("__low"), F.percentile("noise_floor", F.lit(floor_quantiles[1])).alias("__high")))
    keep = F.col("noise_floor").between(F.col("__low"), F.col("__high")) & (F.col("persistence") >= min_persistence) & (F.col("dropout_frac") <= max_dropout) & (F.col("saturation_frac") <= max_saturation)
    return quality.crossJoin(edges).withColumn("keep", keep).drop("__low", "__high")
